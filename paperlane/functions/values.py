"""Parsers and validators of field values, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import search_text


def is_empty(value: Column) -> Column:
    """Null, blank or a placeholder."""
    return value.isNull() | (F.trim(value) == "") | F.lower(F.trim(value)).isin(P.PLACEHOLDERS)


def evidence_invalid(evidence: Column) -> Column:
    return evidence.isNull() | (F.trim(evidence) == "") | F.lower(evidence).rlike(P.NO_EVIDENCE)


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def in_evidence(value: Column, normalized: Column, evidence: Column) -> Column:
    """Whether the value or its normal form occurs in the evidence, as it stands or without punctuation."""
    e = F.coalesce(evidence, F.lit(""))
    bare = lambda v: F.transform(F.array(compact(v)), lambda c: (c != "") & compact(e).contains(c))[0]
    one = lambda v: F.when(is_empty(v), False).when(F.lower(e).contains(F.lower(F.trim(v))), True).otherwise(bare(v))
    return F.coalesce(one(value), F.lit(False)) | F.coalesce(F.when(normalized != value, one(normalized)), F.lit(False))


def _bare_number(value: Column) -> Column:
    """Without blanks, and without what stands around the digits."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", ""), r"^[^\d+-]+|[^\d]+$", "")


def number(value: Column) -> Column:
    """A human number as digits with a point; null for letters, dates and codes. 1.500 is 1500, 1.5 stays."""
    return _number(value, _bare_number(value))


def _number(value: Column, c: Column) -> Column:
    t = F.trim(value)
    dots, comma = c.contains("."), c.contains(",")
    out = F.when(c.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"), F.replace(c, F.lit("."), F.lit(""))).when(comma & dots, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma, F.replace(c, F.lit(","), F.lit("."))).otherwise(c)
    ok = ~t.rlike("[A-Za-z]") & ~t.rlike(r"\d+[/-]\d+") & out.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(ok, out)


def iban_valid(value: Column) -> Column:
    """Form and check digits (remainder 1 modulo 97)."""
    v = F.regexp_replace(F.upper(value), r"[\s-]", "")
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    digit = lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)
    digits = F.array_join(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), digit), "")
    rest = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.try_cast("int")) % 97)
    ok = F.length(v).between(15, 34) & v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$")
    return F.coalesce(F.when(ok, rest == 1), F.lit(False))


def iso_date(value: Column) -> Column:
    """A date at the start of the value, in any of three forms, as yyyy-mm-dd; null if it is no real day."""
    t = F.trim(value)
    g = lambda p, *order: F.when(t.rlike("^" + p), F.concat_ws("-", *[F.regexp_extract(t, "^" + p, k) for k in order]))
    forms = [g(r"(\d{4})-(\d{2})-(\d{2})", 1, 2, 3), g(r"(\d{2})-(\d{2})-(\d{4})", 3, 2, 1), g(r"(\d{2})/(\d{2})/(\d{4})", 3, 2, 1)]
    return F.coalesce(*[F.when(F.try_to_date(f, "yyyy-MM-dd").isNotNull(), f) for f in forms])


def first_amount(value: Column) -> Column:
    """The first number once commas are points: 1.234,56 gives 1.234."""
    t = F.replace(F.regexp_replace(F.trim(value), r"[€$£\s]", ""), F.lit(","), F.lit("."))
    return F.regexp_extract(t, r"(\d+\.?\d*)", 1).try_cast("double")


def rule_amount(value: Column) -> Column:
    """The fraud rules' amount, whose points are dropped: 3.5 gives 35."""
    return F.replace(F.regexp_replace(value, r"[€$£\s.]", ""), F.lit(","), F.lit(".")).try_cast("double")


def naive_amount(value: Column) -> Column:
    """The totals' amount: 1.234,56 fails."""
    return F.trim(F.replace(F.replace(value, F.lit(","), F.lit(".")), F.lit("€"), F.lit(""))).try_cast("double")


def shown_amount(value: Column) -> Column:
    """The user interface's amount: the last of point and comma is the decimal sign if one or two digits follow it."""
    c = F.regexp_replace(value, r"[^\d.,-]", "")
    dot, comma = F.length(c) - F.instr(F.reverse(c), "."), F.length(c) - F.instr(F.reverse(c), ",")
    has_dot, has_comma = c.contains("."), c.contains(",")
    bare = lambda s: F.replace(c, F.lit(s), F.lit(""))
    both = F.when(comma > dot, F.replace(bare("."), F.lit(","), F.lit("."))).otherwise(bare(","))
    return F.when(has_dot & has_comma, both).when(has_comma, F.when(c.rlike(r",\d{1,2}$"), F.replace(c, F.lit(","), F.lit("."))).otherwise(bare(","))).when(has_dot & ~c.rlike(r"\.\d{1,2}$"), bare(".")).otherwise(c).try_cast("double")


def grouped_iban(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"\s+", ""), "(.{4})", "$1 "))


def currency(value: Column, quotes: Column) -> Column:
    """The currency of the sign found in the value, else in the quotes, else euro."""
    of = lambda t: F.when(t.contains("$"), "USD").when(t.contains("£"), "GBP").when(t.contains("¥"), "JPY").when(t.contains("€"), "EUR")
    return F.coalesce(of(value), of(quotes), F.lit("EUR"))


def rule_date(value: Column) -> Column:
    """The fraud rules' date: day-month-year with one or two digits, slashes, year first, two-digit year."""
    t = F.trim(value)
    long_ = lambda p, f: F.when(t.rlike(p), F.try_to_date(t, f))
    return F.coalesce(long_(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), long_(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), long_(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), long_(r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"))


AREA_WORDS = ("m2", "sqm", "area", "oppervlakte", "vloeroppervlak", "gebruiksoppervlakte")


def field_kind(field_type: Column, key: Column, label: Column) -> Column:
    """The kind by which a field's values are checked."""
    t, n = F.lower(F.coalesce(field_type, F.lit("text"))), search_text(F.concat_ws(" ", key, label))
    year = F.arrays_overlap(F.split(n, " "), F.array(F.lit("jaar"), F.lit("year"))) | n.contains("bouwjaar")
    return F.when(t.isin("boolean", "bool"), "boolean").when(t == "enum", "enum").when(t == "date", "date").when(year, "year").when(n.rlike("|".join(AREA_WORDS)), "area").when(t == "number", "number").when(t == "iban", "iban").otherwise("string")


def label_context(key: Column, label: Column, evidence: Column) -> Column:
    """Whether the evidence has the field's label or key, or two label words within ten words."""
    texts = F.array(F.struct(search_text(evidence).alias("e"), search_text(label).alias("l"), search_text(key).alias("k")))

    def found(x: Column) -> Column:
        e, l, k = x["e"], x["l"], x["k"]
        at = F.transform(F.filter(F.split(l, " "), lambda w: F.length(w) >= 2), lambda w: F.array_position(F.split(e, " "), w))
        near = F.transform(F.array(at), lambda p: (F.size(p) >= 2) & (F.array_min(p) > 0) & (F.array_max(p) - F.array_min(p) <= 10))[0]
        return F.when(e == "", False).when((l != "") & e.contains(l), True).when((k != "") & e.contains(k), True).otherwise(near)

    # Bound to a name, so that each text is normalised once.
    return F.transform(texts, found)[0]


def _near(evidence: Column, value: Column, words: tuple, distance: int) -> Column:
    v = F.instr(evidence, value)
    out = F.lit(False)
    for w in words:
        p = F.instr(evidence, w)
        out = out | ((p > 0) & (F.abs(v - p) <= distance))
    return (v > 0) & out


def pattern_match(value: Column, pattern: str) -> Column:
    """The part of a value that matches a pattern; where none does, that which matches it without its anchors; null without either."""
    free = pattern.removeprefix("^").removesuffix("$")
    return F.coalesce(F.regexp_substr(value, F.lit(pattern)), F.regexp_substr(value, F.lit(free)))


YEAR_CLASHES = (("year_evidence_has_date_label", ("datum", "date"), 30), ("year_evidence_has_document_number_label", ("documentnummer", "document number", "nummer", "number", "reference", "referentie", "id"), 35))


def kind_reason(kind: str, v: Column, e: Column, unit: Column, year: int) -> Column:
    """Why a trimmed value is no year or area, beside its evidence in search_text() form; null if it may be."""
    post = e.rlike(r"\b\d{4}\s?[a-z]{2}\b")
    if kind == "year":
        y = v.try_cast("int")
        (by_date, date_words, date_near), (by_number, number_words, number_near) = YEAR_CLASHES
        return F.when(v.rlike(r"\d+[/-]\d+"), "year_value_looks_like_date").when(~v.rlike(r"^\d{4}$"), "year_must_be_four_digits").when((y < 1600) | (y > year + 1), "year_out_of_range").when(_near(e, v, date_words, date_near), by_date).when(post, "year_evidence_has_postcode").when(_near(e, v, number_words, number_near), by_number)
    return F.when(number(v).isNull(), "area_not_numeric").when(e.rlike("eur|euro|amount|bedrag|prijs|price"), "area_looks_like_amount").when(F.length(F.regexp_replace(v, r"\D", "")) >= 7, "area_looks_like_phone_or_document_number").when(post, "area_evidence_has_postcode").when(~F.concat_ws(" ", e, search_text(unit)).rlike("|".join(AREA_WORDS)), "area_missing_unit_or_context")


def only(rows: DataFrame, keep: Column, *columns: str) -> DataFrame:
    """The columns of rows for which a condition holds.

    Spark moves a plain filter below the columns that it reads, and works each of them out again
    wherever the condition or another column needs it. It does not move one into a generator.
    """
    return rows.select(F.inline(F.when(keep, F.array(F.struct(*columns)))))


def checked(rows: DataFrame, kind: Column, value: Column, evidence: Column, unit: Column, enum_values: Column, year: int, pattern: Column | None = None) -> DataFrame:
    """Adds check_reason, the first check of the value's kind that fails, and check_normalized, its normal form. year: the present one.

    pattern: what a sound value must hold, whatever the case. A null pattern asks for nothing.
    What several checks need is a column first, so that it is worked out once for a row. The long
    checks are bound to a name, so that Spark makes no method of them that Java leaves uncompiled.
    """
    d = rows.withColumns({"_kind": kind, "_value": value, "_v": F.trim(value), "_low": F.lower(F.trim(value)), "_e": search_text(evidence), "_unit": unit, "_enum": enum_values, "_pattern": F.lit(None).cast("string") if pattern is None else pattern})
    kind, v, e, low = F.col("_kind"), F.col("_v"), F.col("_e"), F.col("_low")
    numeric = kind.isin("number", "area")
    d = d.withColumn("_bare", F.when(numeric, _bare_number(v))).withColumn("_n", F.when(numeric, _number(v, F.col("_bare"))))
    n = F.col("_n")
    year_reason, area_reason = (F.transform(F.array(e), lambda x: kind_reason(k, v, x, F.col("_unit"), year))[0] for k in ("year", "area"))  # noqa: B023
    enum_bad = (F.size("_enum") > 0) & ~F.exists("_enum", lambda x: F.lower(F.trim(x)) == low)
    yes, no = low.isin("true", "yes", "ja", "waar", "1"), low.isin("false", "no", "nee", "onwaar", "0")
    reason = F.when(is_empty(F.col("_value")), "empty_or_placeholder_value").when(kind == "year", year_reason).when((kind == "number") & n.isNull(), "number_invalid").when(kind == "area", area_reason).when((kind == "enum") & enum_bad, "enum_value_not_allowed").when((kind == "boolean") & ~yes & ~no, "boolean_not_explicit").when((kind == "date") & iso_date(v).isNull(), "date_invalid").when((kind == "iban") & ~iban_valid(v), "iban_invalid")
    d = d.withColumn("check_reason", reason)
    mismatch = F.col("_pattern").isNotNull() & (F.col("_pattern") != "") & ~F.coalesce(F.regexp(v, F.concat(F.lit("(?i)"), F.col("_pattern"))), F.lit(True))
    d = d.withColumn("check_reason", F.coalesce("check_reason", F.when(mismatch, "regex_mismatch")))
    normal = F.when(kind.isin("number", "area"), n).when(kind == "boolean", yes.cast("string")).otherwise(v)
    d = d.withColumn("check_normalized", F.when(F.col("check_reason").isNull(), normal))
    return d.drop("_kind", "_value", "_v", "_low", "_e", "_unit", "_enum", "_pattern", "_bare", "_n")
