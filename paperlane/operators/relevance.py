"""Which chunks of a document speak of which fields: search terms, label places, values near them, scores and selection.

Fields are a short list of settings (Field) known to the driver; chunks are the table. Scores are
column expressions over a chunk, so nothing is shuffled until chunks of a document are compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import values as V
from ..functions.text import java_pattern, plain, search_text


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    field_type: str = "string"
    enum_values: tuple = ()
    regex: str | None = None
    required: bool = False


NUMBER = r"\b\d{1,5}(?:[.,]\d{1,3})?\b"
MATCH = "struct<field: string, score: int, label_score: int, value_score: int, labelled: boolean, regex_only: boolean, places: array<int>>"


def search_terms(key: Column, label: Column) -> Column:
    """The terms by which a field is searched, the longest first: key, label, label without brackets, and the synonyms they call for."""
    own = F.array_distinct(F.filter(F.array(search_text(key), search_text(label), search_text(F.regexp_replace(label, r"\([^)]*\)", " "))), lambda t: t != ""))

    def more(terms: Column) -> Column:
        joined = F.array_join(terms, " ")
        groups = [F.when(joined.rlike("|".join(map(re.escape, called))), F.array(*map(F.lit, given))).otherwise(F.array().cast("array<string>")) for called, given in P.SYNONYMS]
        return F.array_distinct(F.concat(terms, *groups))

    every = F.transform(F.array(own), more)[0]
    ordered = F.array_sort(F.transform(every, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ordered, lambda x: x["t"])


def terms_of(field: Field) -> list[str]:
    """search_terms() of a setting."""
    own = {t for t in map(plain, (field.key, field.label, re.sub(r"\([^)]*\)", " ", field.label))) if t}
    joined = " ".join(own)
    for called, given in P.SYNONYMS:
        if any(c in joined for c in called):
            own.update(given)
    return sorted(own, key=lambda t: (-len(t), t))


def place_pattern(labels: list[str]) -> list[str]:
    """A pattern for each label of at least two letters or digits: its words with any blanks between, at word edges."""
    kept = {x.lower() if x.isascii() else x: x for x in map(str.strip, labels) if len(plain(x)) >= 2}.values()  # case makes no other pattern
    return list(dict.fromkeys("(?i)\\b" + "\\s+".join(re.sub(r"([^\w])", r"\\\1", w) for w in re.split(r"[\s_\-]+", x) if w) + "\\b" for x in kept))


def places(text: Column, patterns: list[str]) -> Column:
    """Offsets in characters at which any of the patterns matches, ascending."""

    def of(pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(F.translate(text, "\u0001", "\u0002"), pattern, "\u0001$0"), "\u0001")
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
        ends = lambda a, x: F.struct((a["n"] + F.length(x)).alias("n"), F.array_append(a["at"], a["n"] + F.length(x)).alias("at"))
        return F.aggregate(pieces, start, ends, lambda a: F.slice(a["at"], 1, F.size(a["at"]) - 1))

    return of(patterns[0]) if len(patterns) == 1 else F.array_sort(F.array_distinct(F.concat(*[of(p) for p in patterns])))


def near_values(text: Column, place: Column, field: Field, year: int, before: int = 120, after: int = 300) -> Column:
    """Values of the field's kind around a place: allowed values, yes or no, what follows a colon or dash, or sound numbers."""
    start = F.greatest(F.lit(0), place - before)
    window = F.substr(text, start + 1, place + after - start)
    kind = _kind(field)
    if kind == "enum" and field.enum_values:
        return F.transform(F.array(search_text(window)), lambda w: F.filter(F.array(*map(F.lit, field.enum_values)), lambda v: w.contains(search_text(v)) & (search_text(v) != "")))[0]
    if kind == "boolean":
        return F.regexp_extract_all(window, F.lit(r"(?i)\b(true|false|yes|no|ja|nee)\b"), F.lit(0))
    if kind == "string":
        v = F.trim(F.regexp_extract(window, r"[:\-]\s*([^\n:;\-]{1,80})", 1))
        return F.transform(F.array(v), lambda x: F.when((x != "") & (F.regexp_count(x, F.lit(r"\s+")) < 8), F.array(x)).otherwise(F.array().cast("array<string>")))[0]
    numbers = F.regexp_extract_all(window, F.lit(NUMBER), F.lit(0))
    if kind == "number":
        return F.transform(numbers, V.number)
    if kind in ("year", "area"):
        return F.transform(F.array(search_text(window)), lambda e: F.filter(numbers, lambda v: V.kind_reason(kind, v, e, F.lit(""), year).isNull()))[0]
    return F.array().cast("array<string>")  # a number is no date and no account


def _kind(field: Field) -> str:
    """V.field_kind() of a setting."""
    t, n = field.field_type.lower(), plain(f"{field.key} {field.label}")
    if t in ("boolean", "bool", "enum", "date"):
        return "boolean" if t == "bool" else t
    if {"jaar", "year"} & set(n.split()) or "bouwjaar" in n:
        return "year"
    if any(w in n for w in V.AREA_WORDS):
        return "area"
    return t if t in ("number", "iban") else "string"


def _words_near(text: Column, words: list[str], window: int = 10) -> Column:
    if len(words) < 2:
        return F.lit(False)
    at = F.transform(F.array(F.split(text, " ")), lambda t: F.array(*[F.array_position(t, w) for w in words]))[0]
    return F.transform(F.array(at), lambda p: (F.array_min(p) > 0) & (F.array_max(p) - F.array_min(p) <= window))[0]


def _names(field: Field) -> list[str]:
    """All that a field may be called in a chunk."""
    return [field.label, field.key, re.sub(r"\([^)]*\)", " ", field.label), *terms_of(field)]


def _valued(text: Column, place: Column, field: Field, year: int) -> Column:
    """Whether near_values() has any."""
    if _kind(field) == "number":
        start = F.greatest(F.lit(0), place - 120)
        return F.substr(text, start + 1, place + 300 - start).rlike(NUMBER)
    return F.size(near_values(text, place, field, year)) > 0


def _named(field: Field, raw: Column, norm: Column) -> dict[str, Column]:
    """What a field's names tell of a chunk: points, whether it is labelled, whether its key or its pattern occurs, and the names' places."""
    label, key = plain(field.label), plain(field.key)
    words = lambda x: [w for w in x.split() if len(w) >= 2]
    has = lambda t: F.contains(norm, F.lit(t)) if t else F.lit(False)
    exact = has(label)
    term = F.lit(False)
    for t in terms_of(field):
        term = term | has(plain(t) if t in map(plain, (field.key, field.label)) else t)
    near = _words_near(norm, words(label))
    key_hit = (has(key) | _words_near(norm, words(key))) if key else F.lit(False)
    pattern = java_pattern(field.regex) if field.regex else None
    # Where a name stands as it is written, it stands in the normal form too, which is quicker to search.
    patterns, written, none = place_pattern(_names(field)), F.lit(False), F.array().cast("array<int>")
    for t in dict.fromkeys(plain(x) for x in _names(field) if len(plain(x)) >= 2):
        written = written | has(t)
    return {
        "base": F.when(exact, 100).otherwise(F.when(term, 30).otherwise(0) + F.when(near, 70).otherwise(0)) + F.when(key_hit, 50).otherwise(0),
        "labelled": exact | term | near,
        "keyed": has(key),
        "regex": raw.rlike("(?i)" + pattern) if pattern else F.lit(False),
        "places": F.when(written, places(raw, patterns)).otherwise(none) if patterns else none,
    }


def _match(field: Field, x: Callable[[str], Column]) -> Column:
    """The points of one field in a chunk by what _named() and _valued() told; null if it has none."""
    label_score = x("base") + F.when(x("labelled") & ~x("value"), 20).otherwise(0)
    value_score = F.when(x("regex"), 5).otherwise(0) + F.when(x("value"), 120).otherwise(0)
    only = x("regex") & ~x("labelled") & ~x("keyed")
    m = F.struct(F.lit(field.key).alias("field"), (label_score + value_score).alias("score"), label_score.alias("label_score"), value_score.alias("value_score"), x("labelled").alias("labelled"), only.alias("regex_only"), x("places").alias("places"))
    return F.when(label_score + value_score > 0, m.cast(MATCH))


def scored(chunks: DataFrame, fields: list[Field], year: int, chunk: str = "chunk") -> DataFrame:
    """Adds to chunks their score and matches, the points of each field that has any.

    What is used more than once is a column first, so that it is worked out once for a chunk.
    """
    d = chunks.withColumn("_norm", search_text(F.col(chunk)))
    raw, norm = F.col(chunk), F.col("_norm")
    of = [lambda k, i=i: F.col(f"_{k}{i}") for i in range(len(fields))]
    told = {f"_{k}{i}": c for i, f in enumerate(fields) for k, c in _named(f, raw, norm).items()}
    d = d.withColumns(told | {"_numbers": F.regexp_count(raw, F.lit(r"\b\d+(?:[.,]\d+)?\b")), "_length": F.length("_norm")})
    at = lambda x: F.when(F.size(x("places")) > 0, x("places")).otherwise(F.array(F.lit(0)))
    d = d.withColumns({f"_value{i}": x("labelled") & F.exists(at(x), lambda p: _valued(raw, p, f, year)) for i, (f, x) in enumerate(zip(fields, of, strict=True))})  # noqa: B023
    d = d.withColumn("matches", F.array_compact(F.array(*[_match(f, x) for f, x in zip(fields, of, strict=True)])))
    m, n = F.col("matches"), F.size("matches")
    numbers, length = F.col("_numbers"), F.col("_length")
    rich = F.size(F.filter(m, lambda x: x["value_score"] > 0))
    weak = F.size(F.filter(m, lambda x: ~x["labelled"] | (x["score"] < 70)))
    rules = (
        (length < 50, -20),
        (norm.rlike("|".join(P.GENERIC_SECTIONS)), -50),
        ((numbers >= 12) & (n <= 1), -40),
        ((numbers >= 20) & (n <= 2), -40),
        ((n > 0) & (numbers == 0) & norm.rlike(P.EXPLANATION), -60),
        ((n >= 2) & (rich >= 2), 150),
        ((length > 2500) & (n == 1) & (weak == 1), -30),
        (n > 1, 20),
    )
    total = F.aggregate(m, F.lit(0), lambda a, x: a + x["score"])
    for when, points in rules:
        total = total + F.when(when, points).otherwise(0)
    return d.withColumn("score", total).select(*chunks.columns, "matches", "score")


def same_line(lines: DataFrame, fields: list[Field], year: int, text: str = "t") -> DataFrame:
    """Values that follow a field's label and a colon or dash on its line: the lines' columns, field, value, confidence and evidence_type.

    A value ends where another label begins, has 60 characters and six words at most, is sound for
    its field's kind, and holds its field's pattern.
    """
    bare = lambda f: "|".join(p.removeprefix("(?i)") for p in place_pattern([f.label, f.key, *terms_of(f)]))
    next_ = "(?is)(?:" + "|".join(bare(f) for f in fields) + r")\s*[:\-].*"
    d, found = lines, []
    for i, f in enumerate(fields):
        after = F.regexp_extract(text, rf"(?i)(?:{bare(f)})\s*[:\-]\s*(.+)$", 1)
        # Bound to a name, so that each field's part is compiled on its own.
        d = d.withColumn("_said", F.transform(F.array(after), lambda a: F.regexp_replace(F.regexp_replace(a, next_, ""), r"^[ :;\-]+|[ :;\-]+$", ""))[0])
        fits = (F.col("_said") != "") & (F.length("_said") <= 60) & (F.regexp_count("_said", F.lit(r"\s+")) < 6)
        enum = F.array(*map(F.lit, f.enum_values)) if f.enum_values else F.lit(None).cast("array<string>")
        d = V.checked(d, F.lit(_kind(f)), F.col("_said"), F.col(text), F.lit(None).cast("string"), enum, year, F.lit(f.regex).cast("string"))
        one = F.struct(F.lit(f.key).alias("field"), F.col("check_normalized").alias("value"), F.lit(95).alias("confidence"), F.lit("exact_label").alias("evidence_type"))
        d = d.withColumn(f"_f{i}", F.when(fits & F.col("check_reason").isNull(), one)).drop("_said", "check_reason", "check_normalized")
        found.append(f"_f{i}")
    return d.select(*lines.columns, F.inline(F.array_compact(F.array(*found))))


def wants_neighbours(chunk: Column, matches: Column) -> Column:
    """Whether a chunk likely cuts through content: it ends inside a sentence or a table, or a label stands near an edge."""
    t = F.rtrim(F.regexp_replace(chunk, r"\s+$", ""))
    n = F.length(t)
    table = F.substr(t, F.greatest(F.lit(1), n - 239)).rlike(r"(\s{2,}|\t|\|)\S*$")
    edge = F.exists(matches, lambda m: F.exists(m["places"], lambda p: (p <= 800) | (n - p <= 150)))
    return F.when(n > 0, ~F.substr(t, n).isin(".", "!", "?", ":", ";") | table | edge).otherwise(False)


def select(chunks: DataFrame, fields: list[Field], year: int, per_field: int = 2, threshold: int = 70, budget: int = 20_000, chunk: str = "chunk") -> DataFrame:
    """The chunks (doc_id, part, score, reason) to read for the fields, within a budget of characters for each document.

    For each field the two best chunks with its label and a value; failing these the best that only
    its pattern finds; failing that one with its label alone. Then the best others while they fit,
    then neighbours of chunks that cut through content, and last the budget by score. A document
    without any is given its best chunk. What must go in turn is folded over one array of a
    document's chunks, which holds figures and no texts.
    """
    d = scored(chunks, fields, year, chunk)
    d = d.select("doc_id", "part", "score", "matches", F.length(chunk).alias("size"), wants_neighbours(F.col(chunk), F.col("matches")).alias("wants"))
    strong = lambda m: (m["score"] >= threshold) & m["labelled"] & (m["label_score"] > 0) & (m["value_score"] > 0)
    concrete = lambda m: (m["label_score"] > 0) & (m["value_score"] > 0)
    figures = F.struct("part", "score", "size", "wants", F.transform("matches", lambda m: F.struct(m["field"].alias("field"), m["score"].alias("score"), strong(m).alias("strong"), concrete(m).alias("concrete"), m["regex_only"].alias("regex_only"), (m["labelled"] & (m["label_score"] > 0)).alias("label"), ((m["label_score"] > 0) & (m["value_score"] <= 0)).alias("told"))).alias("matches"))
    g = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(figures)).alias("all"))
    every = F.col("all")

    def parts(field: str, keep, n: int, rising: bool = False) -> Column:
        """The first n parts of those whose match of the field is kept, by falling score (rising: by rising score)."""
        have = F.filter(every, lambda c: F.exists(c["matches"], lambda m: (m["field"] == field) & keep(m)))
        points = lambda c: F.get(F.filter(c["matches"], lambda m: m["field"] == field), F.lit(0))["score"]
        turn = F.array_sort(F.transform(have, lambda c: F.struct((points(c) if rising else -points(c)).alias("a"), c["part"].alias("part"))))
        return F.slice(F.transform(turn, lambda x: x["part"]), 1, n)

    chosen = []
    for f in fields:
        best = parts(f.key, lambda m: m["strong"], per_field)
        sure = F.exists(every, lambda c: F.exists(c["matches"], lambda m: (m["field"] == f.key) & m["concrete"]))  # noqa: B023
        pattern = F.when(sure, F.array().cast("array<int>")).otherwise(parts(f.key, lambda m: m["regex_only"], 1))
        label = parts(f.key, lambda m: m["label"], 1, rising=True)
        one = lambda ps, why: F.transform(ps, lambda p: F.struct(p.alias("part"), F.lit(f"{why}:{f.key}").alias("reason")))  # noqa: E731, B023
        chosen.append(F.when(F.size(best) > 0, one(best, "best_for_field")).when(F.size(pattern) > 0, one(pattern, "regex_fallback_for_field")).otherwise(one(label, "label_only_fallback_for_field")))
    g = g.withColumn("picked", F.concat(*chosen) if chosen else F.array().cast("array<struct<part: int, reason: string>>"))
    g = g.withColumn("own", F.array_distinct(F.transform("picked", lambda x: x["part"])))
    # The budget's rest goes to the best of the others that still fit.
    used = F.aggregate(F.filter(every, lambda c: F.array_contains("own", c["part"])), F.lit(0), lambda a, c: a + c["size"])
    others = F.array_sort(F.transform(F.filter(every, lambda c: ~F.array_contains("own", c["part"]) & (c["size"] > 0)), lambda c: F.struct((-c["score"]).alias("turn"), c["part"].alias("part"), c["size"].alias("size"))))
    none = F.array().cast("array<int>")
    taking = lambda a, c: F.when(c["size"] <= a["left"], F.struct((a["left"] - c["size"]).alias("left"), F.array_append(a["parts"], c["part"]).alias("parts"))).otherwise(a)
    g = g.withColumn("left", F.lit(budget) - used)
    filled = F.aggregate(others, F.struct(F.col("left").alias("left"), none.alias("parts")), taking, lambda a: a["parts"])
    g = g.withColumn("filled", F.when(F.col("left") > 800, filled).otherwise(none))
    # Without any, the best chunk, one with a label and a value before others.
    best = F.array_sort(F.transform(every, lambda c: F.struct((~F.exists(c["matches"], lambda m: m["concrete"])).alias("none"), (-c["score"]).alias("turn"), c["part"].alias("part"))))[0]
    empty = (F.size("own") == 0) & (F.size("filled") == 0)
    g = g.withColumn("fallback", F.when(empty, F.array(best["part"])).otherwise(none))
    g = g.withColumn("fallback_reason", F.when(best["none"], "fallback_no_concrete_chunk").otherwise("fallback_best_concrete_chunk"))
    g = g.withColumn("some", F.array_sort(F.concat("own", "filled", "fallback")))
    by_part = F.map_from_entries(F.transform(every, lambda c: F.struct(c["part"], c)))
    g = g.withColumn("by_part", by_part)
    # Neighbours of chunks that cut through content, unless they only explain or do not fit.
    chunk_at = lambda p: F.try_element_at("by_part", p)
    wishes = F.flatten(F.transform(F.filter("some", lambda p: chunk_at(p)["wants"]), lambda p: F.array(p - 1, p + 1)))
    wishes = F.filter(wishes, lambda p: chunk_at(p).isNotNull() & ~F.array_contains("some", p) & ~((F.size(chunk_at(p)["matches"]) > 0) & F.forall(chunk_at(p)["matches"], lambda m: m["told"])))
    total = F.aggregate("some", F.lit(0), lambda a, p: a + chunk_at(p)["size"])
    joining = lambda a, p: F.when((a["total"] + chunk_at(p)["size"] <= budget) & ~F.array_contains(a["parts"], p), F.struct((a["total"] + chunk_at(p)["size"]).alias("total"), F.array_append(a["parts"], p).alias("parts"))).otherwise(a)
    g = g.withColumn("joined", F.aggregate(wishes, F.struct(total.alias("total"), none.alias("parts")), joining, lambda a: a["parts"]))
    # Last the budget: by score, the first always, then what fits.
    last = F.array_sort(F.transform(F.concat("some", "joined"), lambda p: F.struct((-chunk_at(p)["score"]).alias("turn"), p.alias("part"), chunk_at(p)["size"].alias("size"))))
    keeping = lambda a, c: F.when((F.size(a["parts"]) == 0) | (a["total"] + c["size"] <= budget), F.struct((a["total"] + c["size"]).alias("total"), F.array_append(a["parts"], c["part"]).alias("parts"))).otherwise(a)
    g = g.withColumn("kept", F.aggregate(last, F.struct(F.lit(0).alias("total"), none.alias("parts")), keeping, lambda a: a["parts"]))
    why = lambda p: F.coalesce(F.get(F.filter("picked", lambda x: x["part"] == p), F.lit(0))["reason"], F.when(F.array_contains("filled", p), "fill_budget_by_score"), F.when(F.array_contains("joined", p), "context_neighbor"), F.col("fallback_reason"))
    out = g.select("doc_id", F.explode(F.transform("kept", lambda p: F.struct(p.alias("part"), chunk_at(p)["score"].alias("score"), why(p).alias("reason")))).alias("x"))
    return out.select("doc_id", "x.part", "x.score", "x.reason")


def _sound(field: Field, number: Column, window: Column, year: int) -> Column:
    """Whether a number is a value of the field's kind, beside its window in search_text() form."""
    kind = _kind(field)
    if kind in ("year", "area"):
        ok = V.kind_reason(kind, number, window, F.lit(""), year).isNull()
    elif kind == "boolean":
        ok = number.isin("0", "1")
    elif kind == "enum":
        ok = F.lower(number).isin([v.strip().lower() for v in field.enum_values]) if field.enum_values else F.lit(True)
    else:
        ok = F.lit(kind not in ("date", "iban"))
    pattern = java_pattern(field.regex) if field.regex else None
    return ok & number.rlike("(?i)" + pattern) if pattern else ok


def window_score(window: Column, fields: list[Field], year: int) -> Column:
    """10 for each field named in a window, 25 if one of its first 20 numbers may be the field's value, 8 for each line like a table's, less 40 for explanations without values."""
    bound = F.array(F.struct(window.alias("raw"), search_text(window).alias("norm"), F.slice(F.regexp_extract_all(window, F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0)), 1, 20).alias("numbers")))

    def of(x: Column) -> Column:
        score, concrete = F.lit(0), F.lit(0)
        for f in fields:
            named = F.lit(False)
            for t in terms_of(f):
                named = named | x["norm"].contains(t)
            found = named & F.exists(x["numbers"], lambda n: _sound(f, n, x["norm"], year))  # noqa: B023
            score, concrete = score + F.when(named, 10).otherwise(0), concrete + F.when(found, 1).otherwise(0)
        rows = F.size(F.filter(F.split(x["raw"], "\n"), lambda t: t.rlike(r"\d") & t.rlike(r"\S\s+\S+\s+\S")))
        return F.transform(F.array(concrete), lambda c: score + 25 * c + 8 * rows - F.when((c == 0) & x["norm"].rlike(P.EXPLANATION), 40).otherwise(0))[0]

    return F.transform(bound, of)[0]


def clipped(chunks: DataFrame, fields: list[Field], year: int, most: Column | int = 2200, chunk: str = "chunk", before: int = 1500, after: int = 800) -> DataFrame:
    """Replaces a chunk by its part that tells most of the fields, at most `most` characters; what is short enough stays.

    Places of labels get windows of `before` and `after` characters, windows that meet become one,
    and the one of the highest score is kept, the first of equals. One that is too long is cut to
    begin at most `before`, or half of `most`, ahead of its best place. Without places the chunk's
    beginning is kept. One place more costs one window more; all is worked out within the row.
    """
    most = F.lit(most) if isinstance(most, int) else most
    patterns = list(dict.fromkeys(p for f in fields for p in place_pattern([f.label, f.key, plain(re.sub(r"\([^)]*\)", " ", f.label))])))
    d = chunks.withColumns({"_t": F.regexp_replace(F.coalesce(F.col(chunk), F.lit("")), r"(?U)^\s+|\s+$", ""), "_most": most})
    text, most = F.col("_t"), F.col("_most")
    long = F.length(text) > F.least(F.lit(3500), most)
    d = d.withColumn("_at", F.when(long, places(text, patterns) if patterns else F.array().cast("array<int>")).otherwise(F.array().cast("array<int>")))
    window = lambda p: F.struct(F.greatest(F.lit(0), p - before).alias("start"), F.least(F.length(text), p + after).alias("end"))
    last = lambda a: F.element_at(a, -1)
    meet = lambda a, w: F.when((F.size(a) > 0) & (w["start"] <= F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], w["end"]).alias("end"))))).otherwise(F.concat(a, F.array(w)))
    d = d.withColumn("_w", F.aggregate(F.transform("_at", window), F.array().cast("array<struct<start: int, end: int>>"), meet))
    score = lambda start, end: window_score(F.substr(text, start + 1, end - start), fields, year)
    best = F.array_max(F.transform("_w", lambda w: F.struct(score(w["start"], w["end"]).alias("score"), (-w["start"]).alias("turn"), w["end"].alias("end"))))
    d = d.withColumn("_b", best).withColumns({"_start": -F.col("_b.turn"), "_end": F.col("_b.end")})
    start, end = F.col("_start"), F.col("_end")
    inside = F.filter("_at", lambda p: (p >= start) & (p <= end))
    place = F.array_max(F.transform(inside, lambda p: F.struct(score(F.greatest(start, p - before), F.least(end, p + after)).alias("score"), (-p).alias("turn"))))
    d = d.withColumn("_p", F.when(end - start > most, -place["turn"]))
    lead = F.least(F.lit(before), F.greatest(F.lit(200), F.floor(most / 2).cast("int")))
    first = F.greatest(F.lit(0), F.col("_p") - lead)
    first = F.greatest(F.lit(0), F.least(first, F.length(text) - most))
    part = F.when(F.col("_p").isNotNull(), F.substr(text, first + 1, most)).otherwise(F.substr(text, start + 1, end - start))
    kept = F.when(~long, text).when(F.size("_at") == 0, F.regexp_replace(F.substr(text, F.lit(1), most), r"(?U)\s+$", "")).otherwise(F.regexp_replace(part, r"(?U)^\s+|\s+$", ""))
    return d.withColumn(chunk, kept).drop("_t", "_most", "_at", "_w", "_b", "_start", "_end", "_p")


def pack_prompt(chunks: DataFrame, fields: list[Field], year: int, most: int = 4200, chunk: str = "chunk") -> DataFrame:
    """Per document the selected chunks (doc_id, part, page, chunk) as one prompt, and what became of each chunk.

    Each chunk has a header with its number, page and the fields found in it. Chunks come in order;
    one of up to 3,500 characters that still fits is taken whole, others are clipped to their share
    of `most`, and one that does not fit even so is dropped, unless it is the first. `told` lists
    part, characters before, characters included and the reason. Texts meet per document only, as
    many as were selected for it.
    """
    n = F.count("*").over(Window.partitionBy("doc_id"))
    share = F.least(F.lit(max(600, most - 300)), F.greatest(F.lit(1800), F.least(F.lit(3000), F.floor(F.lit(most) / F.greatest(n, F.lit(1))).cast("int"))))
    named = lambda f: F.lit(False) if not terms_of(f) else reduce(or_, [F.contains("_norm", F.lit(t)) for t in terms_of(f)])
    found = F.array_compact(F.array(*[F.when(named(f), F.lit(f.key)) for f in fields])) if fields else F.array().cast("array<string>")
    head = F.concat(F.lit("[chunk "), (F.col("part") + 1).cast("string"), F.lit(", page "), (F.coalesce("page", F.lit(0)) + 1).cast("string"), F.lit(", fields: "), F.coalesce(F.nullif(F.array_join(found, ", "), F.lit("")), F.lit("unknown")), F.lit("]\n"))
    d = chunks.withColumn("_norm", search_text(F.col(chunk))).withColumns({"_share": share, "_head": head, "_whole": F.coalesce(F.col(chunk), F.lit("")), "_short": F.coalesce(F.col(chunk), F.lit(""))})
    d = clipped(d, fields, year, F.col("_share"), "_short")
    bare = F.regexp_replace(F.col("_whole"), r"(?U)^\s+|\s+$", "")
    g = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", F.col("_head").alias("head"), F.length("_whole").alias("size"), bare.alias("whole"), F.col("_short").alias("short")))).alias("all"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<part: int, size: int, included: int, reason: string>>").alias("told"))

    def add(a: Column, c: Column) -> Column:
        whole = (c["size"] <= 3500) & (a["used"] + F.length(c["head"]) + c["size"] + 2 <= most)
        text = F.when(whole, c["whole"]).otherwise(c["short"])

        def step(x: Column) -> Column:
            fits = (F.size(a["parts"]) == 0) | (a["used"] + x["n"] + 2 <= most)
            note = F.struct(c["part"].cast("int").alias("part"), c["size"].alias("size"), F.when(fits, F.length(x["text"])).otherwise(0).alias("included"), F.when(fits, "included").otherwise("dropped_prompt_budget").alias("reason"))
            return F.struct(F.when(fits, a["used"] + x["n"] + 2).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["parts"], F.concat(c["head"], x["text"]))).otherwise(a["parts"]).alias("parts"), F.array_append(a["told"], note).alias("told"))

        return F.transform(F.array(F.struct(text.alias("text"), (F.length(c["head"]) + F.length(text)).alias("n"))), step)[0]

    packed = F.aggregate("all", start, add, lambda a: F.struct(F.array_join(a["parts"], "\n\n").alias("prompt"), a["told"].alias("told")))
    return g.select("doc_id", packed.alias("p")).select("doc_id", "p.prompt", "p.told")
