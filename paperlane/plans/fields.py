"""Queries over field values, candidates and evidence. Orders and order lines give the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import values as V
from ..operators import candidates as C
from ..sources.corpus import STATEMENTS_SQL, statements, table

YEAR = 2025


def _pick(values: list, by: str = "l_linenumber", n: str = "l_orderkey"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"(({n} * 7 + {by}) % {len(values)}) + 1")).cast("int"))


def _pick_sql(values: list, by: str = "l_linenumber", n: str = "l_orderkey") -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[(({n} * 7 + {by}) % {len(values)}) + 1]"


_NUM = ["1.234", "1.5", "1.234,56", "12,5", "€ 1.250", "12-03-2024", "abc 12", "", " 77 m", "-3", "1.2.3", None]
_DATES = ["2024-02-30", "2024-02-29", "31-12-2023", "31-02-2023", "05/06/2021", "2024-1-2", "1-2-2024", "01-02-24 ", "morgen", None]
_AMOUNTS = ["€ 1.234,56", "1,234.56", "12,5", "1.500", "99", "USD 3.75", "geen", None]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")


def fx_canonical_key(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 3 == 0, "energylabel").otherwise(F.col("event_type"))
    alias = F.create_map(F.lit("energylabel"), F.lit("energielabel"))
    return t.select("event_id", F.coalesce(F.try_element_at(alias, key), key).alias("key"))


def fx_number_normalize(spark, sf_dir):
    return _lines(spark, sf_dir).select(_pick(_NUM).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", V.number(F.col("value")).alias("number"), "n")


def fx_number_column(spark, sf_dir):
    v = F.concat(F.lit("€ "), F.regexp_replace(F.format_number(F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), 0), ",", "."), F.lit(",50"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", V.number(v).alias("number"))


def fx_placeholder_empty(spark, sf_dir):
    v = _pick(["null", "N/A", " - ", "waarde", "", None, "Onbekend", "niet gevonden", "0"])
    return _lines(spark, sf_dir).select(v.alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", "n", V.is_empty(F.col("value")).alias("empty"))


def fx_evidence_invalid(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Niet Opgenomen in "), F.col("lang"))).when(F.col("doc_id") % 4 == 1, F.col("text")).when(F.col("doc_id") % 4 == 2, "  ")
    return d.select("doc_id", V.evidence_invalid(e).alias("invalid"))


def fx_iban_check(spark, sf_dir):
    s = statements(spark, sf_dir)
    wrong = F.concat(F.substring("iban", 1, 17), ((F.substring("iban", 18, 1).cast("int") + 1) % 10).cast("string"))
    v = F.when(F.col("doc_id") % 3 == 0, wrong).when(F.col("doc_id") % 3 == 1, F.lower(V.grouped_iban(F.col("iban")))).otherwise(F.col("iban"))
    return s.select("doc_id", V.iban_valid(v).alias("valid"))


def fx_iban_format_ui(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", V.grouped_iban(F.col("iban")).alias("shown"))


def fx_date_parse(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", V.iso_date(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("day"))


def fx_date_forms(spark, sf_dir):
    v = _pick(_DATES)
    return _lines(spark, sf_dir).select(v.alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", "n", V.iso_date(F.col("value")).alias("day"))


def fx_amount_parse(spark, sf_dir):
    v = F.concat(F.lit("€ "), F.format_number("l_extendedprice", 2))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", V.first_amount(v).alias("amount"))


def fx_amount_parse_ui(spark, sf_dir):
    return _lines(spark, sf_dir).select(_pick(_AMOUNTS).alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", "n", V.shown_amount(F.col("value")).alias("shown"), V.first_amount(F.col("value")).alias("first"), V.rule_amount(F.col("value")).alias("rule"), V.naive_amount(F.col("value")).alias("naive"))


def fx_currency_detect_ui(spark, sf_dir):
    v = _pick(["$ 5", "5", "£5", None])
    q = F.when(F.col("l_returnflag") == "A", "prijs ¥ 100").otherwise("prijs")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", V.currency(v, q).alias("currency"))


def fx_field_kind(spark, sf_dir):
    f = _lines(spark, sf_dir).select(_pick(["number", "date", "string", "enum", "bool", "iban", "money"]).alias("type"), _pick(["bouwjaar", "oppervlakte_m2", "bedrag", "start_year", "naam"], "l_linenumber * 3").alias("key"))
    return f.groupBy("type", "key").agg(F.count("*").alias("n")).select("type", "key", "n", V.field_kind(F.col("type"), F.col("key"), F.col("key")).alias("kind"))


def fx_hard_validators(spark, sf_dir):
    l = _lines(spark, sf_dir)
    date, amount = _pick(_DATES), _pick(_AMOUNTS)
    errors = F.array_compact(F.array(F.when(date.isNotNull() & V.iso_date(date).isNull(), "invalid_date:ship_date"), F.when(amount.isNotNull() & V.first_amount(amount).isNull(), "invalid_amount:total_amount")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(errors, ",").alias("errors"))


def fx_consistency(spark, sf_dir):
    o = table(spark, sf_dir, "customer")
    total, vat = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    return o.select("c_custkey", F.concat_ws(",", F.when(total < 0, "total_amount:negative"), F.when(vat > total, "vat_exceeds_total")).alias("errors"))


def fx_validate_value(spark, sf_dir):
    l = _lines(spark, sf_dir)
    kind = _pick(["number", "date", "boolean", "enum", "year"])
    value = F.when(kind == "number", F.col("l_quantity").cast("string")).when(kind == "date", F.date_format("l_shipdate", "yyyy-MM-dd")).when(kind == "boolean", F.when(F.col("l_returnflag") == "A", "Ja").when(F.col("l_returnflag") == "N", "nee").otherwise("misschien")).when(kind == "enum", F.col("l_returnflag")).otherwise((F.col("l_partkey") + 1500).cast("string"))
    evidence = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("datum "), value)).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("postcode 1234 AB, "), value)).otherwise("bouw in 19 xx")
    pattern = F.when(F.col("l_linenumber") % 2 == 0, "^[12ajn]")
    l = V.checked(l.withColumns({"k": kind, "v": value, "e": evidence, "p": pattern}), F.col("k"), F.col("v"), F.col("e"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("N")), YEAR, F.col("p"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.col("check_reason").isNull().alias("valid"), F.col("check_reason").alias("reason"), F.col("check_normalized").alias("normalized"))


_KIND = _pick_sql(["number", "date", "boolean", "enum", "year"])


def _candidates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") % 5 == 4, "n/a").otherwise(F.col("l_partkey").cast("string"))
    return l.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "gewicht").otherwise("aantal").alias("field_key"), F.when(F.col("l_returnflag") == "R", "Gewicht").otherwise("Aantal stuks").alias("label"), F.lit("number").alias("field_type"),
        value.alias("value"), value.alias("normalized_value"), F.lit(None).cast("string").alias("unit"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("Aantal: "), value)).otherwise(F.concat(F.lit("regel "), value)).alias("evidence"), F.lit(None).cast("array<string>").alias("enum_values"),
        F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("confidence"), F.when(F.col("l_suppkey") % 2 == 0, "^[1-4]").alias("regex"), F.when(F.col("l_suppkey") % 3 == 0, "exact_label").when(F.col("l_suppkey") % 3 == 1, "semantic").otherwise("guess").alias("evidence_type"), F.when(F.col("l_linenumber") % 2 == 0, "primary").otherwise("background").alias("record_role"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"),
    )


_CAND = """cd AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'gewicht' ELSE 'aantal' END AS field_key, CASE WHEN l_linenumber % 5 = 4 THEN 'n/a' ELSE CAST(l_partkey AS VARCHAR) END AS value, l_linestatus = 'O' AS labelled, l_suppkey % 2 = 0 AND l_partkey::VARCHAR NOT SIMILAR TO '[1-4].*' AS amiss, l_linenumber AS chunk, l_quantity AS confidence,
 CASE l_suppkey % 3 WHEN 0 THEN 'exact_label' WHEN 1 THEN 'semantic' ELSE 'guess' END AS et, CASE WHEN l_linenumber % 2 = 0 THEN 'primary' ELSE 'background' END AS rr, l_partkey * 100000 + l_suppkey AS ord FROM lineitem),
cr AS (SELECT *, CASE WHEN value = 'n/a' THEN 'empty_value' WHEN et = 'guess' THEN 'invalid_evidence_type' WHEN confidence <= 0 THEN 'non_positive_confidence' WHEN amiss THEN 'regex_mismatch' END AS reason, field_key = 'aantal' AND labelled AS ctx FROM cd),
cs AS (SELECT *, CASE WHEN reason IS NULL THEN 60.0::DOUBLE + CASE et WHEN 'exact_label' THEN 60 ELSE 10 END + CASE rr WHEN 'primary' THEN 10 ELSE -20 END + CASE WHEN ctx THEN 60 ELSE 0 END + least(20.0::DOUBLE, greatest(0, confidence / 5)) + greatest(0, 5 - least(chunk, 5)) END AS score FROM cr)"""


def fx_candidate_validate(spark, sf_dir):
    return C.judged(_candidates(spark, sf_dir), YEAR).select("doc_id", "chunk_index", "ord", "reason")


def fx_candidate_score(spark, sf_dir):
    c = C.judged(_candidates(spark, sf_dir), YEAR).withColumn("score", C.score())
    return V.only(c, F.col("reason").isNull(), "doc_id", "chunk_index", "ord", "score")


def fx_resolve(spark, sf_dir):
    r = C.resolve(_candidates(spark, sf_dir), YEAR)
    one = F.transform("rejected", lambda x: F.concat_ws(":", x["chunk_index"], x["value"], F.coalesce(x["reason"], F.lit("scored less"))))
    return r.withColumn("rejected", F.array_join(one, ","))


def fx_required_resolved(spark, sf_dir):
    r = C.resolve(_candidates(spark, sf_dir), YEAR)
    return r.groupBy("doc_id").agg(F.bool_and(F.col("value").isNotNull()).alias("complete"))


_RES = f"""WITH {_CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY score DESC NULLS LAST, ctx DESC, chunk, ord, value DESC) AS r FROM cs),
rs AS (SELECT doc_id, field_key, max(value) FILTER (r = 1) AS v, max(score) AS score, count(score) AS n_valid, count(reason) AS n_rejected,
 coalesce(string_agg(concat(chunk, ':', value, ':', coalesce(reason, 'scored less')), ',' ORDER BY score DESC NULLS LAST, chunk, ord, value) FILTER (r > 1 OR coalesce(best, 0) < 100), '') AS rejected FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, field_key) AS best FROM rk) GROUP BY ALL)"""


def _pages(spark, sf_dir):
    """A statement's lines as its pages."""
    return statements(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


_PAGES = "pg AS (SELECT doc_id, unnest(range(0, len(l))) AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM stmt))"


def fx_find_span(spark, sf_dir):
    q = statements(spark, sf_dir).select("doc_id", F.get(F.array(F.col("iban"), F.lower("iban"), F.lit("nergens"), F.lit("boeking"), F.lit("IBAN")), (F.col("doc_id") % 5).cast("int")).alias("quote"))
    return C.find_span(_pages(spark, sf_dir), q).select("doc_id", "page", "start")


def fx_fill_quotes(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("doc_id", "page", F.substring("text", 3, 6).alias("quote"))


def fx_validate_evidence(spark, sf_dir):
    p = _pages(spark, sf_dir)
    start, end = (F.col("doc_id") % 15).cast("int"), (F.col("doc_id") % 15 + F.col("page") * 4).cast("int")
    value = F.when(F.col("doc_id") % 7 != 0, "x")
    quote = F.when(F.col("doc_id") % 2 == 0, F.substr("text", start + 1, end - start)).otherwise("verkeerd")
    return p.select("doc_id", "page", C.evidence_error(value, F.col("page"), start, end, quote, F.col("text")).alias("error"))


def fx_all_occurrences(spark, sf_dir):
    p = _pages(spark, sf_dir)
    v = statements(spark, sf_dir).select("doc_id", F.lit("boeking").alias("value"))
    known = p.where("page = 2").select("doc_id", F.lit("boeking").alias("value"), "page")
    return C.occurrences(p, v, known).select("doc_id", "page")


def fx_required_errors(spark, sf_dir):
    r = C.resolve(_candidates(spark, sf_dir), YEAR)
    return r.where("value is null").select("doc_id", F.concat(F.lit("missing_required_field:"), "field_key").alias("error"))


def src_slug(spark, sf_dir):
    n = table(spark, sf_dir, "part")
    return n.select("p_partkey", T.slug(F.concat(F.lit(" "), F.col("p_type"), F.lit("__"), F.col("p_brand"))).alias("slug"))


def src_sniff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "TXT", "jpg", "exe")]), (F.col("doc_id") % 4 + 1).cast("int"))
    mime = F.create_map(*[F.lit(x) for kv in P.MIME_BY_EXTENSION.items() for x in kv])
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.coalesce(F.try_element_at(mime, F.lower(ext)), F.lit("application/octet-stream")).alias("mime"))


_NAMES = "fx_canonical_key fx_number_normalize fx_number_column fx_placeholder_empty fx_evidence_invalid fx_iban_check fx_iban_format_ui fx_date_parse fx_date_forms fx_amount_parse fx_amount_parse_ui fx_currency_detect_ui fx_field_kind fx_hard_validators fx_consistency fx_validate_value fx_candidate_validate fx_candidate_score fx_resolve fx_required_resolved fx_find_span fx_fill_quotes fx_validate_evidence fx_all_occurrences fx_required_errors src_slug src_sniff"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def _values(pairs: dict, column: str, source: list, kind: str = "VARCHAR") -> str:
    """A table of what each picked value gives: written out, as the patterns differ between engines."""
    rows = ", ".join(f"({'NULL' if k is None else chr(39) + k.replace(chr(39), chr(39) * 2) + chr(39)}, {'NULL' if v is None else repr(v) if not isinstance(v, bool) else str(v).upper()})" for k, v in pairs.items())
    return f"WITH v(value, {column}) AS (VALUES {rows}), c AS (SELECT {_pick_sql(source)} AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT c.value, CAST({column} AS {kind}) AS {column}, n FROM c LEFT JOIN v ON c.value IS NOT DISTINCT FROM v.value"


def oracle_sql() -> dict[str, str]:
    stmt = f"WITH {STATEMENTS_SQL}"
    grp = r"trim(regexp_replace(iban, '(.{4})', '\1 ', 'g'))"
    num = dict(zip(_NUM, ["1234", "1.5", "1234.56", "12.5", "1250", None, None, None, None, "-3", None, None], strict=True))
    num[" 77 m"] = None
    days = dict(zip(_DATES, [None, "2024-02-29", "2023-12-31", None, "2021-06-05", None, None, None, None, None], strict=True))
    ph = ["null", "N/A", " - ", "waarde", "", None, "Onbekend", "niet gevonden", "0"]
    bad_days = "v IN (" + ", ".join(f"'{d}'" for d, x in days.items() if x is None and d) + ")"
    return {
        "fx_canonical_key": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'energielabel' ELSE event_type END AS key FROM events",
        "fx_number_normalize": _values(num, "number", _NUM),
        "fx_number_column": "SELECT l_orderkey, l_linenumber, l_partkey, concat(CAST(round(l_extendedprice * 100) AS BIGINT) // 100, '.50') AS number FROM lineitem",
        "fx_placeholder_empty": _values({k: k not in ("waarde", "0") for k in ph}, "empty", ph, "BOOLEAN"),
        "fx_evidence_invalid": "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text IS NULL OR trim(text) = '' OR regexp_matches(lower(text), 'niet opgenomen|not found|niet gevonden|n/a') ELSE TRUE END AS invalid FROM documents",
        "fx_iban_check": f"{stmt} SELECT doc_id, doc_id % 3 <> 0 AS valid FROM stmt",
        "fx_iban_format_ui": f"{stmt} SELECT doc_id, {grp} AS shown FROM stmt",
        "fx_date_parse": "SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem",
        "fx_date_forms": _values(days, "day", _DATES),
        "fx_amount_parse": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(regexp_extract(replace(format('{:,.2f}', l_extendedprice), ',', '.'), '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS amount FROM lineitem",
        "fx_amount_parse_ui": f"WITH v(value, shown, first, rule, naive) AS (VALUES ('€ 1.234,56', 1234.56::DOUBLE, 1.234::DOUBLE, 1234.56::DOUBLE, NULL::DOUBLE), ('1,234.56', 1234.56, 1.234, 1.23456, NULL), ('12,5', 12.5, 12.5, 12.5, 12.5), ('1.500', 1500, 1.5, 1500, 1.5), ('99', 99, 99, 99, 99), ('USD 3.75', 3.75, 3.75, NULL, NULL), ('geen', NULL, NULL, NULL, NULL), (NULL, NULL, NULL, NULL, NULL)), c AS (SELECT {_pick_sql(_AMOUNTS)} AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT c.value, n, shown, first, rule, naive FROM c LEFT JOIN v ON c.value IS NOT DISTINCT FROM v.value",
        "fx_currency_detect_ui": f"SELECT l_orderkey, l_linenumber, l_partkey, CASE v WHEN '$ 5' THEN 'USD' WHEN '£5' THEN 'GBP' ELSE CASE WHEN l_returnflag = 'A' THEN 'JPY' ELSE 'EUR' END END AS currency FROM (SELECT *, {_pick_sql(['$ 5', '5', '£5', None])} AS v FROM lineitem)",
        "fx_field_kind": f"WITH f AS (SELECT {_pick_sql(['number', 'date', 'string', 'enum', 'bool', 'iban', 'money'])} AS type, {_pick_sql(['bouwjaar', 'oppervlakte_m2', 'bedrag', 'start_year', 'naam'], 'l_linenumber * 3')} AS key FROM lineitem) SELECT type, key, count(*) AS n, CASE WHEN type = 'bool' THEN 'boolean' WHEN type IN ('enum', 'date') THEN type WHEN key IN ('bouwjaar', 'start_year') THEN 'year' WHEN key = 'oppervlakte_m2' THEN 'area' WHEN type IN ('number', 'iban') THEN type ELSE 'string' END AS kind FROM f GROUP BY ALL",
        "fx_hard_validators": f"SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN {bad_days} THEN 'invalid_date:ship_date' END, CASE WHEN a = 'geen' THEN 'invalid_amount:total_amount' END) AS errors FROM (SELECT *, {_pick_sql(_DATES)} AS v, {_pick_sql(_AMOUNTS)} AS a FROM lineitem)",
        "fx_consistency": "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'total_amount:negative' END, CASE WHEN c_custkey > c_acctbal THEN 'vat_exceeds_total' END) AS errors FROM customer",
        "fx_validate_value": f"""WITH k0 AS (SELECT *, {_KIND} AS kind FROM lineitem),
 k1 AS (SELECT *, CASE kind WHEN 'number' THEN CAST(l_quantity AS VARCHAR) WHEN 'date' THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 'boolean' THEN CASE l_returnflag WHEN 'A' THEN 'Ja' WHEN 'N' THEN 'nee' ELSE 'misschien' END WHEN 'enum' THEN l_returnflag ELSE CAST(l_partkey + 1500 AS VARCHAR) END AS v FROM k0),
 k AS (SELECT *, l_linenumber % 2 = 0 AND NOT regexp_matches(lower(v), '^[12ajn]') AS amiss FROM k1), r AS (SELECT *, CASE WHEN kind = 'boolean' AND l_returnflag = 'R' THEN 'boolean_not_explicit' WHEN kind = 'enum' AND l_returnflag = 'R' THEN 'enum_value_not_allowed' WHEN kind = 'year' AND l_partkey + 1500 < 1600 THEN 'year_out_of_range' WHEN kind = 'year' AND l_partkey + 1500 > 9999 THEN 'year_must_be_four_digits' WHEN kind = 'year' AND l_partkey + 1500 > {YEAR + 1} THEN 'year_out_of_range'
   WHEN kind = 'year' AND l_suppkey % 4 = 0 THEN 'year_evidence_has_date_label' WHEN kind = 'year' AND l_suppkey % 4 = 1 THEN 'year_evidence_has_postcode' WHEN amiss THEN 'regex_mismatch' END AS reason FROM k)
 SELECT l_orderkey, l_linenumber, l_partkey, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN CASE kind WHEN 'number' THEN CAST(l_quantity AS VARCHAR) WHEN 'date' THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 'boolean' THEN CASE WHEN l_returnflag = 'A' THEN 'true' ELSE 'false' END WHEN 'enum' THEN l_returnflag ELSE CAST(l_partkey + 1500 AS VARCHAR) END END AS normalized FROM r""",
        "fx_candidate_validate": f"WITH {_CAND} SELECT doc_id, chunk AS chunk_index, ord, reason FROM cr",
        "fx_candidate_score": f"WITH {_CAND} SELECT doc_id, chunk AS chunk_index, ord, score FROM cs WHERE reason IS NULL",
        "fx_resolve": f"{_RES} SELECT doc_id, field_key, CASE WHEN score >= 100 THEN v END AS value, score, n_valid, n_rejected, rejected FROM rs",
        "fx_required_resolved": f"{_RES} SELECT doc_id, bool_and(coalesce(score >= 100, FALSE)) AS complete FROM rs GROUP BY doc_id",
        "fx_required_errors": f"{_RES} SELECT doc_id, concat('missing_required_field:', field_key) AS error FROM rs WHERE NOT coalesce(score >= 100, FALSE)",
        "fx_find_span": f"{stmt}, {_PAGES}, b AS (SELECT doc_id, min(page) AS page FROM pg WHERE starts_with(text, 'Boeking') GROUP BY doc_id) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN page END AS page, CASE doc_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 3 THEN page - page END AS start FROM stmt LEFT JOIN b USING (doc_id) WHERE doc_id % 5 <> 4",
        "fx_fill_quotes": f"{stmt}, {_PAGES} SELECT doc_id, page, substr(text, 3, 6) AS quote FROM pg",
        "fx_validate_evidence": f"{stmt}, {_PAGES}, z AS (SELECT *, doc_id % 15 AS s, doc_id % 15 + page * 4 AS e FROM pg) SELECT doc_id, page, CASE WHEN doc_id % 7 = 0 THEN 'evidence_for_null' WHEN s >= length(text) OR e > length(text) OR s >= e THEN 'invalid_span' WHEN doc_id % 2 = 1 THEN 'quote_mismatch' END AS error FROM z",
        "fx_all_occurrences": f"{stmt}, {_PAGES} SELECT doc_id, page FROM pg WHERE contains(lower(text), 'boeking') AND page <> 2",
        "src_slug": "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(' ', p_type, '__', p_brand))), '[_\\s]+', '-', 'g'), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
        "src_sniff": "SELECT doc_id, sha256(text) AS sha256, (['application/pdf', 'text/plain', 'image/jpeg', 'application/octet-stream'])[doc_id % 4 + 1] AS mime FROM documents",
    }
