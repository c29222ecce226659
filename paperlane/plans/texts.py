"""Queries over text quality, signals and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import policy as Pol
from ..sources.corpus import STATEMENTS_SQL, statements, table

SIGNALS = [{"key": k, "compute_kind": "builtin", "signal_type": t, "source": "builtin"} for k, t in T.BUILTIN.items()] + [
    {"key": "has_statement", "compute_kind": "keyword_set", "signal_type": "boolean", "source": "user", "config": {"keywords": ["Rekeningafschrift", "IBAN"], "match_mode": "all"}},
    {"key": "has_booking", "compute_kind": "regex_set", "signal_type": "boolean", "source": "user", "config": {"patterns": [r"^boeking\s", "("], "match_mode": "any"}},
]
POLICIES = {
    "bank-statement": Pol.parse({"requirements": [{"signal": "iban_present", "op": "==", "value": 1}, {"signal": "date_amount_row_count", "op": ">=", "value": 2}], "exclusions": [{"signal": "has_booking", "op": "==", "value": 1}]}),
    "booking-list": Pol.parse({"requirements": [{"signal": "has_booking", "op": "==", "value": 1}, {"signal": "amount_count", "op": ">", "value": 1}], "exclusions": []}),
    "anything": Pol.DEFAULT,
}

#: The same patterns as RE2 takes them.
_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_IBAN, _DATE, _AMOUNT = P.IBAN, P.DATE, P.AMOUNT


def _count(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({text}, '{quoted}'))"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_SIG_SQL = rf"""sig AS (SELECT doc_id, text, regexp_matches(p, '{_IBAN}')::INT::DOUBLE AS iban_present, {_count('p', _DATE)}::DOUBLE AS date_count, {_count('p', _AMOUNT)}::DOUBLE AS amount_count,
    len(list_filter(l, lambda x: regexp_matches(x, '{_DATE}') AND regexp_matches(x, '{_AMOUNT}')))::DOUBLE AS date_amount_row_count,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\s]')))::DOUBLE AS line_count, len(regexp_extract_all(p, '[^\s]+'))::DOUBLE AS token_count,
    (contains(lower(p), 'rekeningafschrift') AND contains(lower(p), 'iban'))::INT::DOUBLE AS has_statement, regexp_matches(p, '(?im)^boeking\s')::INT::DOUBLE AS has_booking
  FROM (SELECT doc_id, text, p, string_split({_strip('p')}, chr(10)) AS l FROM (SELECT doc_id, text, regexp_replace(substr(text, 1, 200000), '[ \t\r\f\v]+', ' ', 'g') AS p FROM stmt)))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("doc_id", T.signal_map(T.prepared(F.col("text")), SIGNALS).alias("signals"))


def pol_filter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Pol.eligibility(_signals(spark, sf_dir), POLICIES)
    return e.select("doc_id", "slug", "is_eligible", F.size("failed").alias("n_failed"), F.size("triggered").alias("n_triggered"))


def _sql_tests(part: str, slug: str) -> list[str]:
    return [f"({r['signal']} {'=' if r['op'] == '==' else r['op']} {float(r['value'])})" for r in POLICIES[slug][part]]


def _pol_sql(select: str, where: str = "") -> str:
    rows = []
    for slug in POLICIES:
        failed = " + ".join(f"(NOT {t})::INT" for t in _sql_tests("requirements", slug)) or "0"
        hit = " + ".join(f"{t}::INT" for t in _sql_tests("exclusions", slug)) or "0"
        rows.append(f"SELECT doc_id, '{slug}' AS slug, ({failed}) AS n_failed, ({hit}) AS n_triggered FROM sig")
    return f"WITH {STATEMENTS_SQL}, {_SIG_SQL}, e AS ({' UNION ALL '.join(rows)}) {select} FROM e {where}"


def _tq(name: str, column) -> callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias(name))

    return query


_T = f"(SELECT doc_id, coalesce(text, '') AS text, {_strip("coalesce(text, '')")} AS t, regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g') AS bare FROM documents)"
_EMPTY = "(length(bare) = 0 OR len(regexp_extract_all(bare, '[a-zA-Z0-9]')) / greatest(length(bare), 1) < 0.1)"


def _common(words: list[str]) -> str:
    # RE2 has no Unicode word edge: words are taken whole and looked up.
    return f"len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x IN ({', '.join(repr(w) for w in words)})))"


_REASON = f"""CASE WHEN length(t) < 50 THEN 'too_short' WHEN {_count('t', '[a-zA-Z]')} > 0 AND {_count('t', P.SPECIAL)} / greatest({_count('t', '[a-zA-Z]')}, 1) > 0.5 THEN 'special_characters'
 WHEN length(t) > 100 AND {_count('t', '[a-zA-Z]{3,}')} < 5 THEN 'few_words' WHEN {_count('t', P.CONTROL.replace('x7f-', 'x7f-').replace('\\x9f', '\\x{9f}'))} > length(t) * 0.05 THEN 'control_characters'
 WHEN {_count('t', '[a-zA-Z]{3,}')} > 10 AND {_common(P.DUTCH_COMMON)} + {_common(P.ENGLISH_COMMON)} < 3 THEN 'no_common_words'
 WHEN {' + '.join(_count('t', p) for p in P.GARBAGE)} >= 3 THEN 'garbage_patterns' END"""
_OCR = f"""CASE WHEN length(bare) < 100 THEN 'low' WHEN {' + '.join(_count('text', p) for p in (r'[^\x00-\x7F]', r'\d{10,}', r'[|@#$%^&*]{3,}'))} > length(bare) * 0.05 THEN 'low'
 WHEN {' + '.join(_count('text', p) for p in (r'[^\x00-\x7F]', r'\d{10,}', r'[|@#$%^&*]{3,}'))} > length(bare) * 0.02 THEN 'medium' ELSE 'high' END"""


def _sig(key: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _signals(spark, sf_dir).select("doc_id", F.col("signals")[key].alias("value"))

    return query


def sig_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("p", T.prepared(F.col("text")))
    return d.select("doc_id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(T.MOST_CHARACTERS)).alias("text_length"), F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(T.lines_of(F.col("p")))).alias("line_count"))


def sig_keyword_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.keyword_signal(t, ["License", "the "]).alias("any_hit"), T.keyword_signal(t, ["of", "the"], "all").alias("all_hit"), T.keyword_signal(t, []).alias("none"))


def sig_regex_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.regex_signal(t, ["^the ", "("]).alias("any_hit"), T.regex_signal(t, ["th", "[0-9]{3}"], "all").alias("all_hit"), T.regex_signal(t, ["("]).alias("invalid"))


def sig_compute_all_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {s["key"]: s for s in SIGNALS}
    s = _signals(spark, sf_dir).select(F.explode("signals").alias("key", "value"))
    source = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v["source"])])[F.col("key")]
    return s.groupBy("key").agg(F.first(source).alias("source"), F.sum((F.col("value") > 0).cast("long")).alias("n_positive"), F.sum("value").alias("total"))


def feat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", r"(?U)[^\S\n]+", " ")
    lines = T.lines_of(t)
    return statements(spark, sf_dir).select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(P.DATE) & x.rlike(P.EURO_AMOUNT))).alias("txn_rows"), F.regexp_count(t, F.lit(P.DATE)).alias("date_count"), F.regexp_count(t, F.lit(P.EURO_AMOUNT)).alias("amount_count"), F.length("text").alias("text_length"), F.size(lines).alias("line_count"))


def feat_pii_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("doc_id", T.pii_normalized(F.col("text")).alias("text"))


def feat_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.keyword_signal(t, [], empty=True).alias("no_keyword"), T.regex_signal(t, [], empty=True).alias("no_pattern"), T.keyword_signal(t, ["the"]).alias("keyword"))


def pol_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Pol.eligibility(_signals(spark, sf_dir), {"bank-statement": POLICIES["bank-statement"]})
    return e.select("doc_id", F.array_join("failed", "; ").alias("failed"), F.array_join("triggered", "; ").alias("triggered"))


_ELIGIBILITY_SQL = f"""WITH {STATEMENTS_SQL}, {_SIG_SQL} SELECT doc_id, concat_ws('; ', CASE WHEN iban_present <> 1 THEN concat('iban_present == 1 (werkelijk: ', iban_present::BIGINT, ')') END,
 CASE WHEN date_amount_row_count < 2 THEN concat('date_amount_row_count >= 2 (werkelijk: ', date_amount_row_count::BIGINT, ')') END) AS failed,
 CASE WHEN has_booking = 1 THEN concat('has_booking == 1 (werkelijk: ', has_booking::BIGINT, ')') ELSE '' END AS triggered FROM sig"""

_UNSEEN = {"requirements": [{"signal": "date_count", "op": ">=", "value": 3}, {"signal": "not_there", "op": "!=", "value": 5}], "exclusions": [{"signal": "amount_count", "op": ">", "value": 4}]}


def _preview(missing_fails: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Pol.preview(_signals(spark, sf_dir), Pol.parse(_UNSEEN), missing_fails=missing_fails).select("doc_id", "kind", "signal", "op", "required", "actual", "passed")

    return query


def _preview_sql(missing: str) -> str:
    return f"""WITH {STATEMENTS_SQL}, {_SIG_SQL} SELECT doc_id, 'requirements' AS kind, 'date_count' AS signal, '>=' AS op, 3.0::DOUBLE AS required, date_count AS actual, date_count >= 3 AS passed FROM sig
 UNION ALL SELECT doc_id, 'requirements', 'not_there', '!=', 5.0, 0.0, {missing} FROM sig UNION ALL SELECT doc_id, 'exclusions', 'amount_count', '>', 4.0, amount_count, NOT amount_count > 4 FROM sig"""


def pol_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    return s.select("doc_id", *[Pol.holds(F.col("signals"), {"signal": "date_count", "op": op, "value": 3}).alias(n) for op, n in (("==", "eq"), ("!=", "ne"), (">=", "ge"), ("<=", "le"), (">", "gt"), ("<", "lt"))], Pol.holds(F.col("signals"), {"signal": "gone", "op": "==", "value": 0}).alias("missing_is_zero"))


def pol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies as they lie in a table: JSON text parsed per row, null or malformed to the default."""
    j = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"acceptance":{"trained_model":{"min_confidence":'), F.format_number(F.col("value") % 1, 2), F.lit("}}}"))).when(F.col("event_id") % 4 == 1, "{not json")
    e = table(spark, sf_dir, "events").select("event_id", j.alias("policy"))
    p = F.from_json("policy", "acceptance struct<trained_model: struct<enabled: boolean, min_confidence: double, min_margin: double>>")["acceptance"]["trained_model"]
    ok = lambda c, d: F.coalesce(F.when(p[c].between(0, 1), p[c]), F.lit(d))
    return e.select("event_id", ok("min_confidence", 0.85).alias("min_confidence"), ok("min_margin", 0.1).alias("min_margin"), F.coalesce(p["enabled"], F.lit(True)).alias("enabled"))


def pol_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    limit, op = F.col("value") / 10, F.element_at(F.array(*[F.lit(x) for x in ("==", "!=", ">=", "<=", ">", "<", "~")]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", limit.between(0, 1).alias("limit_ok"), op.isin(list(Pol.OPS)).alias("op_ok"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    third = lambda k: F.when(F.col("event_id") % 5 != k, (F.col("event_id") * (7 + k) % 100) / 100.0)
    return e.select("event_id", third(1).alias("nb"), third(2).alias("bert"), F.lit(0.3).alias("bert2"))


_SCORES_SQL = "s AS (SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN (event_id * 8 % 100) / 100.0::DOUBLE END AS nb, CASE WHEN event_id % 5 <> 2 THEN (event_id * 9 % 100) / 100.0::DOUBLE END AS bert FROM events)"


def pol_pick_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    method, best, second = Pol.pick_trained(F.col("nb"), F.col("bert"), F.col("bert2"))
    return s.select("event_id", method.alias("method"), best.alias("confidence"), second.alias("second"))


_PICK_SQL = f"""WITH {_SCORES_SQL}, w AS (SELECT *, bert IS NOT NULL AND (nb IS NULL OR bert > nb + 0.1::DOUBLE) AS b FROM s)
SELECT event_id, CASE WHEN b THEN 'bert' WHEN nb IS NOT NULL THEN 'naive_bayes' END AS method, CASE WHEN b THEN bert ELSE nb END AS confidence,
 CASE WHEN nb IS NOT NULL AND bert IS NOT NULL THEN CASE WHEN b THEN nb ELSE bert END WHEN bert IS NOT NULL THEN 0.3::DOUBLE WHEN nb IS NOT NULL THEN 0.0::DOUBLE END AS second FROM w"""


def pol_accept_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pol_pick_trained(spark, sf_dir)
    ok = F.coalesce(Pol.accept_trained(F.col("confidence"), F.col("second"), Pol.DEFAULT), F.lit(False))
    return s.select("event_id", ok.alias("accepted"))


def pol_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pol_pick_trained(spark, sf_dir)
    return s.select("event_id", F.coalesce("method", F.lit("unknown")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


_SIG_KEYS = ["iban_present", "date_count", "amount_count", "date_amount_row_count", "line_count", "token_count"]


def queries() -> dict:
    return {
        "pol_filter_types": pol_filter_types,
        "tq_mostly_empty": _tq("mostly_empty", T.mostly_empty),
        "tq_garbage": _tq("garbage", T.is_garbage),
        "tq_garbage_reason": _tq("reason", T.garbage_reason),
        "tq_ocr_quality": _tq("quality", lambda t: T.ocr_quality(t, F.lit(True))),
        "tq_needs_ocr": _tq("needs_ocr", T.needs_ocr),
        **{f"sig_{k}": _sig(k) for k in _SIG_KEYS},
        "sig_prepare": sig_prepare,
        "sig_keyword_set": sig_keyword_set,
        "sig_regex_set": sig_regex_set,
        "sig_dispatch": lambda s, d: _signals(s, d).select("doc_id", F.explode("signals").alias("key", "value")),
        "sig_compute_all_report": sig_compute_all_report,
        "feat_extract": feat_extract,
        "feat_pii_normalize": feat_pii_normalize,
        "feat_helpers": feat_helpers,
        "pol_eligibility": pol_eligibility,
        "pol_preview": _preview(False),
        "pol_preview_mcp": _preview(True),
        "pol_requirement": pol_requirement,
        "pol_parse": pol_parse,
        "pol_validate": pol_validate,
        "pol_pick_trained": pol_pick_trained,
        "pol_accept_trained": pol_accept_trained,
        "pol_unknown": pol_unknown,
    }


def oracle_sql() -> dict[str, str]:
    all_keys = [s["key"] for s in SIGNALS]
    unpivot = f"WITH {STATEMENTS_SQL}, {_SIG_SQL} SELECT doc_id, key, value FROM (SELECT doc_id, {', '.join(all_keys)} FROM sig) UNPIVOT (value FOR key IN ({', '.join(all_keys)}))"
    return {
        "pol_filter_types": _pol_sql("SELECT doc_id, slug, n_failed = 0 AND n_triggered = 0 AS is_eligible, n_failed, n_triggered"),
        "tq_mostly_empty": f"SELECT doc_id, {_EMPTY} AS mostly_empty FROM {_T}",
        "tq_garbage": f"SELECT doc_id, ({_REASON}) IS NOT NULL AS garbage FROM {_T}",
        "tq_garbage_reason": f"SELECT doc_id, {_REASON} AS reason FROM {_T}",
        "tq_ocr_quality": f"SELECT doc_id, {_OCR} AS quality FROM {_T}",
        "tq_needs_ocr": f"SELECT doc_id, length(t) < 200 OR {_EMPTY} OR ({_REASON}) IS NOT NULL AS needs_ocr FROM {_T}",
        **{f"sig_{k}": f"WITH {STATEMENTS_SQL}, {_SIG_SQL} SELECT doc_id, {k} AS value FROM sig" for k in _SIG_KEYS},
        "sig_prepare": f"SELECT doc_id, least(length(coalesce(text, '')), 200000) AS text_length, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE len(string_split({_strip('substr(text, 1, 200000)')}, chr(10))) END AS line_count FROM documents",
        "sig_keyword_set": "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'the ') AS any_hit, contains(lower(text), 'of') AND contains(lower(text), 'the') AS all_hit, FALSE AS \"none\" FROM documents",
        "sig_regex_set": "SELECT doc_id, regexp_matches(text, '(?im)^the ') AS any_hit, regexp_matches(text, '(?i)th') AND regexp_matches(text, '[0-9]{3}') AS all_hit, FALSE AS invalid FROM documents",
        "sig_dispatch": unpivot,
        "sig_compute_all_report": f"SELECT key, CASE WHEN key LIKE 'has_%' THEN 'user' ELSE 'builtin' END AS source, sum((value > 0)::BIGINT)::BIGINT AS n_positive, sum(value) AS total FROM ({unpivot}) GROUP BY key",
        "feat_extract": rf"""WITH {STATEMENTS_SQL}, p AS (SELECT doc_id, text, regexp_replace(text, '[ \t]+', ' ', 'g') AS t FROM stmt), q AS (SELECT *, string_split(trim(t), chr(10)) AS l FROM p)
 SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '{P.DATE}') AND regexp_matches(x, '{P.EURO_AMOUNT}'))) AS txn_rows, {_count('t', P.DATE)} AS date_count, {_count('t', P.EURO_AMOUNT)} AS amount_count, length(text) AS text_length, len(l) AS line_count FROM q""",
        "feat_pii_normalize": rf"WITH {STATEMENTS_SQL} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{P.LOOSE_IBAN}', '__IBAN__', 'g'), '{P.DATE}', '__DATE__', 'g'), '{P.EURO_AMOUNT}', '__AMOUNT__', 'g'), '[ \t]+', ' ', 'g')) AS text FROM stmt",
        "feat_helpers": "SELECT doc_id, TRUE AS no_keyword, TRUE AS no_pattern, contains(lower(text), 'the') AS keyword FROM documents",
        "pol_eligibility": _ELIGIBILITY_SQL,
        "pol_preview": _preview_sql("TRUE"),
        "pol_preview_mcp": _preview_sql("FALSE"),
        "pol_requirement": f"WITH {STATEMENTS_SQL}, {_SIG_SQL} SELECT doc_id, date_count = 3 AS eq, date_count <> 3 AS ne, date_count >= 3 AS ge, date_count <= 3 AS le, date_count > 3 AS gt, date_count < 3 AS lt, TRUE AS missing_is_zero FROM sig",
        "pol_parse": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(format('{:.2f}', value % 1) AS DOUBLE) ELSE 0.85::DOUBLE END AS min_confidence, 0.1::DOUBLE AS min_margin, TRUE AS enabled FROM events",
        "pol_validate": "SELECT event_id, value / 10 BETWEEN 0 AND 1 AS limit_ok, event_id % 7 <> 6 AS op_ok FROM events",
        "pol_pick_trained": _PICK_SQL,
        "pol_accept_trained": f"SELECT event_id, coalesce(confidence >= 0.85::DOUBLE AND confidence - second >= 0.1::DOUBLE, FALSE) AS accepted FROM ({_PICK_SQL})",
        "pol_unknown": f"SELECT event_id, coalesce(method, 'unknown') AS label, coalesce(confidence, 0.0::DOUBLE) AS confidence FROM ({_PICK_SQL})",
    }
