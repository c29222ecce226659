"""Queries over search text, labels in lines, model records and results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..functions import jsonrepair as J
from ..functions import text as T
from ..functions import values as V
from ..operators import candidates as Cand
from ..operators import catalog as C
from ..operators import fraud as R
from ..operators import rules
from ..sources.corpus import STATEMENTS_SQL, statements, table
from .flow import MARKERS


def ascii_fold(text):
    """NFKD, then without what is beyond ASCII, in lower case; null stays null."""
    return F.lower(F.regexp_replace(T.unicode_form(text, "NFKD"), r"[^\x00-\x7F]", ""))


def norm_text(spark, sf_dir):
    """Names as they are compared: characters taken apart, those beyond ASCII removed, lower case."""
    d = table(spark, sf_dir, "documents")
    t = ascii_fold(F.col("text"))
    return d.select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.regexp_count("t", F.lit("[a-z]")).alias("letters"))


def norm_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(F.filter(F.split(T.search_text(F.col("p_name")), " "), lambda w: F.length(w) >= 2), " ").alias("words"))


def fx_regex_filter(spark, sf_dir):
    """A value cut down to its pattern's match; without one it is dropped."""
    p = table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("nr "), F.col("p_partkey"), F.lit(" x"))).otherwise("geen")
    return p.select("p_partkey", V.pattern_match(value, r"^\d+$").alias("value"))


def snk_finalize(spark, sf_dir):
    """Documents with the results of their stages."""
    s = statements(spark, sf_dir).select("doc_id", rules.strong(F.col("text"), [rules.parse_hints("statement", "kw:iban\nnot:boeking")]).alias("slug"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("cast(floor(o_totalprice) as bigint) % 101").alias("risk"))
    return o.join(s, "doc_id", "left").select("doc_id", F.coalesce("slug", F.lit("unknown")).alias("slug"), "risk", C.risk_band(F.col("risk")).alias("level"), F.when(F.col("slug").isNull(), "error").otherwise("done").alias("status"))


def _rows(spark, sf_dir):
    c = table(spark, sf_dir, "supplier")
    old = c.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("pattern"), (F.col("s_suppkey") % 2 == 0).alias("active"))
    new = c.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.lower("s_name").alias("pattern"), F.lit(True).alias("active"))
    return old, new


def rel_skip_crud(spark, sf_dir):
    old, new = _rows(spark, sf_dir)
    return C.upsert(old, new, ["key"])


def rel_type_fields_crud(spark, sf_dir):
    """New rows whose key is taken are refused."""
    old, new = _rows(spark, sf_dir)
    return C.create_unique(old, new, ["key"]).select("key", "pattern")


def src_batch(spark, sf_dir):
    """Batches of at most 50 files with as many references as files."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.count_if(F.col("l_returnflag") != "R").alias("references")).select("l_orderkey", ((F.col("files") <= 50) & ((F.col("references") == 0) | (F.col("references") == F.col("files")))).alias("accepted"))


def _marks() -> str:
    return json.dumps(sorted([list(m) for m in MARKERS]))


def prep_skip_signature(spark, sf_dir):
    """The signature of the markers under which cached texts were cut, kept with each file's hash."""
    sign = hashlib.sha256(_marks().encode()).hexdigest()[:8]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", F.sha2("text", 256), F.lit(sign)).alias("cache_key"))


def fx_evidence_repair(spark, sf_dir):
    """Evidence that lacks its value repaired from lines of a table, from one long line, by the normal form, or not at all."""
    s = statements(spark, sf_dir)
    e = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("IBAN: "), "iban")).otherwise("geen")
    kind = F.col("doc_id") % 5
    value = F.when(kind == 0, "NL00NIET").when(kind == 1, F.lower("iban")).when(kind == 2, "--").otherwise(F.col("iban"))
    normal = F.when(kind != 0, F.col("iban"))
    chunk = F.when(kind == 3, F.concat(F.repeat(F.lit("x "), 40), "iban", F.repeat(F.lit(" y"), 40))).otherwise(F.col("text"))
    return s.select("doc_id", Cand.repaired_evidence(value, normal, e, chunk, 30).alias("evidence"))


_NAMES = "fx_evidence_repair norm_text norm_tokens fx_regex_filter snk_finalize rel_skip_crud rel_type_fields_crud src_batch prep_skip_signature"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    stmt = f"WITH {STATEMENTS_SQL}"
    n = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    bands = "CASE WHEN risk >= 70 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
    return {
        "prep_skip_signature": f"SELECT doc_id, concat_ws(':', sha256(text), substr(sha256('{_marks()}'), 1, 8)) AS cache_key FROM documents",
        "fx_evidence_repair": f"{stmt} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN concat('IBAN: ', iban) WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN concat('IBAN: ', iban) ELSE 'geen' END WHEN doc_id % 5 = 3 THEN concat(repeat('x ', 15), iban, repeat(' y', 15)) ELSE array_to_string(string_split(text, chr(10))[1:4], chr(10)) END AS evidence FROM stmt",
        "norm_tokens": f"SELECT p_partkey, array_to_string(list_filter(string_split({n('p_name')}, ' '), lambda w: length(w) >= 2), ' ') AS words FROM part",
        "fx_regex_filter": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey AS VARCHAR) END AS value FROM part",
        "snk_finalize": f"{stmt}, o AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk FROM orders) SELECT o.doc_id, CASE WHEN ok THEN 'statement' ELSE 'unknown' END AS slug, risk, {bands} AS level, CASE WHEN ok THEN 'done' ELSE 'error' END AS status FROM o LEFT JOIN (SELECT doc_id, NOT contains(lower(text), 'boeking') AS ok FROM stmt) s USING (doc_id)",
        "rel_skip_crud": "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE s_name END AS pattern, s_suppkey % 2 = 0 AS active FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0",
        "rel_type_fields_crud": "SELECT s_suppkey AS key, lower(s_name) AS pattern FROM supplier WHERE s_suppkey % 6 = 0",
        "src_batch": "SELECT l_orderkey, count(*) <= 50 AND count(*) FILTER (l_returnflag <> 'R') IN (0, count(*)) AS accepted FROM lineitem GROUP BY l_orderkey",
    }
