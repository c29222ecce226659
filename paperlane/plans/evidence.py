"""Queries over evidence in pages, and over what of chunks is shown to a model. A customer's statements are their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import candidates as C
from ..operators import relevance as L
from ..sources.corpus import STATEMENTS_SQL, statements, table
from .fields import YEAR
from .relevance import FIELDS

IBAN = [L.Field("iban", "IBAN", "iban")]


def _pages(spark, sf_dir):
    s = statements(spark, sf_dir)
    return s.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


def _by_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("doc_id"))
    return statements(spark, sf_dir).withColumnRenamed("doc_id", "order").join(o, "order")


def fx_clip(spark, sf_dir):
    """Customers' statements, one text for each, clipped around the IBAN that tells most."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n\n")
    return L.clipped(_by_customer(spark, sf_dir).groupBy("doc_id").agg(text.alias("chunk")), IBAN, YEAR)


def fx_prompt_pack(spark, sf_dir):
    """Customers' statements packed to prompts of 4,200 characters."""
    part = (F.row_number().over(Window.partitionBy("doc_id").orderBy("order")) - 1).alias("part")
    chunks = _by_customer(spark, sf_dir).select("doc_id", part, F.col("order").alias("page"), F.col("text").alias("chunk"))
    d = L.pack_prompt(chunks, FIELDS, YEAR)
    told = F.transform("told", lambda x: F.concat_ws(":", x["part"], x["size"], x["included"], x["reason"]))
    return d.select("doc_id", "prompt", F.array_join(told, " ").alias("told"))


def fx_fix_pages(spark, sf_dir):
    """Spans moved to the page that holds their quote, or most of its words; short quotes and those of nowhere stay."""
    kind = (F.col("doc_id") % 5).cast("int")
    number = F.col("doc_id").cast("string")
    quote = F.get(F.array(F.lower("iban"), F.lit("IBAN"), F.concat(F.lit("Rekeningafschrift nummer "), number), F.lit("nergens te vinden"), F.concat(F.lit("rekeningafschrift "), number)), kind)
    spans = statements(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3 - 1).cast("int").alias("page"), quote.alias("quote"), F.lit("iban").alias("field"))
    spans = spans.withColumn("page", F.when(F.col("page") >= 0, F.col("page")))
    return C.fixed_pages(_pages(spark, sf_dir), spans).select("doc_id", "page", "quote", "field")


def fx_verify(spark, sf_dir):
    """How values are borne out: by spans, sound or not, and in eight forms that pages have or lack."""
    kind = (F.col("doc_id") % 9).cast("int")
    n = F.col("doc_id").cast("string")
    value = F.get(F.array(F.lower("iban"), F.col("iban"), F.lit("nergens"), F.concat(F.lit("Rekeningafschrift  "), n), F.concat(F.lit(" rekeningafschrift\t"), n), F.concat(n, F.lit(",0")), F.lit("elders"), F.lit("elders"), F.lit("  ")), kind)
    span = lambda a, b: F.when(kind == 6, a).when(kind == 7, b)
    v = statements(spark, sf_dir).select("doc_id", value.alias("value"), span(F.lit(1), F.lit(0)).alias("page"), span(F.lit(0), F.lit(5)).alias("start"), span(F.lit(4), F.lit(500)).alias("end"))
    return C.verified(_pages(spark, sf_dir), v)


_NAMES = "fx_clip fx_prompt_pack fx_fix_pages fx_verify"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    stmt = f"WITH RECURSIVE {STATEMENTS_SQL}"
    customers = "s AS (SELECT o_custkey AS doc_id, o_orderkey AS page, text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS part FROM stmt JOIN orders ON stmt.doc_id = o_orderkey)"
    # A window's score: 10 for the label, 8 for each line of three words or more with a digit.
    score = lambda a, b: f"10 + 8 * len(list_filter(string_split(substr(t, {a} + 1, {b} - {a}), chr(10)), lambda x: len(regexp_extract_all(x, '\\S+')) >= 3 AND regexp_matches(x, '\\d')))"
    at = "concat('[chunk ', part + 1, ', page ', page + 1, ', fields: ', CASE WHEN contains(lower(text), 'boeking') THEN 'boeking, ' ELSE '' END, 'part, rekening]', chr(10))"
    return {
        "fx_clip": f"""{stmt}, {customers}, c AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS t FROM s GROUP BY doc_id),
 p AS (SELECT doc_id, t, length(t) AS n, unnest(range(0, length(t))) AS i FROM c WHERE length(t) > 2200), pl AS (SELECT * FROM p WHERE substr(t, i + 1, 4) = 'IBAN'),
 w AS (SELECT *, greatest(0, min(i) OVER (PARTITION BY doc_id) - 1500) AS a, least(n, max(i) OVER (PARTITION BY doc_id) + 800) AS b FROM pl),
 g AS (SELECT *, {score("greatest(a, i - 1500)", "least(b, i + 800)")} AS score FROM w),
 m AS (SELECT doc_id, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, arg_max(i, score * 1000000 - i) AS i FROM g GROUP BY doc_id)
 SELECT c.doc_id, CASE WHEN m.doc_id IS NULL THEN t WHEN b - a <= 2200 THEN regexp_replace(substr(t, a + 1, b - a), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(substr(t, greatest(0, least(greatest(0, i - 1100), n - 2200)) + 1, 2200), '^\\s+|\\s+$', '', 'g') END AS chunk
 FROM c LEFT JOIN m USING (doc_id)""",
        "fx_prompt_pack": f"""{stmt}, {customers}, x AS (SELECT doc_id, part, text, {at} AS head, length(text) AS size, length({at}) + length(text) + 2 AS n FROM s),
 r AS (SELECT doc_id, part, CAST(n AS BIGINT) AS used, TRUE AS fits FROM x WHERE part = 0
  UNION ALL SELECT x.doc_id, x.part, CASE WHEN r.used + x.n <= 4200 THEN r.used + x.n ELSE r.used END, r.used + x.n <= 4200 FROM r JOIN x ON x.doc_id = r.doc_id AND x.part = r.part + 1)
 SELECT x.doc_id, string_agg(head || text, chr(10) || chr(10) ORDER BY part) FILTER (fits) AS prompt, string_agg(concat(part, ':', size, ':', CASE WHEN fits THEN size ELSE 0 END, ':', CASE WHEN fits THEN 'included' ELSE 'dropped_prompt_budget' END), ' ' ORDER BY part) AS told
 FROM x JOIN r USING (doc_id, part) GROUP BY x.doc_id""",
        "fx_fix_pages": f"""{stmt}, q AS (SELECT doc_id, iban, doc_id % 5 AS k, CASE doc_id % 3 WHEN 0 THEN NULL ELSE (doc_id % 3 - 1)::INT END AS old FROM stmt)
 SELECT doc_id, CASE k WHEN 0 THEN 1 WHEN 2 THEN CASE WHEN doc_id >= 1000 THEN 0 ELSE old END WHEN 4 THEN 0 ELSE old END AS page,
 CASE k WHEN 0 THEN lower(iban) WHEN 1 THEN 'IBAN' WHEN 2 THEN concat('Rekeningafschrift nummer ', doc_id) WHEN 3 THEN 'nergens te vinden' ELSE concat('rekeningafschrift ', doc_id) END AS quote, 'iban' AS field FROM q""",
        "fx_verify": f"""{stmt}, q AS (SELECT doc_id, iban, doc_id % 9 AS k FROM stmt)
 SELECT doc_id, CASE k WHEN 0 THEN lower(iban) WHEN 1 THEN iban WHEN 2 THEN 'nergens' WHEN 3 THEN concat('Rekeningafschrift  ', doc_id) WHEN 4 THEN concat(' rekeningafschrift', chr(9), doc_id) WHEN 5 THEN concat(doc_id, ',0') WHEN 8 THEN '  ' ELSE 'elders' END AS value,
 CASE WHEN k IN (0, 1) THEN 'auto_found' WHEN k IN (3, 4) THEN 'auto_found_normalized' WHEN k = 5 THEN 'auto_found_number_format' WHEN k = 6 THEN 'evidence' ELSE 'none' END AS method,
 CASE WHEN k IN (0, 1, 6) THEN 1 WHEN k IN (3, 4, 5) THEN 0 END AS page,
 CASE WHEN k IN (0, 1) THEN iban WHEN k = 3 THEN concat('Rekeningafschrift ', doc_id) WHEN k = 4 THEN concat('rekeningafschrift ', doc_id) WHEN k = 5 THEN CAST(doc_id AS VARCHAR) WHEN k = 6 THEN 'IBAN' END AS snippet FROM q""",
    }
