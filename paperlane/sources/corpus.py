"""Tables of the given folder, and the statement corpus derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank statement for each order: doc_id, iban, text.

    Lines flagged A have no amount and those flagged R no date, so that the signals differ.
    """
    li = table(spark, sf_dir, "lineitem")
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    amount = F.concat(F.lit("€"), F.regexp_replace(F.format_number(F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), 0), ",", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    date = F.date_format("l_shipdate", "dd-MM-yyyy")
    flag = F.col("l_returnflag")
    line = F.concat(F.when(flag == "R", "Boeking").otherwise(date), F.lit("  Part "), F.col("l_partkey").cast("string"), F.when(flag == "A", "").otherwise(F.concat(F.lit("  "), amount)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n")
    d = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(body.alias("body"))
    key = F.lpad(F.col("doc_id").cast("string"), 10, "0")
    check = F.lpad((98 - F.concat(F.lit("11102320"), key, F.lit("232100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    d = d.withColumn("iban", F.concat(F.lit("NL"), check, F.lit("BANK"), key))
    return d.select("doc_id", "iban", F.concat(F.lit("Rekeningafschrift "), F.col("doc_id").cast("string"), F.lit("\nIBAN: "), "iban", F.lit("\n"), "body").alias("text"))


STATEMENTS_SQL = r"""
stl AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, concat(CASE WHEN l_returnflag = 'R' THEN 'Boeking' ELSE strftime(l_shipdate, '%d-%m-%Y') END, '  Part ', l_partkey,
    CASE WHEN l_returnflag = 'A' THEN '' ELSE concat('  €', replace(format('{:,}', CAST(round(l_extendedprice * 100) AS BIGINT) // 100), ',', '.'), ',', lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) END) AS line FROM lineitem),
stb AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n, line) AS body, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS k FROM stl GROUP BY doc_id),
sti AS (SELECT doc_id, body, concat('NL', lpad(CAST(98 - CAST(concat('11102320', k, '232100') AS HUGEINT) % 97 AS VARCHAR), 2, '0'), 'BANK', k) AS iban FROM stb),
stmt AS (SELECT doc_id, iban, concat('Rekeningafschrift ', doc_id, chr(10), 'IBAN: ', iban, chr(10), body) AS text FROM sti)"""
