"""Stage results kept as JSON, one row for each document and kind, and what later stages read from them.

An artifact is a row (doc_id, kind, body). Bodies of all kinds of a document meet by one grouped
maximum; of several bodies of one kind the greatest counts. A null body counts as none, a null
doc_id as a document of its own. A body that is no JSON object never fails a job: each reader says
what it does with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fraud import signal


def write_artifacts(artifacts: DataFrame, folder: str) -> None:
    """Writes artifacts as JSON lines in a folder for each kind; kinds that are there already are replaced only as far as they are given."""
    artifacts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").json(folder)


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """What write_artifacts() wrote; reading one kind reads its folder only."""
    return spark.read.schema("doc_id long, body string, kind string").json(folder).select("doc_id", "kind", "body")


def side_by_side(artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows (doc_id, a column for each of the kinds) for documents that have any of them."""
    body = lambda k: F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k)
    return artifacts.where(F.col("kind").isin(*kinds)).groupBy("doc_id").agg(*[body(k) for k in kinds])


def members(body: Column) -> Column:
    """A JSON object's members, nested ones as JSON; null for anything else."""
    return F.when(F.ltrim(body).startswith("{"), F.from_json(body, "map<string, string>"))


def _named(errors: Column, code: str) -> Column:
    """The fields of the errors `code:field`."""
    return F.transform(F.filter(errors, lambda e: e.startswith(code + ":")), lambda e: F.split_part(e, F.lit(":"), F.lit(2)))


def metadata_findings(artifacts: DataFrame) -> DataFrame:
    """Per document with a result, validation or verified artifact: doc_id, ready, invalid_ibans, unverified and signals.

    Findings need both validation and verified; a broken one of the three leaves the document without any. invalid_ibans are the
    fields with such an error. unverified are required fields that validation found without evidence, that the result has and that
    are not marked as verified since. ready tells whether the rules of fields run: there must be a result with members as well.
    """
    d = side_by_side(artifacts, ("result", "validation", "verified"))
    d = d.select("doc_id", F.col("result").isNull().alias("_none"), *[members(F.col(k)).alias(k) for k in ("result", "validation", "verified")])
    whole = F.col("validation").isNotNull() & F.col("verified").isNotNull() & (F.col("_none") | F.col("result").isNotNull())
    errors = F.from_json(F.try_element_at("validation", F.lit("errors")), "array<string>")
    d = d.select("doc_id", whole.alias("_whole"), "result", "verified", F.when(whole, F.coalesce(errors, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("_errors"))
    seen = lambda f: F.coalesce(F.get_json_object(F.try_element_at("verified", f), "$.verified") == "true", F.lit(False))
    has = lambda f: F.coalesce(F.map_contains_key("result", f), F.lit(False))
    missing = F.filter(_named(F.col("_errors"), "missing_verified_required_field"), lambda f: has(f) & ~seen(f))
    d = d.select("doc_id", (F.col("_whole") & (F.coalesce(F.size("result"), F.lit(0)) > 0)).alias("ready"), _named(F.col("_errors"), "invalid_iban").alias("invalid_ibans"), missing.alias("unverified"))
    found = (
        signal(F.size("invalid_ibans") > 0, "invalid_iban", "MEDIUM", 0.7, "context_mismatch"),
        signal(F.size("unverified") > 0, "missing_verified_required_fields", "MEDIUM", 0.6, "context_mismatch"),
    )
    return d.withColumn("signals", F.array_compact(F.array(*found)))


def stored_reports(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per document (doc_id, risk_score, signals_json): doc_id, origin, risk_score and n_signals of the report that is read.

    The cached analysis counts (origin cache), else the risk artifact (artifact), else what the row itself has (database), else
    nothing (null, null and 0). A broken body gives way to the next; rows that name no signals have none to give.
    """
    kept = side_by_side(artifacts, ("fraud", "risk")).withColumnRenamed("doc_id", "_id")
    d = documents.select("doc_id", F.col("risk_score").alias("_score"), "signals_json").join(kept, F.col("doc_id") == F.col("_id"), "left")
    d = d.select("doc_id", "_score", F.from_json("signals_json", "array<string>").alias("_own"), members(F.col("fraud")).alias("_fraud"), members(F.col("risk")).alias("_risk"))
    origin = F.when(F.col("_fraud").isNotNull(), "cache").when(F.col("_risk").isNotNull(), "artifact").when(F.col("_own").isNotNull(), "database")
    body = F.coalesce("_fraud", "_risk")
    listed = F.from_json(F.try_element_at(body, F.lit("signals")), "array<string>")
    d = d.select("doc_id", origin.alias("origin"), "_own", "_score", body.alias("_body"), listed.alias("_listed"))
    score = F.when(F.col("_body").isNotNull(), F.try_element_at("_body", F.lit("risk_score")).try_cast("double")).when(F.col("_own").isNotNull(), F.coalesce("_score", F.lit(0.0)))
    signals = F.when(F.col("_body").isNotNull(), F.col("_listed")).otherwise(F.col("_own"))
    return d.select("doc_id", "origin", score.alias("risk_score"), F.coalesce(F.size(signals), F.lit(0)).alias("n_signals"))
