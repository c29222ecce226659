"""The processing queue as Structured Streaming, and its state in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("queued", "sniffing", "extracting_text", "classifying", "extracting_metadata", "risk_analysis", "done")


def progress(stage: Column, page: Column, pages: Column) -> Column:
    """Per cent done; text extraction runs from 10 to 45 with its pages."""
    fixed = F.create_map(*[F.lit(x) for kv in {"queued": 0, "sniffing": 10, "classifying": 45, "extracting_metadata": 60, "risk_analysis": 85, "done": 100}.items() for x in kv])
    return F.when(stage == "extracting_text", F.floor(10 + (page + 1) / pages * 35).cast("int")).otherwise(fixed[stage])


def latest(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last event of each key."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, tie)).alias("e")).select(key, "e.*")


def read_queue(spark: SparkSession, folder: str, schema: str, per_trigger: int = 50) -> DataFrame:
    """Jobs as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deduplicated(jobs: DataFrame, key: str, at: str, wait: str = "1 hour") -> DataFrame:
    """A job named twice within the wait runs once; the state is dropped with the watermark."""
    return jobs.withWatermark(at, wait).dropDuplicatesWithinWatermark([key])


def run_jobs(jobs: DataFrame, process: Callable[[DataFrame], DataFrame], cancelled: Callable[[], DataFrame], key: str, out: str, checkpoint: str):
    """Processes each micro-batch but for what is cancelled by then. The checkpoint stands for a queue's restart; the batch number makes a repeated write the same."""

    def each(batch: DataFrame, number: int) -> None:
        done = process(batch.join(cancelled(), key, "left_anti"))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def webhook_payload(doc_id: Column, status: Column, slug: Column, confidence: Column, error: Column) -> Column:
    """What a callback is sent; the confidence is rounded to four places, an error cut at 1,000 characters."""
    return F.to_json(F.struct(doc_id.alias("document_id"), status.alias("status"), slug.alias("doc_type"), F.round(confidence, 4).alias("confidence"), F.substring(error, 1, 1000).alias("error")))


#: What a cancelled document says, and the columns that a document of its own analysis has.
CANCELLED = "Geannuleerd door gebruiker"
RESULTS = ("doc_type_slug", "doc_type_confidence", "risk_score")


def after_requests(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """The documents after requests to reprocess, analyse anew or cancel them, with queued, whether they are to be run.

    documents has doc_id, status, progress, stage, error_message and any of RESULTS; requests has request_id, doc_id, action
    (reprocess, analyse, cancel; others count for nothing) and at. The last request decides status and error, of equal times the
    greatest request_id. A reprocess or analysis at any time sets progress and stage back, an analysis takes the results away;
    a cancel later on leaves that so. Requests for unknown or null documents change nothing, those of one document meet by
    grouped maxima, so that one asked for very often is no group in one task.
    """
    is_ = lambda *a: F.col("action").isin(*a)
    r = requests.where(is_("reprocess", "analyse", "cancel") & F.col("doc_id").isNotNull())
    last = F.max_by("action", F.struct("at", "request_id")).alias("_last")
    r = r.groupBy(F.col("doc_id").alias("_id")).agg(last, F.max(is_("reprocess", "analyse")).alias("_reset"), F.max(is_("analyse")).alias("_anew"))
    d = documents.join(r, F.col("doc_id") == F.col("_id"), "left")
    reset, anew, gone = F.coalesce("_reset", F.lit(False)), F.coalesce("_anew", F.lit(False)), F.coalesce(F.col("_last") == "cancel", F.lit(False))
    asked = F.col("_last").isNotNull()
    new = {
        "status": F.when(gone, "error").when(asked, "queued").otherwise(F.col("status")),
        "error_message": F.when(gone, CANCELLED).when(~asked, F.col("error_message")),
        "progress": F.when(reset, 0).otherwise(F.col("progress")),
        "stage": F.when(~reset, F.col("stage")),
    }
    new |= {c: F.when(~anew, F.col(c)) for c in RESULTS if c in documents.columns}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns], (asked & ~gone).alias("queued"))


def finished(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Jobs (doc_id, failure, status, callback_url and others) that ran, with status, error_message, event and calls_back.

    failure is null where processing came to its end. Those of documents in cancelled (doc_id) did not start and are left out. A
    failure makes a document an error, cut at 1,000 characters, unless it was done already; its event is an error either way.
    Who gave an address is called back about both.
    """
    d = jobs.join(cancelled.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")
    bad = F.col("failure").isNotNull()
    kept = F.coalesce(F.col("status") == "done", F.lit(False))
    status, message = F.when(bad & ~kept, "error").otherwise("done"), F.when(bad & ~kept, F.substring("failure", 1, 1000))
    others = [c for c in jobs.columns if c not in ("failure", "status")]
    return d.select(*others, status.alias("status"), message.alias("error_message"), F.when(bad, "error").otherwise("result").alias("event"), (F.coalesce("callback_url", F.lit("")) != "").alias("calls_back"))
