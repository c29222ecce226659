"""Files as sources: checks, names, and the choice among versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import unicode_form
from ..operators.catalog import duplicate_of

MOST_BYTES = 50 * 1024 * 1024
RANK = {"txt": 0, "pdf": 1, "png": 2, "jpg": 3, "jpeg": 4, "docx": 5}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def mime(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in P.MIME_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("application/octet-stream"))


def judged_uploads(found: DataFrame, subjects: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """Uploaded files (id, filename, content, and subject_id with subjects) with length, sha256, mime, reason and duplicate_of; the content goes.

    reason is null for those accepted: type (not on the list), size, empty, or subject (not among the
    subjects, or null). duplicate_of is the smallest other id of the same content, which bars nothing.
    """
    d = found.withColumns({"length": F.length("content").cast("long"), "sha256": F.sha2("content", 256), "mime": mime(F.col("filename"))}).drop("content")
    reason = F.when(F.col("mime") == "application/octet-stream", "type").when(F.col("length") > most, "size").when(F.coalesce("length", F.lit(0)) == 0, "empty")
    if subjects is not None:
        d = d.join(subjects.select("subject_id", F.lit(True).alias("_known")).distinct(), "subject_id", "left")
        reason = reason.when(F.col("_known").isNull(), "subject")
    d = d.withColumn("reason", reason)
    return duplicate_of(d.drop("_known") if subjects is not None else d)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, judged; their path is their id. Spark's reader passes over files without bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    d = judged_uploads(f.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content"))
    return d.select(F.col("id").alias("path"), "filename", "length", "sha256", "mime", "reason")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without those that are none, which Spark's own decoder replaces or refuses; null stays null."""

    @F.pandas_udf("string")
    def work(c: pd.Series) -> pd.Series:
        return c.map(lambda x: bytes(x).decode("utf-8", "ignore"), na_action="ignore")

    return work(content)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as texts (path, text), whole, line ends as they are."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", decoded(F.col("content")).alias("text"))


def safe_name(name: Column) -> Column:
    """A file name without path, control and odd characters, 180 long at most with its extension kept; `upload` if nothing is left."""
    n = F.element_at(F.split(unicode_form(F.regexp_replace(name, "\\x00", ""), "NFKC"), r"[/\\]"), -1)
    n = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(n, r"\p{Cntrl}", ""), r"\s+", " ")), r"[^A-Za-z0-9.\- _()]+", "_")
    ext = F.regexp_extract(n, r"(\.[^.]{1,15})$", 1)
    cut = F.concat(F.substring(F.regexp_replace(n, r"\.[^.]{1,15}$", ""), 1, 160), ext)
    return F.when(F.coalesce(n, F.lit("")).isin("", ".", ".."), "upload").when(F.length(n) > 180, cut).otherwise(n)


def best_version(files: DataFrame, stem: str = "stem", ext: str = "ext") -> DataFrame:
    """One file for each stem: text before PDF before images before Word."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col(ext)]
    cols = [c for c in files.columns if c != stem]
    return files.groupBy(stem).agg(F.min_by(F.struct(*cols), rank).alias("f")).select(stem, "f.*")


def allowed_path(path: Column) -> Column:
    """Whether a path names an artifact of a document: a known folder, no NUL, no way up, not absolute."""
    return path.rlike(r"^(original|text|llm|metadata|risk)/[^/]+$|^fraud_analysis\.json$") & ~path.contains("..") & ~path.contains("\0") & ~path.startswith("/")


def best_rotation(pages: DataFrame) -> DataFrame:
    """Of each page's readings by angle (angle, alnum, words): upright if good enough, else the most 2 * alnum + words, the first of equals."""
    good = (F.col("angle") == 0) & (F.col("alnum") >= 50) & (F.col("words") >= 10)
    order = F.struct(good.alias("good"), (2 * F.col("alnum") + F.col("words")).alias("s"), (-F.col("angle")).alias("turn"))
    return pages.groupBy("doc_id", "page").agg(F.max_by("angle", order).alias("angle"))
