"""The relational surface over subjects, documents, types and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def risk_band(score: Column) -> Column:
    """Null stays null; 70, 50 and 25 are the limits of the analysis' own levels."""
    return F.when(score >= 70, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").when(score.isNotNull(), "LOW")


#: The bands by which the list is filtered, which end elsewhere.
FILTER_BANDS = {"LOW": (0, 25), "MEDIUM": (25, 50), "HIGH": (50, 75), "CRITICAL": (75, 101)}


def page(docs: DataFrame, subjects: DataFrame, where: dict, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the documents that equal all given values, with their subjects' names, latest first."""
    for column, value in where.items():
        if value is not None:
            docs = docs.where(F.col(column) == value)
    rows = docs.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(max(1, min(limit, 200)))
    names = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    return rows.join(names, "subject_id", "left")


def duplicate_of(docs: DataFrame, key: str = "sha256") -> DataFrame:
    """Adds the smallest other id with the same key.

    Groups are reduced to their two smallest ids, so a group of any size passes as two rows a task.
    """
    least = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    many = least.where("_n > 1")
    second = docs.join(many, key).where("id <> _first").groupBy(key).agg(F.min("id").alias("_second"), F.first("_first").alias("_first"))
    return docs.join(second, key, "left").withColumn("duplicate_of", F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))).drop("_first", "_second")


def missing_required(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds the required fields of a document's type that its metadata lacks or has null; none without a type or metadata."""
    need = fields.where("required").groupBy("slug").agg(F.array_sort(F.collect_list("key")).alias("_keys"))
    d = docs.join(F.broadcast(need), "slug", "left")
    gone = F.filter("_keys", lambda k: F.try_element_at(F.col("metadata"), k).isNull())
    empty = F.array().cast("array<string>")
    return d.withColumn("missing", F.when(F.col("metadata").isNull() | (F.size("metadata") == 0), empty).otherwise(F.coalesce(gone, empty))).drop("_keys")


def search_subjects(subjects: DataFrame, text: str, context: str | None = None, limit: int = 20) -> DataFrame:
    """Subjects whose normalised name is LIKE %text%, in which % and _ are live."""
    rows = subjects.where(F.col("name_normalized").like(f"%{text}%"))
    if context is not None:
        rows = rows.where(F.col("context") == context)
    return rows.orderBy("name", "id").limit(limit)


def subjects_by_context(subjects: DataFrame, text: str) -> DataFrame:
    """Matching subjects as one list for each context."""
    rows = subjects.where(F.col("name_normalized").like(f"%{text}%"))
    return rows.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("subjects"))


def search_documents(docs: DataFrame, texts: DataFrame, words: str | None, doc_type: str | None = None, min_risk: int | None = None, max_risk: int | None = None, limit: int = 20) -> DataFrame:
    """Filters first, then a case-blind substring in text or file name, then the limit. Null risk is never in a range."""
    if doc_type is not None:
        docs = docs.where(F.col("doc_type") == doc_type)
    if min_risk is not None:
        docs = docs.where(F.col("risk") >= min_risk)
    if max_risk is not None:
        docs = docs.where(F.col("risk") <= max_risk)
    if words:
        hit = F.coalesce(F.lower("text").contains(words.lower()), F.lit(False)) | F.lower("filename").contains(words.lower())
        docs = docs.join(texts.select("id", "text"), "id", "left").where(hit).drop("text")
    return docs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def high_risk(docs: DataFrame, min_risk: int | None = None, level: str | None = None, limit: int = 20) -> DataFrame:
    """By band, or from a least risk (50 unless given). An unknown level filters nothing."""
    band = FILTER_BANDS.get(level or "")
    if band:
        docs = docs.where((F.col("risk") >= band[0]) & (F.col("risk") < band[1]))
    if min_risk is not None or not level:
        docs = docs.where(F.col("risk") >= (50 if min_risk is None else min_risk))
    return docs.orderBy(F.desc("risk"), F.desc("created_at"), F.desc("id")).limit(limit).withColumn("level", risk_band(F.col("risk")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], guarded: str | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys, column by column where not null.

    guarded: a boolean column of old; rows for which it is true are left as they are.
    """
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns], F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, keys, "full")
    locked = F.coalesce(F.col(guarded), F.lit(False)) if guarded else F.lit(False)
    pick = lambda c: F.when(locked, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) if c in new.columns else F.col(c)
    return j.select(*keys, *[pick(c) for c in rest])


def create_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose keys are not taken, the first of each by all columns."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))
    return fresh.withColumn("_t", turn).where("_t = 1").drop("_t")


def training_feedback(docs: DataFrame) -> DataFrame:
    """Documents that may train: done, confirmed or rejected with a type, not unknown; the label is the corrected or predicted type."""
    label = F.when(F.col("feedback") == "rejected", F.coalesce("corrected", "predicted")).otherwise(F.col("predicted"))
    return docs.where("status = 'done' and feedback in ('confirmed', 'rejected')").withColumn("label", label).where("label <> 'unknown'")


def latest_by_id(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists of documents merged by id; the second wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    cols = [c for c in first.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*cols), "_o").alias("r")).select("id", "r.*")


def types_by_policy(types: DataFrame, has_policy: bool | None = None) -> DataFrame:
    """Document types (slug, name, policy, ...) in the order of their names: all, those with a policy, or those without; an empty object counts as none."""
    has = F.col("policy").isNotNull() & (F.col("policy") != "{}")
    d = types if has_policy is None else types.where(has if has_policy else ~has | F.col("policy").isNull())
    return d.withColumn("with_policy", F.coalesce(has, F.lit(False))).orderBy("name")


def taken(checks: DataFrame, types: DataFrame) -> DataFrame:
    """For each (name, except_slug) how many types bear the name, whatever its case, under another slug; a null slug excepts none."""
    c = checks.select("name", "except_slug", F.lower("name").alias("_n"))
    # Counted per name and per name and slug, so that no pair of types is made.
    per = types.groupBy(F.lower("name").alias("_n")).agg(F.count("*").alias("all"))
    own = types.groupBy(F.lower("name").alias("_m"), F.col("slug").alias("_s")).agg(F.count("*").alias("own"))
    j = c.join(per, "_n", "left").join(own, (F.col("_n") == F.col("_m")) & (F.col("except_slug") == F.col("_s")), "left")
    return j.select("name", "except_slug", (F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("n"))
