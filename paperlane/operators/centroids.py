"""Classification by the cosine to class centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each label and its number of samples. Means are taken per position, so no group is collected."""
    rows = vectors.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x"))
    mean = rows.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    g = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("n").alias("samples"))
    return g.select(label, F.transform("c", lambda x: x["x"]).alias("centroid"), "samples")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scores(vectors: DataFrame, table: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (key, label, score): the cosine to each centroid, moved to 0..1. The table has one row for each label."""
    t = table.select(F.col(label).alias("label"), "centroid", F.sqrt(_dot(F.col("centroid"), F.col("centroid"))).alias("cn"))
    v = vectors.select(key, F.col(vector).alias("v"), F.sqrt(_dot(F.col(vector), F.col(vector))).alias("vn"))
    cos = _dot(F.col("v"), F.col("centroid")) / (F.col("vn") * F.col("cn"))
    return v.crossJoin(F.broadcast(t)).select(key, "label", ((cos + 1) / 2).alias("score"))


def context(rows: DataFrame, key: str = "vec_id", n: int = 3) -> DataFrame:
    """The n best labels of each key, the best score and its lead over the second (0 if single)."""
    best = rows.groupBy(key).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", (-F.col("label")).alias("turn"), "label")))), 1, n).alias("m"))
    second = F.get("m", 1)["score"]
    return best.select(key, F.transform("m", lambda x: x["label"]).alias("labels"), F.get("m", 0)["score"].alias("confidence"), F.when(second.isNotNull(), F.get("m", 0)["score"] - second).otherwise(0.0).alias("margin"))


def predict(rows: DataFrame, threshold: float = 0.7, key: str = "vec_id") -> DataFrame:
    """The best label, or null below the threshold."""
    c = context(rows, key, 1)
    return c.select(key, F.when(F.col("confidence") >= threshold, F.get("labels", 0)).alias("label"), "confidence")
