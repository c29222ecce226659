"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Of each document floor(target / size of its source) whole copies are certain. The rest is an order
sample with unequal probabilities: a document's rank is odds(u) / odds(pi), with u a uniform number
hashed from its id and pi its chance of one more copy. pi falls with the document's length, as
1 / (binary digits of its size) up to 1, so that the same words come from more documents; it is
scaled so that the words expected are those still missing. Where pi is 1 the copy is certain too.
The sample's size is fixed, in words: documents are taken by rank until the missing words are
reached. The cut falls at the document that crosses the middle, so a source ends within half a
document of its target.

No source is ever sorted in one task: ranks are counted in two levels of 1,024 bins, and only the
documents of the one cell that holds the cut are ordered. A repeated row shares its rank with its
twin, and both are taken or neither. A null text has size 0, a null source is a source of its own
(last), an empty table gives an empty result. Null ids share one number u. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle, word_count

BINS = 1024


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) hashed from a key: 52 bits of MD5, so other engines can repeat it."""
    hexa = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(hexa, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of a table (source, size): source_size and target.

    The level at which weighted shares fill the total under the caps is the greatest of the levels
    reached by capping the sources in the order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: what these windows order is as long as the list of sources.
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(turn) - 1) % len(weights)
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when(nth == i, F.lit(float(x))).otherwise(w)
    per = per.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (F.lit(share) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


#: Tables of at most so many sources are sent to every task; with more, documents are joined to their source by shuffle.
FEW = 100_000


def _small(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def digits(size: Column) -> Column:
    """Binary digits of a size, 1 for none."""
    return F.length(F.bin(size))


def chances(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Adds to sources (source, source_size, rest, ...) the map `pis` from a document's digits to its chance of one more copy.

    Per source there is a row for each number of digits. The scale is found like the level of
    targets(): of the scales reached by giving the shortest documents a chance of 1, it is the greatest.
    """
    kinds = sizes.groupBy("source", digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words"))
    kinds = kinds.withColumnRenamed("source", "s0").join(per.select("source", "rest"), F.col("s0").eqNullSafe(F.col("source"))).drop("s0")
    order = Window.partitionBy("source").orderBy("digits")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    shares = F.sum(F.col("words") / F.col("digits")).over(after)
    kinds = kinds.withColumn("scale", F.max(F.when(shares > 0, left / shares)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pi = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("scale", F.lit(0.0))) / F.col("digits"))
    maps = kinds.groupBy(F.col("source").alias("s0")).agg(F.map_from_entries(F.collect_list(F.struct("digits", pi.alias("pi")))).alias("pis"))
    return per.join(maps, F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0")


def _ranked(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Joins each row with its source's figures and ranks it."""
    odds = lambda p: p / (F.lit(1.0) - p)
    j = sizes.join(per, sizes["source"].eqNullSafe(per["source"]), "left").drop(per["source"])
    j = j.withColumn("pi", F.try_element_at("pis", digits(F.col("size")))).drop("pis")
    xi = F.when(F.col("pi") >= 1, F.lit(0.0)).when(F.col("pi") > 0, odds(F.col("u")) / odds(F.when(F.col("pi") < 1, F.col("pi"))))
    j = j.withColumn("xi", xi)
    z = F.col("xi") / (F.lit(1.0) + F.col("xi")) * BINS
    return j.withColumn("b1", F.floor(z).cast("int")).withColumn("b2", F.floor((z - F.floor(z)) * BINS).cast("int"))


def _cell(rows: DataFrame, per: DataFrame, bin_col: str) -> DataFrame:
    """The bin of each source in which the cut lies, and the words before it."""
    sums = rows.where("xi is not null").groupBy("source", bin_col).agg(F.sum("size").alias("in_bin"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy(bin_col)
    sums = sums.withColumn("upto", F.col("base") + F.sum("in_bin").over(w))
    hit = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("in_bin") <= F.col("rest")))
    return hit.select("source", F.col(bin_col).alias("cell"), (F.col("upto") - F.col("in_bin")).alias("at"))


def plan(sizes: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (source, size, u): per source its size, target, whole copies and the rank up to which one more is taken.

    sizes is read a few times and should be a table.
    """
    per = targets(sizes, weights, share, most)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(r)).withColumn("rest", F.col("target") - F.floor(r) * F.col("source_size")).withColumn("base", F.lit(0).cast("long"))
    per = settle(chances(sizes, settle(per, "mix-targets")), "mix-sources")
    few = per.count() <= FEW
    rows = _ranked(sizes, _small(per, few))
    one = settle(_cell(rows, per, "b1"), "mix-cell")
    same = rows["source"].eqNullSafe(one["source"])
    inside = rows.join(_small(one, few), same & (rows["b1"] == one["cell"])).drop(one["source"]).withColumn("base", F.col("at")).drop("cell", "at")
    two = settle(_cell(inside, per, "b2"), "mix-cell")
    fine = inside.join(_small(two, few), inside["source"].eqNullSafe(two["source"]) & (inside["b2"] == two["cell"])).drop(two["source"])
    fine = fine.groupBy("source", "xi").agg(F.sum("size").alias("tied"), F.first("at").alias("at"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("xi").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("at", F.col("at") + F.coalesce(F.sum("tied").over(before), F.lit(0)))
    fine = fine.where(F.col("at") + F.col("tied") / F.lit(2.0) <= F.col("rest"))
    cut = fine.groupBy("source").agg(F.max("xi").alias("last"))
    # A source whose cell gave no document is cut where the cell begins.
    cells = one.select(F.col("source").alias("s1"), F.col("cell").alias("b1"))
    per = per.join(cells, per["source"].eqNullSafe(F.col("s1")), "left").drop("s1")
    cells = two.select(F.col("source").alias("s2"), F.col("cell").alias("b2"))
    per = per.join(cells, per["source"].eqNullSafe(F.col("s2")), "left").drop("s2")
    cut = cut.withColumnRenamed("source", "s3")
    per = per.join(cut, per["source"].eqNullSafe(F.col("s3")), "left").drop("s3", "base")
    per = settle(per.withColumnsRenamed({"b1": "cut1", "b2": "cut2"}).withColumn("base", F.lit(0).cast("long")), "mix-plan")
    return _small(per, few)


def copies(per_source: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds `copies` to rows (source, size, u, ...)."""
    rows = _ranked(sizes, per_source)
    cell = F.struct("b1", "b2")
    cut = F.struct("cut1", "cut2")
    # Without a cell nothing is in excess: all ranked documents are taken (the rest is 0 or the whole source).
    more = F.when(F.col("xi").isNull(), 0).when(F.col("cut1").isNull(), F.when(F.col("rest") > 0, 1).otherwise(0))
    more = more.when(F.col("cut2").isNull(), (F.col("b1") < F.col("cut1")).cast("int"))
    more = more.when(cell < cut, 1).when(cell > cut, 0).otherwise(F.coalesce(F.col("xi") <= F.col("last"), F.lit(False)).cast("int"))
    return rows.withColumn("copies", (F.col("whole") + more).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Per row: the id, size, source_size, target, copies and taken = size * copies."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"))
    sizes = settle(sizes, "mix-sizes")
    out = copies(plan(sizes, weights, share, most), sizes)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of docs as often as it has copies, with the columns of docs.

    The rows are judged as mix() judges them; only the sources' figures are joined to the texts.
    """
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"))
    per = plan(settle(sizes, "mix-sizes"), weights, share, most)
    whole = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = copies(per, whole)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST(concat('0x', substr(md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS r FROM s3),
s5 AS (SELECT *, floor(r) AS whole, target - floor(r) * source_size AS rest FROM s4),
k0 AS (SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
k1 AS (SELECT k0.*, rest - coalesce(sum(words) OVER (PARTITION BY k0.source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing,
    sum(words / digits::DOUBLE) OVER (PARTITION BY k0.source ORDER BY digits ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM k0 JOIN s5 ON k0.source IS NOT DISTINCT FROM s5.source),
k2 AS (SELECT *, max(CASE WHEN shares > 0 THEN missing / shares END) OVER (PARTITION BY source) AS scale FROM k1),
k3 AS (SELECT source, digits, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(scale, 0.0::DOUBLE)) / digits) AS pi FROM k2),
j AS (SELECT d.*, source_size, target, whole, rest, CASE WHEN pi >= 1 THEN 0.0::DOUBLE WHEN pi > 0 THEN (u / (1.0::DOUBLE - u)) / (pi / (1.0::DOUBLE - pi)) END AS xi
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN k3 ON d.source IS NOT DISTINCT FROM k3.source AND length(bin(d.size)) = k3.digits),
g AS (SELECT source, xi, sum(size) AS tied, any_value(rest) AS rest FROM j WHERE xi IS NOT NULL GROUP BY source, xi),
h AS (SELECT *, coalesce(sum(tied) OVER (PARTITION BY source ORDER BY xi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
c AS (SELECT source, max(xi) AS last FROM h WHERE before + tied / 2.0 <= rest GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN xi <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j LEFT JOIN c ON j.source IS NOT DISTINCT FROM c.source
"""
