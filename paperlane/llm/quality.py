"""Quality classifier: document evidence shrunk through host and path by hierarchical empirical Bayes.

Evidence: each measure of a text (see rules.measures) falls into one of a fixed number of bins, and
the labelled documents give the log-likelihood ratio of good to bad for every bin. A site is a
host (a document's source) and, below it, a path (its language). A host's share of good documents
is a Beta posterior around the global share, a path's one around its host's; the strength of each
prior is estimated from how much sites differ beyond chance, so sparse sites lean on what is above
them. A document's probability adds the logit of its path's posterior to its evidence.

Documents fall into two folds by a hash of their id. Each fold is judged by what the labels of the
other one teach, so no document is judged by its own label.

Training takes all labels by grouped aggregation. Collected are, for each fold, two prior strengths
and the table of ratios, which has a row for each measure and bin. A document without labels, a
null label or an unknown site counts for nothing in training and falls back to the level above.
Several labels of one document are averaged and count as good from 0.5. A null or empty text has
its own bin in every measure. A tie at the threshold is kept. Repeated rows are judged alike;
without any label every document is kept. keep_good() passes all columns of the input through,
whatever their names; classify() ignores the others. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .shared import settle

BINS, FOLDS = 24, 2
#: Site tables up to so many rows are sent to every task; larger ones are joined by shuffle.
SMALL = 200_000
#: Documents below this probability are rejected. It is low because a good document lost costs more than a bad one kept.
THRESHOLD = 0.01
#: The capital letters that are counted.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÊÑÓÍÁÚ"


def fold(key: Column) -> Column:
    """0 or 1 by a hash of the id, a null one falling to a fold of its own choice as well."""
    return F.when(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 1) < "8", 0).otherwise(1)


def features(rows: DataFrame) -> DataFrame:
    """From rows with `text`: the other columns, and `bins`, the bin of each measure."""
    d = rules.measures(rows, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(F.lit(0.0))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    values = (
        F.log2(F.col("n_words") + 1) / 20,
        F.col("mean_word_length") / 20,
        F.col("symbol_ratio") / 2,
        F.col("stop_word_ratio"),
        F.col("alpha_word_ratio"),
        F.col("dup_line_ratio"),
        per_word(F.col("n_repeat_words")),
        per_word(F.length(text) - F.length(F.translate(text, "!", ""))),
        F.when(F.col("word_chars") > 0, capitals / F.col("word_chars")).otherwise(F.lit(0.0)),
    )
    one = lambda i, v: (F.lit(i * (BINS + 1)) + F.when(F.col("n_words") == 0, BINS).otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(v * BINS))))).cast("int")
    return d.select(*[c for c in rows.columns if c != "text"], F.array(*[one(i, v) for i, v in enumerate(values)]).alias("bins"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Those rows (fold, id, host, path, bins) that have a label, with good as 0 or 1."""
    mean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_mean"))
    rows = rows.select("fold", "id", "host", "path", "bins")
    return rows.join(mean, rows["id"] == mean["_id"]).withColumn("good", (F.col("_mean") >= 0.5).cast("int")).drop("_id", "_mean")


def ratios(train: DataFrame, alpha: float = 1.0) -> list[dict[int, float]]:
    """For each fold the logarithm of the likelihood ratio of each bin that the other folds met; at most measures * (BINS + 1) of them."""
    n = train.select("fold", F.explode("bins").alias("b"), "good").groupBy("fold", "b").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    out = []
    for f in range(FOLDS):
        table: dict[int, tuple[int, int]] = {}
        for r in n:
            if r.fold != f:
                good, bad = table.get(r.b, (0, 0))
                table[r.b] = (good + r.good, bad + r.n - r.good)
        logs = {}
        for b, (good, bad) in table.items():
            same = [v for k, v in table.items() if k // (BINS + 1) == b // (BINS + 1)]
            all_good, all_bad = sum(g for g, _ in same), sum(x for _, x in same)
            logs[b] = math.log((good + alpha) / (all_good + alpha * (BINS + 1))) - math.log((bad + alpha) / (all_bad + alpha * (BINS + 1)))
        out.append(logs)
    return out


def strength(sites: DataFrame, prior: Column) -> float:
    """How many documents a site's prior is worth, by the method of moments, between 1 and 1e6.

    sites: rows (n, k) whose share k / n is expected around prior.
    """
    p = F.col("k") / F.col("n")
    got = sites.select(F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * F.pow(p - prior, 2)).alias("ss"), F.sum(F.col("n") * prior * (1 - prior)).alias("pq")).first()
    if not got.n or not got.pq:
        return 1e6
    pq, between = got.pq / got.n, got.ss - got.pq * got.sites / got.n  # excess over chance, times n
    tau = between / got.n
    return 1e6 if tau <= 0 else min(1e6, max(1.0, pq / tau - 1))


def site_rates(train: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """Posterior shares of good documents as each fold takes them from the others: tables (f, h, host_rate) and (f, h, p, path_rate), and the global shares."""
    each = settle(train.groupBy("fold", F.col("host").alias("h"), F.col("path").alias("p")).agg(F.count("*").alias("n"), F.sum("good").alias("k")), "quality-paths")
    all_hosts, all_paths, shares = [], [], []
    for f in range(FOLDS):
        paths = each.where(F.col("fold") != f).groupBy("h", "p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
        share = (total.k + 1) / (total.n + 2) if total.n else 0.5
        hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        m = strength(hosts, F.lit(share))
        hosts = hosts.select("h", ((F.col("k") + F.lit(m * share)) / (F.col("n") + F.lit(m))).alias("host_rate"))
        paths = paths.join(hosts.withColumnRenamed("h", "h2"), F.col("h").eqNullSafe(F.col("h2"))).drop("h2")
        m = strength(paths, F.col("host_rate"))
        paths = paths.select("h", "p", ((F.col("k") + F.lit(m) * F.col("host_rate")) / (F.col("n") + F.lit(m))).alias("path_rate"))
        all_hosts.append(hosts.withColumn("f", F.lit(f)))
        all_paths.append(paths.withColumn("f", F.lit(f)))
        shares.append(share)
    union = lambda some, name: settle(some[0].unionByName(some[1]), name)
    return union(all_hosts, "quality-hosts"), union(all_paths, "quality-rates"), shares


def _attach(rows: DataFrame, table: DataFrame, on: Column, few: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if few else table, on, "left")


def score(rows: DataFrame, train: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Turns fold and bins of rows (..., fold, host, path, bins) into evidence, path_rate, p_good and kept."""
    tables = ratios(train)
    hosts, paths, shares = site_rates(train)
    most = max([0, *(b + 1 for t in tables for b in t)])
    by_fold = lambda some: F.when(F.col("fold") == 0, some[0]).otherwise(some[1])
    values = by_fold([F.array(*[F.lit(t.get(i, 0.0)) for i in range(most)]).cast("array<double>") for t in tables])
    rows = rows.withColumn("evidence", F.aggregate("bins", F.lit(0.0), lambda a, b: a + F.coalesce(F.get(values, b), F.lit(0.0)))).drop("bins")
    few = paths.count() <= SMALL
    here = (F.col("fold") == F.col("f")) & F.col("host").eqNullSafe(F.col("h"))
    rows = _attach(rows, paths, here & F.col("path").eqNullSafe(F.col("p")), few).drop("f", "h", "p")
    rows = _attach(rows, hosts, here, few).drop("f", "h")
    rows = rows.withColumn("path_rate", F.coalesce("path_rate", "host_rate", by_fold([F.lit(s) for s in shares]))).drop("host_rate", "fold")
    # The ratio is of likelihoods, so the prior enters once, as the path's.
    logit = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    rows = rows.withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return rows.withColumn("kept", F.col("p_good") >= threshold)


def _judged(docs: DataFrame, labels: DataFrame, whole: bool, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str, threshold: float) -> DataFrame:
    columns = [F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), fold(F.col(id_col)).alias("fold"), F.col(text_col).alias("text")]
    rows = docs.select(*columns, *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []))
    rows = settle(features(rows), "quality-rows")
    return score(rows, settle(labelled(rows, labels, id_col, label_col), "quality-train"), threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, host, path, evidence, path_rate, p_good and kept. Texts are measured once and not moved."""
    d = _judged(docs, labels, False, id_col, text_col, host_col, path_col, label_col, threshold)
    return d.select(F.col("id").alias(id_col), F.col("host").alias(host_col), F.col("path").alias(path_col), "evidence", "path_rate", "p_good", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that classify() keeps, with their columns as they are.

    Rows are written once with their bins, so that texts are measured once and are not shuffled.
    """
    return _judged(docs, labels, True, id_col, text_col, host_col, path_col, label_col, threshold).where("kept").select("row.*")


OP9_SQL = f"""{rules.MEASURES_SQL},
v AS (SELECT r, doc_id, source, lang, n_words, CASE WHEN substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1) < '8' THEN 0 ELSE 1 END AS fold,
    [log2(n_words + 1) / 20, mean_word_length / 20, symbol_ratio / 2, stop_word_ratio, alpha_word_ratio, dup_line_ratio,
     CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END, CASE WHEN n_words > 0 THEN len(regexp_extract_all(text, '!')) / n_words ELSE 0.0 END,
     CASE WHEN word_chars > 0 THEN len(regexp_extract_all(text, '[{CAPITALS}]')) / word_chars ELSE 0.0 END]::DOUBLE[] AS vals FROM n),
b AS (SELECT *, list_transform(range(0, 9), lambda i: (i * 25 + CASE WHEN n_words = 0 THEN 24 ELSE least(23, greatest(0, floor(vals[i + 1] * 24))) END)::INT) AS bins FROM v),
t AS (SELECT b.*, good FROM b JOIN (SELECT doc_id, (avg(quality) >= 0.5)::INT AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id)),
o AS (SELECT f.fold AS f, t.* EXCLUDE (fold) FROM t JOIN (SELECT unnest([0, 1]) AS fold) AS f ON f.fold <> t.fold),
c AS (SELECT f, bin, sum(good) AS g, count(*) - sum(good) AS x FROM (SELECT f, good, unnest(bins) AS bin FROM o) GROUP BY f, bin),
l AS (SELECT f, bin, ln((g + 1.0) / (sum(g) OVER s + 25.0)) - ln((x + 1.0) / (sum(x) OVER s + 25.0)) AS lr FROM c WINDOW s AS (PARTITION BY f, bin // 25)),
ev AS (SELECT r, coalesce(sum(lr), 0.0) AS evidence FROM (SELECT r, fold, unnest(bins) AS bin FROM b) AS e LEFT JOIN l ON l.f = e.fold AND l.bin = e.bin GROUP BY r),
sh AS (SELECT a.f, CASE WHEN count(o.f) > 0 THEN (coalesce(sum(good), 0) + 1.0) / (count(o.f) + 2.0) ELSE 0.5 END::DOUBLE AS share FROM (SELECT unnest([0, 1]) AS f) AS a LEFT JOIN o ON o.f = a.f GROUP BY a.f),
h0 AS (SELECT f, source, count(*) AS n, sum(good) AS k, any_value(share) AS share FROM o JOIN sh USING (f) GROUP BY f, source),
h1 AS (SELECT f, sum(n) AS n, count(*) AS sites, sum(n * pow(k / n - share, 2)) AS ss, sum(n * share * (1 - share)) AS pq FROM h0 GROUP BY f),
h2 AS (SELECT f, CASE WHEN pq = 0 THEN 1e6 WHEN (ss - pq * sites / n) / n <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, (pq / n) / ((ss - pq * sites / n) / n) - 1)) END AS m FROM h1),
h3 AS (SELECT f, source, (k + m * share) / (n + m) AS host_rate FROM h0 JOIN h2 USING (f)),
p0 AS (SELECT o.f, o.source, o.lang, count(*) AS n, sum(good) AS k, any_value(host_rate) AS host_rate FROM o JOIN h3 ON o.f = h3.f AND o.source IS NOT DISTINCT FROM h3.source GROUP BY ALL),
p1 AS (SELECT f, sum(n) AS n, count(*) AS sites, sum(n * pow(k / n - host_rate, 2)) AS ss, sum(n * host_rate * (1 - host_rate)) AS pq FROM p0 GROUP BY f),
p2 AS (SELECT f, CASE WHEN pq = 0 THEN 1e6 WHEN (ss - pq * sites / n) / n <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, (pq / n) / ((ss - pq * sites / n) / n) - 1)) END AS m FROM p1),
p3 AS (SELECT f, source, lang, (k + m * host_rate) / (n + m) AS path_rate FROM p0 JOIN p2 USING (f)),
z AS (SELECT b.doc_id, b.source, b.lang, evidence, coalesce(p3.path_rate, h3.host_rate, share) AS path_rate FROM b JOIN ev USING (r) JOIN sh ON sh.f = b.fold
  LEFT JOIN p3 ON p3.f = b.fold AND p3.source IS NOT DISTINCT FROM b.source AND p3.lang IS NOT DISTINCT FROM b.lang LEFT JOIN h3 ON h3.f = b.fold AND h3.source IS NOT DISTINCT FROM b.source),
y AS (SELECT *, 1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))) AS p_good FROM z)
SELECT doc_id, source, lang, round(evidence, 6) AS evidence, round(path_rate, 6) AS path_rate, round(p_good, 6) AS p_good, p_good >= {THRESHOLD} AS kept FROM y
"""
