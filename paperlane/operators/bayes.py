"""Multinomial Naive Bayes over tokens, trained and applied by grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import pii_normalized

ALPHA, THRESHOLD = 1.0, 0.85


def tokens(text: Column, stop_words: bool = True, normalize: bool = True) -> Column:
    """Runs of at least three letters and underscores of the lower-case text, stop words left out."""
    t = pii_normalized(text) if normalize else F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(t), F.lit("[a-z_]{3,}"), F.lit(0))
    found = F.filter(found, lambda x: x != "___")
    return F.filter(found, lambda x: ~x.isin(P.DUTCH_STOP_WORDS)) if stop_words else found


#: Labels of a model at most, as each is a column of the prediction.
MOST_LABELS = 1000


def token_lists(docs: DataFrame, token_array: Column) -> DataFrame:
    """Rows (doc_id, tokens)."""
    return docs.select("doc_id", token_array.alias("tokens"))


def train(tokens_: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, tokens) and (doc_id, label): tables (label, docs, total, vocabulary, all_docs) and (label, token, c).

    Documents without tokens do not train. Texts are read once: a document counts at its first
    token, and the counts, a row for each label and token, are kept for what reads them again.
    """
    rows = tokens_.join(labels, "doc_id").select("label", F.posexplode("tokens").alias("pos", "token"))
    by_token = rows.groupBy("label", "token").agg(F.count("*").alias("c"), F.count_if(F.col("pos") == 0).alias("docs")).persist()
    classes = by_token.groupBy("label").agg(F.sum("docs").alias("docs"), F.sum("c").alias("total"))
    whole = by_token.agg(F.countDistinct("token").alias("vocabulary"), F.sum("docs").alias("all_docs"))  # one row
    return classes.crossJoin(F.broadcast(whole)).select("label", "total", "docs", "vocabulary", "all_docs"), by_token.select("label", "token", "c")


def predict_all(tokens_: DataFrame, classes: DataFrame, by_token: DataFrame, allowed: list | None = None) -> DataFrame:
    """Probabilities (doc_id, label, p) of every label, or of those allowed; none where these are fewer than two or a text has no tokens.

    The model is turned into a row for each token with a column for each label, which Spark sends to
    every task if it is small and joins by shuffle, splitting frequent tokens, if not. With alpha 1
    a token a label never saw adds ln(1); the denominator comes from the document's length.
    """
    info = classes.limit(MOST_LABELS + 1).collect()
    if len(info) > MOST_LABELS:
        raise ValueError(f"a model of more than {MOST_LABELS} labels")
    info = sorted((r for r in info if allowed is None or r.label in allowed), key=lambda r: str(r.label))
    label_type = classes.schema["label"].dataType.simpleString()
    empty = tokens_.select("doc_id", F.lit(None).cast(label_type).alias("label"), F.lit(0.0).alias("p")).where("false")
    if len(info) < 2:
        return empty
    logs = [F.log(F.coalesce(F.sum(F.when(F.col("label").eqNullSafe(F.lit(r.label)), F.col("c"))), F.lit(0)) + ALPHA).alias(f"w{i}") for i, r in enumerate(info)]
    model = by_token.groupBy("token").agg(*logs)
    seen = tokens_.select("doc_id", F.explode("tokens").alias("token")).join(model, "token", "left")
    sums = seen.groupBy("doc_id").agg(F.count("*").alias("length"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(info))])
    score = lambda i, r: F.col(f"s{i}") - F.col("length") * F.log(F.lit(r.total + ALPHA * r.vocabulary)) + F.log(F.lit((r.docs + ALPHA) / (r.all_docs + ALPHA * len(info))))
    scores = sums.select("doc_id", F.array(*[score(i, r) for i, r in enumerate(info)]).alias("s"))
    scores = scores.select("doc_id", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e")).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    named = F.arrays_zip(F.array(*[F.lit(r.label) for r in info]).alias("label"), F.col("e"))
    return scores.select("doc_id", "sum", F.explode(named).alias("x")).select("doc_id", F.col("x.label").alias("label"), (F.col("x.e") / F.col("sum")).alias("p"))


def predict(probabilities: DataFrame, threshold: float | None = None) -> DataFrame:
    """The best label of each document with its probability; of equals the first by name. Below a threshold the label is null."""
    best = probabilities.groupBy("doc_id").agg(F.min(F.struct((-F.col("p")).alias("turn"), "label")).alias("b"))
    first = best.select("doc_id", F.col("b.label").alias("label"), (-F.col("b.turn")).alias("p"))
    return first if threshold is None else first.withColumn("label", F.when(F.col("p") >= threshold, F.col("label")))


def top_tokens(by_token: DataFrame, n: int = 50) -> DataFrame:
    """The n most frequent tokens of each label."""
    w = Window.partitionBy("label").orderBy(F.desc("c"), "token")
    return by_token.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merged(models: DataFrame, n: int = 50) -> DataFrame:
    """Token counts (model, label, token, c) summed over models, the n greatest of each label."""
    return top_tokens(models.groupBy("label", "token").agg(F.sum("c").alias("c")), n)


def hints_of(top: DataFrame, n: int = 10) -> DataFrame:
    """The first n tokens of each label as `kw:` lines."""
    rows = top.where(F.col("rank") <= n).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("t"))
    return rows.select("label", F.array_join(F.transform("t", lambda x: F.concat(F.lit("kw:"), x["token"])), "\n").alias("hints"))


def looked_up(requests: DataFrame, models: DataFrame, name: str) -> DataFrame:
    """Requests with model, the one that each is answered by: the model it names, else the default one, else null.

    models has model (each once) and labels, the number of its labels. A model without labels answers nothing, and its name does
    not fall back; a null name or one that no model has does.
    """
    first = models.select(F.col("model").alias("_named"), F.col("labels").alias("_labels"))
    d = requests.join(first, F.col(name) == F.col("_named"), "left")
    d = d.withColumn("_other", F.when(F.col("_named").isNull(), "default"))
    second = models.where("model = 'default'").select(F.col("model").alias("_default"), F.col("labels").alias("_default_labels"))
    d = d.join(second, F.col("_other") == F.col("_default"), "left")
    model = F.when(F.col("_labels") > 0, F.col("_named")).when(F.col("_default_labels") > 0, F.col("_default"))
    return d.select(*requests.columns, model.alias("model"))
