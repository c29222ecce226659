"""From documents to training tokens: five stages, each over all that the one before kept.

Every stage takes and gives the columns of documents and whatever others the table has, under any
names; the last one gives tokens instead. An empty table goes through as an empty one. Null ids,
repeated rows and ties are told below; null columns never stop a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlane.llm import bpe, mixing, quality, simhash, substring
from paperlane.llm.shared import settle

#: SQL cannot express the fingerprints and the tokens.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are judged by bins of their own, null sources and languages are sites of
    their own, a null id has no label. Repeated rows are judged alike; a tie at the threshold stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The one of the smallest id stays, null being the greatest, of repeated ids the first by the
    text's hash, of repeated rows one. All texts without words, null ones too, are one group.
    """
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts and drops the texts of which nothing is left, null and empty ones too."""
    left = substring.remove_repeats(docs)
    words = mixing.word_count(left["text"])
    return left.where(words > 0).withColumn("n_chars", mixing.F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: each document as often as the mix takes it. A null source is one of its own, null ids share their rank."""
    return mixing.repeat_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, with digests of the ids and of their decoding; one row for each row. A null text counts as empty."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("BPE encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
