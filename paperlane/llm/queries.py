"""The registered queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, fixity, html, lattice, mixing, periodic, quality, rules, sharding, simhash, substring, variants

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return d.select("doc_id", "source", "lang", *[F.round(c, 6).alias(c) for c in ("evidence", "path_rate", "p_good")], "kept")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(_table(spark, sf_dir, "pages"))


def op11_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.assign(_table(spark, sf_dir, "documents"), shards=24)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return periodic.find_runs(_table(spark, sf_dir, "documents"), columns, edit=periodic.with_periodic_tail)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(_table(spark, sf_dir, "documents"), lose=199))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash": op2_simhash,
        "op3_bpe_encode_decode": op3_bpe_encode_decode,
        "op4_lattice_near_dedup": op4_lattice_near_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_mix_sources": op6_mix_sources,
        "op7_quality_rules": op7_quality_rules,
        "op8_html_extraction": op8_html_extraction,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_warc_fixity": op10_warc_fixity,
        "op11_label_sharding": op11_label_sharding,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mix_sources": mixing.OP6_SQL,
        "op7_quality_rules": rules.OP7_SQL,
        "op9_quality_classifier": quality.OP9_SQL,
        "op10_warc_fixity": fixity.OP10_SQL,
    }
