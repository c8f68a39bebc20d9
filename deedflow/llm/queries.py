"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprints, langid, merkle, mixing, near_duplicates, packing, passages, prefix_trie, quality, sharding, toxicity, twins, warc
from .common import crc32_bucket


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """The public vocabulary that packing counts tokens by; another one is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_documents(mixing.mix_sources(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "slots")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc32_bucket(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = toxicity.fit(docs.filter(~F.col("held_out")), toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(documents(spark, sf_dir)).select(*columns, F.round("quality", 6).alias("quality"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), shards=16, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " ").cast("binary"), 256)
    hashes = found.withColumns({f"{c}_hashes": fingerprints.entry_hashes(F.col(c)) for c in ("print", "next_print", "edited_print")})
    return hashes.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("print").alias("fingerprint"),
        digest("edited_print").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print_hashes"), F.col("edited_print_hashes")).alias("near_edited"),
        fingerprints.likeness(F.col("print_hashes"), F.col("next_print_hashes")).alias("near_next"),
        F.size("print").cast("long").alias("n_entries"),
        fingerprints.entry_list(F.col("print")).alias("entries"),
    )


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(documents(spark, sf_dir)).drop("node")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary()).withColumn("piece", F.col("piece").cast("int"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(documents(spark, sf_dir), digest_all=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_winnowing": op7_winnowing,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_duplicates": op13_exact_duplicates,
}
ORACLE_SQL = twins.ORACLE_SQL
