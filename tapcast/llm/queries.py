"""The operators over the driver tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.llm import (archive, bpe_replay, decontamination, near_duplicates, packing, recurrent_lm, repeats,
                         sharding, syncmers, target_sampling, token_alignment, token_blocks, toxicity)
from tapcast.llm.common import shared_path, table, tokenizer_path
from tapcast.llm.oracle import ORACLE_SQL  # noqa: F401
from tapcast.session import materialize


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_blocks.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return token_blocks.read_digests(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents")).drop("xh")


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out(F.col("doc_id"), 5)
    return recurrent_lm.scores(table(spark, sf_dir, "documents"), held_out)


#: Shards of the sharding query.
SHARDS = 8


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = materialize(sharding.records(table(spark, sf_dir, "documents")))
    sizes = materialize(sharding.slot_sizes(recs))
    maps = shared_path(spark, "slot-maps")
    sharding.save_map(sharding.first_map(sizes, SHARDS), maps)
    return sharding.placed(recs, sizes, sharding.load_map(spark, maps)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op7_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    return archive.read_records(spark, path)


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("h")


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
                              public_pattern())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                   tokenizer_path("piece_bpe_32k.model"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_token_blocks, op3_toxicity, op4_bagminhash, op5_recurrent_lm,
    op6_virtual_slots, op7_content_archive, op8_syncmers, op9_decontamination, op10_prefix_doubling,
    op11_merge_replay, op12_token_alignment, op13_target_resampling)}
