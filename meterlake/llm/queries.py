"""Queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, langid, line_dedup, maxent, nearest, packing, quality, sharding, simhash, telephony, trie
from .common import documents, residue, stored


def tokenizer(name: str) -> str:
    """Where the public vocabulary file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`.  The shuffle is uniform over rows, so it forms no groups: copies of a text are dealt out like any rows."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.uniform_shards(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_windows(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are stored and read back; the PCM, at 16 kHz, is a column of the result and is stored with it."""
    media = stored(telephony.telephony_stored(documents(spark, sf_dir), "text", ["doc_id"]), "telephony")
    out = telephony.telephony_read(media)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    kinds = dict(rows.dtypes)
    pair = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.chat_digest(chat.chat_format(rows.unionByName(pair)))


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.where("NOT held_out"))
    return langid.identified(docs, model, "text", ["doc_id", "held_out"])


def op7_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), "text", ["doc_id"], full=False)


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(documents(spark, sf_dir).select("doc_id", "text"), measures=True)
    return out.drop("text")


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", residue(F.col("doc_id"), 10) == 0)
    return maxent.maxent_scores(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op11_lookaround_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fim_transform(documents(spark, sf_dir).select("doc_id", "text"))
    restored = fim.fim_restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_peeled_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), rebuild=trie.spliced)


def op13_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_hypergeometric_shards, op2_line_windows, op3_telephony, op4_chat_round_trip, op5_golay_simhash, op6_bloom_language, op7_balanced_packing, op8_rank_array_bpe, op9_quality_cascade, op10_maxent, op11_lookaround_fim, op12_peeled_trie, op13_block_neighbours)
}

ORACLE_SQL: dict[str, str] = {"op2_line_windows": line_dedup.oracle(), "op9_quality_cascade": quality.oracle(), "op11_lookaround_fim": fim.oracle(), "op12_peeled_trie": trie.oracle(), "op13_block_neighbours": nearest.oracle()}
