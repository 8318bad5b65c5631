"""The queries that apply this subpackage's operators to their whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_shared_path
from . import (
    bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language,
    license_scan,
    line_dedup,
    lm_score,
    mixing,
    prefix_trie,
    simhash,
    toxicity,
    warc,
)
from .common import id_crc, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id", 3) == 1
    found = language.identify(docs, language.fit(docs.where(~held_out)))
    return found.withColumn("held_out", held_out)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digested(table(spark, sf_dir, "documents"), bpe.read_ranks(bpe.default_path()), public_tokenizers.PATTERN)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentences", ",").alias("sentences"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.default_categories()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_crc("doc_id", 7) == 2
    docs = table(spark, sf_dir, "documents").withColumn("__trained", ~held_out)
    return lm_score.score(docs, "__trained").withColumn("held_out", held_out)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "warc")
    warc.write_archives(warc.mark_revisits(warc.payloads(table(spark, sf_dir, "pages"))), path)
    return warc.resolve(warc.read_archives(spark, path)).withColumnRenamed("id", "page_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language": op1_language,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_lm_score": op8_lm_score,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_dedup": op12_line_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op3_license_scan": license_scan.SQL,
    "op7_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
