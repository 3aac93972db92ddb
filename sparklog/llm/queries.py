"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import chat, langid, mixing, neardup, packing, quality, search, substrings, suffixes, urls
from sparklog.llm.oracles import HOSTILE, ORACLE_SQL, URL_RULES
from sparklog.llm.shared import read_table

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

#: Tokenizer of the packing query; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"

def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(read_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(HOSTILE).alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=10)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_neardup, op2_packing, op3_langid, op4_suffixes, op5_chat, op6_topk, op7_urls, op8_substrings, op9_quality, op10_mixing)}
