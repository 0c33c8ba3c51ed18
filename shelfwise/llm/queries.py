"""The registered queries: each applies its operator to its whole table and
derives the contract's columns from the operator's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bitpack, decontam, language, ngram_join, packing, perplexity, pieces, quality, repair, secret_scan, sharding, substring,
    whitening,
)
from shelfwise.llm import oracle
from shelfwise.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING,
    "op3_benchmark_decontamination": oracle.DECONTAMINATION,
    "op7_ngram_jaccard_join": oracle.JACCARD,
}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer; the library that has it is installed on
    every machine.  The operators take the path as a parameter."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


VOCABULARY = 49_408


@_register
def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = substring.deduplicate(read(spark, d, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    found = perplexity.judge(read(spark, d, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept", "log_perplexity", "lower", "upper")


@_register
def op3_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.Decontaminator(read(spark, d, "documents"), read(spark, d, "benchmark"), window=10).report()
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_register
def op7_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.components_of(read(spark, d, "documents"), size=5)


@_register
def op9_token_bit_packing(spark: SparkSession, d: str) -> DataFrame:
    path, files = bitpack.write(read(spark, d, "documents"), tokenizer_path(), VOCABULARY, end=2)
    return bitpack.read_back(path, files).mapInArrow(
        bitpack.crc32_of, "doc_id long, start long, n_tokens long, ids_crc32 long")


@_register
def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), tokenizer_path(), VOCABULARY, end=1, window=2048)


def held_out() -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@_register
def op4_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(read(spark, d, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
                        secret_scan.written("spans").alias("spans"))


@_register
def op5_label_propagation_sharding(spark: SparkSession, d: str) -> DataFrame:
    found = sharding.shard_documents(read(spark, d, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@_register
def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(read(spark, d, "documents"), read(spark, d, "labels"), held_out())


@_register
def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(read(spark, d, "documents"), held_out())


@_register
def op11_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair(repair.damaged(read(spark, d, "conversations")), copies="copies")


@_register
def op12_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"), components=8)


@_register
def op13_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    found = pieces.encode(read(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.mapInArrow(pieces.digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
