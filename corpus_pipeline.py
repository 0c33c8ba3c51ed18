"""The corpus pipeline: stages over ``documents``, each one of the operators.

1. ``language``: string-kernel language ID; documents without a letter, or with
   no likely language, go: a score under the ``LEAST_SHARE`` quantile of the
   labelled rows that are found to be of their own language.
2. ``near_duplicates``: n-gram Jaccard join; of each group of documents linked
   by near copies the one with the smallest doc_id stays.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``secrets``: each secret becomes a mask in the text; n_chars follows.
5. ``packing``: the rest is encoded and packed into windows of 2048 tokens.

All but the last return the columns of their input.  A decision is by row: a stage
numbers the rows that it reads (written once), gives the operators the numbers as
ids, and drops them.  Rows that share a doc_id, or have none, are rows like any.

A stage's result is written before the next stage begins, which therefore first
deletes the tables that earlier stages wrote on their way, but for any that its own
input still reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontam, language, ngram_join, packing, secret_scan
from shelfwise.llm.common import drop_unread, free_name, read, steps, stored
from shelfwise.llm.queries import VOCABULARY, tokenizer_path
from shelfwise.session import ship_package

LEAST_SHARE = 0.005


_written: list[str] = []            # tables that stages have left behind


def _stage(fn: Callable) -> Callable:
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        drop_unread(docs, _written)
        with steps() as made:
            out = fn(spark, docs, sf_dir)
        _written.extend(made)
        return out
    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number (written once), and the name of that column."""
    row = free_name(docs, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _with_rows(docs: DataFrame, row: str, rows: DataFrame, how: str) -> DataFrame:
    """Rows of numbered ``docs`` whose number is (``left_semi``) or is not
    (``left_anti``) among ``rows`` (doc_id: numbers), without the number."""
    return docs.join(rows.select(F.col("doc_id").alias(row)), row, how).drop(row)


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    found = stored(language.identify(docs, F.lit(False), id_col=row), "languages")
    right = found.join(docs.select(F.col(row).alias("doc_id"), "lang"), "doc_id").filter("lang_pred = lang")
    least = {r.lang_pred: r.least for r in right.groupBy("lang_pred").agg(
        F.percentile_approx("score", LEAST_SHARE, 100_000).alias("least")).collect()}
    table = spark.createDataFrame(list(least.items()), "lang_pred string, least double")
    likely: Column = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= F.coalesce("least", F.lit(0.0)))
    return _with_rows(docs, row, found.join(F.broadcast(table), "lang_pred", "left").filter(likely), "left_semi")


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    groups = ngram_join.components_of(docs, size=5, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = groups.join(docs.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias("doc_id"))
    return _with_rows(docs, row, first, "left_semi")


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = _numbered(docs)
    by_row = docs.select(F.col(row).alias("doc_id"), "text")
    report = decontam.Decontaminator(by_row, read(spark, sf_dir, "benchmark"), window=10).report()
    return _with_rows(docs, row, report.filter("contaminated"), "left_anti")


@_stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), VOCABULARY, end=1, window=2048)


STAGES: list = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Language ID, components of links and packing have no SQL form;
#: tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with steps() as made:
            docs = stored(out, f"stage-{name}")
        _written.extend(made)
    return STAGES[-1][1](spark, docs, sf_dir)
