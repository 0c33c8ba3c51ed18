"""Quality classifier by Bradley-Terry ranking.

Every pair of a good and a bad labelled document is a preference.  A document's
strength is linear in features of its whole text, and the Bradley-Terry model
makes the chance that one is preferred the logistic function of the difference
of strengths: logistic regression on feature differences, without intercept,
solved by Newton's method with a small ridge.  The threshold is the quantile of
the labelled documents' strengths at the share of bad labels, and the score is
the logistic function of the strength above the threshold.

All labelled documents and all their pairs count.  A pair's share in a Newton step
depends on its two strengths alone, so each document is spread over the two nearest
of ``GRID`` strengths, and the pairs are summed over the grid: a pass sums the
features of each label by grid strength, a second one the products of features, and
neither sends more than a row for each grid strength to the driver.

Defined cases: a null or empty text has all counts 0 and a score like any other;
with labels of one kind only, all scores are 0.5.  Labels that are null count
for nothing; if a doc_id has several labels, the smallest counts.  Rows that
repeat a doc_id are scored one by one; a null doc_id has no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored
from shelfwise.llm.measures import measure
from shelfwise.llm.words import blocks
from shelfwise.operators.scan import running_sum

RIDGE = 1e-2
EDGE = 16               # strengths beyond it are as certain as it
CELLS = 32              # of the grid for each unit: a pair's chance is right to 2e-5
GRID = np.arange(-EDGE * CELLS, EDGE * CELLS + 1) / CELLS

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "echoes", "upper", "digits",
            "letters", "stops", "line_words", "repeats_high", "symbols_high", "short")


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    n, chars = np.maximum(m["n_words"], 1), np.maximum(m["n_chars"], 1)
    letters = np.maximum(m["n_letter"], 1)
    repeats, symbols = m["n_repeat_words"] / n, m["n_symbols"] / chars
    return np.stack([
        np.log1p(m["n_words"]), np.minimum(m["word_chars"] / n, 30), symbols, m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        repeats, m["n_distinct"] / n, m["n_echo"] / n, m["n_upper"] / letters, m["n_digit"] / chars, m["n_letter"] / chars,
        m["n_stop"] / n, np.log1p(m["n_words"] / np.maximum(m["n_lines"], 1)), repeats > 0.3, symbols > 0.03, m["n_words"] < 30,
    ], axis=1).astype(np.float64)


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for b in blocks(batch.column(2)):
            x = features(measure(b))
            cut = np.arange(b.n_docs + 1, dtype=np.int32) * x.shape[1]
            yield pa.record_batch([batch.column(0).slice(b.row, b.n_docs), batch.column(1).slice(b.row, b.n_docs),
                                   pa.ListArray.from_arrays(pa.array(cut), pa.array(x.reshape(-1)))], schema=schema)


def _spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid strength below each strength, and how far it is to the next."""
    at = (np.clip(s, -EDGE, EDGE) + EDGE) * CELLS
    low = np.minimum(at.astype(np.int64), len(GRID) - 2)
    return low, at - low


def _first_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of documents and sums of their features, by grid strength."""
    low, share = _spread(x @ w)
    return np.stack([np.bincount(low, v * (1 - share), len(GRID)) + np.bincount(low + 1, v * share, len(GRID))
                     for v in (np.ones(len(x)), *x.T)], axis=1)


def _second_sums(x: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of products of features, by the ``weight`` of the documents' grid strengths."""
    low, share = _spread(x @ w)
    return x.T @ (x * (weight[low] * (1 - share) + weight[low + 1] * share)[:, None])


def _newton(size: int, ridge: float, first, second) -> np.ndarray:
    """Weights by the sums over the documents: ``first(w)`` gives those of the bad and the
    good, ``second(w, weights)`` the sum of both."""
    w = np.zeros(size)
    chance = 1 / (1 + np.exp(GRID[None, :] - GRID[:, None]))      # of the row's strength over the column's
    slope = chance * (1 - chance)
    for _ in range(25):
        bad, good = (found / found[:, 0].sum() for found in first(w))
        lost = 1 - chance
        grad = (lost @ bad[:, 0]) @ good[:, 1:] - (good[:, 0] @ lost) @ bad[:, 1:] - ridge * w
        cross = good[:, 1:].T @ slope @ bad[:, 1:]
        products = second(w, (good[:, 0] @ slope, slope @ bad[:, 0]))
        step = np.linalg.solve(products - cross - cross.T + ridge * np.eye(size), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that make the rows of ``good`` preferred to those of ``bad``."""
    return _newton(good.shape[1], ridge, lambda w: (_first_sums(bad, w), _first_sums(good, w)),
                   lambda w, weight: _second_sums(bad, w, weight[0]) / len(bad) + _second_sums(good, w, weight[1]) / len(good))


def fit(learn: DataFrame, count: dict[int, int], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """:func:`bradley_terry` over the rows (``x``, ``y``) of a table, features in units of ``scale`` from ``mean``."""
    size = len(mean)

    def columns(names: list[str]) -> str:
        return ", ".join(f"{c} double" for c in names)

    def of_label(batch: pa.RecordBatch):
        y, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, size)
        for label in (0, 1):
            if (y == label).any():
                yield label, (x[y == label] - mean) / scale

    def first(w: np.ndarray) -> list[np.ndarray]:
        names = [f"s{i}" for i in range(size + 1)]

        def sums(batches):
            total = np.zeros((2, len(GRID), size + 1))
            for batch in batches:
                for label, x in of_label(batch):
                    total[label] += _first_sums(x, w)
            label, cell = np.nonzero(total[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)),
                                              *[pa.array(v) for v in total[label, cell].T]], ["y", "cell", *names])

        found = learn.select("y", "x").mapInArrow(sums, f"y int, cell int, {columns(names)}")
        out = np.zeros((2, len(GRID), size + 1))
        for r in found.groupBy("y", "cell").agg(*[F.sum(c).alias(c) for c in names]).collect():
            out[r.y, r.cell] = r[2:]
        return list(out)

    def second(w: np.ndarray, weight: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        names = [f"p{i}" for i in range(size * size)]

        def sums(batches):
            total = np.zeros((size, size))
            for batch in batches:
                for label, x in of_label(batch):
                    total += _second_sums(x, w, weight[label]) / count[label]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.reshape(-1)], names)

        found = learn.select("y", "x").mapInArrow(sums, columns(names))
        return np.array(found.agg(*[F.sum(c) for c in names]).first(), dtype=np.float64).reshape(size, size)

    return _newton(size, RIDGE, first, second)


def quantile(values: DataFrame, column: Column, rank: int) -> float:
    """Middle between the values of this and the next rank (from 1), or the last."""
    counts = values.groupBy(column.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sum(counts, [], ["s"], ["n"], ["upto"], rows=20_000)
    low, high = ranked.agg(F.min(F.when(F.col("upto") >= rank, F.col("s"))),
                           F.min(F.when(F.col("upto") > rank, F.col("s")))).first()
    return low if high is None else (low + high) / 2


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.  Rows for
    which ``held_out`` is true are not trained on."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    found = stored(rows.mapInArrow(_features, "doc_id long, held_out boolean, x array<double>"), "features")
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
             .filter("y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y")))
    learn = stored(found.filter("NOT held_out").join(known, "doc_id").select("doc_id", "x", "y"), "labelled")
    each = range(len(FEATURES))
    count = {r.y: r.c for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    strength, bias = F.lit(0.0), 0.0
    if len(count) == 2:
        spread = learn.agg(*[F.avg(F.col("x")[i]) for i in each], *[F.stddev_pop(F.col("x")[i]) for i in each]).first()
        mean, scale = np.array(spread, dtype=np.float64).reshape(2, -1)
        scale = np.where(scale == 0, 1, scale)
        for i, v in enumerate(fit(learn, count, mean, scale) / scale):
            strength = strength + F.lit(float(v)) * F.col("x")[i]
        bias = quantile(learn, strength, count[0])      # at the share of bad labels
    strength = strength - F.lit(bias)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), strength))))
    return found.select("doc_id", "held_out", score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
