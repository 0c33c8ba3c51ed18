"""op12 against numpy over the whole table, and eigenvectors of hard matrices."""

import math

import numpy as np
import pytest

from shelfwise.llm import whitening as W
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01


def direct(vectors):
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, ((n * x - s) ** 2).sum(axis=1), centred, values[order], columns[:, order]


def compare(rows, ids, vectors, components=8, close=1e-7):
    n, deviation, centred, values, columns = direct(vectors)
    k = min(components, centred.shape[1])
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    white = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        own = np.array([white[i, c + 1].whitened for i in ids])
        other = centred @ columns[:, c] / math.sqrt(values[c])
        assert min(np.abs(own - other).max(), np.abs(own + other).max()) < close
        assert all(abs(white[i, c + 1].explained - values[c] / values.sum()) < 1e-10 for i in ids)
    assert [white[i, 1].deviation for i in ids] == deviation.tolist()
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whole_table(spark, duck):
    table = duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    good = [(i, v) for i, v in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    compare(QUERIES["op12_embedding_whitening"](spark, SF01).collect(), [i for i, _ in good], [v for _, v in good])


MATRICES = {
    "spread": np.linspace(1, 100, 40), "tenfold": [5] * 10 + list(range(10, 20)), "near": [1 + 1e-9 * i for i in range(8)] + [3, 3.0000001, 7],
    "very near": [1 + 1e-13 * i for i in range(8)] + [2, 2], "singular": [0, 0, 0, 2.0], "graded": 10.0 ** np.arange(-8, 8), "one": [4.0],
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenpairs(name):
    values = np.array(MATRICES[name], dtype=np.float64)
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    found, x = W.eigenpairs(a)
    whole = np.abs(values).max()
    assert np.abs(a @ x - x * found).max() < 1e-16 * whole and np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert (np.diff(found) <= 1e-16 * whole).all()


def test_nulls_lengths_clashing_names_and_repeats(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in rng.normal(size=4) * [1, 2, 3, 4]] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [1.0, float("inf"), 0.0, 0.0]), (104, [1.0]), (105, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS deviation", "3 AS whitened")
    compare(W.whiten(df).collect(), range(60), vectors, close=1e-11)
    twice = spark.createDataFrame([(None, v) for _, v in rows * 2], "vec_id long, embedding array<double>")
    got = W.whiten(twice, components=3).collect()
    assert len(got) == 360 and all(r.vec_id is None and r.n == 120 for r in got) and got[0].identity_error < 1e-9


def test_without_variance_and_empty(spark):
    kind = "vec_id long, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], kind)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    got = W.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], kind)).collect()
    assert len(got) == 4 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None and r.explained is None for r in got)
    line = W.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12


def test_large_entries_are_exact(spark):
    """Entries of several limbs, a deviation beyond a long, and sums that doubles cannot hold."""
    vectors = [[2.0 ** 40 + i, float(i * i), -2.0 ** 45 * (i % 3)] for i in range(9)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = [[math.floor(1024 * v) + 100000 for v in row] for row in vectors]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((9 * v - t) ** 2 for v, t in zip(row, s)) for row in x]
    got = W.whiten(df).collect()
    assert [r.deviation for r in sorted(got) if r.component == 1] == [v if v < 1 << 63 else None for v in exact]
    model = W.fit(W._vectors(df, "vec_id", "embedding"))
    total = sum(sum((9 * v - t) ** 2 for v, t in zip(row, s)) for row in x) / 9 ** 3
    assert model.sums == s and abs(model.trace / total - 1) < 1e-15
