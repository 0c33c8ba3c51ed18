"""op6 and op8: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import language, quality
from shelfwise.llm.queries import QUERIES, held_out
from tests.conftest import SF01

EDGES = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "de"), (None, "text " * 30, "en"), (5, "é", "fr"), (5, "x" * 90000, "fr"),
         (7, "漢字", "zh"), (8, "the", "en")]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS x", "'k' AS key")


def test_quality_on_held_out_labels(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, SF01).collect()}
    assert len(got) == duck.sql("select count(*) from documents").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = [(q, got[i]) for i, q in duck.sql("select doc_id, quality from labels").fetchall() if got[i].held_out]
    assert np.mean([q == r.predicted for q, r in labels]) > 0.95
    assert min(r.score for r in got.values()) >= 0 and max(r.score for r in got.values()) <= 1


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(frame(spark), labels, F.lit(False)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    one = quality.classify(frame(spark), labels.filter("quality = 1"), F.lit(False)).collect()
    assert {r.score for r in one} == {0.5} and {r.predicted for r in one} == {1}
    assert quality.classify(frame(spark).limit(0), labels, held_out()).count() == 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    good = rng.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0])))
    w = quality.bradley_terry(x[good], x[~good], ridge=1e-4)
    assert w[0] > 1.5 and w[1] < -0.7 and abs(w[2]) < 0.15


def _all_pairs(good, bad, ridge):
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, good.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ (1 - p) / len(d) - ridge * w)
    return w


def test_bradley_terry_counts_every_pair(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(70, 3)) + [0.8, 0, 0.2], rng.normal(size=(90, 3)) * [1, 2, 1]
    exact = _all_pairs(good, bad, quality.RIDGE)
    assert np.abs(quality.bradley_terry(good, bad) - exact).max() < 1e-4
    rows = [(x.tolist(), y) for y, part in ((0, bad), (1, good)) for x in part]
    learn = spark.createDataFrame(rows, "x array<double>, y int").repartition(5)
    assert np.abs(quality.fit(learn, {0: 90, 1: 70}, np.zeros(3), np.ones(3)) - exact).max() < 1e-4


def test_threshold_counts_every_label(spark):
    rows = spark.range(30_001).select(F.expr("CAST(id * id AS DOUBLE)").alias("s"))
    assert quality.quantile(rows, F.col("s"), 12_345) == (12_344.0 ** 2 + 12_345.0 ** 2) / 2
    assert quality.quantile(rows, F.col("s"), 30_001) == 30_000.0 ** 2


def test_language_on_held_out_rows(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF01).collect()}
    rows = duck.sql("select doc_id, lang from documents").fetchall()
    assert len(got) == len(rows)
    held = [(x, got[i]) for i, x in rows if got[i].held_out]
    assert len(held) > 250 and np.mean([x == r.lang_pred for x, r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    rows = language.identify(frame(spark), F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in rows) == sorted(
        (str(i), i in (1, 2, 3)) for i, _, _ in EDGES)
    assert {r.lang_pred for r in language.identify(frame(spark), F.lit(True)).collect()} == {"und"}
    assert language.identify(frame(spark).limit(0), F.lit(False)).count() == 0


def test_kernel_is_the_share_of_common_ngrams():
    sets = [np.unique(language.codes_of(language.SYMBOLS[np.frombuffer(t, np.uint8)])) for t in (b"abab cd", b"abc", b"zq z", b"abab")]
    model = language.Model(["a", "a", "z", "a"], sets, landmarks=4)
    k = model.kernel(model._matrix(sets))
    used = set(np.concatenate([sets[i] for i in (0, 1, 2)]).tolist())
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:2]):
            p, q = used & set(x.tolist()), used & set(y.tolist())
            assert abs(k[i, j] - len(p & q) / np.sqrt(len(p) * len(q))) < 1e-6
