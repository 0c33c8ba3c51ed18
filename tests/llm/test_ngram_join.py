"""op7 against all pairs."""

import itertools
import random

from shelfwise.llm import ngram_join
from shelfwise.llm.graph import components
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

A_Z = {c: c + 32 for c in range(0x41, 0x5B)}


def shingles(text, n=5):
    w = (text or "").translate(A_Z).encode().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=5):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = set()
    for own in index.values():
        pairs.update(itertools.combinations(own, 2))
    links = 0
    for p, q in pairs:
        (i, s), (j, t) = sets[p], sets[q]
        if 100 * len(s & t) >= 75 * len(s | t):
            links += 1
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets), links


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'a' AS h", "2 AS x")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(df).collect()), key=str)


def test_whole_table_equals_brute_force(spark, duck):
    want, links = brute(duck.sql("select doc_id, text from documents").fetchall())
    got = QUERIES["op7_ngram_jaccard_join"](spark, SF01).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want and links > 50


def test_mutated_copies(spark, monkeypatch):
    """Chains and groups of copies near the threshold, with shared passages and
    with so few slots for frequent shingles that some are missed."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300))
    passage = [word() for _ in range(30)]
    rows = []
    for group in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))] + passage * (group % 2)
        for _ in range(rng.choice([1, 2, 5, 40])):
            if rng.random() < 0.7:
                base = base[:]
            copy = base[:]
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    want, links = brute(rows)
    assert links > 100
    assert run(spark, rows) == sorted(want, key=str)
    monkeypatch.setattr(ngram_join, "HOT", 5)
    assert run(spark, rows) == sorted(want, key=str)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "a b c d e f"), (8, long),
            (9, long + " x"), (10, "a " * 9000)]
    want, _ = brute(rows)
    assert run(spark, rows) == sorted(want, key=str)
    got = run(spark, [(None, "p q r"), (2, "p q r"), (2, "p q r"), (2, "k l m"), (3, "k l m"), (4, None)])
    assert got == sorted([(None, 1, None), (2, 1, None), (2, 1, None), (2, 1, None), (3, 1, None), (4, 0, 4)], key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_shared_shingles_are_counted_without_a_window(spark):
    from shelfwise.llm import ngram_join

    rows = [(1, i) for i in range(300)] + [(2, 7), (3, 8), (3, 9)]
    got = ngram_join._shared(spark.createDataFrame(rows, "h long, d long"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.h, r.d, r.df) for r in got.collect()) == [(h, d, 300 if h == 1 else 2) for h, d in rows if h != 2]
