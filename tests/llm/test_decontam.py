"""op3 against a brute-force search of every window in every text."""

import hashlib
import re

from shelfwise.llm import decontam
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(len(w) - n + 1 if len(w) >= n else min(1, len(w))):
            windows.setdefault(tuple(w[s:s + min(n, len(w))]), set()).add("null" if item is None else str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                k = tuple(w[s:s + m])
                if k in windows:
                    hit.update(range(s, s + m))
                    found |= windows[k]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.Decontaminator(d.withColumn("term", d.text), b.withColumn("shard", b.text), **more).report().collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str)


def test_whole_table_equals_brute_force(spark, duck):
    docs = duck.sql("select doc_id, text from documents").fetchall()
    items = duck.sql("select item_id, text from benchmark").fetchall()
    want = sorted((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in brute(docs, items, 10))
    got = QUERIES["op3_benchmark_decontamination"](spark, SF01).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(r.contaminated for r in got) > 0


DOCS = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x a B c y"), (3, None), (4, ""), (5, "q " * 5000 + "c d e" + " z" * 5000),
        (6, "b c"), (7, "a"), (8, "é ü a b c"), (9, "a b"), (10, "c d e c d e c d e")]
ITEMS = [(1, "a b c d"), (2, "c,d;e"), (2, "z z z"), (None, "b c"), (4, None), (5, "... !"), (12, "é ü")]


def test_edges_in_one_block_and_in_many(spark):
    want = sorted(brute(DOCS, ITEMS, 3), key=str)
    assert run(spark, DOCS, ITEMS, window=3) == want
    assert run(spark, DOCS, ITEMS, window=3, block_windows=2) == want


def test_full_vocabulary_index(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_VOCABULARY", 1)
    assert run(spark, DOCS, ITEMS, window=3) == sorted(brute(DOCS, ITEMS, 3), key=str)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS, window=3) == []
    assert run(spark, DOCS, [], window=3) == sorted(((i, len(words(t)), 0, ()) for i, t in DOCS), key=str)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "one x two three y four"), (3, "one q q q q two three four")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    found = decontam.Decontaminator(d, b)
    ids = {r.shard + str(r.ord): r.d for r in found.texts().collect()}
    near = lambda slop: {ids[r.shard + str(r.ord)] for r in found.matches(slop).collect()}
    assert near(0) == {1} and near(2) == {1, 2} and near(4) == {1, 2, 3}
