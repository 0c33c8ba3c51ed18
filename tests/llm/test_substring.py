"""op1 against a brute-force list of all windows."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfwise.llm import substring
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n):
    """(id, text) rows, ids of which order the windows; None is below all."""
    words = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    key = lambda i: -(1 << 70) if i is None else i
    for i, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s:s + n])
            first[k] = min(first.get(k, (1 << 70, 0)), (key(i), s))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s:s + n])] < (key(i), s):
                gone.update(range(s, s + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def run(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, kept int")
    got = substring.deduplicate(df, n).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str)


def test_whole_table_equals_brute_force(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    want = sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute(rows, 20))
    got = QUERIES["op1_substring_dedup"](spark, SF01).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert 0 < sum(r.n_removed for r in got) < sum(r.n_words for r in got)


def test_factors_are_the_removed_words(spark):
    got = substring.deduplicate(spark.read.parquet(f"{SF01}/documents.parquet")).collect()
    for r in got:
        assert len({p for f in r.factors for p in range(f.start, f.start + f.length)}) == r.n_removed
        assert all(f.source <= r.doc_id and f.length >= 20 for f in r.factors)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "x", 1), (2, "", None, 2), (3, " \t\n", "x", None), (4, long, "x", 1), (4, long, "x", 1),
            (None, "pre " + long, "x", 1), (6, long + " " + long, "y", 2), (7, "a " * 50, "y", 2), (8, long + " ", "y", 2),
            (9, "b " * 20000 + long, "z", 3)]
    want = sorted(((i, n, r, k) for i, n, r, k in brute([r[:2] for r in rows], 20)), key=str)
    assert run(spark, rows, 20) == want


def test_texts_of_one_id_and_many_null_ids(spark):
    """Two texts under one id, one of them a copy; a third of the ids null."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "x", 1), (2, a, "x", 1), (2, b, "x", 1), (3, c + " " + b[:60], "x", 1), (3, "tail " + a, "x", 1)]
    assert {k for i, _, _, k in run(spark, rows, 20) if i == 2} == {"", b}
    rows += [(None, " ".join(f"n{k}x{i}" for i in range(40)), "x", 1) for k in range(20)]
    rows += [(50 + k, f"own{k} " + " ".join(f"n{k}x{i}" for i in range(5, 35)) + f" end{k}", "x", 1) for k in range(20)]
    assert run(spark, rows, 20) == sorted(((i, n, r, k) for i, n, r, k in brute([r[:2] for r in rows], 20)), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.deduplicate(df).count() == 0


def test_window_must_exceed_the_anchor_gram(spark):
    with pytest.raises(ValueError):
        substring.deduplicate(spark.createDataFrame([], "doc_id long, text string"), substring.GRAM)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab ", min_size=0, max_size=90), min_size=1, max_size=12))
def test_random_small_alphabet(spark, docs):
    rows = [(i, t, "x", 1) for i, t in enumerate(docs)]
    want = sorted(((i, n, r, k) for i, n, r, k in brute([r[:2] for r in rows], 8)), key=str)
    assert run(spark, rows, 8) == want
