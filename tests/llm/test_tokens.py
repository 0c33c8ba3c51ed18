"""op9 and op10: exact round trips against plain encoding."""

import collections
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import bitpack, packing
from shelfwise.llm.queries import QUERIES, VOCABULARY, tokenizer_path
from shelfwise.llm import tokens
from shelfwise.llm.tokens import encoded
from tests.conftest import SF01

PLAIN = Tokenizer.from_file(tokenizer_path())
EDGES = [(5, "B b b"), (1, None), (2, ""), (3, " \n"), (None, "nothing"), (4, "twice"), (4, "twice"), (4, "again"),
         (9, "long " * 30000 + "tail"), (7, "a<|endoftext|>b <|startoftext|> it's IT 'S ’s  x y é İ Σας"), (8, "x" * 5000)]


def ids_of(text, end):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'<|>aAéＡ́ \x1c\x85"))), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    for row, ids, cut in encoded(pa.array(texts), tokenizer_path(), 3):
        for k in range(len(cut) - 1):
            assert ids[cut[k]:cut[k + 1]].tolist() == ids_of(texts[row + k], 3).tolist()


def test_units_of_real_texts(duck, monkeypatch):
    texts = [t for t, in duck.sql("select text from documents").fetchall()]
    for memory in (tokens.MEMORY, 500):
        monkeypatch.setattr(tokens, "MEMORY", memory)
        monkeypatch.setattr(tokens, "_encoders", {})
        for row, ids, cut in encoded(pa.array(texts), tokenizer_path(), 3):
            for k in range(len(cut) - 1):
                assert ids[cut[k]:cut[k + 1]].tolist() == ids_of(texts[row + k], 3).tolist()


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=200))))
def test_pack_and_unpack(case):
    bits, ids = case
    data = bitpack.pack(np.array(ids, dtype=np.uint32), bits)
    assert len(data) == -(-len(ids) // 64) * bits * 8
    assert bitpack.unpack(data, bits, len(ids)).tolist() == ids


def test_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, 5 * bitpack.BLOCK + 77).astype(np.uint32)
    out = io.BytesIO()
    w = bitpack.Writer(out, bitpack.bits_for(49408))
    for part in np.array_split(ids, 9):
        w.add(np.array([1]), part, np.array([len(part)]))
    w.close()
    r = bitpack.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    for a, n in ((0, 5), (bitpack.BLOCK - 3, 10), (17, 3 * bitpack.BLOCK), (len(ids) - 1, 1), (4, 0)):
        assert r.ids(a, n).tolist() == ids[a:a + n].tolist()
    assert len(out.getvalue()) < 2.02 * len(ids)


def test_op9_whole_table(spark, duck):
    start, want = 0, []
    for i, text in duck.sql("select doc_id, text from documents order by doc_id").fetchall():
        ids = ids_of(text, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op9_token_bit_packing"](spark, SF01).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_op9_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'q' AS d", "1 AS start")
    path, files = bitpack.write(df, tokenizer_path(), VOCABULARY, 2)
    got = sorted(bitpack.read_back(path, files).collect(), key=lambda r: r.start)
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert [bytes(r.ids) for r in got] == [ids_of(t, 2).tobytes() for _, t in order]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    path, files = bitpack.write(df.limit(0), tokenizer_path(), VOCABULARY, 2)
    assert bitpack.read_back(path, files).count() == 0


def check_packing(rows, texts, window):
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[(r.doc_id, r.doc_tokens)].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    want = collections.Counter()
    for i, text in texts:
        want[(i, len(ids_of(text, 1)))] += 1
    assert {k: sum(r.length for r in v) for k, v in docs.items()} == {k: k[1] * c for k, c in want.items()}
    used = sum(r.length for r in rows)
    assert len(seqs) == -(-used // window)        # padding in one sequence at most
    return seqs


def test_op10_whole_table(spark, duck):
    texts = duck.sql("select doc_id, text from documents").fetchall()
    rows = QUERIES["op10_packing"](spark, SF01).collect()
    check_packing(rows, texts, 2048)
    ids = {i: ids_of(t, 1) for i, t in texts}
    covered = collections.Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert len(covered) == sum(map(len, ids.values())) and set(covered.values()) == {1}


def test_op10_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'q' AS r", "1 AS rest")
    for window in (16, 64):
        check_packing(packing.pack(df, tokenizer_path(), VOCABULARY, 1, window).collect(), EDGES, window)
    assert packing.pack(df.limit(0), tokenizer_path(), VOCABULARY, 1).count() == 0


def test_least_squares_fills_the_window():
    h = np.zeros(16, dtype=np.int64)
    h[[3, 13, 5, 6, 8]] = [100, 100, 40, 20, 31]
    combos = packing.combinations(h, 16)
    counts = packing.repeat_counts(combos, h)
    assert (combos.sum(axis=1) == 16).all()
    used = np.bincount(combos.reshape(-1), weights=np.repeat(counts, 3), minlength=16)
    assert (used[1:] <= h[1:]).all() and counts.sum() >= 0.9 * (100 + 20 + 15)


def test_an_id_beyond_the_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1, 16], dtype=np.uint32), 4)
    assert (bitpack.unpack(bitpack.pack(np.array([1, 15], dtype=np.uint32), 4), 4, 2) == [1, 15]).all()


def test_rows_of_one_id_are_in_several_files(spark):
    df = spark.createDataFrame([(None if i % 3 else 7, f"word {i}") for i in range(300)], "doc_id long, text string")
    path, files = bitpack.write(df, tokenizer_path(), VOCABULARY, end=2)
    rows = files.orderBy("part").collect()
    assert sum(r.n_docs > 0 for r in rows) > 4 and sum(r.n_docs for r in rows) == 300
    got = bitpack.read_back(path, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 100
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
