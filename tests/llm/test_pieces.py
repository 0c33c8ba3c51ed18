"""op13 against the sentencepiece library, and the agenda against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shelfwise.llm import pieces as P
from shelfwise.llm.queries import QUERIES
from tests.conftest import SF01

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  a  b ", "hello\n\n world", "<s> </s> <unk> <0x41>", "ﬁ ½ é é", "▁x ▁▁y", "日本語テキスト😀 ok", "a\x00b", "x" * 3000, "   " * 99,
       "the " * 50_000, "ａｂｃ​ d", "\t\ttabs\r\n", "🏳️‍🌈" * 20, "aaaaaaaab" * 200]


def expected(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def test_whole_table(spark, duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    rows = QUERIES["op13_sentencepiece"](spark, SF01).collect()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    assert all(tuple(r)[1:4] == expected(texts[r.doc_id]) for r in rows)


def test_agenda_against_plain_merging():
    """Merge the best-scored leftmost pair of all, one at a time."""
    own, rng = P.PieceEncoder(PATH), random.Random(4)
    for _ in range(400):
        unit = "".join(rng.choice("  aeinrst hou.é日▁".replace("▁", "")) for _ in range(rng.randrange(1, 25)))
        symbols = list(unit)
        while True:
            pairs = [(own.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in own.rank]
            if not pairs:
                break
            _, i = min(pairs)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        assert own.merged(unit) == own._merged_by_heap(unit) == symbols


def test_odd_texts_and_decoding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "a b"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS agrees", "'x' AS decoded")
    got = P.encode(df, PATH)
    found = sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=repr)
    assert found == sorted(((i, LIBRARY.encode(t or "", add_bos=True, add_eos=True),
                             LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows), key=repr)
    assert all(r.agrees for r in got.collect())
    again = P.decode(got, PATH)
    assert sorted((tuple(r) for r in again.collect()), key=repr) == sorted(((i, d) for i, _, d in found), key=repr)


def test_forgetting_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(P, "MEMORY", 50)
    own = P.PieceEncoder(PATH)
    for part in range(20):
        words = [" ".join(f"w{part}x{i}" for i in range(30)), "the same words"]
        buf = np.frombuffer("".join(" " + w for w in words).encode(), dtype=np.uint8)
        ids, at, _ = own.texts(buf, np.append(0, np.cumsum([len(w) + 1 for w in words])))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == LIBRARY.encode(words)
    assert P.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_a_unit_that_the_library_encodes_otherwise(spark):
    own = P.PieceEncoder(PATH)
    own.rank["q" * 3], own.id_of["q" * 3] = 0, 500          # a vocabulary unlike the library's
    own.rank["qq"], own.id_of["qq"] = 0, 501
    texts = [" a plain text", " some qqq here", " the end"]
    ids, at, agrees = own.texts(np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    assert agrees.tolist() == [True, False, True] and 500 in ids[at[1]:at[2]]


def test_ids_outside_the_vocabulary_and_other_models(spark, tmp_path):
    bad = spark.createDataFrame([(1, [1, 99_999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        P.decode(bad, PATH).collect()
    from sentencepiece import sentencepiece_model_pb2
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(LIBRARY.serialized_model_proto())
    model.pieces[300].type = model.SentencePiece.USER_DEFINED
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="user-defined"):
        P.PieceEncoder(str(tmp_path / "other.model"))
