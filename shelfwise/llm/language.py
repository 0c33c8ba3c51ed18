"""Language identification by string kernels.

The kernel is the blended spectrum of n-gram presence: a text is the set of its
1- to 3-grams of symbols (letters folded to lower case, white space, digits,
other ASCII, and classes of the bytes beyond ASCII; 64 in all), and

    k(x, y) = |X n Y| / sqrt(|X| |Y|)

over the n-grams that occur in a landmark.  Landmarks are labelled texts; the
Nystroem features of x are its kernel values to them, whitened by the inverse
root of the landmarks' own kernel matrix.  One-versus-rest kernel ridge
regression on those features has a closed form.  Texts are scored in batches:
a matrix of presences times the landmarks' (intersections), times the weights.

Training takes at most ``TRAIN`` labelled texts, spread evenly over the
languages and chosen by a hash of the id; that bound is a parameter.  Every text
is scored whole.

Defined cases: a null text, or one without a letter, is 'und' with score 0; a
null label is not trained on; with no labelled text at all every text is 'und'.
Rows that repeat a doc_id are scored one by one; a null doc_id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import blocks

TRAIN = 4000
LANDMARKS = 192
RIDGE = 1e-3
ROWS = 128               # texts in one matrix product
DEPTH = 3
BITS = 6
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    b = np.arange(256)
    table = np.full(256, 27, dtype=np.int64)                        # other ASCII
    table[(b >= 0x61) & (b <= 0x7A)] = np.arange(26)
    table[(b >= 0x41) & (b <= 0x5A)] = np.arange(26)
    table[(b >= 0x30) & (b <= 0x39)] = 28
    table[np.isin(b, np.frombuffer(b" \t\n\v\f\r", np.uint8))] = 26
    table[b >= 0x80] = 29 + (b[b >= 0x80] - 0x80) % 35
    return table


SYMBOLS = _symbols()
_SHIFT = np.cumsum([0] + [1 << (BITS * n) for n in range(1, DEPTH + 1)])     # where the codes of n-grams begin
CODES = int(_SHIFT[-1])


def codes_of(symbols: np.ndarray) -> np.ndarray:
    """Codes of all 1- to DEPTH-grams of one text's symbols."""
    out, key = [], symbols
    for n in range(1, DEPTH + 1):
        if n > 1:
            if len(symbols) < n:
                break
            key = (key[:-1] << BITS) | symbols[n - 1:]
        out.append(key + _SHIFT[n - 1])
    return np.concatenate(out)


def _sets(batches):
    schema = pa.schema([("lang", pa.string()), ("codes", pa.binary())])
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for b in blocks(batch.column(0)):
            symbols = SYMBOLS[b.buf]
            rows = [np.unique(codes_of(symbols[i:j])).astype(np.int32).tobytes() for i, j in zip(b.offsets, b.offsets[1:])]
            yield pa.record_batch([pa.array(langs[b.row:b.row + b.n_docs], pa.string()), pa.array(rows, pa.binary())], schema=schema)


class Model:
    def __init__(self, langs: list[str], sets: list[np.ndarray], landmarks: int = LANDMARKS):
        self.classes = sorted(set(langs))
        own: dict[str, list[int]] = {}
        for i, x in enumerate(langs):
            own.setdefault(x, []).append(i)
        each = max(1, landmarks // len(self.classes))
        marks = [i for x in self.classes for i in own[x][:each]]
        used = np.unique(np.concatenate([sets[i] for i in marks]))
        self.place = np.full(CODES, -1, dtype=np.int32)
        self.place[used] = np.arange(len(used))
        self.width = len(used)
        self.marks = self._matrix([sets[i] for i in marks])
        self.norm = np.sqrt(self.marks.sum(axis=1))
        value, vector = np.linalg.eigh(self.kernel(self.marks).astype(np.float64))
        keep = value > 1e-6 * value[-1]
        self.whiten = vector[:, keep] / np.sqrt(value[keep])
        x = np.concatenate([self.kernel(self._matrix(sets[i:i + ROWS])) for i in range(0, len(sets), ROWS)]) @ self.whiten
        y = (np.array(langs)[:, None] == np.array(self.classes)[None, :]).astype(np.float64)
        weight = 1 / np.maximum(y.sum(axis=0), 1)[y.argmax(axis=1)]          # every language counts the same
        weight *= len(y) / weight.sum()
        gram = x.T @ (x * weight[:, None]) + RIDGE * len(y) * np.eye(x.shape[1])
        self.weights = (self.whiten @ np.linalg.solve(gram, x.T @ (y * weight[:, None]))).astype(np.float32)

    def _matrix(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), self.width), dtype=np.float32)
        for k, codes in enumerate(sets):
            at = self.place[codes]
            out[k, at[at >= 0]] = 1
        return out

    def kernel(self, present: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(present.sum(axis=1), 1))
        return (present @ self.marks.T) / (size[:, None] * self.norm[None, :])

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(self._matrix(sets)) @ self.weights


def train(labelled: DataFrame, spark, limit: int = TRAIN) -> Model | None:
    """A model from rows (key, text, lang); at most ``limit`` of them, by hash of key."""
    known = labelled.filter("lang IS NOT NULL")
    counts = {r.lang: r.c for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts:
        return None
    each = max(2, limit // len(counts))
    part = F.pmod(F.xxhash64(F.col("key"), F.lit("train")), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, c in counts.items():
        chosen = F.when(F.col("lang") == lang, part < int(min(1.0, each / c) * (1 << 30))).otherwise(chosen)
    rows = known.filter(chosen).select("text", "lang").mapInArrow(_sets, "lang string, codes binary").collect()
    rows = sorted(((r.lang, bytes(r.codes)) for r in rows if len(r.codes)), key=lambda x: (x[0], hash_of(x[1])))
    if not rows:
        return None
    return Model([x for x, _ in rows], [np.frombuffer(c, np.int32) for _, c in rows])


def hash_of(data: bytes) -> int:
    import zlib
    return zlib.crc32(data)


def _letters(b, column: pa.Array) -> np.ndarray:
    """Texts that have a letter, in any script."""
    low = (b.buf | 0x20)
    ascii_letter = np.append(0, np.cumsum((low >= 0x61) & (low <= 0x7A)))
    out = ascii_letter[b.offsets[1:]] > ascii_letter[b.offsets[:-1]]
    for k in np.flatnonzero(~out):
        text = column[b.row + int(k)].as_py() or ""
        out[k] = any(c.isalpha() for c in text)
    return out


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in blocks(batch.column(2)):
                has = _letters(b, batch.column(2)) & (model is not None)
                names, score = np.full(b.n_docs, UNKNOWN, dtype=object), np.zeros(b.n_docs)
                symbols = SYMBOLS[b.buf]
                todo = np.flatnonzero(has)
                for i in range(0, len(todo), ROWS):
                    at = todo[i:i + ROWS]
                    found = model.scores([codes_of(symbols[b.offsets[k]:b.offsets[k + 1]]) for k in at])
                    best = found.argmax(axis=1)
                    names[at] = np.array(model.classes, dtype=object)[best]
                    score[at] = np.clip(found.max(axis=1), 0, 1)
                yield pa.record_batch([batch.column(0).slice(b.row, b.n_docs), batch.column(1).slice(b.row, b.n_docs),
                                       pa.array(names, pa.string()), pa.array(score)], schema=schema)
    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Rows for
    which ``held_out`` is true are not trained on."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    model = train(rows.filter("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"), docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # landmarks and weights: some megabytes
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
