"""Op 13: SentencePiece ids of whole texts, and the texts that the ids decode to.

A merge-type vocabulary is applied by an agenda: the adjacent symbol pairs of a
unit that are pieces wait in a heap in order of score (ties: the leftmost first);
the best one is merged and its new neighbours join the agenda, until none is left.
A symbol that is no piece becomes the pieces of its bytes.

No piece goes on after a blank that follows another character, so the units of a
text are its runs of blanks with the word behind them, and each distinct unit is
solved once in a block and remembered (``MEMORY`` units in a Python worker).
A vocabulary that has such a piece makes every text one unit.

The units of each Arrow batch are checked against the sentencepiece library as they
are learned: ``agrees`` is false for a text with a unit that the library encodes
otherwise.  (That units join to what the library makes of whole texts is tested.)
The library also normalizes and decodes.

Defined cases: a null text is empty; an empty text has the begin and end ids alone;
repeated rows and null ids are rows like any; extra columns are ignored; an empty
table gives an empty result.  A model that is not of the merge type, lacks byte
pieces, or holds user-defined or unused pieces raises ``ValueError``, and so does one that puts no blank before a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import list_array, list_parts
from shelfwise.llm.tokens import Encoder
from shelfwise.llm.words import hash_ranges, text_buffer

BLANK = "▁"                # how pieces write a blank
MEMORY = 1_000_000              # units that a Python worker remembers, some 60 MB
SHORT = 48                      # characters of a unit whose agenda is a list
BLOCK_BYTES = 1 << 20           # texts handled at once; a longer text is its own block
_BPE = 2                        # model type of merge vocabularies


class PieceEncoder(Encoder):
    """Ids by agenda, with the units met before (see ``tokens.Encoder``)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != _BPE:
            raise ValueError(f"{path}: not a merge-type (BPE) vocabulary")
        if not model.normalizer_spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: a vocabulary whose texts do not begin with a blank is not handled")
        pieces = list(enumerate(model.pieces))
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for _, p in pieces):
            raise ValueError(f"{path}: user-defined and unused pieces are not handled")
        normal = [(i, p) for i, p in pieces if p.type == kinds.NORMAL]
        scores = sorted({p.score for _, p in normal}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = {p.piece.replace(BLANK, " "): rank[p.score] for _, p in normal}
        self.id_of = {p.piece.replace(BLANK, " "): i for i, p in normal}
        self.none = len(scores)
        self.byte = {int(p.piece[3:5], 16): i for i, p in pieces if p.type == kinds.BYTE}
        if len(self.byte) != 256:
            raise ValueError(f"{path}: a vocabulary without byte pieces is not handled")
        self.splits = not any(" " in p.lstrip(" ") for p in self.id_of)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        if min(self.begin, self.end) < 0:
            raise ValueError(f"{path}: no begin or end id")
        self.wrong: set[int] = set()        # hashes of units for which the library has other ids
        self._forget()

    def merged(self, unit: str) -> list[str]:
        """The symbols that the agenda leaves of a unit.  A short unit's agenda is a
        list in order of place, whose least rank is looked up; a long one's a heap."""
        if len(unit) > SHORT:
            return self._merged_by_heap(unit)
        rank, symbols, none = self.rank.get, list(unit), self.none
        agenda = [rank(a + b, none) for a, b in zip(symbols, unit[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + both, none)
        return symbols

    def _merged_by_heap(self, unit: str) -> list[str]:
        rank, symbols, n = self.rank.get, list(unit), len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, 2))
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != size:
                continue                        # one of the two has been merged since
            left = symbols[i] = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(left + symbols[k])
                if r is not None:
                    heappush(agenda, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = rank(symbols[h] + left)
                if r is not None:
                    heappush(agenda, (r, h, len(symbols[h]) + size))
        return [s for s in symbols if s is not None]

    def unit_ids(self, unit: str) -> list[int]:
        symbols = self.merged(unit)
        ids = list(map(self.id_of.get, symbols))
        if None in ids:
            ids = [k for s, i in zip(symbols, ids) for k in ([i] if i is not None else [self.byte[b] for b in s.encode()])]
        return ids

    def _learn(self, texts: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.unit_ids(t) for t in texts]
        expected = self.library.encode([t[1:] for t in texts], num_threads=1)      # which puts the blank back,
        expected = [x or [self.library.piece_to_id(BLANK)] for x in expected]      # but before no empty text
        if found != expected:
            wrong = [t.encode() for t, a, b in zip(texts, found, expected) if a != b]
            self.wrong.update(int(hash_ranges(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in wrong)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units of a block of normalized texts."""
        cut = np.zeros(len(buf) + 1, dtype=bool)
        if self.splits:
            blank = buf == 0x20
            cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normalized texts (blanks for ``BLANK``), each text's offsets, and
        whether the library has the same ids for all its units."""
        start, agrees = self._cuts(buf, offsets), np.ones(len(offsets) - 1, dtype=bool)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64), agrees
        end = np.append(start[1:], len(buf))
        one, two = hash_ranges(buf, start, end, 0), hash_ranges(buf, start, end, 1)
        keys, rep, unit = np.unique(one, return_index=True, return_inverse=True)
        checks, raw = two[rep], buf.tobytes()
        if (checks[unit] != two).any():         # two units with one hash: solve each by itself
            ids, size = self._learn([raw[i:j].decode() for i, j in zip(start.tolist(), end.tolist())], unit)
            agrees[:] = not self.wrong
            return ids, np.append(0, np.cumsum(size))[np.searchsorted(start, offsets)], agrees
        spot, found = self._find(keys, checks)
        if not found.all():
            new = np.flatnonzero(~found)
            if len(self.keys) and (len(self.keys) + len(new) > MEMORY or (self.keys[spot[new]] == keys[new]).any()):
                self._forget()
                new = np.arange(len(keys))
            s, e = start[rep[new]].tolist(), end[rep[new]].tolist()
            self._remember(keys[new], checks[new], [raw[i:j].decode() for i, j in zip(s, e)], np.zeros(len(new), np.int64))
            spot, found = self._find(keys, checks)
        at, n = self.at[spot][unit], self.size[spot][unit]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(stop[-1])) + np.repeat(at - (stop - n), n)]
        if self.wrong:
            places = start[np.isin(one, np.array(sorted(self.wrong), dtype=np.uint64))]
            agrees[np.searchsorted(offsets, places, side="right") - 1] = False
        return ids, np.append(0, stop)[np.searchsorted(start, offsets)], agrees


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _between(ids: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids between a begin and an end id."""
    docs = len(offsets) - 1
    own = offsets + 2 * np.arange(docs + 1)
    out = np.empty(len(ids) + 2 * docs, dtype=np.uint32)
    inner = np.ones(len(out), dtype=bool)
    inner[own[:-1]] = inner[own[1:] - 1] = False
    out[inner], out[own[:-1]], out[own[1:] - 1] = ids, begin, end
    return out, own


def encoded_blocks(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ids, offsets, agrees) of consecutive blocks of a text column, with begin and end ids."""
    own = encoder(path)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        done = sizes[row - 1] if row else 0
        last = max(row + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, side="right")))
        part = texts.slice(row, last - row).to_pylist()
        plain = pc.replace_substring(pa.array(own.library.normalize(part), pa.large_string()), BLANK, " ")
        ids, offsets, agrees = own.texts(*text_buffer(plain))
        yield row, *_between(ids, offsets, own.begin, own.end), agrees
        row = last


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``ids`` (with the begin and end ids), ``decoded`` (what
    they decode to) and ``agrees`` (whether the library gives the same ids for all its units)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()),
                        ("agrees", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            for row, ids, offsets, agrees in encoded_blocks(batch.column(1), path):
                lists = [ids[i:j].tolist() for i, j in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(agrees)), list_array(ids.astype(np.int32), offsets, pa.int32()),
                    pa.array(library.decode(lists, num_threads=1), pa.string()), pa.array(agrees)], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")


def decode(table: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the ``text`` that a list of ids decodes to (a null list: empty).
    An id outside the vocabulary raises ``ValueError``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, offsets = list_parts(batch.column(1))
            if len(ids) and not ((ids >= 0) & (ids < own.library.get_piece_size())).all():
                raise ValueError("an id lies outside the vocabulary")
            lists = [ids[i:j].astype(np.int64).tolist() for i, j in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.library.decode(lists, num_threads=1), pa.string())],
                                             names=["doc_id", "text"])

    return table.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")) \
        .mapInArrow(run, "doc_id long, text string")


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over doc_id, ids, decoded, agrees: the contract's columns."""
    for batch in batches:
        ids, offsets = list_parts(batch.column("ids"))
        raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B") if len(ids) else b""
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
            pa.array([hashlib.sha256(raw[4 * i:4 * j]).hexdigest() for i, j in zip(offsets.tolist(), offsets[1:].tolist())], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()], pa.string()),
            batch.column("agrees")], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])
