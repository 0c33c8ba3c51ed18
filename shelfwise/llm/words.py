"""Words of whole texts as numpy arrays, for use inside Spark tasks.

A block of texts is one UTF-8 buffer.  A table of 256 entries says which bytes
belong to words, so the word borders, the word hashes and the hashes of n
consecutive words are a handful of vector operations, with no Python object
per word.  Texts are never cut: a text longer than a block is a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 3 << 20      # texts handled at once; a longer text is its own block
_SEGMENT = 1 << 16         # bytes hashed at once: what is worked out of them stays in a core's cache
_KEPT = 2 << 20            # most powers kept for hashing

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)      # odd, so invertible modulo 2^64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_byte = np.arange(256)
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, lower-case letters, all beyond ASCII
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
#: A-Z to a-z, other bytes unchanged
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def sorting(x: np.ndarray) -> np.ndarray:
    """The places of 64-bit numbers in ascending order, equal ones as they come.  Numbers are
    sorted with their places in their lowest bits, several times faster than places alone; where
    that takes numbers that differ only there out of order, they are sorted again."""
    low = _U((1 << len(x).bit_length()) - 1)
    own = x & ~low
    own |= np.arange(len(x), dtype=_U)
    own.sort()
    own &= low
    order = own.view(np.int64)
    near = x[order]
    return order[np.argsort(near, kind="stable")] if (near[1:] < near[:-1]).any() else order


def _power_table(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        base = _BASES[lane]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, dtype=_U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = (both[0], both[1])
        if n <= _KEPT:
            _powers[lane] = have
    return have


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of ``buf[start:end]`` for each of ascending, disjoint ranges."""
    out = np.empty(len(start), dtype=_U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = _power_table(lane, max(_SEGMENT, b - a) + 1)
        x = buf[a:b].astype(_U)
        x += _U(1)
        x *= power[:b - a]
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(x, out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
        i = j
    return out


def ngram_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each n consecutive elements of ``h``, by doubling (length ``len(h)-n+1``)."""
    if len(h) < n:
        return np.empty(0, dtype=_U)
    q, size = _BASES[1 - lane], 1
    power = h                                  # hashes of `size` elements
    done, done_len = None, 0                   # hashes of the elements taken so far
    rest = n
    while rest:
        if rest & 1:
            if done is None:
                done, done_len = power, size
            else:
                m = len(h) - done_len - size + 1
                done = done[:m] * _U(pow(q, size, 1 << 64)) + power[done_len:done_len + m]
                done_len += size
        rest >>= 1
        if rest:
            m = len(power) - size
            power = power[:m] * _U(pow(q, size, 1 << 64)) + power[size:size + m]
            size *= 2
    return mix(done)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive elements."""
    size, cur = 1, x
    while size * 2 <= n:
        cur = np.minimum(cur[:len(cur) - size], cur[size:])
        size *= 2
    if size < n:
        gap = n - size
        cur = np.minimum(cur[:len(cur) - gap], cur[gap:])
    return cur


@dataclass
class Block:
    """Words of consecutive texts.  ``first[d]:first[d + 1]`` are text d's words."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: int                    # of the batch, at which the block begins

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lane: int = 0) -> np.ndarray:
        return hash_ranges(self.buf, self.start, self.end, lane)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def window_starts(self, n: int) -> np.ndarray:
        """Words at which n words of one text begin."""
        doc = self.doc_of_word()
        if len(doc) < n:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(offsets) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and first word per text, for the bytes that ``inside`` marks."""
    if len(buf) == 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    word = inside[buf]
    border = np.zeros(len(buf) + 1, dtype=bool)
    border[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | border[1:-1]
    closes = word
    closes[:-1] &= ~word[1:] | border[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def blocks(texts: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False,
           limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column, in blocks of about ``limit`` bytes."""
    buf, offsets = text_buffer(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        part = buf[offsets[row]:offsets[last]]
        part = LOWER[part] if lower else part
        own = offsets[row:last + 1] - offsets[row]
        yield Block(part, own, *split_words(part, own, inside), row)
        row = last
