"""Token ids of whole texts by a public tokenizer, inside Spark tasks.

The tokenizer folds case, drops white space, and cuts what is left into pieces
(letters, one digit, or other characters) that it encodes one by one, so a text's
ids are those of its units in order.  A unit is a run of letters, of digits or of
other ASCII characters of a space-separated word; words with characters for which
that is not certain (apostrophes, ``<``, control characters, all beyond Latin
letters) are units as they stand.  Each distinct unit is encoded once in a block,
and units met before are remembered, ``MEMORY`` at most in a Python worker.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from shelfwise.llm.words import LOWER, Block, blocks, hash_ranges

MEMORY = 600_000        # units, some 40 MB
AT_ONCE = 4_000         # units in one call of the tokenizer
JOINED = 16             # units in one text of that call

_byte = np.arange(256)
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[(_byte > 0x20) & (_byte < 0x7F)] = _OTHER
_KIND[(_byte >= 0x30) & (_byte <= 0x39)] = _DIGIT
_KIND[((_byte | 0x20) >= 0x61) & ((_byte | 0x20) <= 0x7A) | (_byte >= 0x80)] = _LETTER
#: bytes of words that are not cut: all but printable ASCII and U+00C0 to U+024F
_WHOLE = np.isin(_byte, [0x27, 0x3C, 0x7F]) | (_byte < 0x20) | (_byte == 0xC2) | (_byte >= 0xCA)
_BLANK = np.isin(_byte, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_WHOLE &= ~_BLANK


def units_of(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of a block, and the number of pieces of each
    (0: not known)."""
    buf = b.buf
    odd = _WHOLE[buf]
    if len(buf) > 1:                # U+00D7, U+00F7 (no letters) and U+0130 (two characters in lower case)
        lead, tail = buf[:-1], buf[1:]
        odd[:-1] |= (lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (lead == 0xC4) & (tail == 0xB0)
    total = np.append(0, np.cumsum(odd))
    whole = total[b.end] > total[b.start]
    kind = _KIND[buf]
    cut = np.zeros(len(buf), dtype=bool)
    cut[1:] = kind[1:] != kind[:-1]
    word = np.zeros(len(buf) + 1, dtype=np.int8)        # within a word that may be cut
    word[b.start[~whole]] += 1
    word[b.end[~whole]] -= 1
    cut &= np.cumsum(word[:-1]).astype(bool)
    cut[b.start] = True
    start = np.flatnonzero(cut)
    of_word = np.searchsorted(b.start, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(buf)), b.end[of_word])
    pieces = np.where(kind[start] == _DIGIT, end - start, 1)
    pieces[whole[of_word]] = 0
    return start, end, pieces


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)      # ids that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some units, end to end, and how many each has."""
        flat, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i in range(0, len(texts), AT_ONCE):
            part, known = texts[i:i + AT_ONCE], pieces[i:i + AT_ONCE]
            if (known > 0).all():
                ids = np.array([x for e in self._encode([" ".join(part[k:k + JOINED]) for k in range(0, len(part), JOINED)])
                                for x in e], dtype=np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == known.sum() and len(ids) and ends[-1] == len(ids):
                    sizes[i:i + len(part)] = np.diff(np.append(0, ends[np.cumsum(known) - 1]))
                    flat.append(ids)
                    continue
            found = self._encode(part)
            sizes[i:i + len(part)] = [len(x) for x in found]
            flat.append(np.array([x for e in found for x in e], dtype=np.uint32))
        return np.concatenate(flat) if flat else np.empty(0, np.uint32), sizes

    def _remember(self, keys, checks, texts, pieces) -> None:
        """Add units (none of them known) in order of key."""
        at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for part in (np.flatnonzero(pieces > 0), np.flatnonzero(pieces == 0)):
            flat, n = self._learn([texts[i] for i in part], pieces[part])
            at[part], size[part] = np.cumsum(n) - n + len(self.flat), n
            self.flat = np.concatenate([self.flat, flat])
        new = np.zeros(len(self.keys) + len(keys), dtype=bool)
        new[np.searchsorted(self.keys, keys) + np.arange(len(keys))] = True
        merged = []
        for old, own in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.size, size)):
            both = np.empty(len(new), dtype=old.dtype)
            both[new], both[~new] = own, old
            merged.append(both)
        self.keys, self.checks, self.at, self.size = merged

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return spot, (self.keys[spot] == keys) & (self.checks[spot] == checks)

    def block(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the offsets of each text's ids."""
        if not len(b.start):
            return np.empty(0, np.uint32), np.zeros(b.n_docs + 1, np.int64)
        start, end, pieces = units_of(b)
        low = LOWER[b.buf]
        one = hash_ranges(low, start, end, 0) ^ (pieces == 0).astype(np.uint64)
        two = hash_ranges(low, start, end, 1)
        keys, rep, unit = np.unique(one, return_index=True, return_inverse=True)
        checks = two[rep]
        if (checks[unit] != two).any():         # two units with one hash: encode every text as a whole
            whole = self._encode([bytes(b.buf[i:j]).decode() for i, j in zip(b.offsets, b.offsets[1:])])
            return (np.array([x for e in whole for x in e], dtype=np.uint32),
                    np.append(0, np.cumsum([len(e) for e in whole])))
        spot, found = self._find(keys, checks)
        if not found.all():
            if len(self.keys) + int((~found).sum()) > MEMORY:
                self._forget()
                spot, found = self._find(keys, checks)
            new, raw = np.flatnonzero(~found), b.buf.tobytes()
            if len(self.keys) and (self.keys[spot[new]] == keys[new]).any():   # another unit has this hash: start anew
                self._forget()
                new = np.arange(len(keys))
            s, e = start[rep[new]].tolist(), end[rep[new]].tolist()
            self._remember(keys[new], checks[new], [raw[i:j].decode() for i, j in zip(s, e)], pieces[rep[new]])
            spot, found = self._find(keys, checks)
        at, n = self.at[spot][unit], self.size[spot][unit]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(int(stop[-1])) + np.repeat(at - (stop - n), n)]
        return ids, np.append(0, stop)[np.searchsorted(start, b.offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to each text."""
    docs = len(offsets) - 1
    out = np.empty(len(ids) + docs, dtype=np.uint32)
    own = offsets + np.arange(docs + 1)
    last = own[1:] - 1
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    out[keep], out[last] = ids, end
    return out, own


def encoded(texts: pa.Array, path: str, end: int):
    """(row, ids, offsets) of each block of a text column."""
    own = encoder(path)
    for b in blocks(texts, limit=1 << 20):
        yield b.row, *with_end(*own.block(b), end)
