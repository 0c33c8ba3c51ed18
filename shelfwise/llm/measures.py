"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from shelfwise.llm.words import NOT_SPACE, Block, hash_ranges, mix, ngram_hashes, sorting

_byte = np.arange(256)
#: ``[#*$%&|<>]``
SYMBOL = np.isin(_byte, np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (_byte >= 0x41) & (_byte <= 0x5A)
DIGIT = (_byte >= 0x30) & (_byte <= 0x39)
LETTER = UPPER | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
STOP = np.isin(_byte, np.frombuffer(b".,;:!?", np.uint8))
#: first bytes of characters (all but UTF-8 continuation bytes)
FIRST = (_byte & 0xC0) != 0x80
#: first bytes of characters of words (runs without white space)
IN_WORD = FIRST & NOT_SPACE


def per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marked places of each text."""
    total = np.zeros(len(mark) + 1, dtype=np.int64)
    np.cumsum(mark, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _earlier(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier one of their text, and which any other.
    Keys are 64-bit hashes; the text's number is mixed into them."""
    own = mix(key + mix(doc.astype(np.uint64)))
    order = sorting(own)
    own = own[order]
    at = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
    earlier = np.ones(len(own), dtype=bool)
    earlier[order[at]] = False
    size = np.diff(np.append(at, len(own)))
    other = np.zeros(len(own), dtype=bool)
    other[order] = np.repeat(size > 1, size)
    return earlier, other


def lines(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the \\n-split lines that have a word."""
    newline = np.flatnonzero(b.buf == 0x0A)
    start = np.unique(np.concatenate([b.offsets[:-1], newline + 1]))
    start = start[start < len(b.buf)]
    if not len(start):
        return start, start, start
    end = np.append(start[1:], len(b.buf))
    end = end - (b.buf[end - 1] == 0x0A)
    doc = np.searchsorted(b.offsets, start, side="right") - 1
    has = np.searchsorted(b.start, end) > np.searchsorted(b.start, start)
    return start[has], end[has], doc[has]


def base(b: Block) -> dict[str, np.ndarray]:
    """Counts of each text: the base of the quality rules."""
    n = np.diff(b.first)
    doc = b.doc_of_word()
    out = {"n_words": n, "word_chars": per_text(IN_WORD[b.buf], b.offsets),
           "n_symbols": per_text(SYMBOL[b.buf], b.offsets)}
    s, e, owner = lines(b)
    out["n_dup_lines"] = np.bincount(owner[_earlier(hash_ranges(b.buf, s, e), owner)[0]], minlength=b.n_docs)
    h, at = b.hashes(), b.window_starts(3)
    again = np.zeros(len(h) + 2, dtype=bool)
    if len(at):
        found = at[_earlier(ngram_hashes(h, 3)[at], doc[at])[1]]
        for k in range(3):
            again[found + k] = True
    out["n_repeat_words"] = per_text(again[:len(h)], b.first)
    return out


def measure(b: Block) -> dict[str, np.ndarray]:
    """Counts of each text: the base of the quality rules and some more."""
    out = base(b)
    n, doc, h = out["n_words"], b.doc_of_word(), b.hashes()
    out["n_lines"] = np.bincount(lines(b)[2], minlength=b.n_docs)
    out["n_distinct"] = n - per_text(_earlier(h, doc)[0], b.first)
    echo = np.zeros(len(h), dtype=bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["n_echo"] = per_text(echo, b.first)
    for name, table in (("n_upper", UPPER), ("n_digit", DIGIT), ("n_letter", LETTER), ("n_stop", STOP), ("n_chars", FIRST)):
        out[name] = per_text(table[b.buf], b.offsets)
    return out
