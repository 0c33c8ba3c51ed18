"""Quality rules: word n-gram perplexity under a modified Kneser-Ney model.

The model is over pairs of words, per language: a word is a run without white
space, ASCII letters folded to lower case, and in scripts written without blanks
(Han, Kana, Thai, Lao, Khmer, Burmese) one character.  Words and pairs are 64-bit
hashes that the language is mixed into, so a language is never capped or merged
with another, and the model grows with the corpus.

A pair counts as often as different words stand before it (its continuation count
in a model of three words), so that copies of a passage count once.

1. Texts are read once, in blocks of some megabytes.  A block is written as one row: its
   distinct words, frequent ones first, the texts as numbers of these, and the base counts.  It
   carries its name, so that any later split of the table, on any number of cores, finds it.
2. Each block sends its distinct pairs with the words before them (32 bits of
   their hash), in arrays sorted by hash, to the buckets of a hash partitioning.
   A bucket counts and answers every block with the counts over all texts; one
   block owns each pair.
   This is done for one of ``PASSES`` parts of the hash space after another,
   which bounds the disk that is used at a time.
3. From the pairs that it owns a block adds to what its words need: sum as
   context, distinct followers of count 1, 2 and 3 or more, distinct words to
   the left.  Buckets of words add those up and answer in the same way, and give
   the counts of counts of each language.
4. Each block puts the answers together: three discounts an order, continuation
   counts below, uniform at the bottom.  Every pair is one that the corpus has.

No block sends an entry twice, so a passage or word that is everywhere costs a
bucket one entry a block.  The answers are written tables, sorted by block, of which a
task reads its own.

A text's log-perplexity (a word pair) is compared with its language's band:
``BELOW`` and ``ABOVE`` times the distance between median and quartile, over
texts that pass the base rules.  Both widths are chosen from the labelled rows of
10,000 documents: the README has what each width rejects.

Defined cases: a null language is a language of its own.  A null or empty text,
or one of fewer than two words, has no perplexity and fails the base rules.
Rows that repeat a doc_id are judged one by one; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import drop, filesystem, free_shuffles, scratch_path, shuffle_partitions, stored
from shelfwise.llm.measures import base
from shelfwise.llm.words import LOWER, NOT_SPACE, Block, blocks, hash_ranges, mix, sorting, split_words
from shelfwise.session import drop_path

NO_LANGUAGE = "no language"
FLOOR = 0.1              # least discount, so that unseen n-grams keep a probability
BELOW, ABOVE = 6.0, 6.0  # widths of the band
PASSES = 6               # over the pairs, a part of their hashes each
WORD_PASSES = 2          # over the words: with two their steps take as much disk as those of the pairs
BLOCK = 8 << 20          # bytes of text in a block
CHUNK = 256 << 10        # bytes of text split and hashed at once, so that a core's cache holds them
LINK = 1 << 15           # words whose pairs are hashed at once, likewise
BUCKET = 16 << 20        # bytes of text for each bucket of hashes
STEP = 1000              # bins of log-perplexity per unit, for medians and quartiles


def discounts(by_count: list[float]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams of count 1 to 4."""
    y = by_count[0] / (by_count[0] + 2 * by_count[1]) if by_count[0] else 0.0
    return np.array([0.0] + [min(max(k - (k + 1) * y * by_count[k] / by_count[k - 1], FLOOR), float(k))
                             if by_count[k - 1] else 0.5 for k in (1, 2, 3)])


def _single(buf: np.ndarray) -> np.ndarray:
    """Starts of the characters (3 bytes each) of scripts written without blanks."""
    at = np.flatnonzero(buf[:-2] >= 0xE0) if len(buf) > 2 else np.empty(0, np.int64)
    one, two = buf[at], buf[at + 1]
    return at[((one >= 0xE3) & (one <= 0xE9)) | ((one == 0xE0) & (two >= 0xB8) & (two <= 0xBB))
              | ((one == 0xE1) & (((two >= 0x80) & (two <= 0x82)) | (two == 0x9E) | (two == 0x9F)))]


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _new(x: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, the first place of each, and each entry's number among them."""
    order = sorting(x)
    x = x[order]
    new = _new(x)
    number = np.empty(len(x), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], order[new], number


def _hashes(b: Block, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, with its language mixed in, and words and language of each text."""
    single = _single(b.buf)
    start, end, first = b.start, b.end, b.first
    if len(single):
        start, end, _ = split_words(b.buf, np.unique(np.concatenate([b.offsets, single, single + 3])), NOT_SPACE)
        first = np.searchsorted(start, b.offsets)
    sizes = np.diff(first)
    salt = {x: _language(x) for x in set(langs)}
    lang = np.array([salt[x] for x in langs], dtype=np.uint64)
    return mix(hash_ranges(LOWER[b.buf], start, end) + np.repeat(mix(lang), sizes)), sizes, lang


class Pairs:
    """A block's different words (``words``), its texts as numbers of these (``code``), and its
    pairs in order; after :meth:`distinct` also its different pairs (``grams``).  Frequent words
    come first, by the powers of two of their number, so that most numbers are small; then by hash."""

    def __init__(self, b: Block, langs: list[str]):
        self._number([_hashes(b, langs)])
        self._link()

    def _number(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Number the words of the texts of which :func:`_hashes` gave the parts."""
        h, self.sizes, langs = (np.concatenate(x) for x in zip(*parts))
        order = sorting(h)
        h = h[order]
        new = _new(h)
        at = np.flatnonzero(new)
        often = np.frexp(np.diff(at, append=len(h)))[1].astype(np.int8)
        rank = np.argsort(-often, kind="stable")
        place = np.empty(len(at), dtype=np.uint32)
        place[rank] = np.arange(len(at), dtype=np.uint32)
        self.words = h[at[rank]]
        self.lang = langs[np.searchsorted(np.cumsum(self.sizes), order[at[rank]], side="right")]
        self.code = np.empty(len(h), dtype=np.uint32)
        self.code[order] = np.repeat(place, np.diff(at, append=len(h)))

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Pairs:
        """The words of consecutive texts, without their pairs."""
        p = cls.__new__(cls)
        p._number(parts)
        return p

    @classmethod
    def of(cls, words: np.ndarray, lang: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> Pairs:
        """The same from what was written."""
        p = cls.__new__(cls)
        p.words, p.lang, p.code, p.sizes = words, lang, code, sizes
        p._link()
        return p

    def _link(self) -> None:
        self._follows = np.ones(len(self.code), dtype=bool)        # another word of its text
        first = np.cumsum(self.sizes) - self.sizes
        self._follows[first[self.sizes > 0]] = False
        self._at = np.flatnonzero(self._follows[1:])
        self.hash = np.empty(len(self._at), dtype=np.uint64)
        done = 0
        for i in range(0, len(self.code) - 1, LINK):
            h = self.words[self.code[i:i + LINK + 1]]
            x = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            x += h[1:]
            x = mix(x[self._follows[i + 1:i + LINK + 1]])
            self.hash[done:done + len(x)] = x
            done += len(x)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - 1, 0))

    def before(self, pairs: np.ndarray) -> np.ndarray:
        """32 bits of the word before each of these pairs, 0 at the start of a text."""
        at = self._at[pairs]
        h = self.words[self.code[at - 1]]
        return np.where(self._follows[at], h >> np.uint64(32), 0).astype(np.uint32)

    def distinct(self) -> np.ndarray:
        """``grams`` and the words of each; returns each pair's number among them."""
        self.grams, first, number = _distinct(self.hash)
        first = self._at[first]
        self.g_left, self.g_right = self.code[first], self.code[first + 1]
        return number


def _parts(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted keys."""
    own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    return zip(own[cut].astype(int).tolist(), cut.tolist(), [*cut[1:].tolist(), len(own)])


def _planes(values: np.ndarray) -> bytes:
    """Numbers by column, and the bytes of a column by place, as many as the largest has, compressed."""
    flat = np.ascontiguousarray(values.T).reshape(-1)
    width = (int(flat.max()).bit_length() + 7) // 8 if len(flat) else 0
    data = np.empty((width, len(flat)), dtype=np.uint8)
    for k in range(width):
        data[k] = flat >> flat.dtype.type(8 * k)        # the lowest byte of what is left
    return width.to_bytes(1, "little") + len(flat).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _rising(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, whose highest bytes are zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _numbers(data: bytes | pa.Buffer, columns: int = 1, kind: type = np.uint64) -> np.ndarray:
    """What :func:`_planes` wrote, a row for each entry."""
    data = memoryview(data)
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[9:], width * n), np.uint8).reshape(width, n)
    flat = np.zeros(n, dtype=kind)
    for k in range(width):
        flat |= planes[k].astype(kind) << kind(8 * k)
    flat = flat.reshape(columns, -1)
    return flat.T if columns > 1 else flat[0]


_ZSTD = pa.Codec("zstd", compression_level=1)
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_CODED = ("words", "langs", "names", "codes", "sizes")       # what the model reads of a block
_BLOCKS = "task int, block int, doc_id array<long>, lang array<string>, base binary, " + ", ".join(f"{c} binary" for c in _CODED)


def _to_blocks(batches):
    """A row for each block of (text, lang, doc_id): its name, its texts in numbers, their base counts."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        own = ends // BLOCK
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist() if len(own) else []
        for i, j in zip(cut, [*cut[1:], batch.num_rows]):
            text, lang, ids = (c.slice(i, j - i) for c in batch.columns)
            names, counts, parts = lang.to_pylist(), [], []
            for b in blocks(text, limit=CHUNK):
                found = base(b)
                counts.append(np.stack([found[c] for c in _BASE], axis=1))
                parts.append(_hashes(b, names[b.row:b.row + b.n_docs]))
            p = Pairs.joined(parts)
            names, number = np.unique(p.lang, return_inverse=True)
            data = [_planes(np.concatenate(counts)), _rising(p.words), _planes(number), names.tobytes(), _planes(p.code), _planes(p.sizes)]
            all_rows = pa.array([0, j - i], pa.int32())
            yield pa.record_batch([
                pa.array([task], pa.int32()), pa.array([n], pa.int32()), *[pa.ListArray.from_arrays(all_rows, c) for c in (ids, lang)],
                *[pa.array([x], pa.binary()) for x in data]], names=["task", "block", "doc_id", "lang", "base", *_CODED])
            n += 1


def _read_blocks(batches):
    """(task, block, pairs, the batch and the row in it) of each block."""
    for batch in batches:
        for k, (task, block) in enumerate(zip(batch["task"].to_pylist(), batch["block"].to_pylist())):
            words, langs, names, codes, sizes = (batch[c][k].as_buffer() for c in _CODED)
            yield task, block, Pairs.of(
                np.cumsum(_numbers(words), dtype=np.uint64), np.frombuffer(names, np.uint64)[_numbers(langs)],
                _numbers(codes, 1, np.uint32), _numbers(sizes).astype(np.int64)), batch, k


_ASKED = "bucket int, task int, block int, keys binary, a binary"
_ANSWER = "bucket int, task int, block int, part int, a binary, lang decimal(20,0), n array<long>"
_ANSWER_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.decimal128(20, 0), pa.list_(pa.int64())]


def _ask_pairs(part: int, passes: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("task", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("a", pa.binary())])

    def run(batches):
        for task, n, p, _, _ in _read_blocks(batches):
            mine = np.flatnonzero(p.hash % np.uint64(passes) == part)
            keys, before = p.hash[mine], p.before(mine)
            own = mix(keys + before)
            at = sorting(own)
            at = at[_new(own[at])]
            at = at[sorting(keys[at])]
            keys, before = keys[at], before[at]
            rows = [(k, task, n, _rising(keys[i:j]), before[i:j].tobytes()) for k, i, j in _parts(keys, buckets)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def _gathered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A place of each distinct key of all rows, each one's place among the distinct ones, and where rows end."""
    keys = [np.cumsum(_numbers(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
    _, first, place = _distinct(np.concatenate(keys))
    return first, place, np.append(0, np.cumsum([len(x) for x in keys]))


def _answers(table: pa.Table, part: int, values: np.ndarray, cut: np.ndarray, counts=()) -> pa.Table:
    """Answers to the table's rows, and ``counts``: (language, 0 or 1 for words or pairs, numbers)."""
    rows = [(bucket, task, block, part, _planes(values[i:j]), None, None) for bucket, task, block, i, j in zip(
        table["bucket"].to_pylist(), table["task"].to_pylist(), table["block"].to_pylist(), cut, cut[1:])]
    rows += [(None, _COUNTS - k % 64, 0, kind, None, Decimal(int(lang)), n) for k, (lang, kind, n) in enumerate(counts)]
    columns = list(zip(*rows)) or [()] * len(_ANSWER_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _ANSWER_TYPES)], names=["bucket", "task", "block", "part", "a", "lang", "n"])


def _answer_pairs(part: int):
    def run(table: pa.Table) -> pa.Table:
        _, place, cut = _gathered(table)
        before = np.concatenate([np.frombuffer(x, np.uint32) for x in table["a"].to_pylist()])
        entries = np.sort((place.astype(np.uint64) << np.uint64(32)) | before)
        count = np.bincount((entries[_new(entries)] >> np.uint64(32)).astype(np.int64)).astype(np.uint64)
        once = np.append(True, place[1:] != place[:-1])     # a row is sorted: each of its pairs is answered once
        once[cut[:-1]] = True
        total = count[place] << np.uint64(1)
        owner = np.empty(len(count), dtype=np.int64)
        owner[place[once]] = np.flatnonzero(once)
        total[owner] |= np.uint64(1)                        # of the answers one goes to the block that owns the pair
        return _answers(table, part, total[once], np.append(0, np.cumsum(once))[cut])
    return run


def _written(answers: DataFrame, name: str) -> str:
    """Write the answers by task, blocks in order, in small row groups; the path."""
    path = scratch_path(answers.sparkSession, name)
    (answers.repartition("task").sortWithinPartitions("task", "block", "part", "bucket").write.option("compression", "zstd")
     .option("parquet.block.size", 4 << 20).partitionBy("task").parquet(path))
    free_shuffles(answers.sparkSession)
    return path


def _read_answers(path: str, task: int, block: int, columns: int = 1) -> np.ndarray:
    """The values for one block, in order of its keys."""
    fs, at = filesystem(f"{path}/task={task}")
    rows = pads.dataset(at, filesystem=fs, format="parquet").to_table(
        columns=["bucket", "a"], filter=pads.field("block") == block).sort_by("bucket")
    return np.concatenate([_numbers(a, columns) for a in rows["a"].to_pylist()])


def _pair_counts(paths: list[str], task: int, block: int, p: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts of a block's distinct pairs, and which it owns."""
    got = np.zeros(len(p.grams), dtype=np.uint64)
    part = p.grams % np.uint64(len(paths))
    for k, path in enumerate(paths):
        if (part == k).any():
            got[part == k] = _read_answers(path, task, block)
    return (got >> np.uint64(1)).astype(np.int64), (got & np.uint64(1)).astype(bool)


_COUNTS = -1     # and 63 below: the tasks under which counts of counts are written
_WORD = 5       # numbers a word: sum as context, followers of count 1, 2, 3 or more, words to the left
_STATS = "bucket int, task int, block int, keys binary, a binary, langs binary, names binary, n array<long>"


def _ask_words(part: int, parts: int, paths: list[str], buckets: int):
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("bucket", "task", "block", "keys", "a", "langs", "names", "n"), types)))

    def run(batches):
        for task, n, p, _, _ in _read_blocks(batches):
            if not len(p.hash):
                continue
            p.distinct()
            c, own = _pair_counts(paths, task, n, p)
            size, kind = len(p.words), np.minimum(c, 3)
            mine = sorting(p.words)
            mine = mine[p.words[mine] % np.uint64(parts) == part]
            value = np.stack([np.bincount(p.g_left[own], c[own], minlength=size),
                              *[np.bincount(p.g_left[own & (kind == k)], minlength=size) for k in (1, 2, 3)],
                              np.bincount(p.g_right[own], minlength=size)], axis=1).astype(np.uint64)[mine]
            names, lang = np.unique(p.lang, return_inverse=True)
            words, own_lang = p.words[mine], lang[mine]
            rows = [(k, task, n, _rising(words[i:j]), _planes(value[i:j]), _planes(own_lang[i:j]), names.tobytes(), None)
                    for k, i, j in _parts(words, buckets)]
            where = lang[p.g_left]
            for x, name in enumerate(names):            # the pairs' counts of counts go with the first part
                if part == 0:
                    times = c[own & (where == x)]
                    rows.append((task % buckets, task, n, None, None, None, name.tobytes(), [int((times == k).sum()) for k in (1, 2, 3, 4)]))
            if not rows:
                continue
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)
    return run


def _answer_words(table: pa.Table) -> pa.Table:
    """Answers, and by language the counts of counts of the bucket: of pairs, and of words of
    1, 2, 3, 4 and 3 or more words to the left, all of them, and the sum."""
    pairs: dict[int, np.ndarray] = {}
    rest = table.filter(pc.is_valid(table["n"]))
    for name, n in zip(rest["names"].to_pylist(), rest["n"].to_pylist()):
        x = int(np.frombuffer(name, np.uint64)[0])
        pairs[x] = pairs.get(x, 0) + np.array(n)
    words = table.filter(pc.is_null(table["n"]))
    counts = [(x, 1, n.tolist()) for x, n in pairs.items()]
    if not words.num_rows:
        return _answers(words, 0, np.empty(0, np.uint64), np.zeros(1, np.int64), counts)
    first, place, cut = _gathered(words)
    value = np.concatenate([_numbers(x, _WORD) for x in words["a"].to_pylist()])
    total = np.stack([np.bincount(place, value[:, k]) for k in range(_WORD)], axis=1).astype(np.uint64)
    lang = np.concatenate([np.frombuffer(n, np.uint64)[_numbers(x).astype(np.int64)]
                           for n, x in zip(words["names"].to_pylist(), words["langs"].to_pylist())])[first]
    for x in np.unique(lang):
        left = total[lang == x, 4].astype(np.int64)
        counts.append((x, 0, [*[int((left == k).sum()) for k in (1, 2, 3, 4)], int((left >= 3).sum()), int((left > 0).sum()), int(left.sum())]))
    return _answers(words, 0, total[place], cut, counts)


def _added(df: DataFrame, size: int) -> dict[int, list[int]]:
    """Sums by language of the lists ``n``: some numbers for each language."""
    sums = [F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(size)]
    return {int(r.lang): [int(r[f"n{k}"]) for k in range(size)] for r in df.groupBy("lang").agg(*sums).collect()}


class Model:
    """Written answers to the blocks of ``texts`` (see :func:`_to_blocks`), and the discounts."""

    def __init__(self, texts: DataFrame, size: int, passes: int = PASSES):
        spark = texts.sparkSession
        buckets = max(shuffle_partitions(spark), size // BUCKET)
        texts = texts.select("task", "block", *_CODED)
        self.pairs = [_written(texts.mapInArrow(_ask_pairs(k, passes, buckets), _ASKED).groupBy("bucket").applyInArrow(
            _answer_pairs(k), _ANSWER), "pairs") for k in range(passes)]
        self.words = [_written(texts.mapInArrow(_ask_words(k, WORD_PASSES, self.pairs, buckets), _STATS).groupBy("bucket").applyInArrow(
            _answer_words, _ANSWER), "word-counts") for k in range(WORD_PASSES)]
        # ``task`` is the folders' column, so this reads the few folders below zero
        counts = reduce(DataFrame.unionByName, [spark.read.schema(_ANSWER).parquet(path) for path in self.words]).filter(
            F.col("task") <= _COUNTS)
        upper, lower = _added(counts.filter("part = 1"), 4), _added(counts.filter("part = 0"), 7)
        self.languages = {x: (discounts(upper[x]), discounts(lower[x][:4]), lower[x]) for x in upper}

    def loss(self, task: int, block: int, p: Pairs) -> np.ndarray:
        """-log P(right word | left word) of each pair of a block, in order of the text."""
        if not len(p.hash):
            return np.zeros(0)
        inverse = p.distinct()
        c, _ = _pair_counts(self.pairs, task, block, p)
        w, order = np.zeros((len(p.words), _WORD)), sorting(p.words)
        part = p.words[order] % np.uint64(len(self.words))
        for k, path in enumerate(self.words):
            if (part == k).any():
                w[order[part == k]] = _read_answers(path, task, block, _WORD)
        names, own = np.unique(p.lang, return_inverse=True)
        known = [self.languages.get(int(x), (np.zeros(4), np.zeros(4), [0] * 7)) for x in names]   # none: single words only
        d2, d1 = np.array([k[0] for k in known])[own], np.array([k[1] for k in known])[own]
        n1, n2, _, _, n3, size, total = np.array([k[2] for k in known], dtype=np.float64)[own].T
        total = np.maximum(total, 1)
        at = np.arange(len(w))
        rest = (d1[:, 1] * n1 + d1[:, 2] * n2 + d1[:, 3] * n3) / total
        single = (w[:, 4] - d1[at, np.minimum(w[:, 4], 3).astype(int)]) / total + rest / np.maximum(size, 1)
        free = (w[:, 1:4] * d2[:, 1:]).sum(axis=1)
        a, z = p.g_left, p.g_right
        return -np.log((c - d2[a, np.minimum(c, 3)] + free[a] * single[z]) / w[a, 0])[inverse]


_SCORED = ("doc_id long, model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, log_perplexity double")


def _score(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("model", pa.string()), *[(c, pa.int64()) for c in
                       _BASE], ("log_perplexity", pa.float64())])

    def run(batches):
        for task, block, p, batch, k in _read_blocks(batches):
            total = np.bincount(p.doc, shared.value.loss(task, block, p), minlength=len(p.sizes))
            n = np.bincount(p.doc, minlength=len(p.sizes))
            yield pa.record_batch([
                batch["doc_id"][k].values, batch["lang"][k].values,
                *[pa.array(x) for x in _numbers(batch["base"][k].as_py(), len(_BASE)).T.astype(np.int64)],
                pa.array(total / np.maximum(n, 1), mask=n == 0)], schema=schema)
    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          below: float = BELOW, above: float = ABOVE, passes: int = PASSES) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept,
    log_perplexity, lower, upper."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = stored(rows.mapInArrow(_to_blocks, _BLOCKS), "texts")
    model = Model(texts, size, passes)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # paths, and some numbers a language
    scored = stored(texts.mapInArrow(_score(shared), _SCORED), "perplexity")
    drop(texts)
    for path in (*model.pairs, *model.words):
        drop_path(docs.sparkSession, path)
    scored = scored.withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    bins = (scored.filter("NOT base_failed AND log_perplexity IS NOT NULL")
            .groupBy("model", F.floor(F.col("log_perplexity") * STEP).alias("bin")).agg(F.count(F.lit(1)).alias("c")))
    q = bins.groupBy("model").agg(F.expr("percentile(bin + 0.5, array(0.25, 0.5, 0.75), c)").alias("q"))
    q25, q50, q75 = (F.col("q")[k] / STEP for k in range(3))
    table = stored(q.select("model", (q50 - below * F.greatest(q50 - q25, F.lit(1 / STEP))).alias("lower"),
                            (q50 + above * F.greatest(q75 - q50, F.lit(1 / STEP))).alias("upper")), "bands")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return scored.join(table, "model", "left").withColumn("kept", ~F.col("base_failed") & inside)
