"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings: one row per (shard, term) with the
ascending places of the term, where a shard is a block of whole texts of some
megabytes and a place is the word's number in the shard (texts are set apart by
a gap, so no match runs from one text into the next).  Postings never move to be
built: each task indexes the texts it reads.

A search takes the test set in blocks of at most ``block_windows`` distinct
windows.  Each block's terms select the index rows, shards are grouped, and in
each shard a window starts from its rarest term's list, shifts it to the
window's first word and intersects the other terms' shifted lists, rarest first,
until nothing is left.  With ``slop`` over 0 a term may be up to so many words
off its place (a proximity match); with 0 the match is the exact phrase.

When the test set has at most ``MAX_VOCABULARY`` distinct terms, only their
postings are stored (8 MB of hashes at most go to the tasks); beyond that all
postings are, and the searches select from them by join.

Defined cases: a null text has no words and is never hit.  An item of under
``window`` words, but not none, is one window.  A null item_id is reported as
'null'; several rows of one item_id are one item.  Rows that repeat a doc_id are
searched and returned one by one; a null doc_id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import id_out, list_array, stored, texts
from shelfwise.llm.words import ALNUM, blocks

GAP = 64                    # places between texts; a window is at most so long
MAX_VOCABULARY = 1 << 20
BLOCK_WINDOWS = 20_000
SHARD_BYTES = 4 << 20

_INDEX = pa.schema([("shard", pa.string()), ("term", pa.int64()), ("n", pa.int32()), ("places", pa.binary()),
                    ("ids", pa.binary()), ("sizes", pa.binary())])


def _postings(vocabulary: np.ndarray | None):
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for b in blocks(batch.column(1), ALNUM, lower=True, limit=SHARD_BYTES):
                shard, made = f"{part}-{made}", made + 1
                term = b.hashes().view(np.int64)
                sizes = np.diff(b.first)
                begin = b.first[:-1] + GAP * np.arange(b.n_docs)
                place = np.arange(len(term)) + GAP * b.doc_of_word()
                if vocabulary is not None and len(term):
                    spot = np.minimum(np.searchsorted(vocabulary, term), max(0, len(vocabulary) - 1))
                    keep = vocabulary[spot] == term if len(vocabulary) else np.zeros(len(term), bool)
                    term, place = term[keep], place[keep]
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order].astype(np.int32)
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
                last = np.append(first[1:], len(term)) if len(first) else first
                raw = place.tobytes()
                k = len(first)
                yield pa.record_batch([
                    pa.array([shard] * (k + 1)), pa.array([None, *term[first].tolist()], pa.int64()),
                    pa.array(np.append(b.n_docs, last - first).astype(np.int32)),
                    pa.array([begin.astype(np.int32).tobytes(), *(raw[4 * i:4 * j] for i, j in zip(first, last))], pa.binary()),
                    pa.array([ids[b.row:b.row + b.n_docs].tobytes(), *[None] * k], pa.binary()),
                    pa.array([sizes.astype(np.int32).tobytes(), *[None] * k], pa.binary())], schema=_INDEX)
    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The written index: shard, term (null: the shard's texts), n, places, ids, sizes."""
    return stored(texts(docs, id_col, text_col).mapInArrow(
        _postings(vocabulary), "shard string, term long, n int, places binary, ids binary, sizes binary"), "postings")


def _windows(length: int):
    schema = pa.schema([("item", pa.string()), ("terms", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            items = batch.column(0)
            for b in blocks(batch.column(1), ALNUM, lower=True):
                h = b.hashes().view(np.int64)
                doc, flat, sizes = [], [], []
                for k in range(b.n_docs):
                    i, j = int(b.first[k]), int(b.first[k + 1])
                    if j == i:
                        continue
                    n = min(length, j - i)
                    w = np.lib.stride_tricks.sliding_window_view(h[i:j], n)
                    doc += [b.row + k] * len(w)
                    flat.append(w.reshape(-1))
                    sizes.append(np.full(len(w), n))
                if doc:
                    cut = np.append(0, np.cumsum(np.concatenate(sizes)))
                    yield pa.record_batch([items.take(pa.array(doc)), list_array(np.concatenate(flat), cut, pa.int64())],
                                          schema=schema)
    return run


def _intersect(lists: list[np.ndarray], offsets: list[int], slop: int) -> np.ndarray:
    """Places at which a window begins: lists in order from the rarest term."""
    begin = lists[0] - offsets[0]
    for places, off in zip(lists[1:], offsets[1:]):
        if not len(begin):
            break
        at = np.searchsorted(places, begin + (off - slop))
        near = places[np.minimum(at, len(places) - 1)]
        begin = begin[(near >= begin + off - slop) & (near <= begin + off + slop)]
    return begin


_FOUND = "shard string, ord int, window long, start int, length int"


def _search(shared, slop: int):
    """Matches of the block's windows in one shard."""
    schema = pa.schema([("shard", pa.string()), ("ord", pa.int32()), ("window", pa.int64()),
                        ("start", pa.int32()), ("length", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        groups = shared.value
        shard, term = table.column("shard")[0].as_py(), table.column("term").combine_chunks()
        places, out = table.column("places"), []
        known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        head = np.flatnonzero(term.is_null().to_numpy(zero_copy_only=False))
        if len(known) and len(head):
            begin = np.frombuffer(places[int(head[0])].as_py(), np.int32).astype(np.int64)
            values = term.fill_null(0).to_numpy()[known]
            counts = table.column("n").to_numpy()[known]
            order = np.argsort(values)
            values, counts, known = values[order], counts[order], known[order]
            cache = {}

            def posting(i):
                if i not in cache:
                    cache[i] = np.frombuffer(places[int(known[i])].as_py(), np.int32).astype(np.int64)
                return cache[i]

            for number, terms in groups:
                spot = np.minimum(np.searchsorted(values, terms), len(values) - 1)
                for w in np.flatnonzero((values[spot] == terms).all(axis=1)):
                    rarest = np.argsort(counts[spot[w]], kind="stable")
                    found = _intersect([posting(spot[w][k]) for k in rarest], [int(k) for k in rarest], slop)
                    if len(found):
                        ords = np.searchsorted(begin, found, side="right") - 1
                        ok = ords >= 0
                        found, ords = found[ok], ords[ok]
                        out.append((ords, np.full(len(found), number[w]), found - begin[ords],
                                    np.full(len(found), terms.shape[1])))
        if not out:
            return schema.empty_table()
        ords, win, start, length = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array([shard] * len(ords)), pa.array(ords, pa.int32()), pa.array(win, pa.int64()),
                         pa.array(start, pa.int32()), pa.array(length, pa.int32())], schema=schema)
    return run


def _texts_of(batches):
    schema = pa.schema([("shard", pa.string()), ("ord", pa.int32()), ("d", pa.int64()), ("n_words", pa.int64())])
    for batch in batches:
        for shard, n, ids, sizes in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield pa.record_batch([pa.array([shard] * n), pa.array(np.arange(n, dtype=np.int32)),
                                   pa.array(np.frombuffer(ids, np.int64)),
                                   pa.array(np.frombuffer(sizes, np.int32).astype(np.int64))], schema=schema)


class Decontaminator:
    """An index of ``docs`` for the test set ``items``."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = 10, item_col: str = "item_id",
                 item_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
                 block_windows: int = BLOCK_WINDOWS):
        if not 0 < window <= GAP:
            raise ValueError(f"window must be 1 to {GAP} words")
        self.spark, self.block_windows = docs.sparkSession, block_windows
        rows = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"),
                            F.col(f"`{item_text}`").cast("string").alias("text"))
        windows = rows.mapInArrow(_windows(window), "item string, terms array<long>")
        self.windows = stored(windows.groupBy("terms").agg(F.collect_set("item").alias("items"))
                              .withColumn("window", F.monotonically_increasing_id()), "windows")
        terms = self.windows.select(F.explode("terms").alias("term")).distinct()
        vocabulary = None
        if terms.count() <= MAX_VOCABULARY:
            vocabulary = np.sort(np.array([r.term for r in terms.collect()], dtype=np.int64))
        self.index = build_index(docs, vocabulary, id_col, text_col)

    def texts(self) -> DataFrame:
        """Every indexed row: shard, ord (its key), d, n_words."""
        return (self.index.filter("term IS NULL").select("shard", "n", "ids", "sizes")
                .mapInArrow(_texts_of, "shard string, ord int, d long, n_words long"))

    def matches(self, slop: int = 0) -> DataFrame:
        """shard, ord, window, start (word), length: phrase matches, or proximity
        matches with a ``slop`` of 1 to GAP / 2 words."""
        if not 0 <= slop <= GAP // 2:
            raise ValueError(f"slop must be 0 to {GAP // 2}")
        n_blocks = -(-self.windows.count() // self.block_windows)
        found = None
        for k in range(n_blocks):
            block = self.windows.filter(F.pmod(F.xxhash64("terms"), F.lit(n_blocks)) == k).select("window", "terms")
            by_size: dict[int, list] = {}
            for r in block.collect():
                by_size.setdefault(len(r.terms), []).append((r.window, r.terms))
            groups = [(np.array([w for w, _ in rows]), np.array([t for _, t in rows], dtype=np.int64))
                      for rows in by_size.values()]
            shared = self.spark.sparkContext.broadcast(groups)
            terms = block.select(F.explode("terms").alias("term")).distinct()
            rows = self.index.join(F.broadcast(terms), "term", "left_semi").unionByName(self.index.filter("term IS NULL"))
            part = (rows.select("shard", "term", "n", "places").groupBy("shard")
                    .applyInArrow(_search(shared, slop), _FOUND))
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], _FOUND)

    def report(self, slop: int = 0) -> DataFrame:
        """One row per text: doc_id, n_words, n_hit, items (sorted), contaminated."""
        found = stored(self.matches(slop), "matches")
        hit = (found.select("shard", "ord", F.explode(F.expr("sequence(start, start + length - 1)")).alias("p"))
               .distinct().groupBy("shard", "ord").agg(F.count(F.lit(1)).alias("n_hit")))
        items = (found.select("shard", "ord", "window").distinct().join(self.windows.select("window", "items"), "window")
                 .select("shard", "ord", F.explode("items").alias("item")).distinct()
                 .groupBy("shard", "ord").agg(F.array_sort(F.collect_list("item")).alias("items")))
        return (self.texts().join(hit, ["shard", "ord"], "left").join(items, ["shard", "ord"], "left")
                .select(id_out().alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
                .withColumn("contaminated", F.col("n_hit") > 0))
