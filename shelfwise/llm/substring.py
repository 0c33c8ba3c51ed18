"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against the whole corpus as the reference.  The
reference is cut into phrases of ``window`` words and indexed by phrase hash:
hash partitions of that index are the reference blocks, and every document's
phrases are looked up in each block that can hold them.  A factor is a maximal
run of phrases that have an earlier source (a smaller doc_id, or the same
document further left); a phrase that starts inside one factor and ends beyond
it is looked up like any other, so matches that straddle a factor boundary are
found.  The words below the factors are the duplicate spans.

To keep the index small, only phrases that can repeat are put in:

1. *Anchors.*  Of the 6-word grams of each phrase the one with the smallest
   hash is the phrase's anchor; equal phrases have equal anchors.  About one
   gram in eight is an anchor.  Anchors found at one place in the corpus rule
   out all their phrases.  The hash of the whole word sequence travels the same
   way and tells whole copies, which need no phrases of their own.
2. *Phrases* with a repeated anchor are keyed by 128 bits, and the smallest
   document of each is found.

Both steps count within a task first: of the rows with one key in an Arrow
batch, one goes to the key's partition and the others are settled where they
are, so a passage in a third of all documents gives a key no more rows than
there are batches.

Defined cases: a null text or one without words has no words (kept text '').
Texts under one doc_id are texts of one document, each with its own positions;
a null doc_id orders before all others.  Texts of under ``window`` words keep
all words.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import id_out, list_parts, stored, texts
from shelfwise.llm.words import BLOCK_BYTES, blocks, mix, ngram_hashes, sliding_min

GRAM = 6            # words of an anchor gram

_ANCHOR = pa.schema([("pk", pa.int64()), ("v", pa.int64()), ("v2", pa.int64()), ("d", pa.int64()), ("t", pa.int64()),
                     ("known", pa.int64()), ("src", pa.int64())])
_LOW = np.int64(0xFFFFFFFF)
_NONE = np.int64(np.iinfo(np.int64).max)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and where a new key (all but the last array) begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for k in keys[:-1]:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


def _anchors(window: int):
    def run(batches):
        for batch in batches:
            ids, of_text = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            found, places, owners, whole = [], [], [], []
            for b in blocks(batch.column(1)):
                at = b.window_starts(window)
                if not len(at):
                    continue
                h = b.hashes()
                grams = ngram_hashes(h, GRAM)
                least = sliding_min(grams, window - GRAM + 1)
                # a gram is an anchor if a phrase around it has it as its smallest
                best = np.zeros(len(grams), dtype=np.uint64)
                for k in range(window - GRAM + 1):
                    best[at + k] = np.maximum(best[at + k], least[at])
                pos = np.flatnonzero((best == grams) & (best > 0))
                doc = np.searchsorted(b.first, pos, side="right") - 1
                order = np.lexsort((doc, grams[pos]))
                g, o = grams[pos][order], doc[order]
                new = np.ones(len(g), dtype=bool)
                new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(g)))
                found.append(g[first])
                places.append(times)
                owners.append(b.row + o[first])
                # the whole sequence of each text that has a phrase
                long = np.flatnonzero(np.diff(b.first) >= window)
                place = (np.arange(len(h)) - np.repeat(b.first[:-1], np.diff(b.first))).astype(np.uint64)
                sums = []
                for x in (h, b.hashes(1)):
                    total = np.zeros(len(x) + 1, dtype=np.uint64)
                    np.cumsum(mix(x + mix(place)), out=total[1:])
                    sums.append(total[b.first[long + 1]] - total[b.first[long]])
                whole.append((sums[0], sums[1], b.row + long, b.first[long + 1] - b.first[long]))
            if not found:
                continue
            owner = np.concatenate(owners)
            yield from _anchor_rows(np.concatenate(found), np.concatenate(places), ids[owner], of_text[owner])
            v, v2, owner = (np.concatenate([w[i] for w in whole]) for i in range(3))
            n = np.concatenate([w[3] for w in whole]).astype(np.uint64)
            yield from _whole_rows(mix(v ^ n) | np.uint64(1), v2 | np.uint64(1), ids[owner], of_text[owner])
    return run


def _anchor_rows(v, times, d, t):
    """One row per (anchor, text).  Of an anchor's rows in this batch the first
    is counted in the corpus (pk by anchor); with two places here all are known
    to repeat, and the others stay with their text (pk by text)."""
    order, new = _first_rows(v, d)
    v, times, d, t = v[order], times[order], d[order], t[order]
    group = np.cumsum(new) - 1
    here = np.bincount(group, weights=times)[group]
    pk = np.where(new, _signed(v), d)
    yield pa.record_batch([pa.array(pk), pa.array(_signed(v)), pa.array(np.zeros(len(v), np.int64)),
                           pa.array(d.astype(np.int64)), pa.array(t & _LOW), pa.array((here > 1).astype(np.int64)),
                           pa.array(np.full(len(v), _NONE))], schema=_ANCHOR)


def _whole_rows(v, v2, d, t):
    """One row per text; ``known`` is 2 for the counted row and 3 for a copy of a
    text of this batch with a smaller id."""
    order, new = _first_rows(v, v2, d)
    v, v2, d, t = v[order], v2[order], d[order], t[order]
    lead = d[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(d) else d
    copy = d > lead
    pk = np.where(copy, d, _signed(v))
    yield pa.record_batch([pa.array(pk), pa.array(_signed(v)), pa.array(_signed(v2)), pa.array(d.astype(np.int64)), pa.array(t),
                           pa.array(np.where(copy, 3, 2).astype(np.int64)),
                           pa.array(np.where(copy, lead, _NONE))], schema=_ANCHOR)


_PHRASE = pa.schema([("pk", pa.int64()), ("h", pa.int64()), ("h2", pa.int64()), ("d", pa.int64()),
                     ("t", pa.int64()), ("src", pa.int64())])


def _phrases(window: int):
    """Distinct phrases with a repeated anchor, of texts (d, text, t, anchors)."""
    def run(batches):
        for batch in batches:
            ids, of_text = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            flat, cut = list_parts(batch.column(3))
            flat = flat.astype(np.int64)
            out = []
            for b in blocks(batch.column(1)):
                at = b.window_starts(window)
                if not len(at):
                    continue
                h = b.hashes()
                least = _signed(sliding_min(ngram_hashes(h, GRAM), window - GRAM + 1)[at])
                doc = np.searchsorted(b.first, at, side="right") - 1
                repeated = np.unique(flat[cut[b.row]:cut[b.row + b.n_docs]])
                if not len(repeated):
                    continue
                # an anchor that repeats does so for every text that has it
                spot = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
                keep = repeated[spot] == least
                at, doc = at[keep], doc[keep]
                if not len(at):
                    continue
                one = ngram_hashes(h, window)[at]
                two = ngram_hashes(b.hashes(1), window, 1)[at]
                out.append((_signed(one), _signed(two), ids[b.row + doc], of_text[b.row + doc] & _LOW))
            if not out:
                continue
            h, h2, d, t = (np.concatenate([x[i] for x in out]) for i in range(4))
            order = np.lexsort((t, d, h2, h))
            h, h2, d, t = h[order], h2[order], d[order].astype(np.int64), t[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            lead = d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            once = new.copy()
            once[1:] |= (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            h, h2, d, t, lead = h[once], h2[once], d[once], t[once], lead[once]
            later = d > lead
            yield pa.record_batch([pa.array(np.where(later, d, h)), pa.array(h), pa.array(h2), pa.array(d), pa.array(t),
                                   pa.array(np.where(later, lead, _NONE))], schema=_PHRASE)
    return run


_PARSED = "d long, kept string, n_words long, n_removed long, factors array<struct<start:long,length:long,source:long>>"


def _parse(window: int):
    """Greedy parse of each text (d, text, copy_of, hits, sources)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())]))
    schema = pa.schema([("d", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("factors", kind)])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            copy_of = batch.column(2).to_pylist()
            hits, cut = list_parts(batch.column(3))
            sources, _ = list_parts(batch.column(4))
            for b in blocks(batch.column(1)):
                h, at = b.hashes(), b.window_starts(window)
                phrase = np.zeros(len(h), dtype=np.int64)
                phrase[at] = _signed(ngram_hashes(h, window)[at])
                starts = np.zeros(len(h), dtype=bool)
                starts[at] = True
                raw = b.buf.tobytes()
                rows = []
                for k in range(b.n_docs):
                    i, j = int(b.first[k]), int(b.first[k + 1])
                    row, n = b.row + k, j - i
                    text = raw[b.offsets[k]:b.offsets[k + 1]]
                    factors = []
                    if n >= window and copy_of[row] is not None:
                        factors = [(0, n, copy_of[row])]
                    elif n >= window:
                        factors = _factors(phrase[i:j - window + 1], int(ids[row]), window,
                                           hits[cut[row]:cut[row + 1]], sources[cut[row]:cut[row + 1]])
                    words = text.split()
                    gone = 0
                    if factors:
                        keep = np.ones(n, dtype=bool)
                        for start, length, _ in factors:
                            keep[start:start + length] = False
                        gone = n - int(keep.sum())
                        words = [words[x] for x in np.flatnonzero(keep)]
                    rows.append((int(ids[row]), b" ".join(words).decode(), n, gone,
                                 [{"start": s, "length": m, "source": x} for s, m, x in factors]))
                yield pa.record_batch([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _factors(phrase, own, window, hits, sources):
    """Maximal runs of phrases with one source; the run's words are the factor."""
    source = np.full(len(phrase), _NONE)
    if len(hits):
        order = np.argsort(hits, kind="stable")
        sorted_hits = hits[order]
        spot = np.minimum(np.searchsorted(sorted_hits, phrase), len(order) - 1)
        found = sorted_hits[spot] == phrase
        source[found] = sources[order][spot[found]]
    order = np.argsort(phrase, kind="stable")       # repeats inside the text
    again = np.zeros(len(phrase), dtype=bool)
    again[order[1:]] = phrase[order[1:]] == phrase[order[:-1]]
    source[again & (source == _NONE)] = own
    covered = np.flatnonzero(source != _NONE)
    if not len(covered):
        return []
    s = source[covered]
    border = np.flatnonzero((np.diff(covered) > 1) | (s[1:] != s[:-1])) + 1
    first, last = np.append(0, border), np.append(border, len(covered)) - 1
    return [(int(covered[a]), int(covered[z] - covered[a]) + window, int(s[a])) for a, z in zip(first, last)]


def deduplicate(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, kept (words left, joined by one space),
    n_words, n_removed, factors (start, length, source doc_id)."""
    if window <= GRAM:
        raise ValueError(f"window must be over {GRAM} words")
    # ``t`` tells the texts of one id apart.  Lists go by its low half, to save space: two texts of
    # an id that share it share their lists, which name phrases by hash; a copy is told by all of it.
    low = F.col("t").bitwiseAND(F.lit(int(_LOW)))
    base = texts(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    anchors = base.mapInArrow(_anchors(window), "pk long, v long, v2 long, d long, t long, known long, src long")
    same = Window.partitionBy("pk", "v", "v2")
    counted = anchors.select("v", "d", "t", "known", F.count(F.lit(1)).over(same).alias("places"),
                             F.least("src", F.min("d").over(same)).alias("src"))
    whole = F.col("known") >= 2
    repeated = stored(
        counted.filter(F.when(whole, F.col("src") < F.col("d")).otherwise((F.col("known") == 1) | (F.col("places") > 1)))
        .groupBy("d", low.alias("low")).agg(F.collect_set(F.when(~whole, F.col("v"))).alias("anchors"),
                                            F.collect_set(F.when(whole, F.struct("t", "src"))).alias("copies")), "anchors")
    sources = F.transform(F.filter("copies", lambda c: c["t"] == F.col("t")), lambda c: c["src"])
    known = base.withColumn("low", low).join(repeated, ["d", "low"], "left").withColumn("copy_of", F.array_min(sources)).drop("copies")
    phrases = (known.filter("copy_of IS NULL AND size(anchors) > 0").select("d", "text", "t", "anchors")
               .mapInArrow(_phrases(window), "pk long, h long, h2 long, d long, low long, src long"))
    same = Window.partitionBy("pk", "h", "h2")
    hits = (phrases.select("h", "d", "low", F.least("src", F.min("d").over(same)).alias("src"))
            .filter("src < d")
            .groupBy("d", "low").agg(F.collect_set(F.struct("h", "src")).alias("hit")))
    parsed = (known.join(hits, ["d", "low"], "left")
              .select("d", "text", "copy_of", F.col("hit.h").alias("hits"), F.col("hit.src").alias("sources"))
              .mapInArrow(_parse(window), _PARSED))
    return parsed.select(id_out().alias("doc_id"), "kept", "n_words", "n_removed", "factors")
