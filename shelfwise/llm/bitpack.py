"""Token ids on disk at a fixed width: the fewest bits that hold the vocabulary.

A file holds documents in ascending doc_id order.  Layout, little-endian:

    magic 'FWBP0001'
    packed blocks: BLOCK ids each (the last fewer), ``bits`` bits an id, in
        64-bit words, id i of a block at bit i * bits
    doc_id int64 per document, ids per document int64
    byte offset int64 of each block, and of the end of the last
    bits, documents, ids, ids per block (int64 each), magic

The offsets allow access to any id without reading what stands before it, and a
block unpacks with vector operations.  A file is one range of doc_ids, written
under a temporary name by the task that sorted it and then moved to the name of
its partition, so a task that is run again only writes the same file again.

Defined cases: a null or empty text has the end id alone; rows that repeat a
doc_id are kept, ordered by text; a null doc_id orders first and stays null.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import filesystem, id_out, scratch_path, shuffle_partitions, stored, texts
from shelfwise.llm.tokens import encoded

MAGIC = b"FWBP0001"
FILE = 128 << 20         # bytes of text in a file, about
BLOCK = 1 << 14          # ids; a multiple of 64, so that blocks begin at whole words


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits: the vocabulary is larger than was said")
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[:len(ids)] = ids
    lanes = padded.reshape(groups, 64)
    out = np.zeros((groups, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class Writer:
    """Writes one file; ids are packed as soon as a block is full."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.out.write(MAGIC)
        self.offsets, self.rest, self.n = [len(MAGIC)], [], 0
        self.docs, self.sizes, self.held = [], [], 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.sizes.append(sizes.astype("<i8"))
        self.n += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.rest)
            full = len(ids) - len(ids) % BLOCK
            for i in range(0, full, BLOCK):
                self._block(ids[i:i + BLOCK])
            self.rest, self.held = [ids[full:]], len(ids) - full

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.rest))
        docs = np.concatenate(self.docs) if self.docs else np.empty(0, "<i8")
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, "<i8")
        self.out.write(docs.tobytes())
        self.out.write(sizes.tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(np.array([self.bits, len(docs), self.n, BLOCK], "<i8").tobytes())
        self.out.write(MAGIC)
        return len(docs), self.n


class Reader:
    """Random access to one file (an open file that can seek)."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 40)
        tail = file.read(40)
        if tail[32:] != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.n_docs, self.n_ids, self.block = (int(x) for x in np.frombuffer(tail[:32], "<i8"))
        n_blocks = -(-self.n_ids // self.block)
        table = 16 * self.n_docs + 8 * (n_blocks + 1)
        file.seek(size - 40 - table)
        data = file.read(table)
        self.docs = np.frombuffer(data, "<i8", self.n_docs)
        self.sizes = np.frombuffer(data, "<i8", self.n_docs, 8 * self.n_docs)
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, 16 * self.n_docs)
        self._at, self._ids = -1, None

    def _load(self, k: int) -> np.ndarray:
        if self._at != k:
            self.file.seek(int(self.offsets[k]))
            data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
            self._at, self._ids = k, unpack(data, self.bits, min(self.block, self.n_ids - k * self.block))
        return self._ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the file's id ``start`` on."""
        out, at = [], start
        while at < start + n:
            k, skip = divmod(at, self.block)
            part = self._load(k)[skip:skip + start + n - at]
            out.append(part)
            at += len(part)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def _write(path: str, tokenizer: str, end: int, bits: int):
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        part, writer, out = TaskContext.get().partitionId(), None, None
        fs, folder = filesystem(path)
        temp = f"{folder}/_writing-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(temp)
                writer = Writer(out, bits)
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for row, ids, cut in encoded(batch.column(1), tokenizer, end):
                writer.add(docs[row:row + len(cut) - 1], ids, np.diff(cut))
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            name = f"part-{part:06d}.ids"
            fs.move(temp, f"{folder}/{name}")
            yield pa.record_batch([pa.array([part]), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], schema=schema)
    return run


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end: int, path: str | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all ids below a shared folder; its path and the manifest of files:
    part, file, n_docs, n_ids, base (ids in the files before)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    rows = texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # rows of one id, null ids among them, are spread by a hash of their texts
    ordered = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange(max(shuffle_partitions(spark), size // FILE), "d", "h")
               .sortWithinPartitions("d", "h", "text").drop("h"))
    files = stored(ordered.mapInArrow(_write(path, tokenizer, end, bits_for(vocabulary)),
                                      "part long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    return path, files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(path: str):
    schema = pa.schema([("d", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        fs, folder = filesystem(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                info = fs.get_file_info(f"{folder}/{name}")
                with fs.open_input_file(info.path) as file:
                    r = Reader(file, info.size)
                    stop = np.append(0, np.cumsum(r.sizes))
                    first = 0
                    while first < r.n_docs:
                        last = max(first + 1, int(np.searchsorted(stop, stop[first] + (1 << 18), side="right")) - 1)
                        ids = r.ids(int(stop[first]), int(stop[last] - stop[first])).astype("<u4")
                        cut = (4 * (stop[first:last + 1] - stop[first])).astype(np.int32)
                        yield pa.record_batch([
                            pa.array(r.docs[first:last]), pa.array(base + stop[first:last]), pa.array(r.sizes[first:last]),
                            pa.Array.from_buffers(pa.binary(), last - first,
                                                  [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(ids.tobytes())])],
                            schema=schema)
                        first = last
    return run


def read_back(path: str, files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian uint32)."""
    n = max(1, files.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(files.sparkSession))
    rows = files.select("file", "base").repartition(n).mapInArrow(
        _read(path), "d long, start long, n_tokens long, ids binary")
    return rows.select(id_out().alias("doc_id"), "start", "n_tokens", "ids")


def crc32_of(batches):
    """doc_id, start, n_tokens, ids -> the same with ids_crc32 for ids."""
    for batch in batches:
        crc = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())],
                              names=["doc_id", "start", "n_tokens", "ids_crc32"])
