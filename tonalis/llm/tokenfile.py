"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, each followed by an end id::

    b"TPFR" version:u32
    block*                     256 ids each, the last may hold fewer
    doc flags, ids, sizes      u8 (1: null id), i64, u32 for each document
    block starts               u64 byte offset of each block
    n_docs n_blocks n_ids footer_at:u64  b"RFPT"

A line feed stands after the head, after each run of blocks that is written at
once, and after the footer, so that Spark's own writer can put the runs into the
file, whatever the store, and commits or drops a task's file as a whole.  Block
starts count those bytes, too.

A block is ``minimum:u32 width:u8 n_exceptions:u16`` (7 bytes), the differences
to the minimum packed at ``width`` bits, then the exceptions' places (u8) and
their bits above ``width`` (u32).  The width is that of the difference at a
percentile, so a few rare large ids don't widen the block; those are the
exceptions.  Block starts are indexed, hence any range of ids is read without
decoding what lies before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import give_heap_back, map_batches, rows, saved, shared_folder
from .tokens import word_cache

BLOCK = 256
#: Ids that are encoded or decoded at once.
CHUNK = BLOCK * 1024
#: Share of a block's differences that fit the packed width.
PERCENTILE = 0.9
HEAD, TAIL, BLOCK_HEAD = struct.Struct("<4sI"), struct.Struct("<QQQQ4s"), struct.Struct("<IBH")
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values one after the other, as bytes; 64 values fill ``width`` 64-bit words."""
    rows_ = len(values)
    if not width:
        return np.zeros((rows_, 0), np.uint8)
    lanes = np.ascontiguousarray((values & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(rows_, -1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """What ``pack_bits`` packed, ``BLOCK`` values for each row."""
    rows_ = len(packed)
    if not width:
        return np.zeros((rows_, BLOCK), np.uint32)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[j] = (value & mask).astype(np.uint32)
    return np.ascontiguousarray(lanes.T).reshape(rows_, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ``ids``; all but the last hold ``BLOCK`` ids."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    short = count * BLOCK - len(ids)
    grid = np.concatenate([ids, np.full(short, ids[-1], np.uint32)]).astype(np.uint32).reshape(count, BLOCK)
    low = grid.min(axis=1)
    over = grid - low[:, None]
    place = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    mark = np.partition(over, place, axis=1)[:, place]
    widths = np.frexp(mark.astype(np.float64))[1].astype(np.int64)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = over[at]
        packed = pack_bits(part, width)
        high = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        block, place = np.nonzero(high)
        ends = np.searchsorted(block, np.arange(len(at) + 1))
        values = high[block, place].astype("<u4")
        place = place.astype(np.uint8)
        for i, b in enumerate(at.tolist()):
            s, e = int(ends[i]), int(ends[i + 1])
            out[b] = BLOCK_HEAD.pack(int(low[b]), width, e - s) + packed[i].tobytes() + place[s:e].tobytes() + values[s:e].tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``starts`` in ``data``, ``BLOCK`` for each."""
    heads = [BLOCK_HEAD.unpack_from(data, s) for s in starts.tolist()]
    out = np.empty((len(heads), BLOCK), np.uint32)
    low = np.array([h[0] for h in heads], np.uint32)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        size = BLOCK * width // 8
        packed = np.frombuffer(b"".join(data[s + BLOCK_HEAD.size : s + BLOCK_HEAD.size + size] for s in starts[at].tolist()), np.uint8).reshape(len(at), size)
        value = unpack_bits(packed, width)
        for i, b in enumerate(at.tolist()):
            if n := heads[b][2]:
                s = int(starts[b]) + BLOCK_HEAD.size + size
                value[i, np.frombuffer(data, np.uint8, n, s)] |= np.frombuffer(data, "<u4", n, s + n) << np.uint32(width)
        out[at] = value
    return (out + low[:, None]).reshape(-1)


class Writer:
    """Makes one file, piece by piece; documents are added in order, memory stays at one chunk.

    ``put`` takes each piece and has to write a line feed after it.
    """

    def __init__(self, put: Callable[[bytes], object]) -> None:
        self.put, self.at = put, 0
        self._piece(HEAD.pack(b"TPFR", 2))
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.starts: list[int] = []
        self.names: list[int | None] = []
        self.sizes: list[int] = []

    def _piece(self, data: bytes) -> None:
        self.put(data)
        self.at += len(data) + 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """One document's ids, end id included."""
        self.names.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= CHUNK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for begin in range(0, n, CHUNK):
            blocks = encode_blocks(ids[begin : min(n, begin + CHUNK)])
            at = self.at
            for b in blocks:
                self.starts.append(at)
                at += len(b)
            self._piece(b"".join(blocks))
        self.held, self.n_held = ([ids[n:]], len(ids) - n) if n < len(ids) else ([], 0)

    def close(self) -> None:
        """Writes what is held, the documents and the index."""
        self._flush(self.n_held)
        index = (np.array([x is None for x in self.names], np.uint8), np.array([x or 0 for x in self.names], "<i8"), np.array(self.sizes, "<u4"), np.array(self.starts, "<u8"))
        self._piece(b"".join(x.tobytes() for x in index) + TAIL.pack(len(self.names), len(self.starts), self.n_ids, self.at, b"RFPT"))


class Reader:
    """Reads one file by its index."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source = source
        source.seek(source.size() - TAIL.size - 1)
        n_docs, n_blocks, self.n_ids, self.footer_at, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != b"RFPT":
            raise ValueError("not a token file")
        source.seek(self.footer_at)
        null = np.frombuffer(source.read(n_docs), np.uint8)
        names = np.frombuffer(source.read(8 * n_docs), "<i8")
        self.names = [None if x else y for x, y in zip(null.tolist(), names.tolist(), strict=True)]
        self.sizes = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)
        self.starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the file, decoding only their blocks."""
        first, last = begin // BLOCK, -(-end // BLOCK)
        if begin >= end:
            return np.zeros(0, np.uint32)
        at = int(self.starts[first])
        stop = int(self.starts[last]) if last < len(self.starts) else self.footer_at
        self.source.seek(at)
        return decode_blocks(self.source.read(stop - at), self.starts[first:last] - at)[begin - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's document number ``i``."""
        end = int(self.sizes[: i + 1].sum())
        return self.ids(end - int(self.sizes[i]), end)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document in order, its ids in parts of at most a chunk."""
        at, held, held_from = 0, np.zeros(0, np.uint32), 0
        for name, size in zip(self.names, self.sizes.tolist(), strict=True):
            parts, end = [], at + size
            while at < end:
                if at >= held_from + len(held):
                    held_from = at // BLOCK * BLOCK
                    held = self.ids(held_from, min(self.n_ids, held_from + CHUNK))
                take = min(end, held_from + len(held))
                parts.append(held[at - held_from : take - held_from])
                at = take
            yield name, parts


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> None:
    """Encodes the ``text`` of every row and writes files to a new ``folder`` in ascending ``doc_id`` order.

    The files' numbers in their names are their order.  Null texts count as empty;
    rows with a null ``doc_id`` come first; repeated ids follow each other in an
    order given by their texts; repeated rows are written as often as they occur;
    other columns are ignored; an empty table gives no document.  Files go through
    Spark's own writer, so a repeated task leaves one whole file.  Before that the
    executors give back unused heap: sorting grows it again beside the workers.
    """
    give_heap_back(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer, keeps_space=True)
        writer, made = None, []
        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), cache.encode(batch["text"]), strict=True):
                writer = writer or Writer(made.append)
                writer.add(name, np.append(ids, np.uint32(end_id)))
                while made:
                    yield rows("piece binary", piece=[made.pop(0)])
        if writer:
            writer.close()
            for piece in made:
                yield rows("piece binary", piece=[piece])

    ordered = (
        df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    map_batches(ordered, work, "piece binary").select(F.col("piece").cast("string")).write.option("compression", "none").option("lineSep", "\n").text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Reads such files: for each document its place among all ids, its size and the CRC-32 of its ids.

    A file is one row of Spark's reader, so files are bounded by the partitions
    that were written.
    """
    schema = f"file string, {DOCS}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                reader = Reader(pa.BufferReader(content.as_buffer()))
                sums = []
                for _, parts in reader.documents():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                    sums.append(crc)
                starts = np.cumsum(reader.sizes) - reader.sizes
                for at in range(0, len(sums), 10_000):
                    part = slice(at, at + 10_000)
                    yield rows(schema, file=[file] * len(sums[part]), doc_id=reader.names[part], start=starts[part], n_tokens=reader.sizes[part], ids_crc32=sums[part])

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    found = saved(map_batches(stored.select("path", "content"), work, schema), "token-file-documents")
    # a number for each file, not for each document
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    total, before = 0, []
    for r in found.groupBy("file").agg(F.sum("n_tokens").alias("ids")).withColumn("number", number).orderBy("number").collect():
        before.append((r["file"], total))
        total += r["ids"]
    files = spark.createDataFrame(before, "file string, before long")
    return found.join(F.broadcast(files), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(df: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the token files of ``df`` to the shared folder and reports them as read back; see ``write_token_files``."""
    folder = shared_folder(df.sparkSession, "token-files")
    write_token_files(df, tokenizer, folder, end_id)
    return read_token_files(df.sparkSession, folder)
