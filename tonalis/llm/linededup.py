"""Dropping lines that many documents share.

Two Bloom filters hold the keys of lines seen once and seen twice.  Every task
fills its own pair; the pairs are merged by slices of the bit range, a bit of two
tasks' "once" filters moving to "twice".  Only lines whose bits are all in the
merged "twice" filter -- true repeats and a few false alarms -- are shuffled, by an
exact 128-bit key, to count their documents and to choose the one that keeps them.

The filters have ``BITS_A_LINE`` bits for each line that the corpus can hold, by
its characters, up to ``2 ** MOST_BITS`` (64 MB, which bounds what is broadcast and
what a task holds).  A corpus that outgrows them shuffles more suspects, at worst
24 bytes for each of its lines, but loses no repeat.

The repeated keys with the document that keeps each are sent to all executors while
they are at most ``MOST_REPEATED`` (24 bytes each), and every text is judged where it
lies.  Beyond that they meet the documents in a join; keys that very many documents
hold are sent to all executors even then, so none of them meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .common import join_unique, map_batches, release, rows, saved, unused_name

#: Bits for each line, the logarithms of the least and the largest filter, and slices that are merged apart.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 8, 20, 29
SLICES = 64
MOST_REPEATED = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"
PARTS = "slice int, part int, once binary, twice binary"


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    """The 128-bit key of each line of ``text``; None for keys under ``least`` code points."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


def filter_bits(lines: int) -> int:
    """Logarithm of the bits of each filter for at most so many lines."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_A_LINE * max(1, lines) - 1).bit_length()))


def bit_places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two places in a filter of ``2 ** bits`` for each key, by its two halves."""
    return (np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def _local_filters(least: int, bits: int):  # noqa: ANN202
    size = (1 << bits) // 8 // SLICES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size * SLICES, np.uint8), np.zeros(size * SLICES, np.uint8)
        for batch in batches:
            keys = [k for text in batch["text"].to_pylist() for k in {*line_keys(text, least)} if k]
            if not keys:
                continue
            # repeats within the batch, then those of earlier batches
            places = bit_places(keys, bits)
            _, first, counts = np.unique(places[:, 0] << 32 | places[:, 1], return_index=True, return_counts=True)
            places = places[first]
            _set(twice, places[(counts > 1) | _has(once, places).all(axis=1)].ravel())
            _set(once, places.ravel())
        part = TaskContext.get().partitionId()
        for i in range(SLICES):
            a, b = (np.flatnonzero(np.unpackbits(x[i * size : (i + 1) * size], bitorder="little")) for x in (once, twice))
            if len(a):
                yield rows(PARTS, slice=[i], part=[part], once=[_pack(a)], twice=[_pack(b)])

    return work


def _merge(bits: int):  # noqa: ANN202
    """Merges rows of equal (slice, part), which follow each other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros((1 << bits) // SLICES, bool), np.zeros((1 << bits) // SLICES, bool)

        def done() -> pa.RecordBatch:
            out = rows(PARTS, slice=[now[0]], part=[now[1]], once=[_pack(np.flatnonzero(once))], twice=[_pack(np.flatnonzero(twice))])
            once[:] = False
            twice[:] = False
            return out

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["slice"], row["part"])
                if now and key != now:
                    yield done()
                now = key
                places = _unpack(row["once"])
                twice[places[once[places]]] = True
                twice[_unpack(row["twice"])] = True
                once[places] = True
        if now:
            yield done()

    return work


def twice_seen(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bits of the "twice" filter over all rows of ``text``, eight a byte, the lowest first."""
    parts = map_batches(texts.select("text"), _local_filters(least, bits), PARTS)
    for group in (F.col("part") % 32, F.lit(0)):
        parts = parts.withColumn("part", group.cast("int")).repartition("slice", "part").sortWithinPartitions("slice", "part")
        parts = map_batches(parts, _merge(bits), PARTS)
    out, size = np.zeros((1 << bits) // 8, np.uint8), (1 << bits) // SLICES
    for row in parts.select("slice", "twice").toLocalIterator():
        _set(out, row["slice"] * size + _unpack(bytes(row["twice"])))
    return out


def dedup_lines(df: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """Drops lines whose key occurs in at least ``documents`` documents, except in the largest ``doc_id`` holding it.

    A key is the line without white space at its ends, A-Z in lower case; keys
    under ``least`` code points are kept.  ``text`` becomes the lines that stay,
    joined by line feeds, and the columns ``n_lines`` (before) and ``n_dropped``
    are added or replaced; all other columns stay.  A null or empty text is one
    empty line, and a null text stays null.  Rows of one ``doc_id`` are one
    document; rows with a null ``doc_id`` lose nothing and count for nothing.  An
    empty table stays empty.
    """
    spark = df.sparkSession
    named = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    filters = filter_bits((named.agg(F.sum(F.length("text"))).first()[0] or 0) // max(1, least))
    sent = spark.sparkContext.broadcast(twice_seen(named, least, filters))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys = [], []
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = {*line_keys(text, least)} - {None}
                names += [name] * len(own)
                keys += own
            if keys:
                hit = _has(sent.value, bit_places(keys, filters)).all(axis=1)
                yield rows("doc_id long, key binary", doc_id=np.array(names, np.int64)[hit], key=[k for k, h in zip(keys, hit.tolist(), strict=True) if h])

    found = saved(map_batches(named, suspects, "doc_id long, key binary").distinct(), "suspect-lines")
    repeated = saved(found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents), "repeated-lines")
    kept = df.drop("n_lines", "n_dropped")
    schema = StructType([*kept.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    if repeated.count() <= MOST_REPEATED:
        known = spark.sparkContext.broadcast(Keepers(repeated.select("key", "keeper").toArrow()))
        release(found, repeated)

        def gone(batch: pa.RecordBatch) -> Iterator[list[bytes] | None]:
            texts, names = batch["text"].to_pylist(), batch["doc_id"].cast(pa.int64()).to_pylist()
            own = [list({*line_keys(t, least)} - {None}) if n is not None else [] for t, n in zip(texts, names, strict=True)]
            keepers = known.value.of([k for keys in own for k in keys])
            at = 0
            for keys, name in zip(own, names, strict=True):
                yield [k for k, keeper in zip(keys, keepers[at : at + len(keys)], strict=True) if keeper is not None and name < keeper]
                at += len(keys)

        return map_batches(kept, _dropping(gone, least, schema), schema)
    doc, keys = (unused_name(x, df.columns) for x in ("doc", "keys"))
    drops = saved(join_unique(found, repeated, "key", "n", found.count()).where("doc_id < keeper").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("key").alias(keys)), "dropped-lines")
    release(found, repeated)
    joined = kept.join(drops, kept["doc_id"].cast("long") == drops[doc], "left").drop(doc)
    return map_batches(joined, _dropping(lambda batch: batch[keys].to_pylist(), least, schema), schema)


class Keepers:
    """The documents that keep repeated keys, in order of the keys' halves."""

    def __init__(self, table: pa.Table) -> None:
        halves = np.frombuffer(b"".join(table["key"].to_pylist()), "<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.first, self.second = halves[order, 0].copy(), halves[order, 1].copy()
        self.keeper = table["keeper"].to_numpy()[order]

    def of(self, keys: list[bytes]) -> list[int | None]:
        """The document that keeps each key; None for keys that aren't repeated."""
        out: list[int | None] = [None] * len(keys)
        if keys and len(self.first):
            halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            begin, end = (np.searchsorted(self.first, halves[:, 0], side) for side in ("left", "right"))
            for i in np.flatnonzero(begin < end).tolist():
                for j in range(int(begin[i]), int(end[i])):
                    if self.second[j] == halves[i, 1]:
                        out[i] = int(self.keeper[j])
        return out


def _dropping(gone: Callable[[pa.RecordBatch], Iterable[list[bytes] | None]], least: int, schema: StructType):  # noqa: ANN202
    """Takes from each text the lines of the keys that ``gone`` gives for it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, lost = [], [], []
            for text, drop in zip(batch["text"].to_pylist(), gone(batch), strict=True):
                lines, drop = (text or "").split("\n"), set(drop or ())
                stay = [line for line, key in zip(lines, line_keys(text, least), strict=True) if key not in drop] if drop else lines
                texts.append("\n".join(stay) if drop else text)
                totals.append(len(lines))
                lost.append(len(lines) - len(stay))
            of = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays([of[n] if n in of else batch[n] for n in schema.names], names=schema.names)

    return work
