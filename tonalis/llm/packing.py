"""Packing token sequences by order-preserving dynamic programming.

Documents keep their input order and are cut into windows of at most ``window``
tokens.  A window may end where a document ends (free of charge), where a
sentence ends, or, inside long stretches without either, at plain positions
(dearer).  The programme minimises padding plus these truncation penalties.

Padding is ``window - length``, linear in the start of the window, so the best
predecessor of every cut is the head of a monotone queue over ``cost + start``:
one pass, constant work a cut.  A window whose length is a power of two is not
padded; those few exact predecessors are looked at besides the queue.

Each input partition is packed on its own in runs of about ``RUN_TOKENS``
tokens, so there is no shuffle, memory is bounded and a lost task is redone
alone.  A run costs at most one padded window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, rows
from .tokens import word_cache

#: Tokens that are packed together.
RUN_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_tokens int, seq_padded int"


@dataclass(frozen=True)
class Penalties:
    """Costs in tokens of padding that a cut is worth."""

    sentence: float = 2.0
    plain: float = 48.0
    #: Plain cuts are offered this far apart.
    stride: int = 64


def cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, how: Penalties) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut positions in ascending order, 0 and the end included, and the penalty of each.

    ``sentence_ends`` tells of each token id whether it closes a sentence.
    """
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[np.flatnonzero(sentence_ends[ids]) + 1] = how.sentence
    penalty[doc_ends] = 0.0
    penalty[[0, n]] = 0.0
    natural = np.flatnonzero(penalty < np.inf)
    gaps = np.diff(natural)
    extra = (gaps - 1) // how.stride
    begin = np.repeat(natural[:-1], extra)
    step = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    penalty[begin + step * how.stride] = how.plain
    where = np.flatnonzero(penalty < np.inf)
    return where, penalty[where]


def best_cuts(where: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The chosen cut positions, from 0 to the last, of least padding plus penalties.

    Successive positions in ``where`` are at most ``window`` apart.
    """
    n = len(where)
    if n < 2:
        return [0]
    pos, pen = where.tolist(), penalty.tolist()
    number = np.full(pos[-1] + 1, -1, np.int32)
    number[where] = np.arange(n, dtype=np.int32)
    later, before = [], []
    size = window // 2
    while size:
        at = np.searchsorted(where, size)
        found = number[where[at:] - size]
        hit = np.flatnonzero(found >= 0)
        later.append(at + hit)
        before.append(found[hit])
        size //= 2
    after, exact = np.concatenate(later), np.concatenate(before)
    order = np.argsort(after, kind="stable")
    exact = exact[order].tolist()
    ends = np.searchsorted(after[order], np.arange(1, n + 1)).tolist()
    cost, back = [0.0] * n, [0] * n
    # the queue holds (cost + position, position, number), least first
    keys, places, numbers, head, e = [0.0], [0], [0], 0, 0
    for i in range(1, n):
        p = pos[i]
        while places[head] < p - window:
            head += 1
        best, of = keys[head] + window - p, numbers[head]
        end = ends[i]
        while e < end:
            j = exact[e]
            if cost[j] < best:
                best, of = cost[j], j
            e += 1
        best += pen[i]
        cost[i], back[i] = best, of
        key = best + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            places.pop()
            numbers.pop()
        keys.append(key)
        places.append(p)
        numbers.append(i)
    chosen, i = [], n - 1
    while i:
        chosen.append(pos[i])
        i = back[i]
    return [0, *reversed(chosen)]


def padded_size(length: int, window: int) -> int:
    """Size of a sequence as stored: a power of two stays, all else fills the window."""
    return length if length & (length - 1) == 0 else window


def pack_run(docs: list[np.ndarray], sentence_ends: np.ndarray, window: int, how: Penalties) -> tuple[np.ndarray, ...]:
    """Pieces of a run of documents in order: document number, start in it, length, sequence number, offset, sequence length."""
    ids = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    chosen = np.array(best_cuts(*cuts(ids, ends, sentence_ends, how), window), np.int64)
    edges = np.union1d(chosen, np.concatenate([[0], ends]))
    begin, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(chosen, begin, side="right") - 1
    return doc, begin - (ends - [len(d) for d in docs])[doc], length, sequence, begin - chosen[sequence], np.diff(chosen)[sequence]


def pack_documents(df: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, how: Penalties = Penalties(), with_ids: bool = False) -> DataFrame:
    """Packs the ``text`` of every row into sequences; a row for each piece.

    ``start`` and ``length`` say which ids of the document a piece holds,
    ``sequence_id`` and ``offset`` where they stand.  ``with_ids`` adds the ids
    themselves as ``array<int>``.  A null text counts as empty: the document is
    its end id alone.  Repeated rows are packed as often as they occur; further
    columns are ignored; an empty table gives no rows.  A null ``doc_id`` is
    carried along.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer, keeps_space=False)
        vocabulary = cache.tokenizer.get_vocab()
        closing = np.zeros(max(max(vocabulary.values()), end_id) + 1, bool)
        closing[[i for word, i in vocabulary.items() if word.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        context = TaskContext.get()
        sequences = (context.partitionId() if context else 0) << 32
        names: list[int | None] = []
        docs: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal sequences
            doc, start, length, sequence, offset, whole = pack_run(docs, closing, window, how)
            views = [docs[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            sizes = np.array([len(d) for d in docs])
            out = {"doc_id": [names[d] for d in doc.tolist()], "start": start, "length": length, "ids_crc32": [zlib.crc32(v) for v in views], "doc_tokens": sizes[doc], "sequence_id": sequences + sequence, "offset": offset, "seq_tokens": whole, "seq_padded": [padded_size(x, window) for x in whole.tolist()]}
            sequences += int(sequence[-1]) + 1
            names.clear()
            docs.clear()
            return rows(schema, **out, **({"ids": views} if with_ids else {}))

        held = 0
        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), cache.encode(batch["text"]), strict=True):
                names.append(name)
                docs.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                held += len(docs[-1])
                if held >= RUN_TOKENS:
                    yield packed()
                    held = 0
        if docs:
            yield packed()

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema)
