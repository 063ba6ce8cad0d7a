"""Finding benchmark passages in documents, edits allowed.

A passage matches an item of ``W`` words if some part of the document is within
``allowed_edits(W)`` word edits (insert, delete, replace) of it.

Windows of the items' sizes go through a CGK random walk: it reads a string symbol
by symbol, writes the symbol that it stands on and steps on or stays by a random
function of step number and symbol, which turns ``k`` edits into a Hamming
distance that depends on ``k`` alone.  Tables sample a few places of a walk, the
same for windows and items; a window's candidates are the items whose samples
equal its own in some table.  The number of walks is set for each size by trials,
so that ``RECALL`` of items with all allowed edits are met (``walks``).
Candidates are verified by exact edit distance against the stretch of the document
around the window.

Windows that can't match aren't laid: by the pigeonhole principle one of the
``allowed_edits + 1`` equal stretches of an item, ``GRAM`` words or more, stands
unedited in a match.  So a window of an item's size is laid wherever ``GRAM`` words
in a row (all of a shorter item's) are those at some place of an item of that size;
no match is lost by that, and which items it is compared with is left to the tables.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, rows
from .words import gram_numbers, mixed, word_numbers

GRAM = 3
#: Share of an item's words that may be edited.
EDITS = 0.25
#: Items that are sent to the executors at once, and their longest text in all.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20
#: Tables for each random walk, places that a table samples.
TABLES, SAMPLED = 8, 2
#: The share of passages with all the edits that are allowed, the worst of mixed ones, insertions and deletions, that is to be found.
RECALL = 0.99
#: Trials of each kind of edits by which walks are numbered, windows of a trial, and walks beyond which all windows of a size are verified instead.
TRIALS, TRIED, MOST_WALKS = 200, 8, 256
#: Words that are embedded or compared, and index entries that are looked at, at once.
EMBEDDED, ENTRIES = 1 << 20, 1 << 20
FOUND = "doc_id long, item_id long, start_word long, distance int, item_words int"
_STEP, _SYMBOL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def allowed_edits(words: int) -> int:
    """Word edits at which a passage still counts as the item: a quarter of its words, but so few that ``GRAM`` unedited words in a row remain; none for items of under six words."""
    return max(0, min(int(EDITS * words), words // GRAM - 1))


def walk(windows: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """The first ``steps`` of the CGK embedding of the rows of ``windows``: step x row."""
    n, most = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1).reshape(-1)
    base, at = np.arange(n) * (most + 1), np.zeros(n, np.int64)
    out = np.empty((steps, n), np.uint64)
    for j in range(steps):
        symbol = padded[base + np.minimum(at, most)]
        out[j] = symbol
        at += (mixed(symbol * _SYMBOL + np.uint64((seed * 1_000_003 + j) * int(_STEP) % 2**64)) >> np.uint64(63)).astype(np.int64)
    return out


def table_places(words: int, w: int) -> np.ndarray:
    """Places that the tables of walk ``w`` sample for items of that many words, tables x sampled: where all walks are well under way or near the start alike."""
    return np.random.default_rng((words, w)).integers(0, 2 * words, (TABLES, SAMPLED))


def walk_keys(windows: np.ndarray, w: int) -> np.ndarray:
    """Keys of each row in the tables of one walk: row x table."""
    n, size = windows.shape
    out = np.zeros((n, TABLES), np.uint64)
    places = table_places(size, w)
    step = max(1, EMBEDDED // size)
    for i in range(0, n, step):
        embedded = walk(windows[i : i + step], w, int(places.max()) + 1)
        for t in range(TABLES):
            for p in places[t].tolist():
                out[i : i + step, t] = mixed(out[i : i + step, t] + embedded[p] * _SYMBOL)
    return out


def _trials(words: int, kinds: tuple[str, ...], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, the windows that ``search`` would lay in their edited copies, and the item of each window."""
    items, windows, owner = [], [], []
    fresh = lambda n: rng.integers(1, 2**63, n).tolist()
    for k in range(TRIALS):
        item = fresh(words)
        part = [(x, i) for i, x in enumerate(item)]
        for _ in range(allowed_edits(words)):
            kind, at = kinds[int(rng.integers(len(kinds)))], int(rng.integers(max(1, len(part))))
            part[at : at + 1] = {"insert": [(fresh(1)[0], -1), *part[at : at + 1]], "delete": [], "replace": [(fresh(1)[0], -1)]}[kind]
        before = fresh(words)
        text = [*before, *[x for x, _ in part], *fresh(2 * words)]
        n = min(GRAM, words)
        starts = dict.fromkeys(len(before) + j - part[j][1] for j in range(len(part) - n + 1) if part[j][1] >= 0 and all(part[j + m][1] == part[j][1] + m for m in range(n)))
        items.append(item)
        for start in list(starts)[:TRIED]:
            windows.append(text[start : start + words])
            owner.append(k)
    return np.array(items, np.uint64), np.array(windows, np.uint64).reshape(-1, words), np.array(owner, np.int64)


@functools.cache
def _walks(words: int) -> int:
    if not allowed_edits(words):
        return 1
    most = 0
    for kinds in (("insert", "delete", "replace"), ("insert",), ("delete",)):
        items, windows, owner = _trials(words, kinds, np.random.default_rng(words))
        met, w = np.zeros(TRIALS, bool), 0
        while met.mean() < RECALL and w <= MOST_WALKS:
            left = np.flatnonzero(~met[owner])
            same = (walk_keys(windows[left], w) == walk_keys(items, w)[owner[left]]).any(axis=1)
            met[owner[left[same]]] = True
            w += 1
        most = max(most, w)
    return most


def walks(words: int) -> int:
    """Walks that meet ``RECALL`` of trial items of that many words or, as only some sizes are tried, of up to half as many more; 0 where that takes over ``MOST_WALKS``, which stands for verifying every window."""
    size = 4
    while size < words:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    n = _walks(size)
    return n if n <= MOST_WALKS else 0


def distances(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray, region_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (row) to any part of its region, and where that part ends."""
    n, most = items.shape
    width = regions.shape[1]
    row = np.zeros((n, width + 1), np.int32)
    best, ends = np.full(n, np.iinfo(np.int32).max, np.int32), np.zeros(n, np.int64)
    steps = np.arange(width + 1, dtype=np.int32)
    beyond = steps[None, :] > region_sizes[:, None]
    for i in range(1, most + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, i - 1 : i]))
        # deletions along the row: a running minimum of value - place
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        at = np.flatnonzero(sizes == i)
        if len(at):
            last = np.where(beyond[at], np.iinfo(np.int32).max, row[at])
            ends[at] = last.argmin(axis=1)
            best[at] = last[np.arange(len(at)), ends[at]]
    return best, ends


def _cut(numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The stretches from ``low`` to ``high`` as rows, filled with 0."""
    places = low[:, None] + np.arange(int((high - low).max(initial=0)))
    return np.where(places < high[:, None], numbers[np.minimum(places, len(numbers) - 1)], np.uint64(0))


class Items:
    """A block of benchmark items ready for search."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        numbers, edges = word_numbers(pa.array(texts, pa.string()))
        use = np.flatnonzero(np.diff(edges) > 0)
        self.numbers, self.first = numbers, edges[use]
        self.ids, self.sizes = np.array(ids, np.int64)[use], np.diff(edges)[use]
        #: By run length: runs in order, with a place and a size of items that have it there.
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, GRAM + 1):
            mine = np.flatnonzero(self.sizes == n if n < GRAM else self.sizes >= n)
            count = self.sizes[mine] - n + 1
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            grams = gram_numbers(numbers, n)[np.repeat(self.first[mine], count) + place] if len(mine) else np.zeros(0, np.uint64)
            entries = np.unique(np.stack([grams.view(np.int64), place, np.repeat(self.sizes[mine], count)], axis=1), axis=0)
            order = np.argsort(entries[:, 0].view(np.uint64), kind="stable")
            if len(order):
                self.index[n] = entries[order, 0].view(np.uint64), entries[order, 1], entries[order, 2]
        self.maybe = {n: np.zeros(1 << 20, bool) for n in self.index}
        for n, (grams, _, _) in self.index.items():
            self.maybe[n][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        #: By size: the items, and for each walk and table their keys in order, with the item of each.
        self.of_size = {s: np.flatnonzero(self.sizes == s) for s in np.unique(self.sizes).tolist()}
        self.tables: dict[int, list[list[tuple[np.ndarray, np.ndarray]]]] = {}
        for s, mine in self.of_size.items():
            words = self.words(mine, s)
            self.tables[s] = []
            for w in range(walks(s)):
                keys = walk_keys(words, w)
                orders = np.argsort(keys, axis=0, kind="stable")
                self.tables[s].append([(keys[o, t], mine[o]) for t, o in enumerate(orders.T)])

    def words(self, items: np.ndarray, size: int) -> np.ndarray:
        """The words of items of one size as rows."""
        return self.numbers[self.first[items][:, None] + np.arange(size)]

    def laid(self, grams: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of ``grams`` of ``n`` words that items have, with each place and size; about ``ENTRIES`` at once."""
        index, places, sizes = self.index[n]
        at = np.flatnonzero(self.maybe[n][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        first = np.searchsorted(index, grams[at], "left")
        count = np.searchsorted(index, grams[at], "right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        total = np.cumsum(count)
        cuts = np.unique(np.searchsorted(total, np.arange(ENTRIES, int(total[-1]) if len(total) else 0, ENTRIES), "left") + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
            c = count[i:j]
            entry = np.repeat(first[i:j] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
            yield np.repeat(at[i:j], c), places[entry], sizes[entry]

    def met(self, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all that share a table's key."""
        if not self.tables[size]:
            mine = self.of_size[size]
            return np.repeat(np.arange(len(windows)), len(mine)), np.tile(mine, len(windows))
        found = []
        for w, tables in enumerate(self.tables[size]):
            keys = walk_keys(windows, w)
            for t, (known, item) in enumerate(tables):
                first = np.searchsorted(known, keys[:, t], "left")
                count = np.searchsorted(known, keys[:, t], "right") - first
                hit = np.flatnonzero(count)
                c = count[hit]
                entry = np.repeat(first[hit] - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
                found.append(np.stack([np.repeat(hit, c), item[entry]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def search(items: Items, numbers: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, first word of the part, distance, the item's words) of every match, the best for each text and item id."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n in items.index:
        for at, place, size in items.laid(gram_numbers(numbers, n), n):
            text = np.searchsorted(edges, at, "right") - 1
            # the run lies within one text, its window may reach beyond it
            inside = at + n <= edges[text + 1]
            laid = np.unique(np.stack([size, text, at - place], axis=1)[inside], axis=0)
            for s in np.unique(laid[:, 0]).tolist():
                mine = laid[laid[:, 0] == s, 1:]
                step = max(1, EMBEDDED // s)
                for i in range(0, len(mine), step):
                    _match(items, numbers, edges, mine[i : i + step], s, best)
    return [(t, i, start, d, size) for (t, i), (d, start, size) in best.items()]


def _match(items: Items, numbers: np.ndarray, edges: np.ndarray, laid: np.ndarray, size: int, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Puts the matches of windows (``laid``: text, start) of one size into ``best``."""
    text, start = laid.T
    places = start[:, None] + np.arange(size)
    ok = (places >= edges[text][:, None]) & (places < edges[text + 1][:, None])
    which, item = items.met(np.where(ok, numbers[np.clip(places, 0, len(numbers) - 1)], np.uint64(0)), size)
    slack = allowed_edits(size)
    step = max(1, EMBEDDED // (size + 2 * slack))
    for i in range(0, len(which), step):
        w, it = which[i : i + step], item[i : i + step]
        low, high = np.maximum(edges[text[w]], start[w] - slack), np.minimum(edges[text[w] + 1], start[w] + size + slack)
        distance, end = distances(items.words(it, size), np.full(len(it), size), _cut(numbers, low, high), high - low)
        for k in np.flatnonzero(distance <= slack).tolist():
            key, value = (int(text[w[k]]), int(items.ids[it[k]])), (int(distance[k]), int(max(low[k], low[k] + end[k] - size) - edges[text[w[k]]]), size)
            if key not in best or value < best[key]:
                best[key] = value


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size."""
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = listed.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    share = max(size["n"] / BLOCK_ITEMS, (size["chars"] or 0) / BLOCK_CHARS)
    blocks = 1 if share <= 1 else math.ceil(2 * share)
    for b in range(blocks):
        mine = sorted(map(tuple, listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()))
        items = Items([i for i, _ in mine], [t for _, t in mine])
        if len(items.ids):
            yield items


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (``doc_id``, ``text``) and benchmark item (``item_id``, ``text``) that it holds.

    ``start_word`` is the word where the best matching part begins, ``distance``
    its word edits, ``item_words`` the words of the item.  Null and empty texts,
    items without words or without an id match nothing; items of one to five words
    match unedited only, see ``allowed_edits``.  Repeated documents give their rows
    each, a null ``doc_id`` is carried; an ``item_id`` given to several texts has
    one row for a document, that of the best match.  Empty tables give no rows,
    other columns are ignored.  The benchmark is searched in blocks of bounded
    size, one pass over the documents for each.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], FOUND)
    for n, items in enumerate(_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                names = batch["doc_id"].to_pylist()
                if matches := sorted(search(sent.value, *word_numbers(batch["text"]))):
                    text, item, start, distance, size = zip(*matches, strict=True)
                    yield rows(FOUND, doc_id=[names[t] for t in text], item_id=item, start_word=start, distance=distance, item_words=size)

        part = map_batches(docs, work, FOUND)
        found = part if not n else found.unionByName(part)
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose ``text`` holds no benchmark item, columns unchanged, whether they have a ``doc_id`` or not.

    What matches is what ``contaminated`` finds.  Null and empty texts stay,
    repeated rows stay or go alike, and an empty table stays empty.
    """
    left = documents
    for items in _blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in search(sent.value, *word_numbers(batch["text"]))]] = False
                yield batch.filter(pa.array(keep))

        left = map_batches(left, work, left.schema)
    return left
