"""Exact top-k by inner product through distributed histogram selection.

Every query is scored against every row, in blocks of queries whose size in
bytes is bounded.  The k-th best score of a query is located by histograms: the
first pass counts scores by their high bits, the next ones count, within the bin
that holds the k-th value, by lower bits, down to single values.  A partition
reports only the bins above its own k-th best, so a histogram has at most k
entries for each query and partition.  A last pass keeps what beats the k-th
value, and of its ties the smallest ids, which a final ranking orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import map_batches, rows, saved

#: Low bits that each histogram pass leaves out.
SHIFTS = (12, 0)
#: Bytes of the query vectors sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Scores held at once in a task.
SCORES = 1 << 22
SCALE = 1024.0
NONE = np.iinfo(np.int64).min


def integer_vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and integer vectors (whole numbers as doubles) of the rows that take part."""
    column = batch["embedding"]
    flat = column.flatten()
    values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    ok = np.isfinite(values)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    keep = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False) & batch["vec_id"].is_valid().to_numpy(zero_copy_only=False)
    ids = batch["vec_id"].fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(lengths[keep]).tolist():
        at = np.flatnonzero(keep & (lengths == size))
        out[size] = ids[at], values[(ends - lengths)[at][:, None] + np.arange(size)]
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as ``int64``, exact; OverflowError where one doesn't fit."""
    size = a.shape[1]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * size
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = a.astype(object).dot(b.astype(object).T) if size else np.zeros((len(a), len(b)))
    return np.vectorize(int, otypes=[object])(whole).astype(np.int64) if whole.size else whole.astype(np.int64)


class Block:
    """Queries of one block, by dimension: ids, vectors, and for each the bin that holds its k-th value, that bin's rank in it."""

    def __init__(self, ids: list[int], vectors: list[list[float]], k: int) -> None:
        self.by_size: dict[int, list[np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            vec = np.floor(SCALE * np.array([vectors[i] for i in at.tolist()], np.float64).reshape(len(at), size))
            self.by_size[size] = [np.array(ids, np.int64)[at], vec, np.full(len(at), NONE), np.full(len(at), k)]


def _parts(ids: np.ndarray, vectors: np.ndarray, queries: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, SCORES // max(1, len(queries[0])))
    for i in range(0, len(ids), step):
        yield ids[i : i + step], exact_scores(vectors[i : i + step], queries[1])


HISTOGRAM = "query_id long, bin long, n long"
HITS = "query_id long, vec_id long, score long"


def _histogram(block, k: int, before: int | None, shift: int):  # noqa: ANN001, ANN202
    """Counts by bin of ``shift``; within each query's bin of the pass ``before``, if there was one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = block.value.by_size
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, (ids, vectors) in integer_vectors(batch).items():
                if size not in by_size:
                    continue
                queries = by_size[size]
                for own, scores in _parts(ids, vectors, queries):
                    use = own[:, None] != queries[0]
                    if before is not None:
                        use &= (scores >> before) == queries[2]
                    q, b, n, least = held.get(size) or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(len(queries[0]), NONE))
                    bins = np.where(use, scores >> shift, NONE)
                    if len(bins) >= k:
                        least = np.maximum(least, np.partition(bins, len(bins) - k, axis=0)[len(bins) - k])
                    row, col = np.nonzero(use & (bins >= least))
                    q, b, n = np.concatenate([q, col]), np.concatenate([b, bins[row, col]]), np.concatenate([n, np.ones(len(row), np.int64)])
                    held[size] = (*_trim(q, b, n, k), least)
        for size, (q, b, n, _) in held.items():
            for i in range(0, len(q), 50_000):
                part = slice(i, i + 50_000)
                yield rows(HISTOGRAM, query_id=by_size[size][0][q[part]], bin=b[part], n=n[part])

    return work


def _trim(q: np.ndarray, b: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums equal (query, bin), best bins first, and cuts each query after the bin that reaches k."""
    order = np.lexsort((-b, q))
    q, b, n = q[order], b[order], n[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return q, b, n
    q, b, n = q[first], b[first], np.add.reduceat(n, first)
    total = np.cumsum(n) - n
    head = np.ones(len(q), bool)
    head[1:] = q[1:] != q[:-1]
    above = total - total[np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))]
    return q[above < k], b[above < k], n[above < k]


def _hits(block, k: int):  # noqa: ANN001, ANN202
    """Rows above each query's k-th value, and of those at it the k smallest ids of this partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = block.value.by_size
        ties: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, (ids, vectors) in integer_vectors(batch).items():
                if size not in by_size:
                    continue
                queries = by_size[size]
                for own, scores in _parts(ids, vectors, queries):
                    other = own[:, None] != queries[0]
                    row, col = np.nonzero((scores > queries[2]) & other)
                    yield rows(HITS, query_id=queries[0][col], vec_id=own[row], score=scores[row, col])
                    row, col = np.nonzero((scores == queries[2]) & other)
                    q, v = ties.get(size, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    q, v = np.concatenate([q, col]), np.concatenate([v, own[row]])
                    order = np.lexsort((v, q))
                    q, v = q[order], v[order]
                    begin = np.searchsorted(q, q, side="left")
                    few = np.arange(len(q)) - begin < k
                    ties[size] = q[few], v[few]
        for size, (q, v) in ties.items():
            yield rows(HITS, query_id=by_size[size][0][q], vec_id=v, score=by_size[size][2][q])

    return work


def _components(df: DataFrame) -> Column:
    """Floats as they are, which doubles hold exactly; any other numbers as doubles."""
    kind = df.schema["embedding"].dataType
    return F.col("embedding") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col("embedding").cast("array<double>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` (both ``vec_id``, ``embedding``).

    The score is the inner product of the vectors' components, each turned into
    ``floor(1024 * x)``, ``x`` as a double.  Ties go to the smaller ``vec_id``; a row never answers
    a query of its own ``vec_id``.  Vectors that are null, hold a null or
    non-finite component, or lack an id take no part; vectors of another length
    than the query's don't answer it.  Queries are scored in blocks of at most
    ``BLOCK_BYTES``, three passes over ``vectors`` for each block.  Queries of one id are one query, that of
    the smallest vector; repeated candidate rows answer as often as they occur.
    Fewer than ``k`` rows: all are returned.
    """
    spark = vectors.sparkSession
    data = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _components(vectors).alias("embedding"))
    whole = (
        queries.select(F.col("vec_id").cast("long").alias("query_id"), _components(queries).alias("embedding"))
        .where("query_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        .groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    )
    asked = saved(whole, "top-k-queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks = max(1, -(-size["n"] * 8 * max(1, size["d"] or 1) * 5 // (4 * BLOCK_BYTES)))
    found: DataFrame | None = None
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").collect()
        if not mine:
            continue
        block = Block([r["query_id"] for r in mine], [r["embedding"] for r in mine], k)
        before = None
        for shift in SHIFTS:
            sent = spark.sparkContext.broadcast(block)
            counts = map_batches(data, _histogram(sent, k, before, shift), HISTOGRAM).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
            place = W.partitionBy("query_id").orderBy(F.desc("bin"))
            above = counts.withColumn("above", F.sum("n").over(place) - F.col("n"))
            lasts = above.where(F.col("above") < k).groupBy("query_id").agg(F.collect_list(F.struct("bin", "above", "n")).alias("bins"))
            found_bins = {r["query_id"]: sorted((x["bin"], x["above"], x["n"]) for x in r["bins"]) for r in lasts.collect()}
            for ids, _, bins, ranks in block.by_size.values():
                for j, name in enumerate(ids.tolist()):
                    rank = int(ranks[j])
                    # the k-th value lies in the bin that brings the count to the rank
                    chosen = next(((b, a) for b, a, n in found_bins.get(name, ()) if a < rank <= a + n), None)
                    bins[j], ranks[j] = (chosen[0], rank - chosen[1]) if chosen else (NONE, rank)
            before = shift
            sent.unpersist()
        hits = saved(map_batches(data, _hits(spark.sparkContext.broadcast(block), k), HITS), "top-k-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
