"""What the operators of this folder share: Arrow batches, the shared folder, whole-text helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package

#: Bytes of one Arrow batch; a batch of very long texts is cut to this, too.
BATCH_BYTES = "8m"


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, barrier: bool = False) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, not only in rows; a worker gives freed memory back when a task ends."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema, barrier)


def _give_back() -> None:
    """Returns the free memory of Arrow and of the C library, where that can, to the system; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_heap_back(spark: SparkSession) -> None:
    """Every executor's JVM collects its garbage and returns unused heap to the system, a task for each core; else a stage's workers run beside the heap that the stage before has grown."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_type(name: str) -> pa.DataType:
    return pa.list_(_arrow_type(name[6:-1])) if name.startswith("array<") else _ARROW[name]


@functools.cache
def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of flat DDL, without a Spark session (workers have none)."""
    return pa.schema([(name, _arrow_type(kind)) for name, kind in (field.split() for field in ddl.split(","))])


def rows(schema: str, **columns: object) -> pa.RecordBatch:
    """A record batch with the columns of a DDL ``schema``, in its order."""
    target = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and there is one machine, as in local tests, a
    temporary folder of it is used; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tonalis-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def _located(spark: SparkSession, folder: str) -> tuple:
    """The store of a folder and its path there, as Spark itself reaches it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared one; what is written there goes with the session, if not before."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    store, path = _located(spark, folder)
    store.deleteOnExit(path)
    return folder


#: Where the tables that ``saved`` wrote lie.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: Spark's setting by which a query's shuffle files go when it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors; the shuffles that led to it go at once, not when the driver next collects garbage."""
    path, conf = shared_folder(df.sparkSession, purpose), df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_SHUFFLES_GO)
        else:
            conf.set(_SHUFFLES_GO, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for ``tables``, which nothing reads any more."""
    for t in tables:
        if folder := _folders.pop(t, None):
            store, path = _located(t.sparkSession, folder)
            store.delete(path, True)


#: A key counts as hot if it holds more than this share of the rows, so there are no more than ``1 / HOT`` such keys.
HOT = 1 / 4096


def join_unique(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``left`` joined with the columns of ``right`` but ``size``, for the keys that both have.

    ``right`` has one row for each ``key`` and in ``size`` how many of the
    ``total`` rows of ``left`` have it.  Hot keys, if there are any, are sent to
    all executors, at most ``1 / HOT`` rows; the others meet in a shuffle, so no
    task gets a hot key's rows.  The hot keys themselves are a list in the plan,
    by which rows are told apart as they are read, without a join.
    """
    known = saved(right, "keyed")
    hot = known.where(F.col(size) > total * HOT).drop(size)
    names = [r[0] for r in hot.select(key).collect()]
    if not names:
        return left.join(known.drop(size), key)
    rest = known.where(F.col(size) <= total * HOT).drop(size)
    cold = left.where(~F.col(key).isin(names)).join(rest, key)
    return cold.unionByName(left.where(F.col(key).isin(names)).join(F.broadcast(hot), key))


#: The logarithm of the most bits that ``only_maybe`` sends: 2^20 rows of 64.
MOST_BITS = 26


def only_maybe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` whose ``key`` (a long) may be in ``right``: all that are, and about an eighth of the others.

    Thins out wide rows before they are shuffled for a join.  A bit for each of
    ``right``'s keys, of eight times as many as there are, is sent to all
    executors, 64 a row; beyond ``2 ** MOST_BITS`` bits more rows stay, but none
    is lost.
    """
    bits = min(MOST_BITS, max(16, (8 * right.count()).bit_length()))
    place = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    part, bit = unused_name("bits", left.columns), place.bitwiseAND(63).cast("int")
    word = F.shiftright(place, 6)
    sent = right.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(part))
    hit = F.call_function("shiftright", F.col(part), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return left.where(F.col(key).isNotNull()).join(F.broadcast(sent), word == F.col("word")).where(hit).select(left.columns)


def unused_name(stem: str, columns: Iterable[str]) -> str:
    """A column name that isn't among ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem in taken:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
