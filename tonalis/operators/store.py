"""Keyed measurement tables: what is missing or stale, upserts, and overlays.

Plain Parquet has no MERGE, so a new version of a table is the full outer join
of the old one with the changes, written beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import written


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``; an aggregate, so one key's many versions meet partly summed."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_"))
    return best.select(*keys, *[F.col(f"_.{c}").alias(c) for c in rest])


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str], needed: str) -> DataFrame:
    """Rows of ``wanted`` without a row in ``cache`` of equal keys whose ``needed`` column is there."""
    return wanted.join(cache.where(F.col(needed).isNotNull()).select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in, at most one for each key.

    ``keep`` columns stay as they were where the key is known; ``fill`` columns
    take the new value unless it is null; all others are replaced.
    """
    changed, known = F.col("n._in").isNotNull(), F.col("o._in").isNotNull()

    def column(c: str):  # noqa: ANN202
        a, b = F.col(f"o.{c}"), (F.col(f"n.{c}") if c in new.columns else F.lit(None))
        if c == key:
            return F.coalesce(b, a)
        if c not in new.columns or c in keep:
            return F.when(known, a).otherwise(b)
        return F.when(changed, F.coalesce(b, a) if c in fill else b).otherwise(a)

    o, n = old.withColumn("_in", F.lit(1)).alias("o"), new.withColumn("_in", F.lit(1)).alias("n")
    both = o.join(n, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    return both.select(*[column(c).alias(c) for c in old.columns])


def chunked(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``chunk``: rows in the order of ``key``, ``size`` to each.

    Places are counted within sorted ranges and moved by the ranges' sizes, so
    no range but the number of ranges meets in one task.  The ranges are written
    once, as both counts have to see the same ones.
    """
    dealt = written(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")
    within = dealt.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return within.join(starts, "_part").withColumn("chunk", F.floor((F.col("_start") + F.col("_place") - 1) / size)).drop("_part", "_place", "_start")


def ordered_union(lists: dict[str, DataFrame]) -> DataFrame:
    """The distinct ``path``s of several lists (``path``, and ``at``, its place in the list), each with its ``place`` by where it first comes, list by list, and a flag for each list that names it."""
    parts = [df.select("path", F.struct(F.lit(i).alias("l"), F.col("at")).alias("at"), *[F.lit(n == name).alias(n) for n in lists]) for i, (name, df) in enumerate(lists.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy("path").agg(F.min("at").alias("at"), *[F.bool_or(n).alias(n) for n in lists])
    return chunked(merged, "at", 1).select("path", *lists, (F.col("chunk") + 1).alias("place"))


def keywords(old, add, remove):  # noqa: ANN001, ANN201
    """Keyword set with names added, then removed, in order."""
    return F.array_sort(F.array_except(F.array_union(old, add), remove))


def overlay(current, preset):  # noqa: ANN001, ANN201
    """A settings map with a preset laid over it."""
    kept = F.map_filter(current, lambda k, _: ~F.array_contains(F.map_keys(preset), k))
    return F.map_concat(kept, preset)


def apply_report(adjustments: DataFrame, photos: DataFrame) -> DataFrame:
    """What applying ``adjustments`` (``photo_id``, ``n_settings``) to ``photos`` would do, and why rows fail."""
    known = photos.select("photo_id").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), "uuid not found").when(F.coalesce("n_settings", F.lit(0)) == 0, "empty develop").otherwise("applied")
    return adjustments.join(known, "photo_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
