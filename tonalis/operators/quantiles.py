"""Exact quantiles of groups that are too large for one task, by histograms that close in on each rank.

Spark's own ``percentile`` holds the distinct values of a group in one task; up to
``ONE_TASK`` rows in all it is used.  Beyond that every round counts the values that
may still be the wanted one in ``BINS`` bins and goes on with the bin that holds its
rank, between the least and the largest value in that bin, until they are equal.
What is shuffled is a row for each group, rank and bin of a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

ONE_TASK = 20_000_000
BINS = 4096
#: Rounds after which values are counted one by one, which only many orders of magnitude within a bin need.
ROUNDS = 8


def quantiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...], one_task: int | None = None) -> DataFrame:
    """``by``, ``n`` and ``q``: the quantiles of ``value`` in each group at ``shares``, interpolated between neighbours, in their order.

    Nulls and values that are no numbers are left out; groups without any other
    value are absent.  ``one_task`` is for ``ONE_TASK``.
    """
    rows = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    if rows.count() <= (ONE_TASK if one_task is None else one_task):
        return rows.groupBy(F.col("_g").alias(by)).agg(F.count("*").alias("n"), F.percentile("_v", F.array(*map(F.lit, shares))).alias("q"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    place = lambda s: F.lit(s) * (F.col("n") - 1)
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(place(s)).cast("long").alias("rank")) for i, s in enumerate(shares) for side, f in ((0, F.floor), (1, F.ceil))])
    todo = sizes.select("_g", "n", "low", "high", F.explode(ends).alias("e")).select("_g", "n", "e.*", "low", "high").collect()
    schema, spark = "_g " + df.schema[by].dataType.simpleString() + ", n long, i int, side int, rank long, low double, high double", df.sparkSession
    done = {}
    for turn in range(ROUNDS + 2):
        done |= {(r["_g"], r["i"], r["side"]): (r["n"], r["low"]) for r in todo if r["low"] == r["high"]}
        todo = [r for r in todo if r["low"] != r["high"]]
        if not todo:
            break
        # a row for each group and rank: groups are as many as a caller names
        open_ = F.broadcast(spark.createDataFrame([tuple(r) for r in todo], schema).withColumnRenamed("_g", "_o"))
        near = rows.join(open_, F.col("_g").eqNullSafe(F.col("_o")) & F.col("_v").between(F.col("low"), F.col("high")))
        slot = F.col("_v") if turn == ROUNDS else F.least(F.lit(BINS - 1.0), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * F.lit(float(BINS))).cast("double"))
        counts = near.groupBy("_g", "n", "i", "side", "rank", slot.alias("slot")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("c").over(W.partitionBy("_g", "i", "side").orderBy("slot"))
        held = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        todo = held.select("_g", "n", "i", "side", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "low", "high").collect()
    out = []
    for g in dict.fromkeys(k[0] for k in done):
        n = next(v[0] for k, v in done.items() if k[0] == g)
        pairs = [(done[g, i, 0][1], done[g, i, 1][1], s * (n - 1) % 1) for i, s in enumerate(shares)]
        out.append((g, n, [a + (b - a) * f for a, b, f in pairs]))
    return spark.createDataFrame(out, f"`{by}` {df.schema[by].dataType.simpleString()}, n long, q array<double>")
