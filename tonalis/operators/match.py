"""Matching photos to reference photos: standardised nearest neighbours and their weighted target.

A target is matched within the references of its own profile if there are any,
else within all.  References stay with their profile, so targets and references
are joined by an equality on the profile that serves; no pair of different pools
is ever built.  A reference set is what a user marks by hand: up to ``FEW`` it is sent
to all executors; a larger one is dealt by profile, the photos of each over
``SALTS`` parts, so that no profile's photos meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import CALIBRATION, Match

FEATURES = ("rg", "bg", "median_l")
ALL = "*"
FEW, SALTS = 50_000, 32


def scales(seeds: DataFrame, by: str = "pool") -> DataFrame:
    """Population deviation of each feature in each pool; 1 where fewer than two values or none differ."""
    sigma = lambda c: F.when(F.count(c) >= 2, F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    return seeds.groupBy(by).agg(*[sigma(c).alias(f"s_{c}") for c in FEATURES], F.count("*").alias("pool_size"))


def pools(seeds: DataFrame) -> DataFrame:
    """The references twice: under their own profile, and under ``*`` for targets whose profile has none."""
    own = seeds.where("profile IS NOT NULL").withColumn("pool", F.col("profile"))
    return own.unionByName(seeds.withColumn("pool", F.lit(ALL)))


def distance() -> Column:
    """Standardised distance of a target (``rg`` ...) and a reference (``seed_rg`` ...); a null on either side counts as 0."""
    parts = [F.coalesce(F.pow((F.col(c) - F.col(f"seed_{c}")) / F.col(f"s_{c}"), F.lit(2.0)), F.lit(0.0)) for c in FEATURES]
    return F.sqrt(parts[0] + parts[1] + parts[2])


def nearest(targets: DataFrame, seeds: DataFrame, how: Match = Match()) -> DataFrame:
    """``photo_id``, ``seed_id``, ``d`` and ``rank`` of the references of each target.

    ``targets`` are not references themselves.  k is half the pool, at least one
    and at most ``how.most``; a reference closer than ``how.exact`` is taken alone.
    Equal distances go to the smaller id.
    """
    dealt = pools(seeds)
    sizes = scales(dealt)
    served = sizes.select(F.col("pool").alias("own_pool"))
    chosen = targets.join(served, targets["profile"] == F.col("own_pool"), "left").withColumn("pool", F.coalesce("own_pool", F.lit(ALL))).drop("own_pool")
    sides = dealt.select("pool", F.col("photo_id").alias("seed_id"), *[F.col(c).alias(f"seed_{c}") for c in FEATURES]).join(sizes, "pool")
    asked = chosen.select("photo_id", "pool", *FEATURES)
    if seeds.limit(FEW + 1).count() <= FEW:
        pairs = asked.join(F.broadcast(sides), "pool").withColumn("d", distance())
    else:
        salted = asked.withColumn("salt", F.pmod(F.xxhash64("photo_id"), F.lit(SALTS)).cast("int"))
        pairs = salted.join(sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pool", "salt"]).withColumn("d", distance())
    w = W.partitionBy("photo_id").orderBy("d", "seed_id")
    k = F.least(F.lit(how.most), F.greatest(F.lit(1), F.expr("pool_size div 2")))
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= how.most)
    first = F.min("d").over(W.partitionBy("photo_id"))
    return ranked.withColumn("k", F.when(first < how.exact, F.lit(1)).otherwise(k)).where("rank <= k").select("photo_id", "seed_id", "d", "rank")


def weighted(value: str) -> Column:
    """Mean of ``value`` with weights 1 / (d + 1e-6), over the rows that have it; null where there are none."""
    w = F.when(F.col(value).isNotNull(), F.lit(1.0) / (F.col("d") + F.lit(1e-6)))
    return F.sum(F.col(value) * w) / F.sum(w)


def targets(matches: DataFrame, seeds: DataFrame, how: Match = Match()) -> DataFrame:
    """The weighted target of each photo: white balance, tone, and calibration.

    A calibration field whose values lie more than ``how.spread`` apart is that of
    the nearest reference that has it.
    """
    fields = [name for name, _ in CALIBRATION]
    joined = matches.join(seeds.withColumnRenamed("photo_id", "seed_id").select("seed_id", "temperature", "tint", "median_l", *fields), "seed_id")

    def guarded(c: str) -> Column:
        nearest_value = F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank")))
        return F.when((F.count(c) > 1) & (F.max(c) - F.min(c) > how.spread), nearest_value).otherwise(weighted(c)).alias(c)

    return joined.groupBy("photo_id").agg(weighted("temperature").alias("temperature"), weighted("tint").alias("tint"), weighted("median_l").alias("target_l"), *[guarded(c) for c in fields], F.count("*").alias("n_matched"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "seed_id"))), lambda x: x["seed_id"]).alias("seed_ids"))


TONE = ("median_l", "mean_l", "p05_l", "p95_l", "clipped_hi", "clipped_lo", "tonal_frac")


def target_tone(matches: DataFrame, tones: DataFrame) -> DataFrame:
    """Weighted tone (``photo_id``, ``tone``) of each photo's references, over those that have one (``photo_id`` and a ``tone`` struct)."""
    known = tones.where("tone IS NOT NULL").select(F.col("photo_id").alias("seed_id"), *[F.col(f"tone.{c}").alias(c) for c in TONE])
    return matches.join(known, "seed_id").groupBy("photo_id").agg(F.struct(*[weighted(c).alias(c) for c in TONE]).alias("tone"))


def target_bands(matches: DataFrame, bands: DataFrame, share: float = 0.01) -> DataFrame:
    """Weighted bands of each photo's references, over bands with a share of at least ``share``; hue is an unweighted circular mean."""
    from ..functions.scalars import circular_mean

    near = matches.join(bands.withColumnRenamed("photo_id", "seed_id").where(F.col("frac") >= share), "seed_id")
    hue = F.radians("median_hue")
    return near.groupBy("photo_id", "band").agg(*[weighted(c).alias(c) for c in ("frac", "median_chroma", "median_sat", "sat_clip_frac", "median_l")], circular_mean(F.sum(F.sin(hue)), F.sum(F.cos(hue))).alias("median_hue"))
