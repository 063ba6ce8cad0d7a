"""Comparing pictures and sources: band deltas, ratios, warmth, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.color import srgb_to_linear, weighted
from .quantiles import quantiles


def band_deltas(camera: DataFrame, raw: DataFrame) -> DataFrame:
    """Camera bands minus RAW bands of the same photo and name; hue by plain subtraction."""
    names = {"median_chroma": "dchroma", "median_sat": "dsat", "median_hue": "dhue", "median_l": "dl"}
    c = camera.select("photo_id", "band", *[F.col(k).alias(f"c_{k}") for k in names])
    r = raw.select("photo_id", "band", *[F.col(k).alias(f"r_{k}") for k in names])
    return c.join(r, ["photo_id", "band"]).select("photo_id", "band", *[(F.col(f"c_{k}") - F.col(f"r_{k}")).alias(v) for k, v in names.items()])


def oversaturated(frac: Column, clip: Column, least: float = 0.01) -> Column:
    """Whether a RAW band is clipped: null where there is no reliable band, so that null means unknown."""
    return F.when(frac >= least, clip >= 0.05)


def crop_area(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """Share of the frame that is left; missing sides are uncropped."""
    side = lambda a, b: F.greatest(F.lit(0.0), F.coalesce(b, F.lit(1.0)) - F.coalesce(a, F.lit(0.0)))
    return side(left, right) * side(top, bottom)


def scope_of(area: Column, limit: float = 0.8) -> Column:
    """The zone that a photo is measured in."""
    return F.when(area < limit, "sharp").otherwise("global")


def jpeg_metrics(pixels: DataFrame) -> DataFrame:
    """Luma mean and median, gray-world ratios, shares of light and shadow, contrast."""
    lit = pixels.select("photo_id", *[srgb_to_linear(F.col(c)).alias(f"l{c}") for c in "rgb"])
    y = lit.withColumn("y", weighted((0.2126, 0.7152, 0.0722), [F.col("lr"), F.col("lg"), F.col("lb")]))
    p = F.percentile("y", F.array(F.lit(0.9), F.lit(0.1)))
    share = lambda c: F.avg(c.cast("double")) * 100.0
    return y.groupBy("photo_id").agg(F.avg("y").alias("y_mean"), F.median("y").alias("y_median"), (F.avg("lg") / F.avg("lr")).alias("gr"), (F.avg("lg") / F.avg("lb")).alias("gb"), share(F.col("y") > 0.95).alias("hl"), share(F.col("y") < 0.002).alias("sh"), (p[0] - p[1]).alias("contrast"))


def warmth(metrics: DataFrame) -> DataFrame:
    """How a series' warmth is spread, and whether it holds together."""
    rows = metrics.select("gr", F.lit(0).alias("series"))
    q = quantiles(rows, "series", "gr", (0.5, 0.1, 0.9)).select("series", F.col("q")[0].alias("gr"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"))
    rest = rows.groupBy("series").agg(F.count("*").alias("n"), F.stddev_pop("gr").alias("sd"), (F.avg((F.col("gr") < 0.9).cast("double")) * 100.0).alias("warm"))
    found = rest.join(q, "series").drop("series")
    return found.withColumn("coherent", F.col("sd") < 0.05)


def parity(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Mean absolute difference and correlation of two measurements of the same photos."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    flat = (F.count("*") < 2) | (F.stddev_pop("a") <= 1e-9) | (F.stddev_pop("b") <= 1e-9)
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs"), F.when(~flat, F.corr("a", "b")).alias("corr"))


def source_deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Log2 ratio of two sources: mean, deviation, least and largest."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    d = F.log2(F.col("b") / F.col("a"))
    return both.where("a > 0 AND b > 0").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("least"), F.max(d).alias("most"))
