"""Measuring photos: tone, neutral cast and hue bands over the whole frame and its sharp zone.

Pixel tables have ``photo_id``, ``x``, ``y`` and 8-bit ``r``, ``g``, ``b``.  Both
scopes come out of one aggregation with filtered aggregates: pixels are neither
doubled nor scanned twice, and what is shuffled again is a row for each photo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import BANDS, Measure
from ..functions import color

SCOPES = ("global", "sharp")


def with_lab(pixels: DataFrame) -> DataFrame:
    """Adds ``l``, ``a``, ``b_``, ``hue`` and ``sat``."""
    r, g, b = (F.col(c) for c in "rgb")
    names = ("l", "a", "b_", "hue", "sat")
    return pixels.withColumns(dict(zip(names, [*color.lab(r, g, b), *color.hue_saturation(r, g, b)], strict=True)))


def laplacian(pixels: DataFrame, luma: str = "l") -> DataFrame:
    """Adds ``mag``, the absolute Laplacian of ``luma``, the edge repeated beyond it."""
    here = F.col(luma)
    row, column = W.partitionBy("photo_id", "y").orderBy("x"), W.partitionBy("photo_id", "x").orderBy("y")
    around = [F.coalesce(f(luma).over(w), here) for w in (row, column) for f in (F.lag, F.lead)]
    # one exchange by photo serves both windows
    return pixels.repartition("photo_id").withColumn("mag", F.abs(here * 4.0 - around[2] - around[3] - around[0] - around[1]))


def sharp_mask(pixels: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Adds ``sharp``: the upper quarter of ``mag`` of each photo, ties included; everything in a flat photo."""
    limits = pixels.groupBy("photo_id").agg(F.percentile("mag", F.lit(how.sharp_quantile)).alias("limit"), F.max("mag").alias("most"))
    return pixels.join(limits, "photo_id").withColumn("sharp", (F.col("mag") >= F.col("limit")) | (F.col("most") == 0)).drop("limit", "most")


def _only(value: Column, where: Column) -> Column:
    return F.when(where, value)


def tone(pixels: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Tone statistics for each photo and scope.

    Tonal pixels are neither clipped nor dead; a scope without any falls back to
    all pixels of the frame.  Clipped shares are of the whole frame in both scopes.
    """
    high = F.greatest("r", "g", "b") >= how.highlight
    low = F.col("l") <= how.shadow_l
    levels = F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))
    fields = [F.avg(high.cast("double")).alias("clipped_hi"), F.avg(low.cast("double")).alias("clipped_lo"), F.percentile("l", levels).alias("all_p"), F.avg("l").alias("all_m")]
    for scope in SCOPES:
        keep = ~high & ~low & (F.col("sharp") if scope == "sharp" else F.lit(True))
        fields += [F.percentile(_only(F.col("l"), keep), levels).alias(f"{scope}_p"), F.avg(_only(F.col("l"), keep)).alias(f"{scope}_m"), F.avg(keep.cast("double")).alias(f"{scope}_f")]
    wide = pixels.groupBy("photo_id").agg(*fields)
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.coalesce(f"{s}_p", "all_p").alias("p"), F.coalesce(f"{s}_m", "all_m").alias("mean_l"), F.col(f"{s}_f").alias("tonal_frac")) for s in SCOPES])
    long = wide.select("photo_id", "clipped_hi", "clipped_lo", F.explode(rows).alias("s"))
    return long.select("photo_id", "s.scope", F.col("s.p")[0].alias("median_l"), "s.mean_l", F.col("s.p")[1].alias("p05_l"), F.col("s.p")[2].alias("p95_l"), "clipped_hi", "clipped_lo", "s.tonal_frac")


def neutral(pixels: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Cast of near-grey pixels for each photo and scope; zeros where there are none; the share is of all pixels."""
    chroma = F.sqrt(F.col("a") * F.col("a") + F.col("b_") * F.col("b_"))
    near = (chroma < how.neutral_chroma) & F.col("l").between(how.neutral_low, how.neutral_high)
    fields = [F.count("*").alias("n")]
    for s in SCOPES:
        keep = near & (F.col("sharp") if s == "sharp" else F.lit(True))
        fields += [F.median(_only(v, keep)).alias(f"{s}_{k}") for k, v in (("a", F.col("a")), ("b", F.col("b_")), ("c", chroma))] + [F.count_if(keep).alias(f"{s}_n")]
    wide = pixels.groupBy("photo_id").agg(*fields)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), zero(f"{s}_a").alias("a_bias"), zero(f"{s}_b").alias("b_bias"), zero(f"{s}_c").alias("chroma"), (F.col(f"{s}_n") / F.col("n")).alias("neutral_frac"), F.col(f"{s}_n").alias("n_neutral")) for s in SCOPES])
    return wide.select("photo_id", F.explode(rows).alias("s")).select("photo_id", "s.*")


def bands(pixels: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Eight hue bands for each photo and scope; empty ones have share 0, their centre as hue, and zeros.

    The grouping is by photo and band; a dense grid of photos, scopes and bands
    is laid under it.
    """
    chroma = F.sqrt(F.col("a") * F.col("a") + F.col("b_") * F.col("b_"))
    coloured = pixels.withColumn("chroma", chroma).withColumn("band_no", F.when(F.col("chroma") >= how.neutral_chroma, color.nearest_band(F.col("hue"))))
    totals = coloured.groupBy("photo_id").agg(F.count("*").alias("total"))
    fields = []
    for s in SCOPES:
        keep = F.col("sharp") if s == "sharp" else F.lit(True)
        fields += [F.median(_only(F.col(c), keep)).alias(f"{s}_{c}") for c in ("hue", "chroma", "sat", "l")]
        fields += [F.count_if(keep).alias(f"{s}_n"), F.avg(_only((F.col("sat") >= how.saturated).cast("double"), keep)).alias(f"{s}_clip")]
    found = coloured.where("band_no IS NOT NULL").groupBy("photo_id", "band_no").agg(*fields)
    cells = F.array(*[F.struct(F.lit(i).alias("band_no"), F.lit(name).alias("band"), F.lit(centre).alias("centre")) for i, (name, centre) in enumerate(BANDS)])
    grid = totals.select("photo_id", "total", F.explode(cells).alias("c")).select("photo_id", "total", "c.*").join(found, ["photo_id", "band_no"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), (F.coalesce(f"{s}_n", F.lit(0)) / F.col("total")).alias("frac"), F.coalesce(f"{s}_hue", "centre").alias("median_hue"), zero(f"{s}_chroma").alias("median_chroma"), zero(f"{s}_sat").alias("median_sat"), zero(f"{s}_clip").alias("sat_clip_frac"), zero(f"{s}_l").alias("median_l")) for s in SCOPES])
    return grid.select("photo_id", "band_no", "band", F.explode(rows).alias("s")).select("photo_id", "band_no", "band", "s.*")


def analysed(pixels: DataFrame, how: Measure = Measure()) -> DataFrame:
    """Pixels with Lab, hue, saturation, Laplacian and the sharp mask."""
    return sharp_mask(laplacian(with_lab(pixels)), how)


def exposure(linear: DataFrame) -> DataFrame:
    """Mean and median luminance and clipped shares of linear ProPhoto pixels (``lr``, ``lg``, ``lb``)."""
    y = color.luminance(F.col("lr"), F.col("lg"), F.col("lb"))
    return linear.withColumn("_y", y).groupBy("photo_id").agg(
        F.avg("_y").alias("mean_luma"),
        F.median("_y").alias("median_luma"),
        F.avg((F.greatest("lr", "lg", "lb") >= 0.99).cast("double")).alias("clipped_highlights"),
        F.avg((F.col("_y") <= 0.0008).cast("double")).alias("clipped_shadows"),
    )


def gray_world(linear: DataFrame) -> DataFrame:
    """Ratios of mean green to mean red and blue of linear pixels."""
    r, g, b = (F.avg(F.col(c) + F.lit(1e-9)) for c in ("lr", "lg", "lb"))
    return linear.groupBy("photo_id").agg((g / r).alias("gr"), (g / b).alias("gb"))


def preview(pixels: DataFrame) -> DataFrame:
    """Display and linear luma, and gray-world ratios over mid-tones; where these are under 2 % of the frame, over its brightest fifth."""
    light = {c: color.srgb_to_linear(F.col(c)) for c in "rgb"}
    rec709 = lambda v: color.weighted((0.2126, 0.7152, 0.0722), v)
    lit = pixels.select("photo_id", *[v.alias(f"l{c}") for c, v in light.items()], (rec709([F.col(c) / F.lit(255.0) for c in "rgb"])).alias("d")).withColumn("y", rec709([F.col("lr"), F.col("lg"), F.col("lb")]))
    first = lit.groupBy("photo_id").agg(F.median("d").alias("disp_median"), F.avg("d").alias("disp_mean"), F.median("y").alias("lin_median"), F.avg("y").alias("lin_mean"), F.percentile("y", F.lit(0.8)).alias("p80"), F.avg(((F.col("y") > 0.05) & (F.col("y") < 0.6)).cast("double")).alias("mid_frac"))
    use = F.when(F.col("mid_frac") < 0.02, F.col("y") > F.col("p80")).otherwise((F.col("y") > 0.05) & (F.col("y") < 0.6))
    means = lit.join(first.select("photo_id", "p80", "mid_frac"), "photo_id").where(use).groupBy("photo_id").agg((F.avg("lg") / (F.avg("lr") + 1e-9)).alias("gw_rg"), (F.avg("lg") / (F.avg("lb") + 1e-9)).alias("gw_bg"))
    return first.drop("p80").join(means, "photo_id", "left")
