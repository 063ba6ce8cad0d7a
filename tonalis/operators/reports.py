"""Rows and tables that people read: ground truth, source comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Settings in a ground-truth row and their columns.
SHOWN = (("Exposure2012", "exposure2012"), ("Temperature", "temperature"), ("Tint", "tint"), ("Contrast2012", "contrast2012"), ("Highlights2012", "highlights"), ("Shadows2012", "shadows"), ("Whites2012", "whites"), ("Blacks2012", "blacks"), ("Clarity2012", "clarity"), ("Dehaze", "dehaze"), ("Vibrance", "vibrance"), ("Saturation", "saturation"))
# Measures in a ground-truth row, where they come from, their names, and digits kept.
MEASURES = (("raw", "y_mean", "raw_ymean", 5), ("raw", "y_median", "raw_ymedian", 5), ("raw", "y_p25", "raw_yp25", 5), ("raw", "y_p75", "raw_yp75", 5), ("raw", "hl", "raw_hl", 2), ("raw", "sh", "raw_sh", 2), ("raw", "gr", "raw_gr", 4), ("raw", "gb", "raw_gb", 4), ("raw", "asshot_rg", "asshot_rg", 4), ("raw", "asshot_bg", "asshot_bg", 4),
    ("embedded", "y_mean", "emb_ymean", 5), ("embedded", "gr", "emb_gr", 4), ("embedded", "gb", "emb_gb", 4),
    ("final", "y_mean", "fin_ymean", 5), ("final", "y_median", "fin_ymedian", 5), ("final", "hl", "fin_hl", 2), ("final", "sh", "fin_sh", 2), ("final", "gr", "fin_gr", 4), ("final", "gb", "fin_gb", 4), ("final", "contrast", "fin_contrast", 4))


def ground_truth(records: DataFrame) -> DataFrame:
    """One flat row for each photo (``photo``, ``catalog``, ``exif`` struct, ``develop`` map of texts, ``raw``, ``embedded``, ``final`` structs): measures rounded, those of absent pictures 0."""
    exif = [F.col(f"exif.{c}").alias(c) for c in ("iso", "f", "shutter_s", "focal")]
    settings = [F.element_at("develop", key).try_cast("double").alias(name) for key, name in SHOWN]
    value = lambda src, c: F.col(f"{src}.{c}") if src == "raw" else F.coalesce(F.col(f"{src}.{c}"), F.lit(0.0))
    return records.select("photo", "catalog", *exif, *settings, *[F.bround(value(src, c), digits).alias(name) for src, c, name, digits in MEASURES])


def write_csv(rows: DataFrame, folder: str) -> None:
    """Ground-truth rows as CSV with a header, always the same columns."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def channels(linear: DataFrame) -> DataFrame:
    """Mean channels, Rec.709 luma and green's ratios of linear pixels (``photo_id``, ``lr``, ``lg``, ``lb``)."""
    mean = {c: F.avg(f"l{c}") + F.lit(1e-9) for c in "rgb"}
    luma = F.avg(F.col("lr") * 0.2126 + F.col("lg") * 0.7152 + F.col("lb") * 0.0722)
    return linear.groupBy("photo_id").agg(*[mean[c].alias(f"mean_{c}") for c in "rgb"], luma.alias("luma"), (mean["g"] / mean["r"]).alias("gr"), (mean["g"] / mean["b"]).alias("gb"))


def source_offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sources' ``channels`` compared: for luma in stops (log2 b / a) and the ratios in percent, their mean, deviation, least and largest; photos without light are left out."""
    both = a.alias("a").join(b.alias("b"), "photo_id").where("a.luma > 0 AND b.luma > 0")
    of = {"luma": F.log2(F.col("b.luma") / F.col("a.luma")), "gr": (F.col("b.gr") / F.col("a.gr") - 1) * 100, "gb": (F.col("b.gb") / F.col("a.gb") - 1) * 100}
    long = both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("v")) for k, v in of.items()])).alias("e")).select("e.*")
    return long.groupBy("what").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def raw_metrics(linear: DataFrame) -> DataFrame:
    """Luminance mean and median, quartiles by rounded weights, clipped shares in percent, and gray-world ratios of linear ProPhoto pixels."""
    from . import measure

    rough: Column = F.col("lr") * 0.2880 + F.col("lg") * 0.7119 + F.col("lb") * 0.0001
    q = F.percentile(rough, F.array(F.lit(0.25), F.lit(0.75)))
    light = measure.exposure(linear).select("photo_id", F.col("mean_luma").alias("y_mean"), F.col("median_luma").alias("y_median"), (F.col("clipped_highlights") * 100).alias("hl"), (F.col("clipped_shadows") * 100).alias("sh"))
    quarter = linear.groupBy("photo_id").agg(q[0].alias("y_p25"), q[1].alias("y_p75"))
    return light.join(quarter, "photo_id").join(measure.gray_world(linear), "photo_id")
