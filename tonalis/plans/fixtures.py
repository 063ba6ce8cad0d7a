"""Photo tables derived from the given tables by arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import CALIBRATION
from ..functions import color, scalars
from ..session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, shift: int = 0, gain: float = 2.0) -> DataFrame:
    """An 8 x 8 picture for each embedding; the camera's own picture is shifted and has another gain."""
    e = lambda k: F.get("embedding", (F.col("pos") + F.lit(k + shift)) % 64).cast("double")
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.lit(gain) * v + 0.5) * 255.0).cast("int")))
    dealt = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    red, green, blue = e(0), e(21) + F.lit(8.0) * e(0) * e(13), e(42) - F.lit(8.0) * e(0) * e(29)
    return dealt.select("photo_id", "pos", (F.col("pos") % 8).alias("x"), F.expr("pos div 8").cast("int").alias("y"), level(red).alias("r"), level(green).alias("g"), level(blue).alias("b"))


def camera_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures as the cameras made them."""
    return pixels(spark, sf_dir, shift=7, gain=1.6)


def linear_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as linear light, ``lr``, ``lg``, ``lb`` from 0 to 1."""
    return pixels(spark, sf_dir).select("photo_id", "pos", *[(F.col(c) / F.lit(255.0)).alias(f"l{c}") for c in "rgb"])


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and metadata of each photo; every tenth is a reference."""
    light = [color.srgb_to_linear(F.col(c)) for c in "rgb"]
    r, g, b = (F.avg(c) for c in light)
    lum = color.lab(F.col("r"), F.col("g"), F.col("b"))[0]
    features = pixels(spark, sf_dir).groupBy("photo_id").agg((r / g).alias("rg"), (b / g).alias("bg"), F.median(lum).alias("median_l"))
    n = F.col("vec_id")
    odd = F.when(n % 13 == 0, F.lit("0,4 s")).when(n % 13 == 1, F.lit('1"')).when(n % 13 == 2, F.lit("x")).when(n % 13 == 3, F.lit(None).cast("string"))
    shutter = F.when(n % 13 < 4, odd).otherwise(F.concat(F.lit("1/"), (F.lit(50) * (n % 8 + 1)).cast("string")))
    about = table(spark, sf_dir, "embeddings").select(
        n.alias("photo_id"), F.col("label").cast("string").alias("profile"), (n % 10 == 0).alias("is_seed"),
        (F.lit(100) * F.pow(F.lit(2.0), n % 6)).cast("int").alias("iso"),
        F.element_at(F.array(*map(F.lit, (1.8, 2.8, 4.0, 5.6))), (n % 4 + 1).cast("int")).alias("aperture"), shutter.alias("shutter"),
        *[F.when((n + i) % 3 != 0, ((n * 37 + i * 11) % 201 - 100).cast("double")).alias(name) for i, (name, _) in enumerate(CALIBRATION)],
        (F.lit(3000.0) + (n * 53) % 5000).alias("temperature"), ((n * 29) % 61 - 30).cast("double").alias("tint"), (((n * 17) % 41 - 20) / F.lit(10.0)).alias("exposure"),
    )
    return features.join(about, "photo_id").withColumn("ev100", scalars.ev100(F.col("iso"), F.col("aperture"), scalars.shutter_seconds(F.col("shutter"))))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events: submitted, polled, or a result."""
    kind = F.when(F.col("event_type").isin("click", "view"), "submit").when(F.col("event_type") == "signup", "poll").otherwise("result")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("worker"), kind.alias("kind"), F.when(kind == "result", F.when(F.col("event_type") == "purchase", "ok").otherwise("error")).alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def pictures(spark: SparkSession, sf_dir: str, camera: bool = False) -> DataFrame:
    """The pictures of ``pixels``, or the cameras' own, a row for each with its levels as bytes."""
    shift, gain = (7, 1.6) if camera else (0, 2.0)

    def levels(p: Column) -> Column:
        e = lambda k: F.get("embedding", (p + F.lit(k + shift)) % 64).cast("double")
        level = lambda v: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.lit(gain) * v + 0.5) * 255.0).cast("int")))), 2, "0")
        return F.concat(level(e(0)), level(e(21) + F.lit(8.0) * e(0) * e(13)), level(e(42) - F.lit(8.0) * e(0) * e(29)))

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), levels), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data"))


#: XYZ (D65) to camera of the made-up cameras, by rows, and their black levels, white level and white balances.
CAMERA_XYZ = (0.7374, -0.2389, -0.0551, -0.5435, 1.3162, 0.2519, -0.1006, 0.1795, 0.6552)
BLACK, WHITE_LEVEL = (64.0, 60.0, 66.0, 62.0), 4144.0
PATTERNS, BALANCES = ((0, 1, 3, 2), (1, 2, 0, 3), (2, 3, 1, 0)), ((2.0, 1.0, 1.5, 0.0), (1.8, 0.9, 1.4, 0.9), (512.0, 256.0, 400.0, 256.0))


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic for each picture, of one of three layouts and white balances; every 17th can't be read."""
    kind = F.col("vec_id") % 3
    pick = lambda options, t: F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in options]), (kind + 1).cast("int")).cast(f"array<{t}>")
    e = lambda p, k: F.get("embedding", (p + F.lit(k)) % 64).cast("double")
    level = lambda p: F.least(F.lit(4200), F.greatest(F.lit(0), F.floor((e(p, 0) * 1.5 + e(p, 11) + 0.6) * 2500.0).cast("int")))
    plane = F.when(F.col("vec_id") % 17 != 0, F.transform(F.sequence(F.lit(0), F.lit(63)), level))
    constant = lambda v: F.array(*map(F.lit, v))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), F.concat(F.lit("raw/"), F.col("vec_id").cast("string")).alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), plane.alias("mosaic"), pick(PATTERNS, "int").alias("pattern"), F.lit("RGBG").alias("sites"), pick(BALANCES, "double").alias("wb"), constant(BLACK).alias("black"), F.lit(WHITE_LEVEL).alias("white"), constant(CAMERA_XYZ).alias("cam_xyz"))


def settings(photos_: DataFrame) -> DataFrame:
    """Photos with their current settings as a map of texts: every sixth is cropped, every fourth has a red saturation."""
    n = F.col("photo_id")
    entries = [("Exposure2012", F.col("exposure").cast("string")), ("Temperature", F.col("temperature").cast("string")), ("Tint", F.col("tint").cast("string")), ("CameraProfile", F.col("profile")), ("CropRight", F.when(n % 6 == 0, "0.7")), ("SaturationAdjustmentRed", F.when(n % 4 == 0, (n % 11 - 5).cast("string"))), *[(key, F.col(name).cast("string")) for name, key in CALIBRATION]]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries]), lambda e: e["v"].isNotNull())
    return photos_.withColumn("develop", F.map_from_entries(pairs))


def record_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Photos with their present signatures, and keyed tables that lack some of their rows, have some stale, and some without a scope."""
    from ..operators import planes, records

    n = F.col("uuid")
    # each picture is measured once
    known = written(settings(photos(spark, sf_dir)), "photos")
    shown = known.select("photo_id", F.concat(F.lit("raw/"), F.col("photo_id").cast("string")).alias("path"), F.lit("cam").alias("camera"), "develop", F.concat(F.lit("r"), F.col("photo_id").cast("string")).alias("hash_raw"), F.concat(F.lit("p"), F.col("photo_id").cast("string")).alias("hash_preview"), scalars.style_hash(F.col("develop"), list(records.STYLE_KEYS), records.MEASURES).alias("hash_style"))
    own = written(planes.measured(pictures(spark, sf_dir)).withColumnRenamed("photo_id", "uuid"), "renders")
    camera = written(planes.measured(pictures(spark, sf_dir, camera=True)).withColumnRenamed("photo_id", "uuid"), "camera-pictures")
    features = known.withColumnRenamed("photo_id", "uuid")
    text = n.cast("string")
    raw = camera.join(features.select("uuid", "rg", "bg", "profile", "ev100"), "uuid").where("uuid % 31 <> 0").select("uuid", F.when(n % 29 != 0, F.concat(F.lit("r"), text)).otherwise("old").alias("hash_raw"), F.col("rg").alias("asshot_rg"), F.col("bg").alias("asshot_bg"), "ev100", F.col("profile").alias("profile_capture"), F.col("sharp.tone").alias("tone"), F.col("sharp.bands").alias("bands"))
    jpeg = camera.where("uuid % 23 <> 0").select("uuid", F.concat(F.lit("r"), text).alias("hash_jpeg"), F.when(n % 37 != 0, F.col("sharp")).alias("sharp"), "whole", "mask_sharp_frac")
    preview = own.where("uuid % 43 <> 0").select("uuid", F.concat(F.lit("p"), text).alias("hash_preview"), "sharp", "whole", "mask_sharp_frac")
    neutral = own.join(features.select("uuid", "temperature", "tint").join(shown.select(F.col("photo_id").alias("uuid"), "hash_style"), "uuid"), "uuid").select("uuid", F.when(n % 19 != 0, F.col("hash_style")).otherwise("old").alias("hash_style"), "sharp", F.when(n % 41 != 0, F.col("whole")).alias("whole"), F.when(n % 7 != 0, F.col("temperature")).alias("asshot_temp"), F.col("tint").alias("asshot_tint"))
    rows = {"source_raw": raw, "in_camera": jpeg, "previews": preview, "neutral_previews": neutral}
    tables = {name: records.typed(r, name) for name, r in rows.items()}
    tables["pictures"] = records.mark(records.put_pictures(records.empty(spark, "pictures"), known.select("photo_id", F.lit("x").alias("path"), F.lit(None).cast("string").alias("catalog_path"), "develop", F.lit(None).cast("string").alias("profile_capture"), F.lit(1.0).alias("cached_at"))), known.where("is_seed"), True)
    return shown, tables


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the job queues; a result is for its worker's last submitted job."""
    kinds = events(spark, sf_dir)
    last = F.last(F.when(F.col("kind") == "submit", F.col("job_id")), ignorenulls=True).over(W.partitionBy("worker").orderBy("ts", "job_id").rowsBetween(W.unboundedPreceding, 0))
    return kinds.select("worker", "ts", F.col("job_id").alias("seq"), "kind", F.when(F.col("kind") == "poll", F.lit(None)).otherwise(last).alias("job_id"), "status")
