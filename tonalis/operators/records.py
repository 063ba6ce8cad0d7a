"""Keyed measurement tables: their types, what is written to them, and what is read back.

A measurement is kept with the signature of what was measured; a row whose
signature has changed is stale.  Statistics are nested structs, so nothing is
packed into text.  Writing gives the next version of a table, as plain Parquet
has no update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CALIBRATION
from ..functions import scalars
from . import planes, store

#: Version of the tables' structure, which is part of where they lie, and of the measurements, which is part of every signature.
STRUCTURE, MEASURES = 4, "v6-calib-style-keys"

# Settings that change a neutral render, which the style signature is made of.
STYLE_KEYS = (
    "CameraProfile", "ProcessVersion",
    "Contrast2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "Clarity2012", "Dehaze", "Vibrance", "Saturation", "Texture",
    "CropLeft", "CropRight", "CropTop", "CropBottom", "CropAngle",
    "EnableCalibration", "ShadowTint", "RedHue", "RedSaturation", "GreenHue", "GreenSaturation", "BlueHue", "BlueSaturation",
    "SplitToningShadowHue", "SplitToningShadowSaturation", "SplitToningHighlightHue", "SplitToningHighlightSaturation", "SplitToningBalance",
    "ColorGradeShadowLum", "ColorGradeHighlightLum", "ColorGradeMidtoneHue", "ColorGradeMidtoneSat", "ColorGradeMidtoneLum", "ColorGradeGlobalHue", "ColorGradeGlobalSat", "ColorGradeGlobalLum", "ColorGradeBlending",
    "ParametricShadows", "ParametricDarks", "ParametricLights", "ParametricHighlights", "ParametricShadowSplit", "ParametricMidtoneSplit", "ParametricHighlightSplit",
    "ToneCurveName2012", "ToneCurvePV2012", "ToneCurvePV2012Red", "ToneCurvePV2012Green", "ToneCurvePV2012Blue",
)

_T = {name: planes.ddl(kind) for name, kind in (("tone", planes.TONE), ("neutral", planes.NEUTRAL), ("band", planes.BAND), ("render", planes.RENDER), ("light", planes.LIGHT))}
_STRUCT = {name: "struct<" + ", ".join(f"{p.split()[0]}: {p.split(' ', 1)[1]}" for p in kind.split(", ")) + ">" for name, kind in _T.items() if name in ("tone", "neutral", "band", "light")}
_RENDER = f"struct<tone: {_STRUCT['tone']}, neutral: {_STRUCT['neutral']}, bands: array<{_STRUCT['band']}>>"
_DELTA = "struct<band: string, dchroma: double, dsat: double, dhue: double, dl: double>"

#: The tables: key and signature first.
TABLES = {
    "pictures": "uuid long, hash_develop string, path string, catalog_path string, develop map<string,string>, profile_capture string, profile_dcp string, hash_style string, is_seed boolean, cached_at double",
    "source_raw": f"uuid long, hash_raw string, asshot_rg double, asshot_bg double, light {_STRUCT['light']}, light_sharp {_STRUCT['light']}, mask_sharp_frac double, ev100 double, profile_capture string, tone {_STRUCT['tone']}, bands array<{_STRUCT['band']}>, cached_at double",
    "in_camera": f"uuid long, hash_jpeg string, sharp {_RENDER}, whole {_RENDER}, mask_sharp_frac double, profile_capture string, delta_luma_median double, delta_cast_a double, delta_cast_b double, delta_bands array<{_DELTA}>, cached_at double",
    "previews": f"uuid long, hash_preview string, sharp {_RENDER}, whole {_RENDER}, mask_sharp_frac double, cached_at double",
    "neutral_previews": f"uuid long, hash_style string, sharp {_RENDER}, whole {_RENDER}, mask_sharp_frac double, asshot_temp double, asshot_tint double, cached_at double",
}
#: What a row needs beside a fresh signature to count as measured.
NEEDED = {"pictures": None, "source_raw": "tone", "in_camera": None, "previews": None, "neutral_previews": None}


def signature_of(table: str) -> str:
    """The name of a table's signature column."""
    return TABLES[table].split(", ")[1].split()[0]


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], TABLES[table])


def location(folder: str, table: str) -> str:
    """Where a table of this structure lies; another structure lies elsewhere, so it starts empty."""
    return f"{folder.rstrip('/')}/v{STRUCTURE}/{table}"


def opened(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table, or an empty one where there is none of this structure."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location(folder, table))
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(TABLES[table]).parquet(location(folder, table)) if there else empty(spark, table)


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Rows with all columns of a table, null where they aren't given."""
    wanted = empty(rows.sparkSession, table).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def put(old: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """The measurement table with ``rows`` in place of those of the same ``uuid``: whole rows, the last written of several.

    Pictures aren't replaced but changed, see ``put_pictures`` and ``mark``.
    """
    new = store.latest(typed(rows, table).where("uuid IS NOT NULL").withColumn("at", F.coalesce("cached_at", F.lit(0.0))), ["uuid"], "at")
    return old.join(new.select("uuid"), "uuid", "left_anti").unionByName(new.select(old.columns))


def pictures(rows: DataFrame) -> DataFrame:
    """Photos (``photo_id``, ``path``, ``catalog_path``, ``develop``, ``profile_capture``, ``cached_at``) as rows of the picture table, their signatures derived."""
    develop = F.coalesce("develop", F.from_json(F.lit("{}"), "map<string,string>"))
    return typed(rows.select(F.col("photo_id").alias("uuid"), "path", "catalog_path", develop.alias("develop"), "profile_capture", F.element_at(develop, "CameraProfile").alias("profile_dcp"), scalars.develop_hash(develop).alias("hash_develop"), scalars.style_hash(develop, list(STYLE_KEYS), MEASURES).alias("hash_style"), F.lit(False).alias("is_seed"), "cached_at"), "pictures")


def put_pictures(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Photos put into the picture table: a mark as reference stays, a null profile doesn't erase a known one."""
    return store.upsert(old, pictures(rows), "uuid", keep=("is_seed",), fill=("profile_capture",))


def mark(old: DataFrame, photos: DataFrame, value: bool) -> DataFrame:
    """The picture table with ``photos`` (``photo_id``) marked as references or not; unknown ones are put in, known ones keep all else."""
    hit = photos.select(F.col("photo_id").alias("uuid")).distinct()
    changed = old.join(hit.withColumn("hit", F.lit(True)), "uuid", "left").withColumn("is_seed", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("is_seed"))).select(old.columns)
    return changed.unionByName(typed(hit.join(old.select("uuid"), "uuid", "left_anti").withColumn("is_seed", F.lit(value)), "pictures"))


def fresh(table: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``uuid``, ``signature``) with the row of each whose signature is the same and that is measured, as ``found``; null for a miss."""
    known = rows.where(F.col(NEEDED[table]).isNotNull()) if NEEDED[table] else rows
    packed = known.select("uuid", F.col(signature_of(table)).alias("signature"), F.struct(*[c for c in rows.columns if c != "uuid"]).alias("found"))
    return wanted.join(packed, ["uuid", "signature"], "left")


def misses(table: str, rows: DataFrame, wanted: DataFrame, force: bool = False) -> DataFrame:
    """The rows of ``wanted`` that have to be measured: all of them if ``force``."""
    return wanted if force else fresh(table, rows, wanted).where("found IS NULL").select(wanted.columns)


def seed_vectors(pictures_: DataFrame, source_raw: DataFrame, previews: DataFrame) -> DataFrame:
    """Reference photos with the features, settings and bands that matching needs.

    A mark without RAW measures, or without an as-shot ratio, gives none.  The
    profile is that of the RAW, else the picture's; the settings are those kept with
    the picture, read tolerantly.
    """
    number = lambda key: F.element_at("develop", key).try_cast("double")
    raw = source_raw.where("asshot_rg IS NOT NULL").select("uuid", F.col("asshot_rg").alias("rg"), F.col("asshot_bg").alias("bg"), F.col("tone.median_l").alias("median_l"), "ev100", F.nullif("profile_capture", F.lit("")).alias("raw_profile"))
    seen = previews.select("uuid", F.col("sharp.tone").alias("preview_tone"), F.col("sharp.bands").alias("preview_bands"))
    marked = pictures_.where("is_seed").select("uuid", F.nullif("profile_capture", F.lit("")).alias("own_profile"), "develop")
    joined = marked.join(raw, "uuid").join(seen, "uuid", "left")
    return joined.select(F.col("uuid").alias("photo_id"), "rg", "bg", "median_l", "ev100", F.coalesce("raw_profile", "own_profile").alias("profile"), number("Temperature").alias("temperature"), number("Tint").alias("tint"), *[number(key).alias(name) for name, key in CALIBRATION], "preview_tone", "preview_bands")


def deltas(jpeg: Column, raw_tone: Column, raw_bands: Column) -> list[Column]:
    """What the camera's picture adds to the RAW: lightness, cast, and each band that both have; hue by plain subtraction; nulls where a part is missing."""
    by_name = F.map_from_entries(F.transform(raw_bands, lambda b: F.struct(b["band"], b)))
    own = F.filter(jpeg["bands"], lambda b: F.map_contains_key(by_name, b["band"]))
    minus = lambda b, r: F.struct(b["band"].alias("band"), (b["median_chroma"] - r["median_chroma"]).alias("dchroma"), (b["median_sat"] - r["median_sat"]).alias("dsat"), (b["median_hue"] - r["median_hue"]).alias("dhue"), (b["median_l"] - r["median_l"]).alias("dl"))
    each = F.transform(own, lambda b: minus(b, F.element_at(by_name, b["band"])))
    return [(jpeg["tone"]["median_l"] - raw_tone["median_l"]).alias("delta_luma_median"), jpeg["neutral"]["a_bias"].alias("delta_cast_a"), jpeg["neutral"]["b_bias"].alias("delta_cast_b"), F.when(F.size(each) > 0, each).alias("delta_bands")]


def measures(photos: DataFrame, tables: dict[str, DataFrame], embedded: bool) -> DataFrame:
    """One row for each photo that can be planned for, from the keyed tables.

    ``photos`` have ``photo_id``, ``path``, ``camera``, ``develop`` and the present
    signatures ``hash_raw`` (RAW and the camera's picture), ``hash_preview`` and
    ``hash_style``.  Embedded: a neutral render and at least one scope of the
    camera's picture are needed; else the current render is.  The RAW may be
    missing.
    """
    wanted = lambda c: photos.select(F.col("photo_id").alias("uuid"), F.col(c).alias("signature"))
    of = lambda t, c, name: fresh(t, tables[t], wanted(c)).select(F.col("uuid").alias("photo_id"), F.col("found").alias(name))
    marks = tables["pictures"].select(F.col("uuid").alias("photo_id"), "is_seed")
    base = photos.join(of("source_raw", "hash_raw", "r"), "photo_id", "left").join(marks, "photo_id", "left")
    raw = [F.col("r.tone").alias("raw_tone"), F.col("r.bands").alias("raw_bands"), F.col("r.asshot_rg").alias("rg"), F.col("r.asshot_bg").alias("bg"), F.col("r.tone.median_l").alias("median_l"), F.col("r.profile_capture").alias("profile"), F.col("r.ev100").alias("ev100"), F.coalesce("is_seed", F.lit(False)).alias("is_seed")]
    if embedded:
        both = base.join(of("neutral_previews", "hash_style", "n"), "photo_id").join(of("in_camera", "hash_raw", "e"), "photo_id")
        ready = both.where("n IS NOT NULL AND (e.sharp IS NOT NULL OR e.whole IS NOT NULL)")
        own = [F.col("e.sharp").alias("t_sharp"), F.col("e.whole").alias("t_global"), F.col("n.sharp").alias("n_sharp"), F.col("n.whole").alias("n_global"), F.col("n.asshot_temp").alias("asshot_temp"), F.col("n.asshot_tint").alias("asshot_tint")]
    else:
        ready = base.join(of("previews", "hash_preview", "p"), "photo_id").where("p.sharp IS NOT NULL")
        own = [F.col("p.sharp").alias("render")]
    return ready.select("photo_id", "path", "camera", "develop", *raw, *own)


def suspect_anchors(probed: DataFrame, previews: DataFrame, least_ev: float = 0.3, most_l: float = 2.0) -> DataFrame:
    """Neutral renders (``photo_id``, ``develop``, ``sharp``) that look like the last known preview although the exposure is far from 0, so that a stale picture was rendered: ``photo_id`` and ``suspect``."""
    ev = F.abs(F.coalesce(F.element_at("develop", "Exposure2012").try_cast("double"), F.lit(0.0)))
    last = previews.select(F.col("uuid").alias("photo_id"), F.col("sharp.tone.median_l").alias("last_l"))
    near = F.abs(F.col("sharp.tone.median_l") - F.col("last_l")) < most_l
    return probed.join(last, "photo_id", "left").select("photo_id", ((ev >= least_ev) & F.coalesce(near, F.lit(False))).alias("suspect"))


def anchors(photos: DataFrame, neutral_previews: DataFrame, probed: DataFrame, retried: DataFrame, previews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The neutral renders to go on with, and the next version of their table.

    ``photos`` (``photo_id``, ``hash_style``, ``develop``) with a fresh render keep
    it.  For the others ``probed`` renders serve unless they are suspect; then
    ``retried`` ones do, and it is an error if those are suspect as well.  Nothing
    suspect is kept.
    """
    wanted = photos.select(F.col("photo_id").alias("uuid"), F.col("hash_style").alias("signature"))
    todo = misses("neutral_previews", neutral_previews, wanted).select(F.col("uuid").alias("photo_id")).join(photos, "photo_id")
    known = todo.select("photo_id", "develop", "hash_style")
    first = probed.drop("develop", "hash_style").join(known, "photo_id")
    bad = suspect_anchors(first, previews).where("suspect").select("photo_id")
    second = retried.drop("develop", "hash_style").join(known, "photo_id").join(bad, "photo_id", "left_semi")
    cleared = suspect_anchors(second, previews).where("NOT suspect").select("photo_id")
    still = bad.join(cleared, "photo_id", "left_anti").limit(5).collect()
    if still:
        raise RuntimeError(f"neutral renders still stale after another try: {', '.join(str(r['photo_id']) for r in still)}")
    good = first.join(bad, "photo_id", "left_anti").unionByName(second, allowMissingColumns=True)
    table = put(neutral_previews, good.withColumnRenamed("photo_id", "uuid"), "neutral_previews")
    return fresh("neutral_previews", table, wanted).where("found IS NOT NULL").select(F.col("uuid").alias("photo_id"), "found"), table
