"""The planner as one operator: settings for each photo on the axes that are asked for, and what was done.

Measures are rows of ``records.measures``, joined with the response of their
camera and profile (``responses``).  Every axis is a projection of those rows in
the long form ``photo_id``, ``key``, ``value``, ``text``; nothing is measured
here and no photo's pixels are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Plan
from ..functions.scalars import clamp, whole
from . import compare, match, planners

AXES = frozenset({"expo", "wb", "hsl", "calib"})
LONG = "photo_id long, key string, value double, text string"
#: The columns of a response, and the priors where there is none.
RESPONSE = "curve array<struct<ev: double, l: double>>, at double, an double, bt double, bn double, gains map<string, struct<sat: double, lum: double, hue: double>>"


@dataclass(frozen=True)
class Planned:
    """``settings`` in the long form, and ``counts``: for each ``counter`` of the ``mode``, how many photos an axis changed, left, or could not judge."""

    settings: DataFrame
    counts: DataFrame

    def adjustments(self) -> DataFrame:
        """One sparse ``develop`` map of texts for each photo that has any setting."""
        shown = F.coalesce("text", F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")))
        return self.settings.groupBy("photo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", shown)))).alias("develop"))


def responses(measures: DataFrame, models: DataFrame) -> DataFrame:
    """Measures with the columns of ``RESPONSE`` of their ``camera`` and ``model_profile`` (``models`` has both); nulls, that is priors, where there is none."""
    keys = ["camera", "model_profile"]
    left = measures if "model_profile" in measures.columns else measures.withColumn("model_profile", F.element_at("develop", "CameraProfile"))
    m = models.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f.split()[0] for f in ("curve", "at", "an", "bt", "bn", "gains")])
    return left.join(m, F.col("camera").eqNullSafe(F.col("_camera")) & F.col("model_profile").eqNullSafe(F.col("_model_profile")), "left").drop("_camera", "_model_profile")


def series_response(measures: DataFrame, models: DataFrame) -> DataFrame:
    """Measures with one response for all: that of the first camera that is known and of the most frequent profile among the settings, of equal ones the first by photo."""
    profile = F.nullif(F.element_at("develop", "CameraProfile"), F.lit(""))
    first = measures.agg(F.min_by("camera", F.when(F.col("camera").isNotNull(), F.col("photo_id"))).alias("c")).first()["c"]
    mode = measures.where(profile.isNotNull()).groupBy(profile.alias("p")).agg(F.count("*").alias("n"), F.min("photo_id").alias("at")).orderBy(F.desc("n"), "at").first()
    return responses(measures.withColumns({"camera": F.lit(first).cast("string"), "model_profile": F.lit(mode["p"] if mode else None).cast("string")}), models)


def setting(name: str, default: float = 0.0) -> Column:
    """A number among the current settings; the default where it is missing or no number."""
    return F.coalesce(F.element_at("develop", name).try_cast("double"), F.lit(default))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("photo_id", "key", F.col("value").cast("double").alias("value"), (F.col("text") if "text" in rows.columns else F.lit(None)).cast("string").alias("text"))


def _with_mode(white: DataFrame) -> DataFrame:
    """White-balance settings with the mode that makes them count."""
    mode = white.select("photo_id").distinct().select("photo_id", F.lit("WhiteBalance").alias("key"), F.lit(None).cast("double").alias("value"), F.lit("Custom").alias("text"))
    return _long(white).unionByName(_long(mode))


def _by_band(bands: Column) -> Column:
    return F.map_from_entries(F.transform(bands, lambda b: F.struct(b["band"], b)))


def _band_rows(rows: DataFrame, present: str, target: Column, embedded: bool) -> DataFrame:
    """A row for each photo and band that ``planners.bands`` reads: present statistics, target, guard and response slopes.

    ``target`` maps a band's name to its statistics.
    """
    raw = F.get(F.filter("raw_bands", lambda b: b["band"] == F.col("b.band")), F.lit(0))
    each = rows.withColumn("_target", target).select("*", F.explode(present).alias("b"))
    want = F.element_at("_target", F.col("b.band"))
    gain = F.element_at("gains", F.col("b.band"))
    return each.select(
        "photo_id", "develop", "b.band", "b.frac", "b.median_hue", "b.median_chroma", "b.sat_clip_frac", "b.median_l",
        want["median_chroma"].alias("t_chroma"), want["median_l"].alias("t_l"), want["median_hue"].alias("t_hue"),
        compare.oversaturated(raw["frac"], raw["sat_clip_frac"]).alias("raw_oversat"), F.lit(embedded).alias("embedded"),
        F.coalesce(gain["sat"], F.lit(0.0)).alias("g_sat"), F.coalesce(gain["lum"], F.lit(0.0)).alias("g_lum"), F.coalesce(gain["hue"], F.lit(0.0)).alias("g_hue"),
    )


def pairs(measures: DataFrame, how: Plan = Plan()) -> DataFrame:
    """Measures with the target ``t`` and the neutral render ``n`` of one scope (``used``): the sharp zone where the crop is strong, else the frame; the other one where that pair isn't whole; null where none is.

    ``divergent`` tells that frame and sharp zone need different lightness.
    """
    area = compare.crop_area(setting("CropLeft", 0.0), setting("CropRight", 1.0), setting("CropTop", 0.0), setting("CropBottom", 1.0))
    there = {s: F.col(f"t_{s}").isNotNull() & F.col(f"n_{s}").isNotNull() for s in ("sharp", "global")}
    used = F.when((F.col("variant") == "sharp") & there["sharp"], "sharp").when((F.col("variant") == "global") & there["global"], "global").when(there["sharp"], "sharp").when(there["global"], "global")
    pick = lambda p: F.when(F.col("used") == "sharp", F.col(f"{p}_sharp")).when(F.col("used") == "global", F.col(f"{p}_global"))
    gap = lambda s: F.col(f"t_{s}.tone.median_l") - F.col(f"n_{s}.tone.median_l")
    rows = measures.withColumn("variant", compare.scope_of(area, how.sharp_crop_area)).withColumn("used", used)
    return rows.withColumns({"t": pick("t"), "n": pick("n"), "divergent": F.coalesce(F.abs(gap("global") - gap("sharp")) > how.divergence_l, F.lit(False))}).withColumn("resolved", F.col("t.tone").isNotNull() & F.col("n.tone").isNotNull())


def _counted(frame: DataFrame, **counters: Column) -> DataFrame:
    """A row for each counter: how many rows of ``frame`` it holds for."""
    one = frame.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counters.items()])
    return one.select(F.explode(F.create_map(*[x for k in counters for x in (F.lit(k), F.col(k))])).alias("counter", "n"))


def _photos(frame: DataFrame, counter: str) -> DataFrame:
    return frame.agg(F.count_distinct("photo_id").alias("n")).select(F.lit(counter).alias("counter"), "n")


def plan_embedded(measures: DataFrame, seeds: DataFrame | None, axes: frozenset[str] = AXES, how: Plan = Plan()) -> Planned:
    """Towards the cameras' own pictures, from neutral renders: values are absolute, photos that match are left alone.

    Calibration comes from references (``seeds``, of ``records.seed_vectors``), if
    there are any, for all photos.
    """
    targets = pairs(measures.where("NOT is_seed"), how)
    ready = targets.where("resolved")
    parts: list[DataFrame] = []
    counts = [_counted(targets, n_targets=F.lit(True), n_unresolved=~F.col("resolved"), n_divergent=F.col("divergent") & F.col("resolved"), n_sharp=F.col("resolved") & (F.col("used") == "sharp"))]
    if "expo" in axes:
        step = planners.exposure(ready.select("photo_id", "curve", F.col("n.tone.median_l").alias("current_l"), F.col("t.tone.median_l").alias("desired_l"), F.lit(0.0).alias("current_ev"), F.col("n.tone.clipped_hi").alias("clipped_hi"), F.col("n.tone.clipped_lo").alias("clipped_lo")), how)
        deviant = F.abs("value") >= how.exposure_dead
        parts.append(_long(step.where(deviant)))
        counts.append(_counted(step, expo_written=deviant, expo_conform=~deviant))
    if "wb" in axes:
        a, b = F.col("n.neutral.a_bias") - F.col("t.neutral.a_bias"), F.col("n.neutral.b_bias") - F.col("t.neutral.b_bias")
        seen = F.coalesce((F.col("t.neutral.neutral_frac") >= how.neutral_share) & (F.col("n.neutral.neutral_frac") >= how.neutral_share), F.lit(False))
        deviant = seen & F.coalesce(F.sqrt(a * a + b * b) >= how.cast_dead, F.lit(False))
        able = planners.calibrated() & F.col("asshot_temp").isNotNull()
        rows = ready.select("photo_id", F.col("n.neutral.a_bias").alias("n_a"), F.col("n.neutral.b_bias").alias("n_b"), F.col("n.neutral.neutral_frac").alias("n_frac"), F.col("t.neutral.a_bias").alias("t_a"), F.col("t.neutral.b_bias").alias("t_b"), F.col("t.neutral.neutral_frac").alias("t_frac"), F.col("asshot_temp").alias("temp"), F.col("asshot_tint").alias("tint"), "at", "an", "bt", "bn")
        parts.append(_with_mode(planners.white_balance_embedded(rows, how)))
        counts.append(_counted(ready, wb_written=deviant & able, wb_conform=~deviant, wb_uncalibrated=deviant & ~able))
    if "hsl" in axes:
        good = F.filter("t.bands", lambda x: x["frac"] >= 0.01)
        steps = planners.bands(_band_rows(ready.withColumn("n_bands", F.col("n.bands")), "n_bands", _by_band(good), True))
        parts.append(_long(steps.withColumn("value", clamp(F.col("value"), -100.0, 100.0))))
        counts.append(_photos(steps, "hsl_written"))
    if "calib" in axes and seeds is not None:
        found = planners.calibration(match.targets(match.nearest(targets, seeds), seeds))
        parts.append(_long(found))
        counts.append(_photos(found, "calib_written"))
    return _planned("embedded", parts, counts, measures)


def plan_seeds(measures: DataFrame, seeds: DataFrame, axes: frozenset[str] = AXES, how: Plan = Plan()) -> Planned:
    """Towards the references nearest to each photo, from its current render and settings."""
    targets = measures.where("NOT is_seed")
    usable = targets.where("render.tone IS NOT NULL")
    near = match.nearest(usable, seeds)
    wanted = match.targets(near, seeds)
    counts = [_counted(targets, n_targets=F.lit(True), n_unresolved=F.col("render.tone").isNull())]
    parts: list[DataFrame] = []
    if "expo" in axes:
        tones = match.target_tone(near, seeds.select("photo_id", F.col("preview_tone").alias("tone")))
        rows = usable.join(tones.select("photo_id", F.col("tone.median_l").alias("desired_l")), "photo_id").select("photo_id", "curve", F.col("render.tone.median_l").alias("current_l"), "desired_l", setting("Exposure2012").alias("current_ev"), F.col("render.tone.clipped_hi").alias("clipped_hi"), F.col("render.tone.clipped_lo").alias("clipped_lo"))
        step = planners.exposure(rows, how)
        parts.append(_long(step))
        counts.append(_photos(step, "expo_written"))
    if "wb" in axes:
        rows = usable.select("photo_id", "at", "an", "bt", "bn", *[F.col(f"render.neutral.{c}").alias(c) for c in ("a_bias", "b_bias", "neutral_frac", "n_neutral")]).join(wanted.select("photo_id", "temperature", "tint"), "photo_id")
        white = planners.white_balance_seeds(rows, how)
        parts.append(_with_mode(white))
        counts.append(_photos(white, "wb_written"))
    if "hsl" in axes:
        bands = seeds.select("photo_id", F.explode("preview_bands").alias("b")).select("photo_id", "b.*")
        target = match.target_bands(near, bands).groupBy("photo_id").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("median_chroma", "median_l", "median_hue")))).alias("wanted"))
        rows = _band_rows(usable.join(target, "photo_id").withColumn("p_bands", F.col("render.bands")), "p_bands", F.col("wanted"), False)
        steps = planners.bands(rows).join(usable.select("photo_id", "develop"), "photo_id")
        now = F.coalesce(F.element_at("develop", F.col("key")).try_cast("double"), F.lit(0.0))
        parts.append(_long(steps.withColumn("value", whole(clamp(now + F.col("value"), -100.0, 100.0)))))
        counts.append(_photos(steps, "hsl_written"))
    if "calib" in axes:
        found = planners.calibration(wanted)
        parts.append(_long(found))
        counts.append(_photos(found, "calib_written"))
    return _planned("seeds", parts, counts, measures)


def _planned(mode: str, parts: list[DataFrame], counts: list[DataFrame], measures: DataFrame) -> Planned:
    settings = measures.sparkSession.createDataFrame([], LONG)
    for p in parts:
        settings = settings.unionByName(p)
    whole_ = counts[0]
    for c in counts[1:]:
        whole_ = whole_.unionByName(c)
    return Planned(settings, whole_.select(F.lit(mode).alias("mode"), "counter", "n"))


def plan(measures: DataFrame, seeds: DataFrame | None = None, axes: frozenset[str] = AXES, forced_embedded: bool = False, how: Plan = Plan()) -> Planned:
    """The plan for photos that aren't references: towards the references if there are any and nothing else is forced, else towards the cameras' own pictures.

    Axes that aren't asked for are not computed; unknown ones are an error.
    """
    if unknown := set(axes) - AXES:
        raise ValueError(f"no such axis: {', '.join(sorted(unknown))}")
    none = seeds is None or seeds.isEmpty()
    if forced_embedded or none:
        return plan_embedded(measures, None if none else seeds, axes, how)
    return plan_seeds(measures, seeds, axes, how)


def same_photos(planned: DataFrame, selected: DataFrame) -> bool:
    """Whether a plan is for just the photos that are selected now; one that isn't must not be applied."""
    a, b = (x.select("photo_id").distinct() for x in (planned, selected))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def preview_lines(planned: Planned, photos: DataFrame) -> DataFrame:
    """``photo_id``, ``key`` and a ``line`` ``key: current → target (change)`` for each planned setting; texts and unset values without a change."""
    now = F.element_at("develop", F.col("key"))
    number = now.try_cast("double")
    shown = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(F.bround(c, 2).cast("string"))
    goal = F.coalesce(F.col("text"), shown(F.col("value")))
    change = F.when(number.isNotNull() & F.col("value").isNotNull(), F.concat(F.lit(" ("), F.when(F.col("value") >= number, "+").otherwise(""), shown(F.bround(F.col("value") - number, 2)), F.lit(")"))).otherwise("")
    line = F.concat(F.col("key"), F.lit(": "), F.coalesce(now, F.lit("?")), F.lit(" → "), goal, change)
    return planned.settings.join(photos.select("photo_id", "develop"), "photo_id", "left").select("photo_id", "key", line.alias("line"))


def first_and_rest(rows: DataFrame, key: str, n: int = 10) -> tuple[DataFrame, int]:
    """The first rows by ``key``, and how many more there are."""
    return rows.orderBy(key).limit(n), max(0, rows.count() - n)
