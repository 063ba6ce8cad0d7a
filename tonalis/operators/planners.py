"""Planning settings: exposure, white balance, colour bands, calibration.

Every planner returns the long form ``photo_id``, ``key``, ``value``;
``as_maps`` folds it to a sparse map for each photo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CALIBRATION, Plan
from ..functions.color import hue_difference
from ..functions.scalars import clamp, whole


def headroom(clip: Column, limit: float) -> Column:
    """1 up to the limit, falling to 0 at twice the limit."""
    return F.when(clip <= limit, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (clip - limit) / F.lit(limit)))


def slope_at(samples: Column, level: Column, prior: float = 17.0) -> Column:
    """Slope of a response curve (``array<struct<ev,l>>``) at a lightness, at least 1.

    The first segment that holds the level, else the nearest; segments without
    width are skipped; fewer than two samples give the prior.
    """
    s = F.array_sort(samples)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(
        F.greatest(F.lit(0.0), F.least(a["l"], b["l"]) - level, level - F.greatest(a["l"], b["l"])).alias("away"), (b["ev"] - a["ev"]).alias("w"), ((b["l"] - a["l"]) / F.nullif(b["ev"] - a["ev"], F.lit(0.0))).alias("slope")))
    real = F.filter(pairs, lambda p: p["w"] > 1e-9)
    near = F.array_min(F.transform(real, lambda p: p["away"]))
    best = F.get(F.filter(real, lambda p: p["away"] == near), F.lit(0))["slope"]
    return F.when(best.isNotNull(), F.greatest(best, F.lit(1.0))).otherwise(F.lit(prior))


def exposure(samples: DataFrame, how: Plan = Plan()) -> DataFrame:
    """New exposure from ``current_l``, ``desired_l``, ``current_ev``, clipped shares and a response ``curve`` (or null)."""
    middle = (F.col("current_l") + F.col("desired_l")) / F.lit(2.0)
    step = clamp((F.col("desired_l") - F.col("current_l")) / slope_at(F.col("curve"), middle, how.slope_prior), -how.step_ev, how.step_ev)
    room = F.when(step > 0, headroom(F.col("clipped_hi"), how.clip_limit)).when(step < 0, headroom(F.col("clipped_lo"), how.clip_limit)).otherwise(F.lit(1.0))
    return samples.where("desired_l IS NOT NULL").select("photo_id", F.lit("Exposure2012").alias("key"), F.bround(F.col("current_ev") + step * room, 2).alias("value"))


def solve_cast(a: Column, b: Column) -> list[Column]:
    """Change of temperature and tint that undoes a cast, by the 2 x 2 response ``at``, ``an``, ``bt``, ``bn`` (a and b for each 100 K and each tint); zeros where it is singular."""
    det = F.col("at") * F.col("bn") - F.col("an") * F.col("bt")
    ok = F.abs(det) >= 1e-12
    safe = F.when(ok, det).otherwise(F.lit(1.0))
    return [F.when(ok, x / safe).otherwise(F.lit(0.0)) for x in ((F.col("an") * b - F.col("bn") * a) * 100.0, F.col("bt") * a - F.col("at") * b)]


def calibrated() -> Column:
    """Whether any entry of the response is not zero."""
    return F.coalesce(F.greatest(*[F.abs(F.col(c)) for c in ("at", "an", "bt", "bn")]) > 1e-9, F.lit(False))


def white_balance_embedded(rows: DataFrame, how: Plan = Plan()) -> DataFrame:
    """From casts of the neutral render (``n_a``, ``n_b``, ``n_frac``) and the camera's picture (``t_...``), as-shot ``temp``, ``tint`` and the response."""
    ea, eb = F.col("n_a") - F.col("t_a"), F.col("n_b") - F.col("t_b")
    deviant = (F.col("n_frac") >= how.neutral_share) & (F.col("t_frac") >= how.neutral_share) & (F.sqrt(ea * ea + eb * eb) >= how.cast_dead)
    dt, dn = solve_cast(ea, eb)
    temp = clamp(F.col("temp") + clamp(dt, -how.step_temp, how.step_temp), 2000.0, 12000.0)
    tint = clamp(F.coalesce("tint", F.lit(0.0)) + clamp(dn, -how.step_tint, how.step_tint), -150.0, 150.0)
    return _white(rows.where(deviant & calibrated() & F.col("temp").isNotNull()), temp, tint)


def white_balance_seeds(rows: DataFrame, how: Plan = Plan()) -> DataFrame:
    """From the target's ``temperature`` and ``tint``, refined by the present cast (``a_bias``, ``b_bias``, ``neutral_frac``, ``n_neutral``) where that can be trusted."""
    dt, dn = solve_cast(F.col("a_bias"), F.col("b_bias"))
    refine = (F.col("n_neutral") > 0) & (F.col("neutral_frac") >= how.refine_share) & calibrated()
    tint = F.coalesce("tint", F.lit(0.0))
    temp = F.when(refine, clamp(F.col("temperature") + clamp(dt, -how.step_temp, how.step_temp), 2000.0, 12000.0)).otherwise(F.col("temperature"))
    fine = F.when(refine, tint + clamp(dn, -how.step_tint, how.step_tint)).otherwise(tint)
    return _white(rows.where("temperature IS NOT NULL"), temp, clamp(fine, -150.0, 150.0))


def _white(rows: DataFrame, temp: Column, tint: Column) -> DataFrame:
    pairs = F.array(F.struct(F.lit("Temperature").alias("key"), whole(temp).cast("double").alias("value")), F.struct(F.lit("Tint").alias("key"), whole(tint).cast("double").alias("value")))
    return rows.select("photo_id", F.explode(pairs).alias("s")).select("photo_id", "s.*")


def bands(rows: DataFrame) -> DataFrame:
    """Saturation, luminance and hue steps for each photo and band.

    Needs the band's ``frac``, ``median_chroma``, ``median_l``, ``median_hue`` and
    ``sat_clip_frac``; targets ``t_chroma``, ``t_l``, ``t_hue`` (null: none),
    ``raw_oversat`` (false blocks a cut, null doesn't), ``embedded`` (tighter
    limits), and response slopes ``g_sat``, ``g_lum``, ``g_hue``.
    """
    gain = lambda c, prior: F.when(F.abs(F.col(c)) > 1e-9, F.col(c)).otherwise(F.lit(prior))
    excess = F.col("median_chroma") - F.col("t_chroma")
    excess = F.when(F.col("sat_clip_frac") >= 0.05, F.greatest(excess, F.lit(5.0))).otherwise(excess)
    blocked = F.col("raw_oversat").eqNullSafe(F.lit(False))
    sat = F.when(F.col("t_chroma").isNotNull() & ~blocked & (excess >= 4), whole(clamp(-excess / gain("g_sat", 0.6), -25.0, 0.0)))
    dl = F.col("t_l") - F.col("median_l")
    cap = F.when(F.col("embedded"), F.lit(10.0)).otherwise(F.lit(20.0))
    lum = F.when(F.abs(dl) >= 3, whole(F.greatest(-cap, F.least(cap, dl / gain("g_lum", 0.4)))))
    dh = hue_difference(F.col("t_hue"), F.col("median_hue"))
    turn = F.when(F.col("embedded"), F.lit(8.0)).otherwise(F.lit(15.0))
    hue = F.when(F.abs(dh) >= 6, whole(F.greatest(-turn, F.least(turn, dh / gain("g_hue", 0.35)))))
    steps = F.array(*[F.struct(F.concat(F.lit(name), F.col("band")).alias("key"), v.cast("double").alias("value")) for name, v in (("SaturationAdjustment", sat), ("LuminanceAdjustment", lum), ("HueAdjustment", hue))])
    return rows.where("frac >= 0.01").select("photo_id", F.explode(steps).alias("s")).select("photo_id", "s.*").where("value <> 0")


def calibration(targets: DataFrame) -> DataFrame:
    """Calibration fields of the target, rounded and bounded; absent ones are left out, and a switch is set if there is any."""
    pairs = F.array(*[F.struct(F.lit(key).alias("key"), clamp(whole(F.col(name)).cast("double"), -100.0, 100.0).alias("value")) for name, key in CALIBRATION])
    found = targets.select("photo_id", F.filter(pairs, lambda p: p["value"].isNotNull()).alias("p"))
    switch = F.array(F.struct(F.lit("EnableCalibration").alias("key"), F.lit(1.0).alias("value")))
    return found.where(F.size("p") > 0).select("photo_id", F.explode(F.concat("p", switch)).alias("s")).select("photo_id", "s.*")


def as_maps(long: DataFrame) -> DataFrame:
    """One sparse ``develop`` map for each photo."""
    return long.groupBy("photo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("develop"))
