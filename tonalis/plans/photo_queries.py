"""Queries that measure, match and plan, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import BANDS, CALIBRATION
from ..functions import color, scalars
from ..operators import match, measure, planes, planners
from . import fixtures as fx, oracle as o

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Columns rounded to six digits, negative zeros made positive."""
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


TONE = ("median_l", "mean_l", "p05_l", "p95_l", "clipped_hi", "clipped_lo", "tonal_frac")
NEUTRAL = ("a_bias", "b_bias", "chroma", "neutral_frac")
BAND = ("frac", "median_hue", "median_chroma", "median_sat", "sat_clip_frac", "median_l")


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return measure.analysed(fx.pixels(spark, d))


def _scopes(spark: SparkSession, d: str, camera: bool = False) -> DataFrame:
    """Statistics of whole pictures, measured in one pass without a shuffle."""
    return planes.scopes(planes.measured(fx.pictures(spark, d, camera)))


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.tone("sh", "t")) + f"SELECT photo_id, scope, {o.rounded(*TONE)} FROM t")
def tone_dual(spark: SparkSession, d: str) -> DataFrame:
    """Tone statistics, whole frame and sharp zone."""
    return r6(_scopes(spark, d).select("photo_id", "scope", "r.tone.*"), *TONE)


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.neutral("sh", "t")) + f"SELECT photo_id, scope, {o.rounded(*NEUTRAL)}, n_neutral FROM t")
def neutral_dual(spark: SparkSession, d: str) -> DataFrame:
    """Neutral cast, whole frame and sharp zone."""
    return r6(_scopes(spark, d).select("photo_id", "scope", "r.neutral.*"), *NEUTRAL)


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "t")) + f"SELECT photo_id, band_no, band, scope, {o.rounded(*BAND)} FROM t")
def bands_dual(spark: SparkSession, d: str) -> DataFrame:
    """Hue bands, whole frame and sharp zone."""
    return r6(planes.banded(_scopes(spark, d)), *BAND)


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.tone("sh", "t")) + f"SELECT photo_id, scope, {o.rounded(*TONE)} FROM t")
def tone_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same tone statistics from pixels in rows."""
    return r6(measure.tone(_seen(spark, d)), *TONE)


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "t")) + f"SELECT photo_id, band_no, band, scope, {o.rounded(*BAND)} FROM t")
def bands_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same hue bands from pixels in rows."""
    return r6(measure.bands(_seen(spark, d)), *BAND)


@query(o.with_(o.PX, o.LAB) + f"SELECT photo_id, pos, {o.rounded('l', 'a', 'b_')} FROM lab")
def lab_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Lab of every pixel."""
    return r6(measure.with_lab(fx.pixels(spark, d)).select("photo_id", "pos", "l", "a", "b_"), "l", "a", "b_")


@query(o.with_(o.PX, o.LAB) + f"SELECT photo_id, pos, {o.rounded('hue', 'sat')} FROM lab")
def hsv_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Hue and saturation of every pixel."""
    return r6(measure.with_lab(fx.pixels(spark, d)).select("photo_id", "pos", "hue", "sat"), "hue", "sat")


@query(o.with_(o.PX) + f"SELECT photo_id, round(avg({o.linear('r')}), 6) AS lr, round(avg({o.linear('g')}), 6) AS lg, round(avg({o.linear('b')}), 6) AS lb FROM px GROUP BY 1")
def srgb_linear(spark: SparkSession, d: str) -> DataFrame:
    """Mean linear light of each photo."""
    return fx.pixels(spark, d).groupBy("photo_id").agg(*[F.round(F.avg(color.srgb_to_linear(F.col(c))), 6).alias(f"l{c}") for c in "rgb"])


_PP = lambda i: "+".join(f"({w!r}e0*{c}/255.0e0)" for w, c in zip(color.PROPHOTO_SRGB[i], "rgb", strict=True))
_SR = lambda v: f"(CASE WHEN {v} <= 0.0031308e0 THEN 12.92e0*{v} ELSE 1.055e0*pow({v}, 1/2.4e0)-0.055e0 END)"
_U8 = lambda v, f: f"CAST(least(255, greatest(0, {f}(255.0e0*{_SR(f'greatest(0.0e0, least(1.0e0, {v}))')}{', 0' if f == 'round_even' else ''}))) AS INTEGER)"


@query(o.with_(o.PX) + f"SELECT photo_id, pos, {', '.join(f'{_U8(_PP(i), f)} AS {c}{n}' for n, f in (('_round', 'round_even'), ('_cut', 'floor')) for i, c in enumerate('rgb'))} FROM px")
def prophoto_srgb(spark: SparkSession, d: str) -> DataFrame:
    """Linear ProPhoto as 8-bit sRGB, rounded and cut off."""
    p = fx.linear_pixels(spark, d)
    light = [F.col(f"l{c}") for c in "rgb"]
    both = {f"{c}{n}": v for n, how in (("_round", True), ("_cut", False)) for c, v in zip("rgb", color.prophoto_to_srgb(*light, rounded=how), strict=True)}
    return p.withColumns(both).select("photo_id", "pos", *both)


@query(o.with_(o.PX, o.LAB, o.SH) + "SELECT photo_id, pos, round(mag, 6) + 0.0 AS mag FROM sh")
def laplacian(spark: SparkSession, d: str) -> DataFrame:
    """Absolute Laplacian of every pixel."""
    return r6(measure.laplacian(measure.with_lab(fx.pixels(spark, d))).select("photo_id", "pos", "mag"), "mag")


@query(o.with_(o.PX, o.LAB, o.SH) + "SELECT photo_id, count(*) AS n, count(*) FILTER (sharp) AS n_sharp, round(avg(CASE WHEN sharp THEN 1.0e0 ELSE 0 END), 6) AS mask_sharp_frac FROM sh GROUP BY 1")
def sharp_mask(spark: SparkSession, d: str) -> DataFrame:
    """Size of the sharp zone."""
    return _seen(spark, d).groupBy("photo_id").agg(F.count("*").alias("n"), F.count_if("sharp").alias("n_sharp"), F.round(F.avg(F.col("sharp").cast("double")), 6).alias("mask_sharp_frac"))


_Y = "(0.2880402e0*(r/255.0e0)+0.7118741e0*(g/255.0e0)+0.0000857e0*(b/255.0e0))"


@query(o.with_(o.PX) + f"SELECT photo_id, round(avg({_Y}), 6) AS mean_luma, round(median({_Y}), 6) AS median_luma, round(avg(CASE WHEN greatest(r,g,b)/255.0e0 >= 0.99 THEN 1.0e0 ELSE 0 END), 6) AS clipped_highlights, round(avg(CASE WHEN {_Y} <= 0.0008 THEN 1.0e0 ELSE 0 END), 6) AS clipped_shadows FROM px GROUP BY 1")
def exposure_linear(spark: SparkSession, d: str) -> DataFrame:
    """Luminance of linear pixels."""
    return r6(measure.exposure(fx.linear_pixels(spark, d)), "mean_luma", "median_luma", "clipped_highlights", "clipped_shadows")


@query(o.with_(o.PX) + "SELECT photo_id, round(avg(g/255.0e0+1e-9)/avg(r/255.0e0+1e-9), 6) AS gr, round(avg(g/255.0e0+1e-9)/avg(b/255.0e0+1e-9), 6) AS gb FROM px GROUP BY 1")
def gray_world(spark: SparkSession, d: str) -> DataFrame:
    """Gray-world ratios."""
    return r6(measure.gray_world(fx.linear_pixels(spark, d)), "gr", "gb")


_PREVIEW = ("disp_median", "disp_mean", "lin_median", "lin_mean", "mid_frac", "gw_rg", "gw_bg")


@query(
    o.with_(o.PX, f"v AS (SELECT photo_id, {o.linear('r')} AS lr, {o.linear('g')} AS lg, {o.linear('b')} AS lb, 0.2126e0*(r/255.0e0)+0.7152e0*(g/255.0e0)+0.0722e0*(b/255.0e0) AS d FROM px), w AS (SELECT *, 0.2126e0*lr+0.7152e0*lg+0.0722e0*lb AS y FROM v)",
            "m AS (SELECT photo_id, median(d) AS disp_median, avg(d) AS disp_mean, median(y) AS lin_median, avg(y) AS lin_mean, quantile_cont(y, 0.8) AS p80, avg(CASE WHEN y > 0.05 AND y < 0.6 THEN 1.0e0 ELSE 0 END) AS mid_frac FROM w GROUP BY 1)",
            "g AS (SELECT photo_id, avg(lg)/(avg(lr)+1e-9) AS gw_rg, avg(lg)/(avg(lb)+1e-9) AS gw_bg FROM w JOIN m USING (photo_id) WHERE CASE WHEN mid_frac < 0.02 THEN y > p80 ELSE y > 0.05 AND y < 0.6 END GROUP BY 1)")
    + f"SELECT photo_id, {o.rounded(*_PREVIEW)} FROM m LEFT JOIN g USING (photo_id)"
)
def preview_midtone(spark: SparkSession, d: str) -> DataFrame:
    """Preview statistics."""
    return r6(measure.preview(fx.pixels(spark, d)), *_PREVIEW)


@query(o.with_(o.PX, o.LAB, o.PHOTO) + "SELECT photo_id, round(ev100, 6) AS ev100 FROM photo")
def ev100(spark: SparkSession, d: str) -> DataFrame:
    """Exposure value of each photo."""
    return r6(fx.photos(spark, d).select("photo_id", "ev100"), "ev100")


_SHUTTERS = ["1/250", "0,4 s", '1"', "x", None, "2", " 1 / 8 s", "1/0", "-1/4", "0", "-3", "", "1/x", "30s"]


@query("SELECT i, shutter, round(" + o._SECONDS + ", 9) AS seconds FROM (SELECT *, replace(regexp_replace(trim(shutter), '[\"s ]+$', ''), ',', '.') AS s FROM (VALUES " + ", ".join(f"({i}, {'NULL' if s is None else repr(s)})" for i, s in enumerate(_SHUTTERS)) + ") v(i, shutter))")
def shutter_parse(spark: SparkSession, d: str) -> DataFrame:
    """Shutter texts in seconds."""
    rows = spark.createDataFrame(list(enumerate(_SHUTTERS)), "i int, shutter string")
    return rows.withColumn("seconds", F.round(scalars.shutter_seconds(F.col("shutter")), 9))


_FEATURES = ("rg", "bg", "median_l", "ev100")


@query(o.with_(o.PX, o.LAB, o.PHOTO, "p AS (SELECT *, profile AS pool FROM photo WHERE is_seed UNION ALL SELECT *, '*' FROM photo WHERE is_seed)") + f"SELECT pool, {o._SIGMA.replace(' AS s_', ' AS s_')}, count(*) AS pool_size FROM p GROUP BY 1".replace("SELECT pool, ", "SELECT pool, round(s_rg, 6) AS s_rg, round(s_bg, 6) AS s_bg, round(s_median_l, 6) AS s_median_l, pool_size FROM (SELECT pool, ") + ")")
def feature_scale(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each feature in each reference pool."""
    return r6(match.scales(match.pools(_seeds(spark, d))), "s_rg", "s_bg", "s_median_l")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return fx.photos(spark, d).where("is_seed")


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    photos = fx.photos(spark, d)
    wanted, seeds = photos.where("NOT is_seed"), photos.where("is_seed")
    return wanted, seeds, match.nearest(wanted, seeds)


@query(o.with_(o.PX, o.LAB, o.PHOTO, o.KNN) + "SELECT photo_id, seed_id, round(d, 6) AS d, rank FROM knn")
def knn_match(spark: SparkSession, d: str) -> DataFrame:
    """The references of each photo."""
    return r6(_matches(spark, d)[2], "d")


_TARGET = ("temperature", "tint", "target_l", *[n for n, _ in CALIBRATION])


@query(o.with_(o.PX, o.LAB, o.PHOTO, o.KNN, o.TARGET) + f"SELECT photo_id, {o.rounded(*_TARGET)}, n_matched, array_to_string(seed_ids, ',') AS seed_ids FROM target")
def knn_target(spark: SparkSession, d: str) -> DataFrame:
    """The weighted target of each photo."""
    _, seeds, near = _matches(spark, d)
    return r6(match.targets(near, seeds), *_TARGET).withColumn("seed_ids", F.array_join(F.col("seed_ids").cast("array<string>"), ","))


_BW = lambda c: f"sum(b.{c}*(1/(k.d+1e-6)))/sum(1/(k.d+1e-6)) AS {c}"
TARGET_BANDS = f"tb AS (SELECT k.photo_id, band, {', '.join(_BW(c) for c in ('frac', 'median_chroma', 'median_sat', 'sat_clip_frac', 'median_l'))}, degrees(atan2(sum(sin(radians(median_hue))), sum(cos(radians(median_hue))))) AS h0 FROM knn k JOIN bd b ON b.photo_id=k.seed_id AND scope='global' AND frac >= 0.01 GROUP BY 1, 2), tband AS (SELECT *, h0-360*floor(h0/360) AS median_hue FROM tb)"


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd"), o.PHOTO, o.KNN, TARGET_BANDS) + f"SELECT photo_id, band, {o.rounded(*BAND)} FROM tband")
def knn_target_bands(spark: SparkSession, d: str) -> DataFrame:
    """Weighted bands of each photo's references."""
    near = _matches(spark, d)[2]
    return r6(match.target_bands(near, planes.banded(_scopes(spark, d)).where("scope = 'global'")), *BAND)


# A response for each profile: calibrated, uncalibrated, singular.
_KIND = "CAST(profile AS INTEGER) % 3"
RESPONSE = f"""resp AS (SELECT DISTINCT profile, {_KIND} AS kind, CASE {_KIND} WHEN 0 THEN 4.0e0 WHEN 2 THEN 1.0e0 ELSE 0 END AS jat, CASE {_KIND} WHEN 0 THEN 0.5e0 WHEN 2 THEN 2.0e0 ELSE 0 END AS jan,
  CASE {_KIND} WHEN 0 THEN 0.3e0 WHEN 2 THEN 0.5e0 ELSE 0 END AS jbt, CASE {_KIND} WHEN 0 THEN 2.0e0 WHEN 2 THEN 1.0e0 ELSE 0 END AS jbn, CASE {_KIND} WHEN 0 THEN 0.5e0 ELSE 0 END AS g FROM photo),
seg AS (SELECT * FROM (VALUES (0, 1, 33e0, 50e0, 17e0), (0, 2, 50e0, 67e0, 17e0), (2, 1, 40e0, 50e0, 10e0), (2, 3, 55e0, 52e0, -3e0)) v(kind, ord, l0, l1, slope))"""
SLOPE = lambda level: f"coalesce((SELECT greatest(1, arg_min(slope, struct_pack(a := greatest(0, least(l0,l1)-({level}), ({level})-greatest(l0,l1)), o := ord))) FROM seg WHERE seg.kind = q.kind HAVING count(*) > 0), 17.0e0)"


def responses(photos: DataFrame) -> DataFrame:
    """The response of each photo's profile: curve, cast matrix, band slopes."""
    kind = F.col("profile").cast("int") % 3
    point = lambda ev, lum: F.struct(F.lit(ev).alias("ev"), F.lit(lum).alias("l"))
    curve = F.when(kind == 0, F.array(point(1.0, 67.0), point(-1.0, 33.0), point(0.0, 50.0))).when(kind == 2, F.array(point(0.0, 55.0), point(-1.0, 40.0), point(1.0, 52.0), point(0.0, 50.0)))
    pick = lambda a, b: F.when(kind == 0, F.lit(a)).when(kind == 2, F.lit(b)).otherwise(F.lit(0.0))
    return photos.withColumns({"curve": curve, "at": pick(4.0, 1.0), "an": pick(0.5, 2.0), "bt": pick(0.3, 0.5), "bn": pick(2.0, 1.0), "g_sat": pick(0.5, 0.0), "g_lum": pick(0.5, 0.0), "g_hue": pick(0.5, 0.0)})


@query(o.with_(o.PX, o.LAB, o.PHOTO, RESPONSE) + f"SELECT photo_id, round({SLOPE('q.median_l')}, 6) AS slope FROM (SELECT photo_id, median_l, kind FROM photo JOIN resp USING (profile)) q")
def response_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the profile's response at each photo's lightness."""
    rows = responses(fx.photos(spark, d))
    return r6(rows.select("photo_id", planners.slope_at(F.col("curve"), F.col("median_l")).alias("slope")), "slope")


def _tone(spark: SparkSession, d: str, camera: bool = False) -> DataFrame:
    return _scopes(spark, d, camera).where("scope = 'global'").select("photo_id", "r.tone.*")


_EV = "CASE WHEN s > 0 THEN s*CASE WHEN clipped_hi <= 0.02 THEN 1 ELSE greatest(0, 1-(clipped_hi-0.02e0)/0.02e0) END WHEN s < 0 THEN s*CASE WHEN clipped_lo <= 0.02 THEN 1 ELSE greatest(0, 1-(clipped_lo-0.02e0)/0.02e0) END ELSE s END"
_STEP = f"z AS (SELECT *, greatest(-2.0e0, least(2.0e0, (want-have)/{SLOPE('(q.want+q.have)/2')})) AS s FROM q)"


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.tone("sh", "t"), o.PHOTO, o.KNN, o.TARGET, RESPONSE, "q AS (SELECT p.photo_id, kind, t.median_l AS have, target_l AS want, clipped_hi, clipped_lo, exposure FROM photo p JOIN t ON t.photo_id=p.photo_id AND scope='global' JOIN target g ON g.photo_id=p.photo_id JOIN resp r ON r.profile=p.profile)", _STEP) + f"SELECT photo_id, 'Exposure2012' AS key, round_even(round((exposure + {_EV})*100, 6), 0)/100 + 0.0 AS value FROM z")
def plan_exposure_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Exposure towards the references' lightness."""
    wanted, seeds, near = _matches(spark, d)
    rows = responses(wanted.select("photo_id", "profile", "exposure")).join(match.targets(near, seeds), "photo_id").join(_tone(spark, d), "photo_id")
    return planners.exposure(rows.select("photo_id", "curve", F.col("median_l").alias("current_l"), F.col("target_l").alias("desired_l"), F.col("exposure").alias("current_ev"), "clipped_hi", "clipped_lo")).withColumn("value", F.col("value") + F.lit(0.0))


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.tone("sh", "t"), o.PT, o.PTLAB, o.PTSH, o.tone("ptsh", "tt"), o.PHOTO, RESPONSE, "q AS (SELECT p.photo_id, kind, t.median_l AS have, tt.median_l AS want, t.clipped_hi, t.clipped_lo FROM photo p JOIN t ON t.photo_id=p.photo_id AND t.scope='global' JOIN tt ON tt.photo_id=p.photo_id AND tt.scope='global' JOIN resp r ON r.profile=p.profile WHERE NOT is_seed)", _STEP) + f"SELECT photo_id, 'Exposure2012' AS key, value FROM (SELECT photo_id, round_even(round(({_EV})*100, 6), 0)/100 + 0.0 AS value FROM z) WHERE abs(value) >= 0.1")
def plan_exposure_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Exposure towards the camera's own picture; small steps are left out."""
    have = _tone(spark, d).select("photo_id", F.col("median_l").alias("current_l"), "clipped_hi", "clipped_lo")
    want = _tone(spark, d, camera=True).select("photo_id", F.col("median_l").alias("desired_l"))
    photos = responses(fx.photos(spark, d).where("NOT is_seed").select("photo_id", "profile"))
    plan = planners.exposure(photos.join(have, "photo_id").join(want, "photo_id").withColumn("current_ev", F.lit(0.0)))
    return plan.withColumn("value", F.col("value") + F.lit(0.0)).where("abs(value) >= 0.10")


_CAST = lambda a, b: f"CASE WHEN abs(jat*jbn-jan*jbt) < 1e-12 THEN 0 ELSE (jan*({b})-jbn*({a}))*100.0e0/(jat*jbn-jan*jbt) END AS dt, CASE WHEN abs(jat*jbn-jan*jbt) < 1e-12 THEN 0 ELSE (jbt*({a})-jat*({b}))/(jat*jbn-jan*jbt) END AS dn"
_LONG_WB = "SELECT photo_id, unnest(['Temperature', 'Tint']) AS key, unnest([round_even(temp, 0), round_even(tint, 0)]) + 0.0 AS value FROM w"


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.neutral("sh", "n"), o.PT, o.PTLAB, o.PTSH, o.neutral("ptsh", "nt"), o.PHOTO, RESPONSE,
    f"e AS (SELECT p.photo_id, p.temperature, p.tint, n.a_bias-nt.a_bias AS ea, n.b_bias-nt.b_bias AS eb, jat, jan, jbt, jbn FROM photo p JOIN n ON n.photo_id=p.photo_id AND n.scope='global' JOIN nt ON nt.photo_id=p.photo_id AND nt.scope='global' JOIN resp r ON r.profile=p.profile WHERE NOT is_seed AND n.neutral_frac >= 0.02 AND nt.neutral_frac >= 0.02 AND kind <> 1), f AS (SELECT *, {_CAST('ea', 'eb')} FROM e WHERE sqrt(ea*ea+eb*eb) >= 3)",
    "w AS (SELECT photo_id, least(12000, greatest(2000, temperature+greatest(-600, least(600, dt)))) AS temp, least(150, greatest(-150, tint+greatest(-10, least(10, dn)))) AS tint FROM f)") + _LONG_WB)
def plan_wb_embedded(spark: SparkSession, d: str) -> DataFrame:
    """White balance against the camera's own picture."""
    cast = lambda camera, p: _scopes(spark, d, camera).where("scope = 'global'").select("photo_id", F.col("r.neutral.a_bias").alias(f"{p}_a"), F.col("r.neutral.b_bias").alias(f"{p}_b"), F.col("r.neutral.neutral_frac").alias(f"{p}_frac"))
    photos = responses(fx.photos(spark, d).where("NOT is_seed").select("photo_id", "profile", F.col("temperature").alias("temp"), "tint"))
    return planners.white_balance_embedded(photos.join(cast(False, "n"), "photo_id").join(cast(True, "t"), "photo_id"))


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.neutral("sh", "n"), o.PHOTO, o.KNN, o.TARGET, RESPONSE,
    f"e AS (SELECT g.photo_id, g.temperature, coalesce(g.tint, 0) AS tint, kind <> 1 AND n_neutral > 0 AND neutral_frac >= 0.005 AS refine, {_CAST('a_bias', 'b_bias')} FROM target g JOIN photo p ON p.photo_id=g.photo_id JOIN resp r ON r.profile=p.profile JOIN n ON n.photo_id=g.photo_id AND scope='global')",
    "w AS (SELECT photo_id, CASE WHEN refine THEN least(12000, greatest(2000, temperature+greatest(-600, least(600, dt)))) ELSE temperature END AS temp, least(150, greatest(-150, CASE WHEN refine THEN tint+greatest(-10, least(10, dn)) ELSE tint END)) AS tint FROM e)") + _LONG_WB)
def plan_wb_seeds(spark: SparkSession, d: str) -> DataFrame:
    """White balance from the references, refined by the present cast."""
    wanted, seeds, near = _matches(spark, d)
    cast = _scopes(spark, d).where("scope = 'global'").select("photo_id", "r.neutral.*")
    return planners.white_balance_seeds(responses(wanted.select("photo_id", "profile")).join(match.targets(near, seeds).select("photo_id", "temperature", "tint"), "photo_id").join(cast, "photo_id"))


_HD = "((t_hue-median_hue+180)-360*floor((t_hue-median_hue+180)/360)-180)"
_HSL = f"""step AS (SELECT photo_id, band, CASE WHEN t_chroma IS NOT NULL AND raw_oversat IS DISTINCT FROM false AND ex >= 4 THEN round_even(greatest(-25.0e0, least(0.0e0, -ex/coalesce(nullif(g,0),0.6e0))), 0) END AS sat,
  CASE WHEN abs(t_l-median_l) >= 3 THEN round_even(greatest(-cap, least(cap, (t_l-median_l)/coalesce(nullif(g,0),0.4e0))), 0) END AS lum, CASE WHEN abs({_HD}) >= 6 THEN round_even(greatest(-turn, least(turn, {_HD}/coalesce(nullif(g,0),0.35e0))), 0) END AS hue
  FROM (SELECT *, CASE WHEN sat_clip_frac >= 0.05 THEN greatest(median_chroma-t_chroma, 5.0e0) ELSE median_chroma-t_chroma END AS ex FROM h WHERE frac >= 0.01))
SELECT * FROM (SELECT photo_id, unnest(['SaturationAdjustment' || band, 'LuminanceAdjustment' || band, 'HueAdjustment' || band]) AS key, unnest([sat, lum, hue]) + 0.0 AS value FROM step) WHERE value <> 0"""


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd"), o.PT, o.PTLAB, o.PTSH, o.bands("ptsh", "bt"), o.PHOTO, RESPONSE,
    "h AS (SELECT b.*, CASE WHEN t.frac >= 0.01 THEN t.median_chroma END AS t_chroma, CASE WHEN t.frac >= 0.01 THEN t.median_l END AS t_l, CASE WHEN t.frac >= 0.01 THEN t.median_hue END AS t_hue, CASE WHEN w.frac >= 0.01 THEN w.sat_clip_frac >= 0.05 END AS raw_oversat, 10.0e0 AS cap, 8.0e0 AS turn, g FROM bd b JOIN bt t ON t.photo_id=b.photo_id AND t.band=b.band AND t.scope='global' JOIN bt w ON w.photo_id=b.photo_id AND w.band=b.band AND w.scope='sharp' JOIN photo p ON p.photo_id=b.photo_id JOIN resp r ON r.profile=p.profile WHERE b.scope='global' AND NOT is_seed)", _HSL))
def plan_hsl_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Colour bands towards the camera's own picture."""
    camera = planes.banded(_scopes(spark, d, camera=True))
    reliable = F.col("frac") >= 0.01
    want = camera.where("scope = 'global'").select("photo_id", "band", *[F.when(reliable, F.col(c)).alias(t) for c, t in (("median_chroma", "t_chroma"), ("median_l", "t_l"), ("median_hue", "t_hue"))])
    raw = camera.where("scope = 'sharp'").select("photo_id", "band", F.when(reliable, F.col("sat_clip_frac") >= 0.05).alias("raw_oversat"))
    photos = responses(fx.photos(spark, d).where("NOT is_seed").select("photo_id", "profile"))
    rows = planes.banded(_scopes(spark, d)).where("scope = 'global'").join(want, ["photo_id", "band"]).join(raw, ["photo_id", "band"]).join(photos, "photo_id")
    return planners.bands(rows.withColumn("embedded", F.lit(True)))


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd"), o.PHOTO, o.KNN, TARGET_BANDS, RESPONSE,
    "h AS (SELECT b.*, t.median_chroma AS t_chroma, t.median_l AS t_l, t.median_hue AS t_hue, CASE WHEN w.frac >= 0.01 THEN w.sat_clip_frac >= 0.05 END AS raw_oversat, 20.0e0 AS cap, 15.0e0 AS turn, g FROM bd b JOIN tband t ON t.photo_id=b.photo_id AND t.band=b.band JOIN bd w ON w.photo_id=b.photo_id AND w.band=b.band AND w.scope='sharp' JOIN photo p ON p.photo_id=b.photo_id JOIN resp r ON r.profile=p.profile WHERE b.scope='global')", _HSL))
def plan_hsl_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Colour bands towards the references."""
    seen = planes.banded(_scopes(spark, d))
    here = seen.where("scope = 'global'")
    wanted, _, near = _matches(spark, d)
    want = match.target_bands(near, here).select("photo_id", "band", F.col("median_chroma").alias("t_chroma"), F.col("median_l").alias("t_l"), F.col("median_hue").alias("t_hue"))
    raw = seen.where("scope = 'sharp'").select("photo_id", "band", F.when(F.col("frac") >= 0.01, F.col("sat_clip_frac") >= 0.05).alias("raw_oversat"))
    rows = here.join(want, ["photo_id", "band"]).join(raw, ["photo_id", "band"]).join(responses(wanted.select("photo_id", "profile")), "photo_id")
    return planners.bands(rows.withColumn("embedded", F.lit(False)))


_CAL = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN least(100, greatest(-100, round_even({n}, 0))) END" for n, _ in CALIBRATION)
_ANY = "coalesce(" + ", ".join(n for n, _ in CALIBRATION) + ")"


@query(o.with_(o.PX, o.LAB, o.PHOTO, o.KNN, o.TARGET) + f"SELECT * FROM (SELECT photo_id, unnest([{', '.join(repr(k) for _, k in CALIBRATION)}, 'EnableCalibration']) AS key, unnest([{_CAL}, CASE WHEN {_ANY} IS NOT NULL THEN 1 END]) + 0.0 AS value FROM target) WHERE value IS NOT NULL")
def plan_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibration taken over from the references."""
    _, seeds, near = _matches(spark, d)
    return planners.calibration(match.targets(near, seeds)).withColumn("value", F.col("value") + F.lit(0.0))


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd")) + """SELECT band, count(*) AS n, round(median(median_chroma), 6) AS median_chroma, round(quantile_cont(median_chroma, 0.9), 6) AS p90_chroma, round(avg(sat_clip_frac), 6) AS mean_clip, round(median(median_l), 6) AS median_l,
  round(CASE WHEN r <= 1e-9 THEN 180 ELSE degrees(sqrt(greatest(0, -2*ln(r)))) END, 6) AS hue_std, quantile_cont(median_chroma, 0.9) > 70 OR avg(sat_clip_frac) > 0.03 AS candidate
  FROM (SELECT *, sqrt(pow(avg(cos(radians(median_hue))) OVER (PARTITION BY band), 2)+pow(avg(sin(radians(median_hue))) OVER (PARTITION BY band), 2)) AS r FROM bd WHERE scope='global' AND frac >= 0.01) GROUP BY band, r""")
def hsl_series_report(spark: SparkSession, d: str) -> DataFrame:
    """Each band over all photos, and whether its saturation should be looked at."""
    rows = planes.banded(_scopes(spark, d)).where("scope = 'global' AND frac >= 0.01")
    hue = F.radians("median_hue")
    spread = F.sqrt(F.pow(F.avg(F.cos(hue)), 2) + F.pow(F.avg(F.sin(hue)), 2))
    std = F.when(F.col("r") <= 1e-9, F.lit(180.0)).otherwise(F.degrees(F.sqrt(F.greatest(F.lit(0.0), F.log("r") * -2.0))))
    p90: Column = F.percentile("median_chroma", F.lit(0.9))
    found = rows.groupBy("band").agg(F.count("*").alias("n"), F.median("median_chroma").alias("mc"), p90.alias("p90_chroma"), F.avg("sat_clip_frac").alias("mean_clip"), F.median("median_l").alias("ml"), spread.alias("r"))
    out = found.select("band", "n", F.col("mc").alias("median_chroma"), "p90_chroma", "mean_clip", F.col("ml").alias("median_l"), std.alias("hue_std"), ((F.col("p90_chroma") > 70) | (F.col("mean_clip") > 0.03)).alias("candidate"))
    return r6(out, "median_chroma", "p90_chroma", "mean_clip", "median_l", "hue_std")


assert len(BANDS) == 8
