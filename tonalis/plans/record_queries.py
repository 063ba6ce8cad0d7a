"""Queries over keyed measurement tables and the planner that reads them, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CALIBRATION
from ..functions import color
from ..operators import match, planes, planner, records
from ..session import written
from . import fixtures as fx, oracle as o
from .photo_queries import _CAL, _CAST, _EV, _HSL, _KIND, RESPONSE, SLOPE, BAND, query, r6, responses

T = fx.table
_LIGHT = ("mean_luma", "median_luma", "clipped_highlights", "clipped_shadows", "gr", "gb")


def _inverse() -> list[list[float]]:
    """Camera to ProPhoto of the made-up cameras, by cofactors, for the SQL text."""
    to_camera = color.product(tuple(tuple(fx.CAMERA_XYZ[3 * i : 3 * i + 3]) for i in range(3)), color.product(color.BRADFORD, color.PROPHOTO_XYZ))
    m = [[x / sum(row) for x in row] for row in to_camera]
    minor = lambda i, j: (lambda r: r[0][0] * r[1][1] - r[0][1] * r[1][0])([[m[a][b] for b in range(3) if b != j] for a in range(3) if a != i])
    det = sum((-1) ** j * m[0][j] * minor(0, j) for j in range(3))
    return [[(-1) ** (i + j) * minor(j, i) / det for j in range(3)] for i in range(3)]


_ROWS = lambda rows: "[" + ", ".join("[" + ", ".join(f"{x}" if isinstance(x, int) else f"{x!r}e0" for x in r) + "]" for r in rows) + "]"
_M = _inverse()
_MOSAIC = f"""mos AS (SELECT vec_id AS photo_id, CAST(p AS INTEGER) AS pos, p%8 AS x, p//8 AS y, ({_ROWS(fx.PATTERNS)})[vec_id%3+1][(p//8%2)*2+p%2+1] AS site, ({_ROWS(fx.BALANCES)})[vec_id%3+1] AS wb,
  least(4200, greatest(0, floor((CAST(embedding[p%64+1] AS DOUBLE)*1.5e0+CAST(embedding[(p+11)%64+1] AS DOUBLE)+0.6e0)*2500.0e0))) AS level FROM embeddings, range(64) t(p) WHERE vec_id % 17 <> 0),
val AS (SELECT photo_id, pos, x, y, [0, 1, 2, 1][site+1] AS chan, greatest(level-black, 0)/greatest({fx.WHITE_LEVEL}e0-black, 1)*(CASE WHEN site = 3 AND wb[4] = 0 THEN wb[2] ELSE wb[site+1] END)/wb[2] AS v FROM (SELECT *, ({_ROWS([fx.BLACK])})[1][site+1] AS black FROM mos)),
near AS (SELECT a.photo_id, a.pos, b.chan, sum(b.v*(2-abs(a.x-b.x))*(2-abs(a.y-b.y)))/(sum((2-abs(a.x-b.x))*(2-abs(a.y-b.y)))+1e-8) AS v FROM val a JOIN val b ON a.photo_id=b.photo_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 GROUP BY 1, 2, 3),
cam AS (SELECT photo_id, pos, coalesce(max(CASE WHEN chan=0 THEN v END), 0) AS c0, coalesce(max(CASE WHEN chan=1 THEN v END), 0) AS c1, coalesce(max(CASE WHEN chan=2 THEN v END), 0) AS c2 FROM near GROUP BY 1, 2),
pp AS (SELECT photo_id, pos, {", ".join(f"least(1.0e0, greatest(0.0e0, ({_M[i][0]!r}e0)*c0+({_M[i][1]!r}e0)*c1+({_M[i][2]!r}e0)*c2)) AS l{c}" for i, c in enumerate("rgb"))} FROM cam)"""


@query(o.with_(_MOSAIC) + f"SELECT photo_id, pos, {o.rounded('lr', 'lg', 'lb')} FROM pp")
def demosaic(spark: SparkSession, d: str) -> DataFrame:
    """Linear pixels of mosaics of three layouts."""
    return r6(planes.raw_pixels(fx.mosaics(spark, d)), "lr", "lg", "lb")


_Y = "(0.2880402e0*lr+0.7118741e0*lg+0.0000857e0*lb)"


@query(o.with_(_MOSAIC, f"s AS (SELECT photo_id, avg({_Y}) AS mean_luma, median({_Y}) AS median_luma, avg(CASE WHEN greatest(lr,lg,lb) >= 0.99 THEN 1.0e0 ELSE 0 END) AS clipped_highlights, avg(CASE WHEN {_Y} <= 0.0008 THEN 1.0e0 ELSE 0 END) AS clipped_shadows, (avg(lg)+1e-9)/(avg(lr)+1e-9) AS gr, (avg(lg)+1e-9)/(avg(lb)+1e-9) AS gb FROM pp GROUP BY 1)")
       + f"SELECT vec_id AS photo_id, {o.rounded(*_LIGHT)}, CASE WHEN s.photo_id IS NOT NULL THEN round(({_ROWS(fx.BALANCES)})[vec_id%3+1][1]/({_ROWS(fx.BALANCES)})[vec_id%3+1][2], 6) END AS asshot_rg, CASE WHEN s.photo_id IS NOT NULL THEN round(({_ROWS(fx.BALANCES)})[vec_id%3+1][3]/({_ROWS(fx.BALANCES)})[vec_id%3+1][2], 6) END AS asshot_bg FROM embeddings LEFT JOIN s ON s.photo_id = vec_id")
def raw_light(spark: SparkSession, d: str) -> DataFrame:
    """Light of each RAW picture; nulls for those that can't be read."""
    found = planes.raw_measured(fx.mosaics(spark, d))
    return r6(found.select("photo_id", *[f"light.{c}" for c in _LIGHT], "asshot_rg", "asshot_bg"), *_LIGHT, "asshot_rg", "asshot_bg")


_U8 = lambda i: f"CAST(round_even(255.0e0*(CASE WHEN c{i} <= 0.0031308e0 THEN 12.92e0*c{i} ELSE 1.055e0*pow(c{i}, 1/2.4e0)-0.055e0 END), 0) AS INTEGER)"
_SRGB = lambda i: "least(1.0e0, greatest(0.0e0, " + "+".join(f"({w!r}e0*l{c})" for w, c in zip(color.PROPHOTO_SRGB[i], "rgb", strict=True)) + "))"
_RAWPX = (
    f"rpx AS (SELECT photo_id, pos, CAST(pos%8 AS INTEGER) AS x, CAST(pos//8 AS INTEGER) AS y, {_U8(0)} AS r, {_U8(1)} AS g, {_U8(2)} AS b FROM (SELECT *, {_SRGB(0)} AS c0, {_SRGB(1)} AS c1, {_SRGB(2)} AS c2 FROM pp))",
    o._lab("rpx", "rlab"), o._sharp("rlab", "rsh"), o.SCOPE, o.tone("rsh", "rt"), o.CENTRES, o.bands("rsh", "rb"),
)
_TONE = match.TONE


@query(o.with_(_MOSAIC, *_RAWPX) + f"SELECT photo_id, {o.rounded(*_TONE)} FROM rt WHERE scope = 'sharp'")
def raw_tone(spark: SparkSession, d: str) -> DataFrame:
    """Tone of each RAW picture's sharp zone."""
    return r6(planes.raw_measured(fx.mosaics(spark, d)).where("tone IS NOT NULL").select("photo_id", "tone.*"), *_TONE)


@query(o.with_(_MOSAIC, *_RAWPX) + f"SELECT photo_id, band, {o.rounded(*BAND)} FROM rb WHERE scope = 'sharp'")
def raw_bands(spark: SparkSession, d: str) -> DataFrame:
    """Hue bands of each RAW picture's sharp zone."""
    found = planes.raw_measured(fx.mosaics(spark, d)).select("photo_id", F.explode("bands").alias("b"))
    return r6(found.select("photo_id", "b.*"), *BAND)


@query(o.with_(o.PT, o.PTLAB, o.PTSH, o.SCOPE, o.tone("ptsh", "t")) + "SELECT path, vec_id AS photo_id, need_raw AND vec_id % 17 <> 0 AS has_raw, CASE WHEN need_embedded THEN round(median_l, 6) END AS embedded_l FROM (SELECT 'raw/' || vec_id AS path, CASE WHEN vec_id % 13 <> 0 THEN vec_id END AS vec_id, vec_id % 2 = 0 AS need_raw, vec_id % 3 = 0 AS need_embedded FROM embeddings UNION ALL SELECT 'gone', NULL, true, true) LEFT JOIN t ON photo_id = vec_id AND scope = 'sharp'".replace("need_raw AND vec_id % 17 <> 0 AS", "coalesce(need_raw AND vec_id % 17 <> 0, false) AS"))
def raw_sources(spark: SparkSession, d: str) -> DataFrame:
    """RAW measures and the camera's own picture, each only where it is wanted; nulls for paths that aren't there."""
    n = F.col("vec_id")
    wanted = T(spark, d, "embeddings").select(F.concat(F.lit("raw/"), n.cast("string")).alias("path"), (n % 2 == 0).alias("need_raw"), (n % 3 == 0).alias("need_embedded"))
    wanted = wanted.unionByName(spark.createDataFrame([("gone", True, True)], wanted.schema))
    there = fx.mosaics(spark, d).where("photo_id % 13 <> 0")
    own = fx.pictures(spark, d, camera=True).withColumn("path", F.concat(F.lit("raw/"), F.col("photo_id").cast("string"))).where("photo_id % 13 <> 0")
    found = planes.sources(wanted, there, own)
    return r6(found.select("path", "photo_id", F.coalesce(F.col("raw.tone").isNotNull(), F.lit(False)).alias("has_raw"), F.col("embedded.sharp.tone.median_l").alias("embedded_l")), "embedded_l")


# --- keyed tables ---------------------------------------------------------------------------------------------

_HIT = {"source_raw": "vec_id % 31 <> 0 AND vec_id % 29 <> 0", "in_camera": "vec_id % 23 <> 0", "previews": "vec_id % 43 <> 0", "neutral_previews": "vec_id % 19 <> 0"}
_SIGNED = {"source_raw": "hash_raw", "in_camera": "hash_raw", "previews": "hash_preview", "neutral_previews": "hash_style"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", vec_id AS photo_id FROM embeddings WHERE NOT ({h})" for t, h in _HIT.items()))
def record_misses(spark: SparkSession, d: str) -> DataFrame:
    """What has to be measured again in each keyed table: missing, stale, or without what is needed."""
    shown, tables = fx.record_tables(spark, d)
    parts = [records.misses(t, tables[t], shown.select(F.col("photo_id").alias("uuid"), F.col(c).alias("signature"))).select(F.lit(t).alias("table"), F.col("uuid").alias("photo_id")) for t, c in _SIGNED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(o.with_(o.PX, o.LAB, o.SH, o.PT, o.PTLAB, o.PTSH, o.SCOPE, o.tone("sh", "t"), o.tone("ptsh", "tt")) + "SELECT vec_id AS photo_id, round(tt.median_l, 6) AS raw_l, round(t.median_l, 6) AS render_l, vec_id % 10 = 0 AS is_seed FROM embeddings JOIN t ON t.photo_id = vec_id AND t.scope = 'sharp' LEFT JOIN tt ON tt.photo_id = vec_id AND tt.scope = 'sharp' AND vec_id % 31 <> 0 AND vec_id % 29 <> 0 WHERE vec_id % 43 <> 0")
def measures_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Photos that can be planned for from their current render, with RAW measures if there are any."""
    shown, tables = fx.record_tables(spark, d)
    found = records.measures(shown, tables, embedded=False)
    return r6(found.select("photo_id", F.col("raw_tone.median_l").alias("raw_l"), F.col("render.tone.median_l").alias("render_l"), "is_seed"), "raw_l", "render_l")


@query(o.with_(o.PX, o.LAB, o.SH, o.PT, o.PTLAB, o.PTSH, o.SCOPE, o.tone("sh", "t"), o.tone("ptsh", "tt")) + "SELECT vec_id AS photo_id, CASE WHEN vec_id % 37 <> 0 THEN round(ts.median_l, 6) END AS t_sharp, round(tg.median_l, 6) AS t_global, round(ns.median_l, 6) AS n_sharp, CASE WHEN vec_id % 41 <> 0 THEN round(ng.median_l, 6) END AS n_global, CASE WHEN vec_id % 7 <> 0 THEN 3000.0e0 + (vec_id*53) % 5000 END AS asshot_temp FROM embeddings JOIN t ns ON ns.photo_id = vec_id AND ns.scope = 'sharp' JOIN t ng ON ng.photo_id = vec_id AND ng.scope = 'global' JOIN tt ts ON ts.photo_id = vec_id AND ts.scope = 'sharp' JOIN tt tg ON tg.photo_id = vec_id AND tg.scope = 'global' WHERE vec_id % 19 <> 0 AND vec_id % 23 <> 0")
def measures_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Photos that can be planned for from a neutral render and the camera's own picture."""
    shown, tables = fx.record_tables(spark, d)
    names = ("t_sharp", "t_global", "n_sharp", "n_global")
    return r6(records.measures(shown, tables, embedded=True).select("photo_id", *[F.col(f"{n}.tone.median_l").alias(n) for n in names], "asshot_temp"), *names)


@query(o.with_(o.PX, o.LAB, o.PHOTO) + "SELECT photo_id, round(rg, 6) AS rg, profile, temperature, tint, shadow_tint FROM photo WHERE is_seed AND photo_id % 31 <> 0")
def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    """References that can be matched: marked, and with RAW measures."""
    shown, t = fx.record_tables(spark, d)
    found = records.seed_vectors(t["pictures"], t["source_raw"], t["previews"])
    return r6(found.select("photo_id", "rg", "profile", "temperature", "tint", "shadow_tint"), "rg")


@query("SELECT vec_id AS photo_id, CAST(label AS VARCHAR) AS profile_dcp, vec_id % 10 = 0 AS is_seed, 2.0e0 AS cached_at, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS profile_capture FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, NULL, true, NULL, NULL FROM embeddings WHERE vec_id % 30 = 0")
def picture_table(spark: SparkSession, d: str) -> DataFrame:
    """Pictures put in twice and marked: a known profile isn't erased, marks stay, unknown photos that are marked are put in."""
    known = fx.settings(fx.photos(spark, d))
    rows = lambda at, profile: known.where("photo_id % 3 <> 0").select("photo_id", F.lit("p").alias("path"), F.lit("c").alias("catalog_path"), "develop", profile.alias("profile_capture"), F.lit(at).alias("cached_at"))
    first = records.put_pictures(records.empty(spark, "pictures"), rows(1.0, F.lit("old")))
    marked = records.mark(first, known.where("photo_id % 10 = 0"), True)
    out = records.put_pictures(marked, rows(2.0, F.when(F.col("photo_id") % 2 == 0, F.lit("new"))))
    return out.select(F.col("uuid").alias("photo_id"), "profile_dcp", "is_seed", "cached_at", "profile_capture")


_BANDED = (o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd"), o.tone("sh", "t"), o.neutral("sh", "n"), o.PT, o.PTLAB, o.PTSH, o.bands("ptsh", "bt"), o.tone("ptsh", "tt"), o.neutral("ptsh", "nt"))


@query(o.with_(*_BANDED) + "SELECT c.photo_id, c.band, round(tt.median_l - t.median_l, 6) + 0.0 AS delta_luma_median, round(nt.a_bias, 6) + 0.0 AS delta_cast_a, round(c.median_chroma - r.median_chroma, 6) + 0.0 AS dchroma, round(c.median_hue - r.median_hue, 6) + 0.0 AS dhue FROM bt c JOIN bd r ON r.photo_id = c.photo_id AND r.band = c.band AND r.scope = 'sharp' JOIN t ON t.photo_id = c.photo_id AND t.scope = 'sharp' JOIN tt ON tt.photo_id = c.photo_id AND tt.scope = 'sharp' JOIN nt ON nt.photo_id = c.photo_id AND nt.scope = 'sharp' WHERE c.scope = 'sharp'")
def camera_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What the cameras' pictures add to the RAW: lightness, cast and bands."""
    raw = planes.measured(fx.pictures(spark, d)).select("photo_id", F.col("sharp").alias("raw"))
    both = planes.measured(fx.pictures(spark, d, camera=True)).join(raw, "photo_id")
    found = both.select("photo_id", *records.deltas(F.col("sharp"), F.col("raw.tone"), F.col("raw.bands")))
    out = found.select("photo_id", "delta_luma_median", "delta_cast_a", F.explode("delta_bands").alias("b")).select("photo_id", "b.band", "delta_luma_median", "delta_cast_a", "b.dchroma", "b.dhue")
    return r6(out, "delta_luma_median", "delta_cast_a", "dchroma", "dhue")


@query(o.with_(o.PX, o.LAB, o.SH, o.PT, o.PTLAB, o.PTSH, o.SCOPE, o.tone("sh", "t"), o.tone("ptsh", "tt"), o.PHOTO) + "SELECT p.photo_id, abs(exposure) >= 0.3 AND p.photo_id % 43 <> 0 AND abs(t.median_l - tt.median_l) < 2.0 AS suspect FROM photo p JOIN t ON t.photo_id = p.photo_id AND t.scope = 'sharp' JOIN tt ON tt.photo_id = p.photo_id AND tt.scope = 'sharp'")
def anchor_suspect(spark: SparkSession, d: str) -> DataFrame:
    """Neutral renders that look like the last preview although the exposure is far from 0."""
    shown, tables = fx.record_tables(spark, d)
    probed = planes.measured(fx.pictures(spark, d, camera=True)).join(shown.select("photo_id", "develop"), "photo_id")
    return records.suspect_anchors(probed, tables["previews"])


# --- the planner ----------------------------------------------------------------------------------------------

_RAW = "photo_id % 31 <> 0 AND photo_id % 29 <> 0"
_FEAT = ", ".join(f"CASE WHEN {_RAW} THEN {c} END AS {c}" for c in ("rg", "bg", "profile"))
#: References by their RAW measures of any age, and photos by fresh ones; the RAW is the camera's picture here.
_POOL = f"""rl AS (SELECT photo_id, median_l FROM tt WHERE scope = 'sharp'),
seeds AS (SELECT p.* REPLACE (rl.median_l AS median_l) FROM photo p JOIN rl USING (photo_id) WHERE is_seed AND photo_id % 31 <> 0),
wanted AS (SELECT p.photo_id, p.profile AS own_profile, exposure, temperature AS now_temp, tint AS now_tint, {_FEAT.replace('photo_id', 'p.photo_id').replace('THEN rg', 'THEN p.rg').replace('THEN bg', 'THEN p.bg').replace('THEN profile', 'THEN p.profile')}, CASE WHEN {_RAW.replace('photo_id', 'p.photo_id')} THEN rl.median_l END AS median_l FROM photo p JOIN rl USING (photo_id) WHERE NOT is_seed AND """
_KNN = o.KNN.split("wanted AS (SELECT * FROM photo WHERE NOT is_seed),", 1)[1]
_PRE = (*_BANDED, o.PHOTO, RESPONSE)
_ALL = lambda *parts: " UNION ALL ".join(f"SELECT photo_id, key, value, text FROM ({p})" for p in parts)
_EXPO = lambda src, least: f"SELECT photo_id, 'Exposure2012' AS key, value, NULL::VARCHAR AS text FROM (SELECT photo_id, round_even(({src})*100, 0)/100 + 0.0 AS value FROM z) WHERE abs(value) >= {least}"
_WB = "SELECT photo_id, unnest(['Temperature', 'Tint', 'WhiteBalance']) AS key, unnest([round_even(temp, 0) + 0.0, round_even(tint, 0) + 0.0, NULL]) AS value, unnest([NULL, NULL, 'Custom']) AS text FROM w"
_CALIB = f"SELECT * FROM (SELECT photo_id, unnest([{', '.join(repr(k) for _, k in CALIBRATION)}, 'EnableCalibration']) AS key, unnest([{_CAL}, CASE WHEN coalesce({', '.join(n for n, _ in CALIBRATION)}) IS NOT NULL THEN 1 END]) + 0.0 AS value, NULL::VARCHAR AS text FROM target) WHERE value IS NOT NULL"
_STEP = f"z AS (SELECT *, greatest(-2.0e0, least(2.0e0, (want-have)/{SLOPE('(q.want+q.have)/2')})) AS s FROM q)"
_NOW = "CASE WHEN key = 'SaturationAdjustmentRed' AND photo_id % 4 = 0 THEN photo_id % 11 - 5 ELSE 0 END"
_STEPS, _HSLSEL = _HSL.split("\nSELECT * FROM ", 1)

_SEEDS = (
    *_PRE, _POOL + "photo_id % 43 <> 0)," + _KNN, o.TARGET,
    "ptone AS (SELECT k.photo_id, sum(t.median_l/(d+1e-6))/sum(1/(d+1e-6)) AS want FROM knn k JOIN t ON t.photo_id = seed_id AND scope = 'sharp' AND seed_id % 43 <> 0 GROUP BY 1)",
    "q AS (SELECT p.photo_id, kind, t.median_l AS have, want, clipped_hi, clipped_lo, p.exposure FROM wanted p JOIN t ON t.photo_id = p.photo_id AND scope = 'sharp' JOIN ptone ON ptone.photo_id = p.photo_id JOIN resp r ON r.profile = p.own_profile)", _STEP,
    f"e AS (SELECT g.photo_id, g.temperature, coalesce(g.tint, 0) AS tint, kind <> 1 AND n_neutral > 0 AND neutral_frac >= 0.005 AS refine, {_CAST('a_bias', 'b_bias')} FROM target g JOIN wanted p ON p.photo_id = g.photo_id JOIN resp r ON r.profile = p.own_profile JOIN n ON n.photo_id = g.photo_id AND scope = 'sharp')",
    "w AS (SELECT photo_id, CASE WHEN refine THEN least(12000, greatest(2000, temperature+greatest(-600, least(600, dt)))) ELSE temperature END AS temp, least(150, greatest(-150, CASE WHEN refine THEN tint+greatest(-10, least(10, dn)) ELSE tint END)) AS tint FROM e)",
    f"tb AS (SELECT k.photo_id, band, {', '.join(f'sum(b.{c}/(d+1e-6))/sum(1/(d+1e-6)) AS {c}' for c in ('median_chroma', 'median_l'))}, degrees(atan2(sum(sin(radians(median_hue))), sum(cos(radians(median_hue))))) AS h0 FROM knn k JOIN bd b ON b.photo_id = k.seed_id AND scope = 'sharp' AND frac >= 0.01 AND k.seed_id % 43 <> 0 GROUP BY 1, 2), tband AS (SELECT *, h0-360*floor(h0/360) AS median_hue FROM tb)",
    f"h AS (SELECT b.*, x.median_chroma AS t_chroma, x.median_l AS t_l, x.median_hue AS t_hue, CASE WHEN {_RAW.replace('photo_id', 'b.photo_id')} AND c.frac >= 0.01 THEN c.sat_clip_frac >= 0.05 END AS raw_oversat, 20.0e0 AS cap, 15.0e0 AS turn, g FROM bd b JOIN tband x ON x.photo_id = b.photo_id AND x.band = b.band JOIN bt c ON c.photo_id = b.photo_id AND c.band = b.band AND c.scope = 'sharp' JOIN wanted p ON p.photo_id = b.photo_id JOIN resp r ON r.profile = p.own_profile WHERE b.scope = 'sharp')", _STEPS,
    f"hsl AS (SELECT photo_id, key, round_even(greatest(-100.0e0, least(100.0e0, value + {_NOW})), 0) + 0.0 AS value, NULL::VARCHAR AS text FROM {_HSLSEL.replace('WHERE value <> 0', 'WHERE value <> 0')})",
)
_SEEDS_ALL = _ALL(_EXPO(f"exposure + {_EV}", -1), _WB, "SELECT * FROM hsl", _CALIB)


def _models(spark: SparkSession) -> DataFrame:
    """The responses of the made-up profiles."""
    profiles = spark.range(10).select(F.col("id").cast("string").alias("profile"))
    gains = F.map_from_entries(F.array(*[F.struct(F.lit(b), F.struct(F.col("g_sat").alias("sat"), F.col("g_lum").alias("lum"), F.col("g_hue").alias("hue"))) for b, _ in color.BANDS]))
    return responses(profiles).select(F.lit("cam").alias("camera"), F.col("profile").alias("model_profile"), "curve", "at", "an", "bt", "bn", gains.alias("gains"))


def _plan(spark: SparkSession, d: str, forced: bool) -> planner.Planned:
    shown, t = fx.record_tables(spark, d)
    seeds = written(records.seed_vectors(t["pictures"], t["source_raw"], t["previews"]), "seed-vectors")
    rows = planner.responses(records.measures(shown, t, embedded=forced), _models(spark))
    return planner.plan(written(rows, "measures"), seeds, forced_embedded=forced)


def _settings(plan: planner.Planned) -> DataFrame:
    return plan.settings.withColumn("value", F.col("value") + F.lit(0.0))


@query(o.with_(*_SEEDS) + _SEEDS_ALL)
def plan_full_seeds(spark: SparkSession, d: str) -> DataFrame:
    """All settings towards the references."""
    return _settings(_plan(spark, d, forced=False))


_V = "CASE WHEN p.photo_id % 6 = 0 THEN 'sharp' ELSE 'global' END"
_SP, _GL = "p.photo_id % 37 <> 0", "p.photo_id % 41 <> 0"
_EMBEDDED = (
    *_PRE, _POOL + "photo_id % 19 <> 0 AND photo_id % 23 <> 0)," + _KNN, o.TARGET,
    f"us AS (SELECT p.photo_id, p.own_profile, kind, jat, jan, jbt, jbn, g, CASE WHEN p.photo_id % 7 <> 0 THEN now_temp END AS temperature, now_tint AS tint, CASE WHEN {_V} = 'sharp' AND {_SP} THEN 'sharp' WHEN {_V} = 'global' AND {_GL} THEN 'global' WHEN {_SP} THEN 'sharp' WHEN {_GL} THEN 'global' END AS used, {_SP} AND {_GL} AS whole_ FROM wanted p JOIN resp r ON r.profile = p.own_profile)",
    "q AS (SELECT p.photo_id, kind, t.median_l AS have, tt.median_l AS want, t.clipped_hi, t.clipped_lo FROM us p JOIN t ON t.photo_id = p.photo_id AND t.scope = used JOIN tt ON tt.photo_id = p.photo_id AND tt.scope = used)", _STEP,
    "c AS (SELECT p.*, n.a_bias-nt.a_bias AS ea, n.b_bias-nt.b_bias AS eb, n.neutral_frac >= 0.02 AND nt.neutral_frac >= 0.02 AS seen FROM us p JOIN n ON n.photo_id = p.photo_id AND n.scope = used JOIN nt ON nt.photo_id = p.photo_id AND nt.scope = used)",
    f"f AS (SELECT *, {_CAST('ea', 'eb')} FROM c WHERE seen AND sqrt(ea*ea+eb*eb) >= 3 AND kind <> 1 AND temperature IS NOT NULL)",
    "w AS (SELECT photo_id, least(12000, greatest(2000, temperature+greatest(-600, least(600, dt)))) AS temp, least(150, greatest(-150, tint+greatest(-10, least(10, dn)))) AS tint FROM f)",
    f"h AS (SELECT b.*, CASE WHEN x.frac >= 0.01 THEN x.median_chroma END AS t_chroma, CASE WHEN x.frac >= 0.01 THEN x.median_l END AS t_l, CASE WHEN x.frac >= 0.01 THEN x.median_hue END AS t_hue, CASE WHEN {_RAW.replace('photo_id', 'b.photo_id')} AND c.frac >= 0.01 THEN c.sat_clip_frac >= 0.05 END AS raw_oversat, 10.0e0 AS cap, 8.0e0 AS turn, g FROM us p JOIN bd b ON b.photo_id = p.photo_id AND b.scope = used JOIN bt x ON x.photo_id = b.photo_id AND x.band = b.band AND x.scope = used JOIN bt c ON c.photo_id = b.photo_id AND c.band = b.band AND c.scope = 'sharp')", _STEPS,
    f"hsl AS (SELECT photo_id, key, value, NULL::VARCHAR AS text FROM {_HSLSEL})",
)


@query(o.with_(*_EMBEDDED) + _ALL(_EXPO(_EV, 0.1), _WB, "SELECT * FROM hsl", _CALIB))
def plan_full_embedded(spark: SparkSession, d: str) -> DataFrame:
    """All settings towards the cameras' own pictures."""
    return _settings(_plan(spark, d, forced=True))


_N = lambda name, sql: f"SELECT 'embedded' AS mode, '{name}' AS counter, ({sql}) AS n"
_DEV = "seen AND sqrt(ea*ea+eb*eb) >= 3"


@query(o.with_(*_EMBEDDED, f"x AS (SELECT abs(round_even(round(({_EV})*100, 6), 0)/100) >= 0.1 AS big FROM z)") + " UNION ALL ".join((
    _N("n_targets", "SELECT count(*) FROM us"), _N("n_unresolved", "SELECT count(*) FROM us WHERE used IS NULL"),
    _N("n_divergent", "SELECT count(*) FROM us p JOIN t a ON a.photo_id=p.photo_id AND a.scope='global' JOIN t b ON b.photo_id=p.photo_id AND b.scope='sharp' JOIN tt c ON c.photo_id=p.photo_id AND c.scope='global' JOIN tt d ON d.photo_id=p.photo_id AND d.scope='sharp' WHERE whole_ AND abs((c.median_l-a.median_l)-(d.median_l-b.median_l)) > 4"),
    _N("n_sharp", "SELECT count(*) FROM us WHERE used = 'sharp'"), _N("expo_written", "SELECT count(*) FROM x WHERE big"), _N("expo_conform", "SELECT count(*) FROM x WHERE NOT big"),
    _N("wb_written", f"SELECT count(*) FROM c WHERE {_DEV} AND kind <> 1 AND temperature IS NOT NULL"), _N("wb_conform", f"SELECT count(*) FROM c WHERE NOT ({_DEV})"), _N("wb_uncalibrated", f"SELECT count(*) FROM c WHERE {_DEV} AND (kind = 1 OR temperature IS NULL)"),
    _N("hsl_written", "SELECT count(DISTINCT photo_id) FROM hsl"), _N("calib_written", f"SELECT count(DISTINCT photo_id) FROM ({_CALIB})"),
)))
def plan_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the plan towards the cameras' own pictures did, left, and could not judge."""
    return _plan(spark, d, forced=True).counts


@query(o.with_(*_SEEDS) + f"SELECT a.photo_id, a.key, a.key || ': ' || coalesce(now, '?') || ' → Custom' AS line FROM ({_ALL(_WB)}) a LEFT JOIN (SELECT 0 AS photo_id, NULL::VARCHAR AS now) b ON false WHERE a.key = 'WhiteBalance'")
def plan_lines(spark: SparkSession, d: str) -> DataFrame:
    """How planned white-balance modes are shown."""
    plan = _plan(spark, d, forced=False)
    return planner.preview_lines(plan, fx.record_tables(spark, d)[0]).where("key = 'WhiteBalance'")


assert _KIND
