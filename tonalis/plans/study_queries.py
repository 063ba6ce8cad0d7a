"""Queries of the offline studies, catalogues and preview caches, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import sharp_zone, studies
from ..sources import catalog, previews
from . import fixtures as fx, oracle as o
from .photo_queries import query, r6

T = fx.table
_PHOTO = (o.PX, o.LAB, o.PHOTO)
_Z = "z AS (SELECT photo_id, rg, bg, temperature, tint, exposure, temperature-2450.0e0*rg AS z FROM photo)"


def _draw(trials: int) -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '-' || photo_id), photo_id) AS rank FROM z, range({trials}) t(trial))"


def _plane(by: str) -> str:
    c = lambda a, b: f"covar_pop({a}, {b})"
    det = f"nullif({c('rg', 'rg')}*{c('bg', 'bg')}-{c('rg', 'bg')}*{c('rg', 'bg')}, 0)"
    return f"({c('rg', by)}*{c('bg', 'bg')}-{c('bg', by)}*{c('rg', 'bg')})/{det} AS a, ({c('bg', by)}*{c('rg', 'rg')}-{c('rg', by)}*{c('rg', 'bg')})/{det} AS b"


@query(o.with_(*_PHOTO, _Z, _draw(200), "ks AS (SELECT * FROM (VALUES (3), (5), (8), (12), (20), (40)) v(k))", f"f AS (SELECT k, trial, median(z) AS i, median(tint) AS t, median(exposure) AS e, {_plane('temperature')}, avg(temperature) AS mt, avg(rg) AS mr, avg(bg) AS mb FROM r, ks WHERE rank <= k GROUP BY 1, 2)",
    "x AS (SELECT k, r.trial, sqrt(avg(pow(temperature-a*rg-b*bg-(mt-a*mr-b*mb), 2))) AS full_, sqrt(avg(pow(temperature-2450.0e0*rg-i, 2))) AS slope, sqrt(avg(pow(t-tint, 2))) AS tint, sqrt(avg(pow(e-exposure, 2))) AS exposure FROM r JOIN f ON f.trial = r.trial AND rank > k GROUP BY 1, 2)")
    + "SELECT k, round(avg(full_), 1) AS \"full\", round(avg(slope), 4) AS slope, round(avg(tint), 4) AS tint, round(avg(exposure), 4) AS exposure, count(*) AS trials FROM x WHERE k < (SELECT count(*) FROM z) GROUP BY 1")
def seed_curve(spark: SparkSession, d: str) -> DataFrame:
    """How the errors on other photos fall with the number of references."""
    out = studies.seed_curve(fx.photos(spark, d)).withColumn("full", F.round("full", 1))
    return out.withColumns({c: F.round(c, 4) for c in ("slope", "tint", "exposure")})


_TRIALS = (*_PHOTO, _Z, _draw(60),
    "cal AS (SELECT trial, median(z) AS i, stddev_pop(temperature) AS spread, median(tint) AS t, avg(z) AS mz, var_pop(z) AS vz, count(*) AS n FROM r WHERE rank <= 6 GROUP BY 1), c2 AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE sqrt(vz + pow(mz-i, 2)) END AS residual FROM cal), c3 AS (SELECT *, CASE WHEN n < 4 OR spread < 150 THEN 'uncertain' WHEN residual/spread <= 0.5 THEN 'physics' WHEN residual/spread >= 0.7 THEN 'artistic' ELSE 'uncertain' END AS regime FROM c2)",
    "tr AS (SELECT r.trial, residual, regime, sqrt(avg(pow(greatest(2000, least(12000, 2450.0e0*rg+i))-temperature, 2))) AS temperature, sqrt(avg(pow(t-tint, 2))) AS tint FROM r JOIN c3 ON c3.trial = r.trial AND rank > 6 GROUP BY 1, 2, 3)")


@query(o.with_(*_TRIALS) + "SELECT CAST(trial AS INTEGER) AS trial, round(residual, 4) AS residual, regime, round(temperature, 4) AS temperature, round(tint, 4) AS tint FROM tr")
def seed_trials(spark: SparkSession, d: str) -> DataFrame:
    """Calibrations from six random references, and their errors on the other photos."""
    return studies.seed_trials(fx.photos(spark, d), trials=60).withColumns({c: F.round(c, 4) for c in ("residual", "temperature", "tint")})


_SUMMARY = ("mean", "std", "p90", "gain", "tint", "residual", "physics", "uncertain", "artistic")


@query(o.with_(*_TRIALS, "b AS (SELECT sqrt(avg(pow(temperature-m, 2))) AS base FROM photo, (SELECT median(temperature) AS m FROM photo))") + f"SELECT {', '.join(f'round({c}, 4) AS {c}' for c in _SUMMARY)} FROM (SELECT avg(temperature) AS mean, stddev_pop(temperature) AS std, quantile_cont(temperature, 0.9) AS p90, (1-avg(temperature)/any_value(base))*100 AS gain, avg(tint) AS tint, median(residual) AS residual, {', '.join(f'avg(CASE WHEN regime={r!r} THEN 1.0e0 ELSE 0 END)*100 AS {r}' for r in ('physics', 'uncertain', 'artistic'))} FROM tr, b)")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    """What such calibrations gain over knowing nothing."""
    rows = fx.photos(spark, d).withColumn("one", F.lit(1))
    base = studies.baseline(rows, "one", "temperature").first()["baseline"]
    return studies.trial_summary(studies.seed_trials(rows, trials=60), base).withColumns({c: F.round(c, 4) for c in _SUMMARY})


_MOM2 = f"fit AS (SELECT profile, count(*) AS n, {_plane('temperature')}, avg(rg) AS m1, avg(bg) AS m2, avg(temperature) AS my, covar_pop(rg,rg) AS s11, covar_pop(rg,bg) AS s12, covar_pop(bg,bg) AS s22, var_pop(temperature) AS syy FROM photo GROUP BY 1 HAVING count(*) >= 31)"


@query(o.with_(*_PHOTO, _MOM2, "e AS (SELECT p.profile, temperature-my-a*(rg-m1)-b*(bg-m2) AS err, 1.0e0/n + (pow(rg-m1, 2)*s22-2*(rg-m1)*(bg-m2)*s12+pow(bg-m2, 2)*s11)/((s11*s22-s12*s12)*n) AS h FROM photo p JOIN fit USING (profile))", "l AS (SELECT profile, sqrt(avg(pow(err/greatest(1e-6, 1-h), 2))) AS loo, sum(err*err) AS sse FROM e GROUP BY 1)")
       + "SELECT profile, n, round(a, 3) AS a, round(b, 3) AS b, round(my-a*m1-b*m2, 3) AS c, round(1-sse/(syy*n), 6) AS r2, round(loo, 4) AS loo, round(sqrt(syy), 4) AS base, loo < sqrt(syy)*0.9 AS helps FROM fit JOIN l USING (profile)")
def regress_plane(spark: SparkSession, d: str) -> DataFrame:
    """Temperature on both ratios for each profile, with its leave-one-out error."""
    out = studies.regress_plane(fx.photos(spark, d), "profile", "rg", "bg", "temperature").withColumn("helps", studies.helps(F.col("loo"), F.col("base")))
    return r6(out.withColumns({c: F.round(c, 3) for c in "abc"} | {c: F.round(c, 4) for c in ("loo", "base")}), "r2")


@query(o.with_(*_PHOTO) + "SELECT profile, setting, round(median(v), 6) + 0.0 AS median, round(stddev_pop(v), 6) AS std, min(v) + 0.0 AS least, max(v) + 0.0 AS most, count(v) AS n FROM (SELECT profile, unnest(['exposure', 'temperature', 'tint']) AS setting, unnest([CASE WHEN photo_id % 9 <> 0 THEN exposure END, temperature, tint]) AS v FROM photo) GROUP BY 1, 2")
def chosen_settings(spark: SparkSession, d: str) -> DataFrame:
    """What was chosen in each profile."""
    rows = fx.photos(spark, d).withColumn("exposure", F.when(F.col("photo_id") % 9 != 0, F.col("exposure")))
    return r6(studies.chosen_settings(rows, "profile"), "median", "std", "least", "most")


@query(o.with_(*_PHOTO) + "SELECT profile, round(100*avg(CASE WHEN temperature > 5500 THEN 1.0e0 ELSE 0 END), 6) AS warm, round(100*avg(CASE WHEN temperature < 4500 THEN 1.0e0 ELSE 0 END), 6) AS cool, round(stddev_pop(temperature), 6) AS std, round(CASE WHEN count(*) >= 20 THEN regr_r2(temperature, rg) END, 6) AS r2, CASE WHEN count(*) < 20 THEN 'too few' WHEN regr_r2(temperature, rg) > 0.4 THEN 'followable' WHEN stddev_pop(temperature) < 250 THEN 'constant' ELSE 'mixed' END AS verdict FROM photo GROUP BY 1")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    """Whether white balance follows the light, is constant, or neither."""
    return r6(studies.coherence(fx.photos(spark, d), "profile"), "warm", "cool", "std", "r2")


@query("SELECT c_nationkey AS catalog, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS mode, count(*) AS n FROM customer GROUP BY 1, 2")
def wb_modes(spark: SparkSession, d: str) -> DataFrame:
    """White-balance modes of each catalogue."""
    return studies.white_balance_modes(T(spark, d, "customer").withColumnRenamed("c_nationkey", "catalog"), "catalog", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))


@query("SELECT k AS name, k || CASE WHEN n < 20 THEN ' (too few)' ELSE printf(' R2=%.3f LOO=%.3fEV base=%.3f n=%d', r2, loo, base, n) || CASE WHEN loo < base*0.9 THEN ' HELPS' ELSE '' END END AS line FROM (SELECT 'n' || c_nationkey AS k, count(*) AS n, (c_nationkey % 10) / 10.0e0 AS r2, c_nationkey / 7.0e0 AS loo, c_nationkey / 4.0e0 - 1 AS base FROM customer GROUP BY c_nationkey)")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fits as lines of text."""
    n = F.col("c_nationkey")
    rows = T(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("n"), n.cast("string")).alias("name"), "n", ((n % 10) / 10.0).alias("r2"), (n / 7.0).alias("loo"), (n / 4.0 - 1).alias("base"))
    return rows.select("name", studies.report_line(F.col("name"), F.when(F.col("n") >= 20, F.col("r2")), F.col("loo"), F.col("base"), F.col("n"), "EV").alias("line"))


@query("""WITH p AS (SELECT l_suppkey AS band, CASE l_linenumber % 3 WHEN 0 THEN 'hue' WHEN 1 THEN 'sat' ELSE 'lum' END AS axis, ([-15.0, -8.0, 0.0, 8.0, 15.0])[l_partkey % 5 + 1] + l_orderkey / 1000000.0e0 AS delta, l_discount AS frac, (l_partkey * 7 % 360) + 0.0e0 AS value FROM lineitem),
f AS (SELECT band, axis, arg_min(value, delta) AS ref FROM p WHERE frac >= 0.01 GROUP BY 1, 2), y AS (SELECT p.band, p.axis, delta, CASE WHEN p.axis = 'hue' THEN ref + (value-ref+180-360*floor((value-ref+180)/360)) - 180 ELSE value END AS y FROM p JOIN f USING (band, axis) WHERE frac >= 0.01)
SELECT band, axis, round(CASE WHEN count(*) < 2 OR var_pop(delta)*count(*) < 1e-9 THEN 0 ELSE regr_slope(y, delta) END, 4) + 0.0 AS slope FROM y GROUP BY 1, 2""")
def band_axis_response(spark: SparkSession, d: str) -> DataFrame:
    """Slopes of bands on sliders, hues unwrapped."""
    axis = F.when(F.col("l_linenumber") % 3 == 0, "hue").when(F.col("l_linenumber") % 3 == 1, "sat").otherwise("lum")
    delta = F.element_at(F.array(*map(F.lit, (-15.0, -8.0, 0.0, 8.0, 15.0))), (F.col("l_partkey") % 5 + 1).cast("int")) + F.col("l_orderkey") / F.lit(1_000_000.0)
    probes = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("band"), axis.alias("axis"), delta.alias("delta"), F.col("l_discount").alias("frac"), (F.col("l_partkey") * 7 % 360).cast("double").alias("value"))
    return studies.band_axis_response(probes).withColumn("slope", F.round("slope", 4) + F.lit(0.0))


# --- the sharp zone of the studies ------------------------------------------------------------------------------

_HALF = """hp AS (SELECT photo_id, x//2 AS x, y//2 AS y, (sum(r)+2)//4 AS r, (sum(g)+2)//4 AS g, (sum(b)+2)//4 AS b FROM px GROUP BY 1, 2, 3), gr AS (SELECT *, round_even(0.299e0*r+0.587e0*g+0.114e0*b, 0) AS l FROM hp),
m AS (SELECT i, CASE WHEN j < 4 THEN j ELSE 6-j END AS s FROM (SELECT i, ((i % 6) + 6) % 6 AS j FROM range(-4, 8) t(i))),
lp AS (SELECT a.photo_id, a.x, a.y, a.r, a.g, a.b, abs(sum(n.l) - 4*any_value(a.l)) AS lap FROM gr a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dx, dy), m mx, m my, gr n WHERE mx.i = a.x+dx AND my.i = a.y+dy AND n.photo_id = a.photo_id AND n.x = mx.s AND n.y = my.s GROUP BY 1, 2, 3, 4, 5, 6),
kr AS (SELECT k, exp(-0.5e0*k*k) / (SELECT sum(exp(-0.5e0*q*q)) FROM range(-4, 5) t(q)) AS w FROM range(-4, 5) t(k)),
bx AS (SELECT a.photo_id, a.x, a.y, a.r, a.g, a.b, sum(w*n.lap ORDER BY k) AS v FROM lp a, kr, m mx, lp n WHERE mx.i = a.x+k AND n.photo_id = a.photo_id AND n.x = mx.s AND n.y = a.y GROUP BY 1, 2, 3, 4, 5, 6),
bb AS (SELECT a.photo_id, a.x, a.y, a.r, a.g, a.b, sum(w*n.v ORDER BY k) AS v FROM bx a, kr, m my, bx n WHERE my.i = a.y+k AND n.photo_id = a.photo_id AND n.y = my.s AND n.x = a.x GROUP BY 1, 2, 3, 4, 5, 6),
zn AS (SELECT b.*, v >= (SELECT quantile_cont(q.v, 0.85) FROM bb q WHERE q.photo_id = b.photo_id) AS sharp, """ + ", ".join(f"{o.linear(c)} AS l{c}" for c in "rgb") + " FROM bb b)"
_RATIO = lambda a, b, f: f"CASE WHEN avg({b}) FILTER ({f}) > 1e-7 THEN avg({a}) FILTER ({f})/avg({b}) FILTER ({f}) END"
_ZONE = ("g_luma", "g_gr", "g_gb", "zm_luma", "zm_gr", "zm_gb")
_ZSQL = ", ".join(f"round(avg(0.2126e0*lr+0.7152e0*lg+0.0722e0*lb) FILTER ({f}), 6) AS {n}_luma, round({_RATIO('lg', 'lr', f)}, 6) AS {n}_gr, round({_RATIO('lg', 'lb', f)}, 6) AS {n}_gb" for n, f in (("g", "true"), ("zm", "sharp")))


@query(o.with_(o.PX, _HALF) + f"SELECT photo_id, count(*) FILTER (sharp) AS zone_px, {_ZSQL} FROM zn GROUP BY 1 HAVING count(*) FILTER (sharp) >= 3")
def sharp_zone_light(spark: SparkSession, d: str) -> DataFrame:
    """Light of pictures and of their sharp zones."""
    return r6(sharp_zone.zones(fx.pictures(spark, d), sigma=1.0, least=3), *_ZONE)


@query("")
def sharp_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Colour clusters of sharp zones; held against numpy in tests."""
    return r6(sharp_zone.clusters(fx.pictures(spark, d), sigma=1.0, least=3), *_ZONE, "n_luma", "n_gr", "n_gb", "n_chroma", "n_pct", "b_luma")


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 < 3)")
def catalog_sample(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a fixed sample: as many, and the same for one seed, whichever way they are dealt."""
    orders = T(spark, d, "orders").where("o_orderkey % 100 < 3").select(F.col("o_orderkey").alias("id"))
    return sharp_zone.sampled(orders, orders.count(), "id")


# --- catalogues and preview caches ------------------------------------------------------------------------------

_KEYED = """k AS (SELECT c_custkey AS id_global, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey + 5 END AS id_local FROM customer), e AS (SELECT o_custkey + 5 AS imageId, min(md5(CAST(o_custkey AS VARCHAR))) AS uuid, 'd' || o_custkey AS digest FROM orders GROUP BY o_custkey),
kd AS (SELECT id_global, uuid, digest FROM k LEFT JOIN e ON imageId = id_local)"""


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    wanted = T(spark, d, "customer").select(key.alias("id_global"), F.when(key % 7 != 0, key + 5).alias("id_local"))
    entries = T(spark, d, "orders").select("o_custkey").distinct().select((F.col("o_custkey") + 5).alias("imageId"), F.md5(F.col("o_custkey").cast("string")).alias("uuid"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("digest"))
    keyed = previews.keys(wanted.select("id_global"), wanted, entries)
    line = T(spark, d, "lineitem").select("l_linenumber", F.md5(F.col("l_suppkey").cast("string")).alias("u"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat("u", F.lit("-x.lrfprev"))).when(F.col("l_linenumber") % 3 == 1, F.concat("u", F.lit("-x_"), "q")).otherwise(F.concat("u", F.lit(".dng")))
    files = line.where("l_linenumber % 4 <> 0").select(F.concat_ws("/", F.substring("u", 1, 1), F.substring("u", 1, 4)).alias("folder"), name.alias("name")).distinct()
    return keyed, files


_FILES = "fl AS (SELECT DISTINCT u[1:1] || '/' || u[1:4] AS folder, CASE l_linenumber % 3 WHEN 0 THEN u || '-x.lrfprev' WHEN 1 THEN u || '-x_' || q ELSE u || '.dng' END AS name, u FROM (SELECT l_linenumber, md5(CAST(l_suppkey AS VARCHAR)) AS u, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem WHERE l_linenumber % 4 <> 0))"


@query(o.with_(_KEYED) + "SELECT * FROM kd")
def preview_keys(spark: SparkSession, d: str) -> DataFrame:
    """Photos with their entry in the preview cache."""
    return _cache(spark, d)[0]


@query(o.with_(_KEYED, _FILES) + "SELECT id_global, (SELECT arg_max(folder || '/' || name, struct_pack(a := name NOT LIKE '%.lrfprev', b := coalesce(TRY_CAST(regexp_extract(name, '_([0-9]+)$', 1) AS BIGINT), -1), c := name)) FROM fl WHERE fl.u = kd.uuid AND name NOT LIKE '%.dng') AS path FROM kd")
def rendered_previews(spark: SparkSession, d: str) -> DataFrame:
    """The largest rendered preview of each photo."""
    return previews.rendered(*_cache(spark, d))


@query(o.with_(_KEYED, _FILES) + "SELECT id_global, (SELECT min(folder || '/' || name) FROM fl WHERE fl.u = kd.uuid AND name LIKE '%.dng') AS path FROM kd")
def smart_previews(spark: SparkSession, d: str) -> DataFrame:
    """The smart preview of each photo."""
    return previews.smart(*_cache(spark, d))


@query(o.with_(_KEYED, _FILES, "rp AS (SELECT id_global, (SELECT max(1) FROM fl WHERE fl.u = kd.uuid AND name NOT LIKE '%.dng') AS p FROM kd)") + "SELECT id_global AS photo_id, CASE WHEN id_global % 3 = 0 THEN 'thumbnail' WHEN p IS NOT NULL THEN 'preview' ELSE 'none' END AS channel FROM rp")
def preview_channel(spark: SparkSession, d: str) -> DataFrame:
    """The picture to measure: the thumbnail, else the preview."""
    keyed, files = _cache(spark, d)
    wanted = keyed.select(F.col("id_global").alias("photo_id"))
    thumbs = wanted.where("photo_id % 3 = 0").withColumn("path", F.concat(F.lit("t/"), F.col("photo_id").cast("string")))
    own = previews.rendered(keyed, files).where("path IS NOT NULL").withColumnRenamed("id_global", "photo_id")
    return previews.render_paths(wanted, thumbs, own).select("photo_id", "channel")


@query("SELECT o_orderkey AS id_global, r_name || n_name || '/' || c_name || '.ARW' AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def catalog_path_join(spark: SparkSession, d: str) -> DataFrame:
    """Path of each picture through file, folder and root."""
    images_ = T(spark, d, "orders").select(F.col("o_orderkey").alias("id_global"), F.col("o_custkey").alias("rootFile"))
    files = T(spark, d, "customer").select(F.col("c_custkey").alias("id_local"), F.col("c_nationkey").alias("folder"), F.col("c_name").alias("baseName"), F.lit("ARW").alias("extension"))
    folders = T(spark, d, "nation").select(F.col("n_nationkey").alias("id_local"), F.col("n_regionkey").alias("rootFolder"), F.concat("n_name", F.lit("/")).alias("pathFromRoot"))
    return catalog.image_paths(images_, files, folders, T(spark, d, "region").select(F.col("r_regionkey").alias("id_local"), F.col("r_name").alias("absolutePath")))


@query("SELECT c_name AS photo, arg_max(o_orderkey % 40 / 10.0e0, o_orderkey) AS exposure, CASE WHEN max(o_orderkey) % 3 <> 0 THEN 4000.0e0 + max(o_orderkey) % 900 END AS temperature, arg_max(CASE o_orderkey % 2 WHEN 0 THEN 'Custom' ELSE 'As Shot' END, o_orderkey) AS mode FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def catalog_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each file, from the last of its texts."""
    n = F.col("o_orderkey")
    text = F.concat(F.lit("s = { Exposure2012 = "), (n % 40 / 10.0).cast("string"), F.when(n % 3 != 0, F.concat(F.lit(", Temperature = "), (n % 900 + 4000).cast("string"))).otherwise(""), F.lit(', WhiteBalance = "'), F.when(n % 2 == 0, "Custom").otherwise("As Shot"), F.lit('" }'))
    files = T(spark, d, "customer").select(F.col("c_custkey").alias("id_local"), F.col("c_name").alias("baseName"))
    images_ = T(spark, d, "orders").select(n.alias("id_local"), F.col("o_custkey").alias("rootFile"))
    develop = T(spark, d, "orders").select(n.alias("id_local"), n.alias("image"), text.alias("text"))
    return catalog.develop_settings(files, images_, develop).select("photo", "exposure", "temperature", "mode")


@query("SELECT 'A\\B/' || c_custkey || '.arw' AS src, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN c_mktsegment END AS profile FROM customer")
def capture_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Capture profiles that a metadata reader listed under rewritten paths."""
    key = F.col("c_custkey").cast("string")
    c = T(spark, d, "customer")
    listed = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("a/b/"), key, F.lit(".ARW")).alias("path"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise("  ").alias("profile"))
    return catalog.capture_profiles(c.select(F.concat(F.lit("A\\B/"), key, F.lit(".arw")).alias("src")), listed)


_TYPED = ['s = { Exposure2012 = 0.5, Temperature = 5200, WhiteBalance = "Custom", Look = { Name = "Vivid", Amount = 1 } }', "RedHue = 0, ColorGradeBlending = 50, EnableCalibration = true", "ToneCurvePV2012 = false, HueAdjustmentRed = -0.0", ""]


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TYPED)) + """) v(i, s)), m AS (SELECT i, unnest(regexp_extract_all(s, '{p}', 1)) AS key, unnest(regexp_extract_all(s, '{p}', 2)) AS v FROM t) SELECT i, key, CASE WHEN v[1:1] = '"' THEN 'text' WHEN v IN ('true', 'false') THEN 'flag' WHEN contains(v, '.') THEN 'float' ELSE 'integer' END AS kind, TRY_CAST(v AS DOUBLE) + 0.0 AS number FROM m""".replace("{p}", scalars.SETTING).replace("TRY_CAST(v AS DOUBLE)", "CASE WHEN v NOT IN ('true', 'false') THEN TRY_CAST(v AS DOUBLE) END"))
def develop_types(spark: SparkSession, d: str) -> DataFrame:
    """Settings with their types."""
    rows = spark.createDataFrame(list(enumerate(_TYPED)), "i int, s string")
    return rows.select("i", F.explode(scalars.develop_typed(F.col("s"))).alias("key", "v")).select("i", "key", "v.kind", (F.col("v.number") + F.lit(0.0)).alias("number"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {str(v).lower()})" for i, flags in enumerate(({"Look": True}, {"ColorGrade": True}, {}, {})) for k, v in ({p: False for p in (*scalars.STYLES, "Look")} | flags).items()) + ") v(i, style, used)")
def style_flags(spark: SparkSession, d: str) -> DataFrame:
    """Styles that settings texts use."""
    rows = spark.createDataFrame(list(enumerate(_TYPED)), "i int, s string")
    return rows.select("i", F.explode(scalars.style_flags(F.col("s"))).alias("style", "used"))


@query("SELECT c_custkey AS photo_id, CASE WHEN c_custkey % 2 = 0 THEN 'Exposure2012, Tint' ELSE 'Exposure2012' END AS names, round(log2(greatest(c_acctbal, 1e-6)), 6) + 0.0 AS light, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS n FROM customer")
def setting_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Settings that are shown, light in stops, and JSON that can or can't be read."""
    n = F.col("c_custkey")
    settings = F.create_map(F.lit("Exposure2012"), F.lit("1"), F.lit("Tint"), F.when(n % 2 == 0, "2"), F.lit("Other"), F.lit("3"))
    text = F.when(n % 3 != 0, F.concat(F.lit('{"n": '), n.cast("string"), F.lit("}"))).otherwise("{oops")
    kept = scalars.kept_settings(settings, ["Exposure2012", "Tint"])
    return T(spark, d, "customer").select(n.alias("photo_id"), scalars.setting_names(kept).alias("names"), (F.round(scalars.log_light(F.col("c_acctbal")), 6) + F.lit(0.0)).alias("light"), scalars.decoded(text, "n long")["n"].alias("n"))
