"""Queries over keyed tables, catalogs, studies, collections and the job bridge, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import quantiles, store, studies
from ..sources import images
from . import fixtures as fx, oracle as o
from .photo_queries import query, r6

T = fx.table


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("uuid"))
    wanted = e.withColumn("hash", F.sha1(F.concat_ws(":", F.col("uuid").cast("string"), F.lit("v6"))))
    stale = F.when(F.col("uuid") % 5 == 0, F.lit("old")).otherwise(F.col("hash"))
    cache = wanted.where("uuid % 3 <> 0").select("uuid", stale.alias("hash"), F.when(F.col("uuid") % 7 != 0, F.lit("{}")).alias("tone"))
    return wanted, cache


@query("SELECT vec_id AS uuid, sha1(vec_id || ':v6') AS hash FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0 OR vec_id % 7 = 0")
def freshness_misses(spark: SparkSession, d: str) -> DataFrame:
    """Photos to measure again: missing, stale, or without tone."""
    return store.misses(*_cache(spark, d), ["uuid", "hash"], "tone")


@query("""SELECT o_custkey AS uuid, o_orderkey AS hash, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last written row of each key."""
    rows = T(spark, d, "orders").select(F.col("o_custkey").alias("uuid"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").alias("value"))
    return store.latest(rows, ["uuid"], "at").select("uuid", F.col("at.o_orderkey").alias("hash"), "value")


@query("""SELECT coalesce(n.uuid, o.uuid) AS uuid, CASE WHEN o.uuid IS NOT NULL THEN o.is_seed ELSE 0 END AS is_seed, CASE WHEN n.uuid IS NOT NULL THEN coalesce(n.p, o.p) ELSE o.p END AS profile_capture, CASE WHEN n.uuid IS NOT NULL THEN n.at ELSE o.at END AS cached_at
FROM (SELECT vec_id AS uuid, CAST(vec_id % 10 = 0 AS INTEGER) AS is_seed, 'p' || label AS p, 1.0e0 AS at FROM embeddings WHERE vec_id % 2 = 0) o
FULL JOIN (SELECT vec_id AS uuid, CASE WHEN vec_id % 4 <> 0 THEN 'n' || label END AS p, 2.0e0 AS at FROM embeddings WHERE vec_id % 3 = 0) n ON o.uuid = n.uuid""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Pictures put into the cache: references stay marked, a null profile doesn't erase a known one."""
    e = T(spark, d, "embeddings")
    n = F.col("vec_id")
    old = e.where("vec_id % 2 = 0").select(n.alias("uuid"), (n % 10 == 0).cast("int").alias("is_seed"), F.concat(F.lit("p"), F.col("label").cast("string")).alias("profile_capture"), F.lit(1.0).alias("cached_at"))
    new = e.where("vec_id % 3 = 0").select(n.alias("uuid"), F.lit(0).alias("is_seed"), F.when(n % 4 != 0, F.concat(F.lit("n"), F.col("label").cast("string"))).alias("profile_capture"), F.lit(2.0).alias("cached_at"))
    return store.upsert(old, new, "uuid", keep=("is_seed",), fill=("profile_capture",))


@query("""SELECT coalesce(n.uuid, o.uuid) AS uuid, CASE WHEN n.uuid IS NOT NULL THEN 1 ELSE o.is_seed END AS is_seed, coalesce(o.at, n.at) AS cached_at
FROM (SELECT vec_id AS uuid, 0 AS is_seed, 1.0e0 AS at FROM embeddings WHERE vec_id % 2 = 0) o FULL JOIN (SELECT vec_id AS uuid, 2.0e0 AS at FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 = 1) n ON o.uuid = n.uuid""")
def seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Photos marked as references, put in where they are new."""
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("uuid"))
    old = e.where("uuid % 2 = 0").select("uuid", F.lit(0).alias("is_seed"), F.lit(1.0).alias("cached_at"))
    return store.upsert(old, e.where("uuid % 10 IN (0, 1)").select("uuid", F.lit(1).alias("is_seed"), F.lit(2.0).alias("cached_at")), "uuid", keep=("cached_at",))


_CONTRAST, _EXPO = "CAST(CAST(vec_id % 50 AS DOUBLE) AS VARCHAR)", "CAST(CAST(vec_id % 7 AS DOUBLE) AS VARCHAR)"


@query(f"""SELECT vec_id AS photo_id, sha1('{{"Contrast2012":' || {_CONTRAST} || ',"Exposure2012":' || {_EXPO} || '}}') AS hash_develop, sha1('{{"Contrast2012":' || {_CONTRAST} || '}}v6') AS hash_style FROM embeddings""")
def style_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Freshness of all settings, and of those that change a neutral render."""
    n = F.col("vec_id")
    settings = F.create_map(F.lit("Exposure2012"), (n % 7).cast("double"), F.lit("Contrast2012"), (n % 50).cast("double"))
    return T(spark, d, "embeddings").select(n.alias("photo_id"), scalars.develop_hash(settings).alias("hash_develop"), scalars.style_hash(settings, ["Contrast2012", "Dehaze"], "v6").alias("hash_style"))


@query("SELECT p_partkey AS id, p_name AS name, s_name AS lens, round_even(round(pow(2, p_size / 2.0e0) * 10, 6), 0) / 10 AS f_number, round(pow(2, -CAST(p_size AS DOUBLE)), 6) AS shutter_s FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def ground_truth_join(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with their lens, if known, and APEX values decoded."""
    size = F.col("p_size").cast("double")
    j = T(spark, d, "part").join(T(spark, d, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    return j.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("s_name").alias("lens"), F.bround(F.pow(F.lit(2.0), size / 2.0), 1).alias("f_number"), F.round(F.pow(F.lit(2.0), -size), 6).alias("shutter_s"))


@query("""SELECT uuid, max(name) FILTER (size = top) AS name, any_value(top) AS size FROM (SELECT *, max(size) OVER (PARTITION BY uuid) AS top FROM (
  SELECT l_orderkey AS uuid, name, coalesce(TRY_CAST(regexp_extract(name, '_([0-9]+)$', 1) AS BIGINT), -1) AS size FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'f-' || l_orderkey ELSE 'f-' || l_orderkey || '_' || CAST(l_quantity AS BIGINT) END AS name FROM lineitem))) GROUP BY uuid""")
def largest_preview(spark: SparkSession, d: str) -> DataFrame:
    """The largest preview file of each photo."""
    base = F.concat(F.lit("f-"), F.col("l_orderkey").cast("string"))
    name = F.when(F.col("l_linenumber") % 3 == 0, base).otherwise(F.concat_ws("_", base, F.col("l_quantity").cast("long").cast("string")))
    return images.largest_preview(T(spark, d, "lineitem").select(F.col("l_orderkey").alias("uuid"), name.alias("name")))


@query("SELECT coalesce(CASE WHEN c_nationkey % 7 <> 0 THEN c_mktsegment END, '?') AS camera, count(*) AS n FROM customer GROUP BY 1")
def camera_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Photos of each camera."""
    camera = F.coalesce(F.when(F.col("c_nationkey") % 7 != 0, F.col("c_mktsegment")), F.lit("?"))
    return T(spark, d, "customer").groupBy(camera.alias("camera")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera")


@query("SELECT c_nationkey AS catalog, arg_min(c_mktsegment, struct_pack(n := -n, f := f)) AS profile FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) GROUP BY 1")
def mode_profile(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent profile of each catalog, the first seen where two tie."""
    each = T(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("f"))
    return each.groupBy(F.col("c_nationkey").alias("catalog")).agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "f")).alias("profile"))


@query("""SELECT catalog, key, count(DISTINCT coalesce(v, '∅')) = 1 AS constant FROM (SELECT c_nationkey AS catalog, unnest(['segment', 'sign', 'same', 'rare']) AS key, unnest([c_mktsegment, CASE WHEN c_acctbal > 0 THEN '+' ELSE '-' END, 'x', CASE WHEN c_custkey % 100 = 0 THEN 'y' END]) AS v FROM customer) GROUP BY 1, 2""")
def constant_keys(spark: SparkSession, d: str) -> DataFrame:
    """Settings that are the same all over a catalog; an absent one counts as a value."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("v")) for k, v in (("segment", F.col("c_mktsegment")), ("sign", F.when(F.col("c_acctbal") > 0, "+").otherwise("-")), ("same", F.lit("x")), ("rare", F.when(F.col("c_custkey") % 100 == 0, "y")))])
    rows = T(spark, d, "customer").select(F.col("c_nationkey").alias("catalog"), F.explode(entries).alias("e")).select("catalog", "e.key", F.coalesce("e.v", F.lit("∅")).alias("v"))
    # constant iff least and largest are one value: no distinct sets
    return rows.groupBy("catalog", "key").agg((F.min("v") == F.max("v")).alias("constant"))


@query(o.with_(o.PX, o.LAB, "f AS (SELECT photo_id, median(l) AS l FROM lab GROUP BY 1), s AS (SELECT median(l) AS m, stddev_pop(l) AS sd, quantile_cont(l, 0.05) AS p05, quantile_cont(l, 0.95) AS p95 FROM f)") + "SELECT photo_id, round(l - m, 6) + 0.0 AS delta, round(m, 6) AS median_l, round(sd, 6) AS std, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM f, s ORDER BY abs(round(l - m, 6)) DESC, photo_id LIMIT 10")
def series_deviation(spark: SparkSession, d: str) -> DataFrame:
    """The ten photos farthest from their series."""
    rows = fx.photos(spark, d).select("photo_id", "median_l", F.lit(0).alias("series"))
    q = quantiles.quantiles(rows, "series", "median_l", (0.5, 0.05, 0.95)).select("series", F.col("q")[0].alias("m"), F.col("q")[1].alias("p05"), F.col("q")[2].alias("p95"))
    whole = rows.groupBy("series").agg(F.stddev_pop("median_l").alias("std")).join(q, "series")
    out = rows.join(F.broadcast(whole), "series").select("photo_id", (F.col("median_l") - F.col("m")).alias("delta"), F.col("m").alias("median_l"), "std", "p05", "p95")
    return r6(out, "delta", "median_l", "std", "p05", "p95").orderBy(F.abs("delta").desc(), "photo_id").limit(10)


@query("SELECT l_returnflag AS scope, round(stddev_pop(log2(l_extendedprice / m)), 6) AS sigma FROM lineitem JOIN (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1")
def sigma_stops(spark: SparkSession, d: str) -> DataFrame:
    """Spread in stops around the median."""
    rows = T(spark, d, "lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_extendedprice").alias("v"))
    middle = quantiles.quantiles(rows, "scope", "v", (0.5,)).select("scope", F.col("q")[0].alias("m"))
    return r6(rows.join(F.broadcast(middle), "scope").groupBy("scope").agg(F.stddev_pop(F.log2(F.col("v") / F.col("m"))).alias("sigma")), "sigma")


_XY = "(SELECT c_nationkey AS k, o_totalprice AS y, c_acctbal AS x FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"""WITH r AS {_XY}, f AS (SELECT k, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, avg(x) AS mx, var_pop(x) AS vx, stddev_pop(y) AS base FROM r GROUP BY 1 HAVING count(*) >= 20)
SELECT k, n, round(slope, 6) + 0.0 AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(sqrt(avg(pow((y - slope*x - intercept) / greatest(1e-6, 1 - (1.0e0/n + pow(x-mx, 2)/(vx*n))), 2))), 4) AS loo, round(base, 4) AS base FROM r JOIN f USING (k) GROUP BY k, n, slope, intercept, r2, base""")
def regress_loo(spark: SparkSession, d: str) -> DataFrame:
    """Least squares with leave-one-out error."""
    rows = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("x"))
    out = r6(studies.regress(rows, "k", "x", "y"), "slope", "r2")
    return out.withColumns({c: F.round(c, 4) for c in ("intercept", "loo", "base")})


_MOM = "mom AS (SELECT profile, count(*) AS n, avg(rg) AS m1, avg(bg) AS m2, avg(temperature) AS my, covar_pop(rg,rg) AS s11, covar_pop(rg,bg) AS s12, covar_pop(rg,temperature) AS s1y, covar_pop(bg,bg) AS s22, covar_pop(bg,temperature) AS s2y, covar_pop(temperature,temperature) AS syy FROM photo GROUP BY 1), fit AS (SELECT *, (s1y*s22-s2y*s12)/(s11*s22-s12*s12) AS a, (s2y*s11-s1y*s12)/(s11*s22-s12*s12) AS b FROM mom), fitc AS (SELECT *, my-a*m1-b*m2 AS c FROM fit)"


@query(o.with_(o.PX, o.LAB, o.PHOTO, _MOM) + "SELECT f.profile AS fit_on, p.profile AS tested_on, round(sqrt(avg(pow(temperature - f.a*rg - f.b*bg - f.c, 2))), 3) AS rmse FROM fitc f, photo p GROUP BY 1, 2")
def cross_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Error of each profile's fit on each other's photos."""
    m = studies.moments(fx.photos(spark, d), "profile", "rg", "bg", "temperature")
    fit = studies.plane(m).select(F.col("profile").alias("fit_on"), "a", "b", "c")
    return studies.plane_error(fit, m.withColumnRenamed("profile", "tested_on")).withColumn("rmse", F.round("rmse", 3))


@query(o.with_(o.PX, o.LAB, o.PHOTO, "z AS (SELECT *, temperature-2450.0e0*rg AS z FROM photo WHERE is_seed), i AS (SELECT profile, count(*) AS n, median(z) AS intercept, stddev_pop(temperature) AS spread, median(tint) AS tint, median(exposure) AS exposure FROM z GROUP BY 1), e AS (SELECT profile, CASE WHEN count(*) = 1 THEN 0 ELSE sqrt(avg(pow(z-intercept, 2))) END AS residual FROM z JOIN i USING (profile) GROUP BY 1)") + "SELECT profile, n, round(intercept, 4) AS intercept, round(residual, 4) AS residual, round(spread, 4) AS spread, tint, exposure, CASE WHEN n < 4 OR spread < 150 THEN 'uncertain' WHEN residual/spread <= 0.5 THEN 'physics' WHEN residual/spread >= 0.7 THEN 'artistic' ELSE 'uncertain' END AS regime FROM i JOIN e USING (profile)")
def wb_regime(spark: SparkSession, d: str) -> DataFrame:
    """White-balance calibration of each profile's references, and what kind it is."""
    out = studies.white_balance(fx.photos(spark, d).where("is_seed"), "profile")
    return out.withColumns({c: F.round(c, 4) for c in ("intercept", "residual", "spread")})


@query("SELECT l_suppkey AS band, round(CASE WHEN count(*) < 2 OR var_pop(l_quantity)*count(*) < 1e-9 THEN 0 ELSE coalesce(regr_slope(l_extendedprice, l_quantity), 0) END, 4) AS slope FROM lineitem GROUP BY 1")
def response_fit(spark: SparkSession, d: str) -> DataFrame:
    """Slope of a probed response for each band."""
    return T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("band")).agg(F.round(studies.guarded_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("SELECT l_suppkey AS photo_id, count(*) AS n, round(avg(l), 6) AS mean_l, round(median(l), 6) AS median_l FROM (SELECT *, 116*(CASE WHEN ty > pow(6.0e0/29,3) THEN pow(ty, 1.0e0/3) ELSE ty/(3*pow(6.0e0/29,2))+4.0e0/29 END)-16 AS l FROM (SELECT l_suppkey, 0.2126729e0*" + o.linear("r") + "+0.7151522e0*" + o.linear("g") + "+0.0721750e0*" + o.linear("b") + " AS ty FROM (SELECT l_suppkey, l_partkey%256 AS r, (l_orderkey*7+l_linenumber)%256 AS g, (l_suppkey*13+l_partkey*3)%256 AS b FROM lineitem))) GROUP BY 1")
def big_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Lightness of large pictures."""
    from ..functions import color

    rgb = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("photo_id"), (F.col("l_partkey") % 256).alias("r"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 256).alias("g"), ((F.col("l_suppkey") * 13 + F.col("l_partkey") * 3) % 256).alias("b"))
    lum = color.lab(F.col("r"), F.col("g"), F.col("b"))[0]
    return rgb.withColumn("l", lum).groupBy("photo_id").agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("mean_l"), F.round(F.median("l"), 6).alias("median_l"))


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk FROM orders")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows in chunks of fifty."""
    return store.chunked(T(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 50)


@query("SELECT CASE WHEN c_custkey IS NULL THEN 'uuid not found' WHEN o_orderkey % 11 = 0 THEN 'empty develop' ELSE 'applied' END AS status, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = o_custkey GROUP BY 1")
def apply_report(spark: SparkSession, d: str) -> DataFrame:
    """What became of each adjustment."""
    wanted = T(spark, d, "orders").select(F.col("o_custkey").alias("photo_id"), F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(3).alias("n_settings"))
    return store.apply_report(wanted, T(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("photo_id")))


@query("SELECT o_custkey AS photo_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(list(o_orderpriority), ['new', 'x']), lambda k: k NOT IN ('x', '5-LOW')))), '|') AS keywords FROM orders GROUP BY 1")
def keyword_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with some added and some removed."""
    old = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("photo_id")).agg(F.collect_set("o_orderpriority").alias("old"))
    return old.select("photo_id", F.array_join(store.keywords(F.col("old"), F.array(F.lit("new"), F.lit("x")), F.array(F.lit("x"), F.lit("5-LOW"))), "|").alias("keywords"))


@query("SELECT vec_id AS photo_id, unnest(['Contrast2012', 'Dehaze', 'Exposure2012']) AS key, unnest([10.0e0, CAST(label AS DOUBLE), CAST(vec_id % 7 AS DOUBLE)]) AS value FROM embeddings")
def preset_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Settings with a preset laid over them."""
    now = F.create_map(F.lit("Exposure2012"), (F.col("vec_id") % 7).cast("double"), F.lit("Contrast2012"), (F.col("vec_id") % 50).cast("double"))
    preset = F.create_map(F.lit("Contrast2012"), F.lit(10.0), F.lit("Dehaze"), F.col("label").cast("double"))
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), F.explode(store.overlay(now, preset)).alias("key", "value"))


@query("SELECT path, bool_or(raw) AS need_raw, bool_or(emb) AS need_emb, row_number() OVER (ORDER BY min(struct_pack(l := l, n := n))) AS place FROM (SELECT c_custkey AS path, true AS raw, false AS emb, 0 AS l, -c_custkey AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, false, true, 1, o_orderkey FROM orders) GROUP BY 1")
def path_union(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two lists in the order in which they first come, and what each is wanted for."""
    raw = T(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), (-F.col("c_custkey")).alias("at"))
    return store.ordered_union({"need_raw": raw, "need_emb": T(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("at"))})



_TEXTS = ['s = { Exposure2012 = 0.5, Temperature = 5200, WhiteBalance = "Custom", Look = { Name = "Vivid", Amount = 1 } }', "Exposure2012 = 1, Exposure2012 = -2.25, EnableCalibration = true", "nothing here", ""]


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TEXTS)) + """) v(i, s)), m AS (SELECT i, unnest(regexp_extract_all(s, '{p}', 1)) AS key, unnest(regexp_extract_all(s, '{p}', 2)) AS v, unnest(range(len(regexp_extract_all(s, '{p}', 1)))) AS n FROM t) SELECT i, key, trim(arg_max(v, n), '"') AS value FROM m GROUP BY 1, 2""".replace("{p}", scalars.SETTING))
def develop_parse(spark: SparkSession, d: str) -> DataFrame:
    """Settings read from develop texts."""
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "i int, s string")
    return rows.select("i", F.explode(scalars.develop_map(F.col("s"))).alias("key", "value"))
