"""Queries that compare sources and look things up, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import compare, measure, planes
from ..sources import catalog
from . import fixtures as fx, oracle as o
from .photo_queries import query, r6

T = fx.table
_DELTAS = ("dchroma", "dsat", "dhue", "dl")
_BOTH = (o.PX, o.LAB, o.SH, o.SCOPE, o.CENTRES, o.bands("sh", "bd"), o.PT, o.PTLAB, o.PTSH, o.bands("ptsh", "bt"))


def _bands(spark: SparkSession, d: str, camera: bool) -> DataFrame:
    return planes.banded(planes.scopes(planes.measured(fx.pictures(spark, d, camera))))


@query(o.with_(*_BOTH) + "SELECT c.photo_id, c.band, round(c.median_chroma-r.median_chroma, 6)+0.0 AS dchroma, round(c.median_sat-r.median_sat, 6)+0.0 AS dsat, round(c.median_hue-r.median_hue, 6)+0.0 AS dhue, round(c.median_l-r.median_l, 6)+0.0 AS dl FROM bt c JOIN bd r ON c.photo_id=r.photo_id AND c.band=r.band AND c.scope='sharp' AND r.scope='sharp'")
def band_delta_join(spark: SparkSession, d: str) -> DataFrame:
    """Camera bands against RAW bands."""
    sharp = "scope = 'sharp'"
    return r6(compare.band_deltas(_bands(spark, d, True).where(sharp), _bands(spark, d, False).where(sharp)), *_DELTAS)


@query(o.with_(*_BOTH[:6]) + "SELECT photo_id, band, CASE WHEN frac >= 0.01 THEN sat_clip_frac >= 0.05 END AS oversat FROM bd WHERE scope='sharp'")
def raw_oversat_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether each RAW band is clipped, or unknown."""
    return _bands(spark, d, False).where("scope = 'sharp'").select("photo_id", "band", compare.oversaturated(F.col("frac"), F.col("sat_clip_frac")).alias("oversat"))


@query("SELECT vec_id AS photo_id, round(a, 6) AS area, CASE WHEN a < 0.8 THEN 'sharp' ELSE 'global' END AS variant FROM (SELECT vec_id, greatest(0, CASE WHEN vec_id%5=0 THEN 1.0e0 ELSE (vec_id%10)/10.0e0 END - (vec_id%3)/20.0e0) * greatest(0, 1.0e0-(vec_id%4)/20.0e0) AS a FROM embeddings)")
def crop_variant(spark: SparkSession, d: str) -> DataFrame:
    """The zone in which a cropped photo is measured."""
    n = F.col("vec_id")
    area = compare.crop_area((n % 3) / F.lit(20.0), F.when(n % 5 != 0, (n % 10) / F.lit(10.0)), (n % 4) / F.lit(20.0), F.lit(None).cast("double"))
    return T(spark, d, "embeddings").select(n.alias("photo_id"), F.round(area, 6).alias("area"), compare.scope_of(area).alias("variant"))


_JPEG = ("y_mean", "y_median", "gr", "gb", "hl", "sh", "contrast")
_Y = "(0.2126e0*lr+0.7152e0*lg+0.0722e0*lb)"
_JSQL = f"jm AS (SELECT photo_id, avg({_Y}) AS y_mean, median({_Y}) AS y_median, avg(lg)/avg(lr) AS gr, avg(lg)/avg(lb) AS gb, 100*avg(CASE WHEN {_Y} > 0.95 THEN 1.0e0 ELSE 0 END) AS hl, 100*avg(CASE WHEN {_Y} < 0.002 THEN 1.0e0 ELSE 0 END) AS sh, quantile_cont({_Y}, 0.9)-quantile_cont({_Y}, 0.1) AS contrast FROM lab GROUP BY 1)"


@query(o.with_(o.PX, o.LAB, _JSQL) + f"SELECT photo_id, {o.rounded(*_JPEG)} FROM jm")
def jpeg_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of finished pictures."""
    return r6(compare.jpeg_metrics(fx.pixels(spark, d)), *_JPEG)


@query(o.with_(o.PX, o.LAB, _JSQL) + "SELECT count(*) AS n, round(median(gr), 6) AS gr, round(stddev_pop(gr), 6) AS sd, round(quantile_cont(gr, 0.1), 6) AS p10, round(quantile_cont(gr, 0.9), 6) AS p90, round(100*avg(CASE WHEN gr < 0.9 THEN 1.0e0 ELSE 0 END), 6) AS warm, stddev_pop(gr) < 0.05 AS coherent FROM jm")
def warmth_summary(spark: SparkSession, d: str) -> DataFrame:
    """Warmth of the whole series."""
    return r6(compare.warmth(compare.jpeg_metrics(fx.pixels(spark, d))), "gr", "sd", "p10", "p90", "warm")


_M = "a AS (SELECT photo_id, median(l) AS v FROM lab GROUP BY 1), b AS (SELECT photo_id, median(l) AS v FROM ptlab GROUP BY 1), j AS (SELECT a.v AS a, b.v AS b FROM a JOIN b USING (photo_id))"


def _medians(spark: SparkSession, d: str) -> list[DataFrame]:
    return [measure.with_lab(p(spark, d)).groupBy("photo_id").agg(F.median("l").alias("v")) for p in (fx.pixels, fx.camera_pixels)]


@query(o.with_(o.PX, o.LAB, o.PT, o.PTLAB, _M) + "SELECT count(*) AS n, round(avg(abs(a-b)), 6) AS mean_abs, round(corr(a, b), 6) AS corr FROM j")
def parity_summary(spark: SparkSession, d: str) -> DataFrame:
    """How well two measurements agree."""
    return r6(compare.parity(*_medians(spark, d), "photo_id", "v"), "mean_abs", "corr")


@query(o.with_(o.PX, o.LAB, o.PT, o.PTLAB, _M) + "SELECT count(*) AS n, round(avg(log2(b/a)), 6) AS mean, round(stddev_pop(log2(b/a)), 6) AS std, round(min(log2(b/a)), 6) AS least, round(max(log2(b/a)), 6) AS most FROM j WHERE a > 0 AND b > 0")
def source_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Offset between two sources, in stops."""
    return r6(compare.source_deltas(*_medians(spark, d), "photo_id", "v"), "mean", "std", "least", "most")


@query("SELECT o_custkey AS photo_id, CASE WHEN o_custkey % 3 = 0 THEN 'selection' WHEN c_custkey IS NOT NULL THEN 'catalog' ELSE 'missing' END AS found FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey")
def photo_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Where wanted photos are found."""
    wanted = T(spark, d, "orders").select(F.col("o_custkey").alias("photo_id")).distinct()
    return catalog.resolve(wanted, wanted.where("photo_id % 3 = 0"), T(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("photo_id")))


@query("SELECT photo, coalesce(min(c), '?') AS catalog FROM (SELECT p_name AS photo FROM part GROUP BY 1) LEFT JOIN (SELECT p_name AS n, p_brand AS c FROM part WHERE p_size > 25) ON n = photo GROUP BY 1")
def first_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The first catalogue that lists a photo."""
    part = T(spark, d, "part")
    return catalog.first_catalog(part.select(F.col("p_name").alias("photo")).distinct(), part.where("p_size > 25").select(F.col("p_name").alias("photo"), F.col("p_brand").alias("catalog")))


@query("""WITH p AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a/b/' ELSE 'x/' END || c_custkey || '.ARW' AS path FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT 'A\\B/' || c_custkey || '.arw' AS src FROM customer), k AS (SELECT src, lower(replace(src, '\\', '/')) AS k FROM s)
SELECT src, coalesce(e.path, n.path) AS path FROM k LEFT JOIN (SELECT lower(path) AS k, min(path) AS path FROM p GROUP BY 1) e ON e.k = k.k LEFT JOIN (SELECT lower(split_part(path, '/', -1)) AS f, min(path) AS path FROM p GROUP BY 1) n ON n.f = split_part(k.k, '/', -1)""")
def path_match(spark: SparkSession, d: str) -> DataFrame:
    """Paths matched but for slashes and case, else by name."""
    key = F.col("c_custkey").cast("string")
    c = T(spark, d, "customer")
    paths = c.where("c_custkey % 5 <> 0").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "a/b/").otherwise("x/"), key, F.lit(".ARW")).alias("path"))
    return catalog.match_paths(c.select(F.concat(F.lit("A\\B/"), key, F.lit(".arw")).alias("src")), paths)


@query("SELECT DISTINCT coalesce(nullif(replace(c_name, '|', '_'), ''), 'unknown') || '|' || coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN '' END, ''), 'unknown') AS key FROM customer")
def model_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of response models."""
    profile = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 0, "")
    return T(spark, d, "customer").select(scalars.model_key(F.col("c_name"), profile).alias("key")).distinct()
