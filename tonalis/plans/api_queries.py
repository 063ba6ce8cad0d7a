"""Queries over the engine's public surface, response models and reports, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import match, planes, reports
from ..sources import models
from . import fixtures as fx, oracle as o
from .api import Engine
from .photo_queries import query, r6

T = fx.table


def _engine(spark: SparkSession, d: str) -> Engine:
    n = F.col("c_custkey")
    photos = T(spark, d, "customer").select(n.alias("photo_id"), (n % 6).cast("int").alias("rating"), (n % 3 - 1).cast("int").alias("flag"), F.lower("c_mktsegment").alias("color"), F.array("c_mktsegment", F.lit("old")).alias("keywords"), F.create_map(F.lit("Exposure2012"), (n % 7).cast("string"), F.lit("Contrast2012"), (n % 50).cast("string")).alias("develop"), (n % 4 == 0).alias("selected"))
    row = lambda t, key, shift, parent, name, kind: T(spark, d, t).select((F.col(key) + shift).cast("long").alias("id"), parent.cast("long").alias("parent"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    collections = row("region", "r_regionkey", 1000, F.lit(None), "r_name", "set").unionByName(row("nation", "n_nationkey", 2000, F.col("n_regionkey") + 1000, "n_name", "set")).unionByName(row("supplier", "s_suppkey", 10000, F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey") + 2000), "s_name", "collection"))
    members = T(spark, d, "customer").where("c_custkey % 10 = 0").select((F.col("c_custkey") % 20 + 10001).alias("collection_id"), n.alias("photo_id"))
    presets = T(spark, d, "part").where("p_partkey <= 100").select(F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("preset_id"), F.col("p_brand").alias("folder"), F.col("p_type").alias("name"), F.create_map(F.lit("Contrast2012"), F.lit("10"), F.lit("Dehaze"), (F.col("p_size") % 9).cast("string")).alias("settings"))
    return Engine(photos, collections, members, presets)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """Photos of orders, some of them unknown."""
    return T(spark, d, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") * 2).alias("photo_id"))


_WANTED = "w AS (SELECT DISTINCT o_custkey * 2 AS photo_id FROM orders WHERE o_orderkey % 3 = 0)"


@query("SELECT c_custkey AS photo_id, CAST(c_custkey % 6 AS INTEGER) AS rating, lower(c_mktsegment) AS color FROM customer WHERE c_custkey % 4 = 0")
def api_selected(spark: SparkSession, d: str) -> DataFrame:
    """Selected photos."""
    return _engine(spark, d).selected().select("photo_id", "rating", "color")


@query("SELECT c_custkey AS photo_id, c_custkey % 7 || '' AS exposure FROM customer")
def api_catalog(spark: SparkSession, d: str) -> DataFrame:
    """All photos with their settings."""
    return _engine(spark, d).catalog(True).select("photo_id", F.element_at("develop", "Exposure2012").alias("exposure"))


@query(f"WITH {_WANTED} SELECT c_custkey AS photo_id, CASE WHEN w.photo_id IS NOT NULL THEN 4 ELSE CAST(c_custkey % 6 AS INTEGER) END AS rating FROM customer LEFT JOIN w ON w.photo_id = c_custkey")
def api_rating(spark: SparkSession, d: str) -> DataFrame:
    """Photos rated."""
    return _engine(spark, d).set_rating(_ids(spark, d), 4)[0].select("photo_id", "rating")


@query(f"WITH {_WANTED} SELECT c_custkey AS photo_id, CASE WHEN w.photo_id IS NOT NULL THEN -1 ELSE CAST(c_custkey % 3 - 1 AS INTEGER) END AS flag, lower(c_mktsegment) AS color FROM customer LEFT JOIN w ON w.photo_id = c_custkey")
def api_flag(spark: SparkSession, d: str) -> DataFrame:
    """Photos flagged; the colour stays."""
    return _engine(spark, d).set_flag_color(_ids(spark, d), flag="reject")[0].select("photo_id", "flag", "color")


@query(f"WITH {_WANTED} SELECT c_custkey AS photo_id, array_to_string(list_sort(CASE WHEN w.photo_id IS NOT NULL THEN [c_mktsegment, 'new'] ELSE [c_mktsegment, 'old'] END), '|') AS keywords FROM customer LEFT JOIN w ON w.photo_id = c_custkey")
def api_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Photos with a keyword added and one removed."""
    return _engine(spark, d).set_keywords(_ids(spark, d), ["new"], ["old"])[0].select("photo_id", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@query(f"WITH {_WANTED} SELECT c_custkey AS photo_id, CASE WHEN w.photo_id IS NOT NULL AND c_custkey % 5 <> 0 THEN '1.5' ELSE c_custkey % 7 || '' END AS exposure, c_custkey % 50 || '' AS contrast FROM customer LEFT JOIN w ON w.photo_id = c_custkey")
def api_apply(spark: SparkSession, d: str) -> DataFrame:
    """Planned settings laid over the present ones; empty plans change nothing."""
    plan = _ids(spark, d).distinct().select("photo_id", F.when(F.col("photo_id") % 5 != 0, F.create_map(F.lit("Exposure2012"), F.lit("1.5"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("develop"))
    return _engine(spark, d).apply_adjustments(plan)[0].select("photo_id", F.element_at("develop", "Exposure2012").alias("exposure"), F.element_at("develop", "Contrast2012").alias("contrast"))


@query(f"WITH {_WANTED}, x AS (SELECT CASE WHEN c_custkey IS NULL THEN 'uuid not found: ' || photo_id WHEN photo_id % 5 = 0 THEN 'empty develop for ' || photo_id END AS e, photo_id FROM w LEFT JOIN customer ON c_custkey = photo_id) SELECT 'ok' AS status, (SELECT count(*) FROM x) AS total, (SELECT count(*) FROM x WHERE e IS NULL) AS applied, (SELECT string_agg(e, ' | ' ORDER BY photo_id, e) FROM (SELECT e, photo_id FROM x WHERE e IS NOT NULL ORDER BY photo_id, e LIMIT 5)) || ' | +' || ((SELECT count(*) FROM x WHERE e IS NOT NULL) - 5) || ' more' AS errors_summary")
def api_apply_report(spark: SparkSession, d: str) -> DataFrame:
    """What applying a plan is answered with."""
    plan = _ids(spark, d).distinct().select("photo_id", F.when(F.col("photo_id") % 5 != 0, F.create_map(F.lit("Exposure2012"), F.lit("1.5"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("develop"))
    answer = _engine(spark, d).apply_adjustments(plan)[1].answer()
    return spark.createDataFrame([tuple(answer[k] for k in ("status", "total", "applied", "errors_summary"))], "status string, total long, applied long, errors_summary string")


_NODES = "SELECT r_regionkey + 1000 AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name, 'set' AS kind FROM region UNION ALL SELECT n_nationkey + 2000, n_regionkey + 1000, n_name, 'set' FROM nation UNION ALL SELECT s_suppkey + 10000, CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey + 2000 END, s_name, 'collection' FROM supplier"
_TREE = f"nodes AS ({_NODES}), tree AS (SELECT id, parent, name, kind, 0 AS depth, name AS path, [CASE kind WHEN 'set' THEN 1 ELSE 0 END, id] AS place FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, n.name, n.kind, t.depth + 1, t.path || '/' || n.name, t.place || [CASE n.kind WHEN 'set' THEN 1 ELSE 0 END, n.id] FROM nodes n JOIN tree t ON n.parent = t.id)"


@query(f"WITH RECURSIVE {_TREE} SELECT id, name, kind, depth, path, row_number() OVER (ORDER BY place) AS n FROM tree")
def collection_tree(spark: SparkSession, d: str) -> DataFrame:
    """Collections and sets in the order of the tree."""
    from ..operators.store import chunked

    tree = _engine(spark, d).tree().select(F.col("id").cast("long").alias("id"), "name", "kind", "depth", "path", "place")
    return chunked(tree, "place", 1).select("id", "name", "kind", "depth", "path", (F.col("chunk") + 1).alias("n"))


@query(f"WITH RECURSIVE {_TREE}, asked AS (SELECT unnest(['Supplier#000000007', '10003', 'none', 'ASIA']) AS ref) SELECT ref, (SELECT arg_min(t.id, place) FROM tree t WHERE kind = 'collection' AND (CAST(t.id AS VARCHAR) = ref OR name = ref)) AS collection, (SELECT arg_min(t.id, place) FROM tree t WHERE kind = 'set' AND (CAST(t.id AS VARCHAR) = ref OR name = ref)) AS \"set\" FROM asked")
def collection_find(spark: SparkSession, d: str) -> DataFrame:
    """Collections and sets found by id or name."""
    engine = _engine(spark, d)
    first = lambda df: (r := df.first()) and int(r["id"])
    return spark.createDataFrame([(ref, first(engine.find_collection(ref)), first(engine.find_set(ref))) for ref in ("Supplier#000000007", "10003", "none", "ASIA")], "ref string, collection long, set long")


@query(f"WITH {_WANTED} SELECT DISTINCT collection_id, photo_id FROM (SELECT c_custkey % 20 + 10001 AS collection_id, c_custkey AS photo_id FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 10003, photo_id FROM w JOIN customer ON c_custkey = photo_id)")
def collection_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of collections after known photos were added to one."""
    return _engine(spark, d).add_to_collection("10003", _ids(spark, d))[0]


@query(f"WITH {_WANTED}, p AS (SELECT p_size % 9 AS dehaze FROM part WHERE p_partkey <= 100 AND p_type = (SELECT p_type FROM part WHERE p_partkey = 7) ORDER BY p_brand, 'id' || p_partkey LIMIT 1) SELECT c_custkey AS photo_id, CASE WHEN w.photo_id IS NOT NULL THEN '10' ELSE c_custkey % 50 || '' END AS contrast, CASE WHEN w.photo_id IS NOT NULL THEN (SELECT dehaze FROM p) || '' END AS dehaze FROM customer LEFT JOIN w ON w.photo_id = c_custkey")
def api_preset(spark: SparkSession, d: str) -> DataFrame:
    """A preset, found by name, laid over photos' settings."""
    engine = _engine(spark, d)
    name = T(spark, d, "part").where("p_partkey = 7").first()["p_type"]
    return engine.apply_preset(_ids(spark, d), name)[0].select("photo_id", F.element_at("develop", "Contrast2012").alias("contrast"), F.element_at("develop", "Dehaze").alias("dehaze"))


@query("SELECT 'id' || p_partkey AS preset_id, p_brand AS folder, p_type AS name FROM part WHERE p_partkey <= 100")
def api_presets(spark: SparkSession, d: str) -> DataFrame:
    """Presets and their folders."""
    return _engine(spark, d).list_presets()


@query(f"WITH {_WANTED} SELECT c_custkey AS photo_id, 't/' || c_custkey AS thumbnail_path FROM customer JOIN w ON w.photo_id = c_custkey WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0")
def api_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails of the wanted photos among those selected."""
    made = T(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("photo_id"), F.concat(F.lit("t/"), F.col("c_custkey").cast("string")).alias("thumbnail_path"))
    return _engine(spark, d).thumbnails(made, _ids(spark, d))


_FILE = "regexp_replace(replace(coalesce(nullif(replace(c_name, '|', '_'), ''), 'unknown') || '|' || coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN '' END, ''), 'unknown'), '|', '__'), '[/\\\\ :*?\"<>=%]', '_', 'g')"


@query(f"SELECT DISTINCT {_FILE} AS file FROM customer")
def model_files(spark: SparkSession, d: str) -> DataFrame:
    """Names under which response models are kept."""
    profile = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 0, "")
    return T(spark, d, "customer").select(models.file_key(F.col("c_name"), profile).alias("file")).distinct()


_CH = ("mean_r", "mean_g", "mean_b", "luma", "gr", "gb")
_LIN = lambda t: f"SELECT photo_id, avg(r/255.0e0)+1e-9 AS mean_r, avg(g/255.0e0)+1e-9 AS mean_g, avg(b/255.0e0)+1e-9 AS mean_b, avg(0.2126e0*(r/255.0e0)+0.7152e0*(g/255.0e0)+0.0722e0*(b/255.0e0)) AS luma, (avg(g/255.0e0)+1e-9)/(avg(r/255.0e0)+1e-9) AS gr, (avg(g/255.0e0)+1e-9)/(avg(b/255.0e0)+1e-9) AS gb FROM {t} GROUP BY 1"


@query(o.with_(o.PX, f"c AS ({_LIN('px')})") + f"SELECT photo_id, {o.rounded(*_CH)} FROM c")
def channel_means(spark: SparkSession, d: str) -> DataFrame:
    """Channels, luma and ratios of each picture."""
    return r6(reports.channels(fx.linear_pixels(spark, d)), *_CH)


@query(o.with_(o.PX, o.PT, f"a AS ({_LIN('px')})", f"b AS ({_LIN('pt')})", "v AS (SELECT unnest(['luma', 'gr', 'gb']) AS what, unnest([log2(b.luma/a.luma), (b.gr/a.gr-1)*100, (b.gb/a.gb-1)*100]) AS v FROM a JOIN b USING (photo_id) WHERE a.luma > 0 AND b.luma > 0)") + "SELECT what, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS least, round(max(v), 5) AS most FROM v GROUP BY 1")
def source_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets between two sources in light and colour."""
    other = fx.camera_pixels(spark, d).select("photo_id", *[(F.col(c) / F.lit(255.0)).alias(f"l{c}") for c in "rgb"])
    found = reports.source_offsets(reports.channels(fx.linear_pixels(spark, d)), reports.channels(other))
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "std", "least", "most")})


_RY = "(0.2880402e0*(r/255.0e0)+0.7118741e0*(g/255.0e0)+0.0000857e0*(b/255.0e0))"
_RM = ("y_mean", "y_median", "y_p25", "y_p75", "hl", "sh", "gr", "gb")
_RMSQL = f"rm AS (SELECT photo_id, avg({_RY}) AS y_mean, median({_RY}) AS y_median, quantile_cont(0.2880e0*(r/255.0e0)+0.7119e0*(g/255.0e0)+0.0001e0*(b/255.0e0), 0.25) AS y_p25, quantile_cont(0.2880e0*(r/255.0e0)+0.7119e0*(g/255.0e0)+0.0001e0*(b/255.0e0), 0.75) AS y_p75, 100*avg(CASE WHEN greatest(r,g,b)/255.0e0 >= 0.99 THEN 1.0e0 ELSE 0 END) AS hl, 100*avg(CASE WHEN {_RY} <= 0.0008 THEN 1.0e0 ELSE 0 END) AS sh, avg(g/255.0e0+1e-9)/avg(r/255.0e0+1e-9) AS gr, avg(g/255.0e0+1e-9)/avg(b/255.0e0+1e-9) AS gb FROM px GROUP BY 1)"


@query(o.with_(o.PX, _RMSQL) + f"SELECT photo_id, {o.rounded(*_RM)} FROM rm")
def raw_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of linear pictures."""
    return r6(reports.raw_metrics(fx.linear_pixels(spark, d)), *_RM)


_GT = ("raw_ymean", "raw_hl", "raw_gr", "emb_ymean", "fin_ymean", "fin_contrast")


@query(o.with_(o.PX, _RMSQL, o.PHOTO.split("photo0 AS")[0] + "e0 AS (SELECT vec_id AS photo_id, ((vec_id*17) % 41 - 20) / 10.0e0 AS exposure FROM embeddings)")
       + "SELECT photo_id || '' AS photo, exposure AS exposure2012, round_even(y_mean*1e5, 0)/1e5 AS raw_ymean, round_even(hl*100, 0)/100 AS raw_hl, round_even(gr*1e4, 0)/1e4 AS raw_gr, CASE WHEN photo_id % 3 <> 0 THEN round_even(y_mean*1e5, 0)/1e5 ELSE 0.0 END AS emb_ymean, 0.0e0 AS fin_ymean, 0.0e0 AS fin_contrast FROM rm JOIN e0 USING (photo_id)")
def ground_truth_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth rows, absent pictures as zeros."""
    found = reports.raw_metrics(fx.linear_pixels(spark, d)).withColumns({"asshot_rg": F.lit(1.0), "asshot_bg": F.lit(1.0), "contrast": F.lit(0.5)})
    part = F.struct(*[c for c in found.columns if c != "photo_id"])
    exif = F.struct(F.lit(100).alias("iso"), F.lit(2.8).alias("f"), F.lit(0.01).alias("shutter_s"), F.lit(50.0).alias("focal"))
    develop = fx.settings(fx.photos(spark, d)).select("photo_id", "develop")
    whole = found.select("photo_id", F.col("photo_id").cast("string").alias("photo"), F.lit("c").alias("catalog"), exif.alias("exif"), part.alias("raw"), F.when(F.col("photo_id") % 3 != 0, part).alias("embedded"), F.when(F.lit(False), part).alias("final")).join(develop, "photo_id")
    return reports.ground_truth(whole).select("photo", "exposure2012", *_GT)


_TW = ", ".join(f"sum(t.{c}/(d+1e-6))/sum(1/(d+1e-6)) AS {c}" for c in match.TONE)


@query(o.with_(o.PX, o.LAB, o.SH, o.SCOPE, o.tone("sh", "t"), o.PHOTO, o.KNN, f"x AS (SELECT k.photo_id, {_TW} FROM knn k JOIN t ON t.photo_id = k.seed_id AND scope = 'sharp' GROUP BY 1)") + f"SELECT photo_id, {o.rounded(*match.TONE)} FROM x")
def knn_target_tone(spark: SparkSession, d: str) -> DataFrame:
    """The weighted tone of each photo's references."""
    photos = fx.photos(spark, d)
    near = match.nearest(photos.where("NOT is_seed"), photos.where("is_seed"))
    tones = planes.measured(fx.pictures(spark, d)).select("photo_id", F.col("sharp.tone").alias("tone"))
    return r6(match.target_tone(near, tones).select("photo_id", "tone.*"), *match.TONE)



