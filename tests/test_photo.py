"""Known answers, the SQL twins, the sources, and the stream against the batch."""

import math
import os
import sqlite3
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import __spark_entry__
from tonalis import registry
from tonalis.functions import color, scalars
from tonalis.operators import match, measure, planes, planner, planners, records, sharp_zone, store, studies
from tonalis.operators.quantiles import quantiles
from tonalis.plans import fixtures, record_queries
from tonalis.session import written
from tonalis.sources import catalog, images, previews
from tonalis.sources.sqlite import SqliteSource
from tonalis.streaming import bridge
from tonalis.streaming.queue import Ledger

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["tone_dual", "neutral_dual", "exposure_linear", "gray_world", "shutter_parse", "knn_target", "plan_wb_seeds", "plan_calibration", "freshness_misses", "cache_upsert", "seed_upsert", "style_hashes", "largest_preview", "constant_keys", "mode_profile", "wb_regime", "cross_catalog", "seed_curve", "job_queue_short", "job_status", "job_results", "queue_saturation", "job_routes", "late_thumbnails", "batch_report", "batch_chunks", "picture_table", "raw_light", "camera_deltas", "sharp_zone_light", "coherence", "report_lines", "rendered_previews", "smart_previews", "catalog_settings", "capture_profiles", "develop_types", "style_flags", "path_match", "collection_tree", "keyword_overlay", "preset_overlay", "path_union", "develop_parse"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_sql_twin(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_color_known_answers(spark):
    white = one(spark, *color.lab(F.lit(255), F.lit(255), F.lit(255)))
    assert math.isclose(white[0], 100, abs_tol=1e-4) and abs(white[1]) < 0.01 and abs(white[2]) < 0.02
    assert one(spark, *color.lab(F.lit(0), F.lit(0), F.lit(0)))[0] == 0
    assert one(spark, *color.hue_saturation(F.lit(0), F.lit(255), F.lit(0)))[0] == pytest.approx(120, abs=1e-6)
    assert [one(spark, color.nearest_band(F.lit(float(h))))[0] for h in (0, 330, 350, 36, 47.5, 134, 360)] == [0, 7, 0, 1, 1, 3, 0]
    assert all(-180 <= one(spark, color.hue_difference(F.lit(float(a)), F.lit(90.0)))[0] < 180 for a in range(0, 360, 45))
    assert [tuple(one(spark, *color.prophoto_to_srgb(F.lit(v), F.lit(v), F.lit(v)))) for v in (0.0, 1.0)] == [(0, 0, 0), (255, 255, 255)]


def test_response_known_answers(spark):
    point = lambda ev, lum: F.struct(F.lit(ev).alias("ev"), F.lit(lum).alias("l"))
    curve = F.array(point(-1.0, 33.0), point(0.0, 50.0), point(1.0, 67.0))
    assert one(spark, planners.slope_at(curve, F.lit(58.5)))[0] == 17.0 and one(spark, planners.slope_at(F.array(point(0.0, 50.0)), F.lit(5.0)))[0] == 17.0
    row = spark.range(1).select(F.lit(1.0).alias("at"), F.lit(0.0).alias("an"), F.lit(0.0).alias("bt"), F.lit(1.0).alias("bn"))
    assert tuple(row.select(*planners.solve_cast(F.lit(2.0), F.lit(3.0))).first()) == (-200.0, -3.0)
    zero = spark.range(1).select(*[F.lit(0.0).alias(c) for c in ("at", "an", "bt", "bn")])
    assert tuple(zero.select(*planners.solve_cast(F.lit(2.0), F.lit(3.0))).first()) == (0.0, 0.0)
    probes = spark.createDataFrame([(1, x, 0.6 * x + 2) for x in (-15.0, -8.0, 0.0, 8.0, 15.0)] + [(2, 1.0, 5.0)], "g int, x double, y double")
    assert {r["g"]: round(r["s"], 9) for r in probes.groupBy("g").agg(studies.guarded_slope("y", "x").alias("s")).collect()} == {1: 0.6, 2: 0.0}


def test_weighted_target(spark):
    near = spark.createDataFrame([(1, 10, 3.0 - 1e-6, 1), (1, 11, 1.0 - 1e-6, 2)], "photo_id long, seed_id long, d double, rank int")
    seeds = spark.createDataFrame([(10, 10.0, None, 5.0, 30.0), (11, 20.0, 1.0, 6.0, -20.0)], "photo_id long, temperature double, tint double, median_l double, red_hue double")
    fields = ["shadow_tint", "red_saturation", "green_hue", "green_saturation", "blue_hue", "blue_saturation"]
    r = match.targets(near, seeds.withColumns({f: F.lit(None).cast("double") for f in fields})).first()
    assert round(r["temperature"], 9) == 17.5 and r["tint"] == 1.0 and r["red_hue"] == 30.0 and r["blue_hue"] is None and r["seed_ids"] == [10, 11]


def test_circular_mean(spark):
    def mean(*degrees):
        s, c = sum(math.sin(math.radians(d)) for d in degrees), sum(math.cos(math.radians(d)) for d in degrees)
        return one(spark, scalars.circular_mean(F.lit(s), F.lit(c)))[0]

    assert mean(0, 90) == pytest.approx(45) and min(mean(10, 350), 360 - mean(10, 350)) == pytest.approx(0, abs=1e-9)


def test_band_limits(spark):
    base = dict(photo_id=1, band="Red", frac=0.5, median_hue=0.0, median_chroma=80.0, median_sat=0.5, sat_clip_frac=0.0, median_l=50.0, t_chroma=10.0, t_l=99.0, t_hue=90.0, g_sat=0.0, g_lum=0.0, g_hue=0.0)
    rows = [base | dict(photo_id=1, embedded=True, raw_oversat=None), base | dict(photo_id=2, embedded=False, raw_oversat=False), base | dict(photo_id=3, embedded=False, raw_oversat=True, frac=0.005)]
    schema = ", ".join(f"{k} {'long' if k == 'photo_id' else 'string' if k == 'band' else 'boolean' if k in ('embedded', 'raw_oversat') else 'double'}" for k in rows[0])
    got = {(r["photo_id"], r["key"]): r["value"] for r in planners.bands(spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], schema)).collect()}
    assert got == {(1, "SaturationAdjustmentRed"): -25.0, (1, "LuminanceAdjustmentRed"): 10.0, (1, "HueAdjustmentRed"): 8.0, (2, "LuminanceAdjustmentRed"): 20.0, (2, "HueAdjustmentRed"): 15.0}


def test_style_hash_ignores_neutralised_settings(spark):
    h = lambda **k: one(spark, scalars.style_hash(F.create_map(*[x for kv in k.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), ["Contrast2012"], "v"))[0]
    assert h(Contrast2012=1.0, Exposure2012=2.0) == h(Exposure2012=-1.0, Contrast2012=1.0) != h(Contrast2012=2.0)


def test_chunks_and_upsert(spark):
    got = store.chunked(spark.range(23).withColumnRenamed("id", "k").repartition(4), "k", 5).collect()
    assert {r["k"]: r["chunk"] for r in got} == {i: i // 5 for i in range(23)}
    old = spark.createDataFrame([(1, 1, "a"), (2, 0, "b")], "k int, seed int, p string")
    new = spark.createDataFrame([(2, 1, None), (3, 0, "c")], "k int, seed int, p string")
    assert sorted(map(tuple, store.upsert(old, new, "k", keep=("seed",), fill=("p",)).collect())) == [(1, 1, "a"), (2, 0, "b"), (3, 0, "c")]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INTEGER, b REAL, c TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, None if i % 3 else str(i)) for i in range(50)])
        c.execute("CREATE TABLE e (a INTEGER)")
    spark.dataSource.register(SqliteSource)
    read = lambda t: spark.read.format("sqlite").option("path", path).option("table", t).load()
    assert sorted(map(tuple, read("t").collect())) == [(i, i / 2, None if i % 3 else str(i)) for i in range(50)] and read("e").count() == 0


def test_jpeg_stream_and_previews(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ab\xff\xd8\xffxy")), (2, bytearray(b"\x0f\xfd\x8f\xf0")), (3, None)], "i int, b binary")
    assert {r["i"]: r["s"] and bytes(r["s"]) for r in rows.select("i", images.jpeg_stream(F.col("b")).alias("s")).collect()} == {1: b"\xff\xd8\xffxy", 2: None, 3: None}
    files = spark.createDataFrame([("u", "u-a_9"), ("u", "u-a_10"), ("v", "v-x")], "uuid string, name string")
    assert {r["uuid"]: r["name"] for r in images.largest_preview(files).collect()} == {"u": "u-a_10", "v": "v-x"}


def test_demosaic_of_a_flat_plane():
    y, x = np.mgrid[0:6, 0:6]
    assert np.allclose(planes.demosaic(np.full((6, 6), 0.4), (y % 2) + (x % 2)), 0.4, atol=1e-6)


def test_a_second_green_without_a_balance_has_the_first_ones():
    site = np.array([[0, 1], [3, 2]])
    got = planes.balanced(np.full((2, 2), 1064.0), site, np.array([2.0, 1.0, 1.5, 0.0]), np.full(4, 64.0), 2064.0)
    assert got.tolist() == [[1.0, 0.5], [0.5, 0.75]]
    assert np.allclose(planes.camera_matrix(np.array(fixtures.CAMERA_XYZ)) @ np.ones(3), 1.0)


def test_pictures_that_cannot_be_read_stay_as_nulls(spark, tmp_path):
    def png(path, w, h, channels):
        kind = {1: 0, 3: 2, 4: 6}[channels]
        rows = b"".join(b"\0" + bytes((10 * c + 3 * x + y) % 256 for x in range(w) for c in range(channels)) for y in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))

    for n in (1, 3, 4):
        png(tmp_path / f"c{n}.png", 4, 3, n)
    (tmp_path / "bad.png").write_bytes(b"no picture")
    found = {os.path.basename(r["path"]): r for r in images.pictures(spark, str(tmp_path)).collect()}
    assert set(found) == {"c1.png", "c3.png", "c4.png", "bad.png"} and found["bad.png"]["data"] is None
    for n in (1, 3, 4):
        rgb = np.frombuffer(found[f"c{n}.png"]["data"], np.uint8).reshape(3, 4, 3)
        assert rgb[2, 3].tolist() == [(10 * (c if n > 1 else 0) + 9 + 2) % 256 for c in range(3)]
    paths = spark.createDataFrame([(r["path"],) for r in found.values()] + [("gone",)], "path string")
    measured = planes.measured(images.wanted_pictures(spark, paths, str(tmp_path)).withColumn("photo_id", F.xxhash64("path"))).collect()
    assert sum(r["whole"] is not None for r in measured) == 3 and len(measured) == 5
    one = images.pictures(spark, str(tmp_path)).withColumn("photo_id", F.lit(1))
    best = images.first_readable(("thumbnail", one.where("path LIKE '%bad%'").drop("path")), ("preview", one.where("path LIKE '%c3%'").drop("path"))).first()
    assert best["channel"] == "preview" and best["data"] is not None
    none = images.first_readable(("thumbnail", one.where("path LIKE '%bad%'").drop("path")))
    assert none.first()["channel"] == "none" and "none 1" in images.channel_report(none)


def test_planes_measure_what_pixels_in_rows_do(spark, sf_dir):
    some = lambda df: df.where("photo_id < 40")
    rows = measure.analysed(some(fixtures.pixels(spark, sf_dir)))
    seen = planes.scopes(planes.measured(some(fixtures.pictures(spark, sf_dir))))
    for ours, theirs, keys in ((seen.select("photo_id", "scope", "r.tone.*"), measure.tone(rows), ["photo_id", "scope"]), (seen.select("photo_id", "scope", "r.neutral.*"), measure.neutral(rows), ["photo_id", "scope"]), (planes.banded(seen), measure.bands(rows), ["photo_id", "scope", "band"])):
        a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (ours, theirs))
        assert a.keys() == b.keys()
        assert all(math.isclose(a[k][c], b[k][c], abs_tol=1e-6) if isinstance(a[k][c], float) else a[k][c] == b[k][c] for k in a for c in ours.columns)


def test_sharp_clusters_equal_numpy():
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (24, 20, 3)).astype(np.uint8)
    small = rgb.reshape(12, 2, 10, 2, 3).astype(float).mean(axis=(1, 3))
    assert np.abs(sharp_zone.halved(rgb) - small).max() <= 0.5
    plane = rng.random((9, 7))
    k = np.exp(-0.5 * (np.arange(-4, 5)) ** 2.0)
    k /= k.sum()
    wide = np.pad(plane, 4, "reflect")
    brute = np.array([[sum(k[i] * k[j] * wide[y + i, x + j] for i in range(9) for j in range(9)) for x in range(7)] for y in range(9)])
    assert np.allclose(sharp_zone.blurred(plane, 1.0), brute)
    points = np.concatenate([rng.normal(c, 0.01, (30, 3)) for c in ((0.1, 0.1, 0.1), (0.9, 0.2, 0.1), (0.3, 0.6, 0.9))]).clip(0.001, 1)
    found = sharp_zone.clustered(points, 3)
    assert math.isclose(found["n_luma"], points[:30].mean(axis=0) @ sharp_zone.REC709, rel_tol=1e-9) and found["n_pct"] == 1 / 3
    assert found["n_chroma"] == np.ptp(points[:30].mean(axis=0)) and found["b_luma"] > found["n_luma"]
    assert sharp_zone.clustered(np.zeros((9, 3)), 3) is None and sharp_zone.zone_light(np.zeros((4, 4, 3), np.uint8), 1.0, 0.85, 99) is None


def test_sharp_zone_of_half_levels():
    # the second pixel of the second row is 153.5 grey, which a matrix product may make less
    levels = np.array([[[142, 186, 161, 137], [128, 142, 137, 94], [103, 102, 115, 78], [132, 146, 96, 161]], [[86, 46, 53, 126], [166, 168, 175, 120], [156, 100, 153, 131], [94, 114, 160, 156]], [[164, 107, 125, 127], [58, 109, 95, 91], [192, 85, 172, 72], [121, 146, 184, 122]]], np.uint8).T
    found, points = sharp_zone.zone_light(levels.repeat(2, axis=0).repeat(2, axis=1), 1.0, 0.85, 3)
    assert found["zone_px"] == 3 and np.array_equal(points, sharp_zone.linear(levels[[2, 2, 3], [0, 1, 0]]))
    every = np.stack(np.meshgrid(*[np.arange(0, 256, 3)] * 3), axis=-1).reshape(-1, 3).astype(np.uint8)
    assert sharp_zone.grey_levels(every).tolist() == [round(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in every.tolist()]


def test_queue_rules():
    q = Ledger(stale=900, most=2)
    second = 1_000_000
    assert q.submit(1, 0) == (True, []) and q.submit(2, second) == (True, []) and q.submit(3, 2 * second) == (False, [])
    assert q.poll(2 * second) == 1 and q.status(1) == "in_progress" and q.pending() == 1 and q.connected(7 * second) and not q.connected(8 * second)
    # nothing evicts but a submission, so a stale job is still handed out
    assert q.poll(2000 * second) == 2 and q.poll(2000 * second) is None
    assert q.result(1, "ok") == "done" and q.result(9, "ok") is None and q.result(2, "error") == "failed"
    assert q.take(1) == "done" and q.take(1) is None
    assert q.submit(4, 2001 * second) == (True, [2]) and q.status(2) is None
    # a job that ended while it waited keeps its place until a poll passes it
    assert q.result(4, "ok") == "done" and q.pending() == 1 and q.poll(2002 * second) is None and q.pending() == 0
    again = Ledger()
    again.load(q.dump())
    assert again.jobs == q.jobs and again.waiting == q.waiting and again.last_poll == q.last_poll
    assert Ledger().seconds_since_poll(5) is None and not Ledger().connected(5)


def test_stream_gives_the_batch_answer(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = fixtures.queue_events(spark, sf_dir).where("worker < 12")
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    q = bridge.queue_stream(spark.readStream.schema(events.schema).parquet(path), 172_800.0, 3).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    columns = ["worker", "seq", "kind", "job_id", "outcome", "waiting"]
    got, want = (sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) for df in (spark.table("replayed"), bridge.replay(spark.read.parquet(path), 172_800.0, 3)))
    assert got == want


def test_stored_tables(spark, tmp_path):
    none = records.opened(spark, str(tmp_path), "previews")
    assert none.count() == 0
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (None, "x", 1.0)], "uuid long, hash_preview string, cached_at double")
    table = records.put(none, rows, "previews")
    table.write.parquet(records.location(str(tmp_path), "previews"))
    stored = records.opened(spark, str(tmp_path), "previews")
    assert sorted((r["uuid"], r["hash_preview"]) for r in stored.collect()) == [(1, "b"), (2, "a")]
    again = records.put(stored, rows.where("uuid = 2").withColumn("hash_preview", F.lit("c")), "previews")
    assert sorted((r["uuid"], r["hash_preview"]) for r in again.collect()) == [(1, "b"), (2, "c")]
    wanted = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "uuid long, signature string")
    assert {r["uuid"]: r["found"] is not None for r in records.fresh("previews", again, wanted).collect()} == {1: True, 2: False, 3: False}
    assert records.misses("previews", again, wanted, force=True).count() == 3 and records.misses("previews", again, wanted).count() == 2


def test_anchors(spark):
    tone = lambda v: {"tone": dict.fromkeys(match.TONE, 0.0) | {"median_l": v}, "neutral": None, "bands": None}
    kind = records.empty(spark, "previews").schema["sharp"].dataType
    develop = "develop map<string,string>"
    photos = spark.createDataFrame([(1, "s", {"Exposure2012": "1.0"}), (2, "s", {"Exposure2012": "1.0"}), (3, "s", {"Exposure2012": "0.1"}), (4, "s", {})], f"photo_id long, hash_style string, {develop}")
    render = lambda *r: spark.createDataFrame([(i, tone(v)) for i, v in r], StructType([StructField("photo_id", LongType()), StructField("sharp", kind)]))
    previews_ = records.typed(render((1, 50.0), (2, 50.0), (3, 50.0)).withColumnRenamed("photo_id", "uuid"), "previews")
    kept = records.typed(render((4, 40.0)).withColumnRenamed("photo_id", "uuid").withColumn("hash_style", F.lit("s")), "neutral_previews")
    probed = render((1, 50.5), (2, 60.0), (3, 50.0), (4, 99.0))
    found, table = records.anchors(photos, kept, probed, render((1, 70.0)), previews_)
    assert {r["photo_id"]: r["found"]["sharp"]["tone"]["median_l"] for r in found.collect()} == {1: 70.0, 2: 60.0, 3: 50.0, 4: 40.0} and table.count() == 4
    for retried in (render((1, 49.0)), render((2, 70.0))):
        with pytest.raises(RuntimeError):
            records.anchors(photos, kept, probed, retried, previews_)


def test_plan_modes_and_axes(spark, sf_dir):
    shown, t = fixtures.record_tables(spark, sf_dir)
    seeds = written(records.seed_vectors(t["pictures"], t["source_raw"], t["previews"]), "seeds")
    rows = written(planner.responses(records.measures(shown, t, embedded=False).where("photo_id < 80"), record_queries._models(spark)), "rows")
    only = planner.plan(rows, seeds, frozenset({"hsl"}))
    assert {r["key"].rstrip("RedOrangYlwGnAquBPpiMt")[:3] for r in only.settings.collect()} <= {"Sat", "Lum", "Hue"} and only.settings.count() > 0
    assert {r["counter"] for r in only.counts.collect()} == {"n_targets", "n_unresolved", "hsl_written"}
    with pytest.raises(ValueError):
        planner.plan(rows, seeds, frozenset({"tone"}))
    whole = planner.plan(rows, seeds, frozenset({"wb"})).adjustments().first()["develop"]
    assert set(whole) == {"Temperature", "Tint", "WhiteBalance"} and whole["WhiteBalance"] == "Custom" and "." not in whole["Tint"]
    other = records.measures(shown, t, embedded=True).where("photo_id < 80")
    none = planner.plan(planner.responses(other, record_queries._models(spark)), seeds.where("false"), frozenset({"calib"}))
    assert none.settings.count() == 0 and {r["mode"] for r in none.counts.collect()} == {"embedded"}
    a = spark.range(5).withColumnRenamed("id", "photo_id")
    assert planner.same_photos(a, a.union(a)) and not planner.same_photos(a, a.where("photo_id < 4"))
    head, more = planner.first_and_rest(a, "photo_id", 3)
    assert [r["photo_id"] for r in head.collect()] == [0, 1, 2] and more == 2


def test_catalogue_lookups(spark, tmp_path):
    for name in ("b/two.lrcat", "a/one.lrcat", "a/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [os.path.basename(r["path"]) for r in catalog.catalogs(spark, str(tmp_path)).collect()] == ["one.lrcat", "two.lrcat"]
    files = spark.createDataFrame([("p",), ("p",), ("q",)], "baseName string")
    assert sorted(r["photo"] for r in catalog.base_names(files).collect()) == ["p", "q"]
    ids = spark.createDataFrame([("g1",), ("g2",)], "id_global string")
    assert {r["id_global"]: r["id_local"] for r in catalog.local_ids(ids, spark.createDataFrame([("g1", 7)], "id_global string, id_local long")).collect()} == {"g1": 7, "g2": None}
    row = one(spark, *catalog.bundle(F.lit("/x/Cat.lrcat")), images.preview_folder(F.lit("ABCDEF")))
    assert tuple(row) == ("/x/Cat Previews.lrdata", "/x/Cat Smart Previews.lrdata", "A/ABCD")


def test_studies_need_enough_rows(spark):
    features = spark.range(60).select(F.col("id").alias("photo"), (F.col("id") * 1.0).alias("rg"))
    develop = features.select("photo", F.when(F.col("photo") < 55, F.lit(5000.0)).alias("temperature"))
    assert studies.with_features(features, develop, "photo", ("temperature",)).count() == 55
    assert studies.with_features(features.where("photo < 50"), develop.where("photo > 5"), "photo", ("temperature",)).count() == 0
    assert one(spark, studies.camera_slope(F.lit("x")), studies.exposure_follows(F.lit("artistic")), studies.predicted_temperature(F.lit(2450.0), F.lit(0.0), F.lit(9.0)))[:] == (2450.0, False, 12000.0)
    assert [round(one(spark, studies.hue_near(F.lit(h), F.lit(350.0)))[0], 9) for h in (350.0, 10.0, 171.0, 169.0)] == [350.0, 370.0, 171.0, 529.0]


def test_preview_with_raw_and_smart(spark):
    paths = spark.createDataFrame([("g2", "/r/b.ARW"), ("g1", "/r/a.ARW"), ("g3", "/r/c.ARW"), ("g4", "/r/d.ARW")], "id_global string, path string")
    smart = spark.createDataFrame([("g1", "x"), ("g2", "x"), ("g3", None), ("g4", "x")], "id_global string, path string")
    got = previews.with_raw_and_smart(paths, paths.where("id_global <> 'g4'"), smart)
    assert [tuple(r) for r in got.collect()] == [("a", "g1", "/r/a.ARW"), ("b", "g2", "/r/b.ARW")]
    assert previews.with_raw_and_smart(paths, paths, smart, 1).count() == 1


def test_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=2000), "b": np.repeat([1.0, 5.0], [300, 1]), "c": np.array([7.0]), "d": 10.0 ** rng.uniform(-300, 300, 500), None: rng.integers(0, 3, 400).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = (0.0, 0.05, 0.5, 0.9, 1.0)
    for limit in (0, 10**9):
        got = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, "g", "v", shares, limit).collect()}
        assert got.keys() == values.keys()
        for k, v in values.items():
            assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, shares), rtol=1e-9)


def test_many_references_are_dealt_out(spark, sf_dir, monkeypatch):
    photos = fixtures.photos(spark, sf_dir).where("photo_id < 200")
    near = lambda: sorted(map(tuple, match.nearest(photos.where("NOT is_seed"), photos.where("is_seed")).collect()))
    few = near()
    monkeypatch.setattr(match, "FEW", 3)
    assert near() == few


def test_csv_rows_and_last_features(spark, tmp_path):
    (tmp_path / "f.csv").write_text("photo,a,b\nx,9,1\ny,1,z\nx,2,3\n")
    path = str(tmp_path / "f.csv")
    assert {r["photo"]: (r["a"], r["b"]) for r in catalog.csv_features(spark, path, ["a", "b"]).collect()} == {"x": (2.0, 3.0), "y": (1.0, None)}
    assert sorted(tuple(r) for r in catalog.csv_rows(spark, path, ["a", "b"], ("photo",)).collect()) == [("x", 2.0, 3.0), ("x", 9.0, 1.0)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(registry.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(__spark_entry__.SMOKE_DIR)
