"""The public surface, and the way of a job through the bridge."""

import pytest

from tonalis.plans import api_queries, fixtures, record_queries
from tonalis.plans.api import Bridge, BridgeError, Engine, Report, autocorrect, dispatch, same_selection, shown
from tonalis.sources import models
from tonalis.streaming.queue import Ledger


@pytest.fixture(scope="module")
def engine(spark):
    photos = spark.createDataFrame([(1, 0, 0, None, ["a"], {"Exposure2012": "0.5"}, True), (2, 3, 1, "red", [], {}, False)], "photo_id long, rating int, flag int, color string, keywords array<string>, develop map<string,string>, selected boolean")
    collections = spark.createDataFrame([(1, None, "Best", "set"), (2, 1, "1", "collection"), (3, 1, "Deep", "set"), (4, 3, "New", "collection"), (5, 1, "Best", "collection"), (9, None, "New", "collection")], "id long, parent long, name string, kind string")
    members = spark.createDataFrame([(5, 1)], "collection_id long, photo_id long")
    presets = spark.createDataFrame([("p1", "f", "Soft", {"Exposure2012": "1.0", "Dehaze": "2"}), ("p2", "e", "Soft", {}), ("Soft", "z", "Hard", {"Dehaze": "9"})], "preset_id string, folder string, name string, settings map<string,string>")
    return Engine(photos, collections, members, presets)


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "photo_id long")


def test_changes(spark, engine):
    get = lambda df, c: {r["photo_id"]: r[c] for r in df.collect()}
    table, report = engine.set_rating(ids(spark, 1, 9), 5)
    assert get(table, "rating") == {1: 5, 2: 3} and report == Report(2, 1, 1, ("uuid not found: 9",))
    assert get(engine.set_flag_color(ids(spark, 2), flag="reject")[0], "flag") == {1: 0, 2: -1}
    assert get(engine.set_keywords(ids(spark, 1), ["b"], ["a"])[0], "keywords") == {1: ["b"], 2: []}
    assert get(engine.apply_preset(ids(spark, 1), "p1")[0], "develop") == {1: {"Exposure2012": "1.0", "Dehaze": "2"}, 2: {}}
    assert get(engine.apply_preset(ids(spark, 1), "Soft")[0], "develop")[1] == {"Exposure2012": "0.5", "Dehaze": "9"}
    assert engine.apply_preset(ids(spark, 1), "none")[1].answer()["error"] == "0/1 applied. preset not found: none"
    assert engine.selected().columns == [c for c in engine.photos.columns if c != "develop"] and engine.selected().count() == 1
    for bad in (lambda: engine.set_rating(ids(spark, 1), 6), lambda: engine.set_flag_color(ids(spark, 1)), lambda: engine.set_flag_color(ids(spark, 1), flag="x"), lambda: engine.set_keywords(ids(spark, 1))):
        with pytest.raises(ValueError):
            bad()
    assert same_selection(ids(spark, 1, 1), engine) and not same_selection(ids(spark, 1, 2), engine)


def test_reports():
    assert Report(0, 0, 0).answer() == {"status": "ok", "applied": 0, "matched": 0, "total": 0}
    assert Report(3, 0, 0).answer()["error"] == "0/3 applied. no matching photo"
    assert Report(9, 2, 2, tuple("abcde"), 2).answer()["errors_summary"] == "a | b | c | d | e | +2 more"


def test_collections(spark, engine):
    # one without a set first, then set by set, a set's own collections before those of the sets in it
    assert engine.find_collection("New").first()["id"] == 9 and engine.find_collection("1").first()["id"] == 2 and engine.find_collection("Best").first()["id"] == 5
    assert engine.find_set("Best").first()["id"] == 1 and engine.find_set("Deep").first()["id"] == 3 and engine.find_set("New").first() is None
    same, found = engine.create_collection("Best", "1")
    assert found == {"name": "Best", "id": "5", "created": True} and same.count() == 6
    more, found = engine.create_collection("Best", "nowhere")
    assert found["created"] and more.where(f"id = {found['id']}").first()["parent"] is None and more.count() == 7
    table, report = engine.add_to_collection("Best", ids(spark, 1, 2, 9))
    assert sorted(map(tuple, table.collect())) == [(5, 1), (5, 2)] and report.applied == 2 and report.errors == ("uuid not found: 9",)
    table, report = engine.add_to_collection("none", ids(spark, 1))
    assert table.count() == 1 and report.status == "error"


def test_json_leaves_out_what_is_absent(spark):
    photos = spark.sql("SELECT 1 AS photo_id, 'p' AS path, named_struct('iso', 100, 'camera', CAST(NULL AS STRING)) AS exif, map('Tint', '1') AS develop")
    assert shown(photos, False).first()["json"] == '{"photo_id":1,"path":"p","exif":{"iso":100}}'
    assert shown(photos, True).first()["json"].endswith('"current_develop":{"Tint":"1"}}')


def test_jobs_go_through_the_bridge(spark, engine):
    now = [0]
    bridge = Bridge(engine, Ledger(most=2), lambda: now[0])
    assert bridge.status() == {"connected": False, "last_poll_s_ago": None, "pending_jobs": 0}
    with pytest.raises(BridgeError):
        bridge.require()
    assert bridge.run("test") == {"status": "ok"} and bridge.status()["connected"]
    bridge.require()
    assert bridge.run("set_rating", {"photo_ids": [1], "rating": 2})["applied"] == 1 and bridge.engine.photos.where("rating = 2").count() == 1
    assert [p["photo_id"] for p in bridge.run("get_selected_photos")["photos"]] == [1]
    assert bridge.run("create_collection", {"name": "x", "parent": "Deep"})["data"]["created"] and bridge.engine.find_collection("x").count() == 1
    for kind, payload in (("nothing", {}), ("set_rating", {"photo_ids": [1], "rating": 9}), ("set_rating", {}), ("add_to_collection", {"collection": "?", "photo_ids": [1]})):
        with pytest.raises(BridgeError):
            bridge.run(kind, payload)
    jobs = [bridge.submit("test"), bridge.submit("list_develop_presets")]
    with pytest.raises(BridgeError):
        bridge.submit("test")
    with pytest.raises(BridgeError):
        bridge.fetch(jobs[0])
    assert bridge.poll() == jobs[0] and not bridge.hand_in(99, {"status": "ok"})
    now[0] = 2_000_000_000
    bridge.submit("test")  # evicts both
    with pytest.raises(BridgeError):
        bridge.fetch(jobs[0])
    made = spark.createDataFrame([(1, "t/1", None), (2, "t/2", None)], "photo_id long, thumbnail_path string, error string")
    assert [t["photo_id"] for t in dispatch(engine, "get_thumbnails", {}, made)[1]["thumbnails"]] == [1]
    assert [t["photo_id"] for t in dispatch(engine, "render_probe", {"adjustments": [{"photo_id": 2}]}, made)[1]["thumbnails"]] == [2]


def test_models_on_disk(spark, tmp_path):
    folder = str(tmp_path / "models")
    known = record_queries._models(spark)
    models.save(known, folder)
    models.save(known.where("model_profile = '3'").withColumn("at", known["at"] + 1), folder)
    (tmp_path / "models" / "file=cam__broken").mkdir()
    (tmp_path / "models" / "file=cam__broken" / "part-0.json").write_text("{ not json")
    wanted = spark.createDataFrame([("cam", "3"), ("cam", "2"), ("cam", "broken"), (None, None)], "camera string, model_profile string")
    got = {r["model_profile"]: r["at"] for r in models.load(spark, folder, wanted).collect()}
    assert got == {"3": 5.0, "2": 1.0, "broken": None, None: None}


def test_autocorrect(spark, sf_dir):
    photos, tables = fixtures.record_tables(spark, sf_dir)
    few = photos.where("photo_id < 60")
    plan = autocorrect(few, tables, record_queries._models(spark), frozenset({"expo", "wb"}))
    done = plan.adjustments().collect()
    assert done and all({"Temperature", "Tint", "WhiteBalance"} <= set(r["develop"]) for r in done) and {r["mode"] for r in plan.counts.collect()} == {"seeds"}
    with pytest.raises(ValueError):
        autocorrect(photos.where("false"), tables, record_queries._models(spark))


def test_fixture_engine(spark, sf_dir):
    assert api_queries._engine(spark, sf_dir).catalog().count() > 0
