"""The engine's public surface: one object over the tables of a catalogue.

Reading methods return DataFrames.  Changing methods return the new version of
the table that they change, so a caller writes it where it belongs, and a report:
how many photos were wanted, known and changed, and what went wrong.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import planner, records, store
from ..sources import catalog
from ..streaming.queue import Ledger

# The flags of a photo.
FLAGS = {"pick": 1, "reject": -1, "none": 0}
AXES = planner.AXES
#: Errors that a report tells in full.
TOLD = 5


@dataclass(frozen=True)
class Report:
    """What became of a batch: ok if anything was applied or there was nothing to do."""

    total: int
    matched: int
    applied: int
    errors: tuple[str, ...] = ()
    more: int = 0

    @property
    def status(self) -> str:
        """ok or error."""
        return "ok" if self.applied or not self.total else "error"

    def answer(self) -> dict:
        """The report as it is sent: the first errors joined, and how many more."""
        told = " | ".join(self.errors) + (f" | +{self.more} more" if self.more else "")
        out = {"status": self.status, "applied": self.applied, "matched": self.matched, "total": self.total}
        if self.status == "error":
            out["error"] = f"0/{self.total} applied. {self.errors[0] if self.errors else 'no matching photo'}"
        return out | ({"errors_summary": told} if told else {})


@dataclass
class Engine:
    """``photos`` has ``photo_id``, ``rating``, ``flag``, ``color``, ``keywords``, ``develop`` (a map of texts) and ``selected``; ``collections`` has ``id``, ``parent``, ``name``, ``kind`` (set, collection); ``members`` has ``collection_id``, ``photo_id``; ``presets`` has ``preset_id``, ``folder``, ``name``, ``settings``."""

    photos: DataFrame
    collections: DataFrame
    members: DataFrame
    presets: DataFrame

    def catalog(self, include_develop: bool = False) -> DataFrame:
        """All photos."""
        return self.photos if include_develop else self.photos.drop("develop")

    def selected(self, include_develop: bool = False) -> DataFrame:
        """Selected photos."""
        return self.catalog(include_develop).where("selected")

    def thumbnails(self, made: DataFrame, photo_ids: DataFrame | None = None) -> DataFrame:
        """Thumbnails that were ``made`` (``photo_id``, ``thumbnail_path``, ``error``) of selected photos; of the wanted ones among them, if any are named."""
        mine = made.join(self.photos.where("selected").select("photo_id"), "photo_id", "left_semi")
        return mine if photo_ids is None or photo_ids.isEmpty() else mine.join(photo_ids.select("photo_id"), "photo_id", "left_semi")

    def _reported(self, wanted: DataFrame, empty: DataFrame | None = None) -> Report:
        """The report for ``wanted`` photos, which may be named more than once; ``empty`` are those without anything to apply."""
        state = catalog.resolve(wanted.select("photo_id"), self.photos.where("selected"), self.photos)
        errors = state.where("found = 'missing'").select("photo_id", F.concat(F.lit("uuid not found: "), F.col("photo_id").cast("string")).alias("e"))
        if empty is not None:
            errors = errors.unionByName(empty.join(self.photos.select("photo_id"), "photo_id", "left_semi").select("photo_id", F.concat(F.lit("empty develop for "), F.col("photo_id").cast("string")).alias("e")))
        total, bad = wanted.count(), errors.count()
        told = tuple(r["e"] for r in errors.orderBy("photo_id", "e").limit(TOLD).collect())
        return Report(total, total - bad, total - bad, told, max(0, bad - TOLD))

    def _changed(self, photo_ids: DataFrame, **values: Column) -> tuple[DataFrame, Report]:
        hit = photo_ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
        joined = self.photos.join(hit, "photo_id", "left")
        table = joined.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in values.items()}).select(self.photos.columns)
        return table, self._reported(photo_ids)

    def set_rating(self, photo_ids: DataFrame, rating: int) -> tuple[DataFrame, Report]:
        """Photos with a rating from 0 to 5."""
        if not 0 <= rating <= 5:
            raise ValueError("a rating is 0 to 5")
        return self._changed(photo_ids, rating=F.lit(rating))

    def set_flag_color(self, photo_ids: DataFrame, flag: str | None = None, color: str | None = None) -> tuple[DataFrame, Report]:
        """Photos with a flag, a colour label, or both; what isn't given stays."""
        if flag is None and color is None:
            raise ValueError("neither flag nor color")
        if flag is not None and flag not in FLAGS:
            raise ValueError(f"a flag is one of {', '.join(FLAGS)}")
        return self._changed(photo_ids, **({"flag": F.lit(FLAGS[flag])} if flag else {}), **({"color": F.lit(color)} if color else {}))

    def set_keywords(self, photo_ids: DataFrame, add: list[str] | None = None, remove: list[str] | None = None) -> tuple[DataFrame, Report]:
        """Photos with keywords added, then removed."""
        if not add and not remove:
            raise ValueError("neither add nor remove")
        names = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
        return self._changed(photo_ids, keywords=store.keywords(F.col("keywords"), names(add), names(remove)))

    def apply_adjustments(self, adjustments: DataFrame) -> tuple[DataFrame, Report]:
        """Photos with planned settings (``photo_id``, ``develop``) laid over theirs."""
        new = adjustments.where(F.size("develop") > 0).select("photo_id", F.col("develop").alias("_new"))
        joined = self.photos.join(new, "photo_id", "left")
        table = joined.withColumn("develop", F.when(F.col("_new").isNotNull(), store.overlay(F.col("develop"), F.col("_new"))).otherwise(F.col("develop"))).select(self.photos.columns)
        return table, self._reported(adjustments, adjustments.where("develop IS NULL OR size(develop) = 0").select("photo_id"))

    def tree(self) -> DataFrame:
        """Collections and sets with their ``depth``, ``path`` of names and ``place``: collections before sets, by id, sets before what is in them.

        A walk goes down one level a step, so it takes as many steps as sets are nested.
        """
        step = "concat(CASE WHEN {a}.kind = 'set' THEN '1' ELSE '0' END, lpad(CAST({a}.id AS STRING), 19, '0'))"
        return self.collections.sparkSession.sql(
            f"WITH RECURSIVE tree AS (SELECT id, parent, name, kind, 0 AS depth, CAST(name AS STRING) AS path, {step.format(a='n')} AS place FROM {{nodes}} n WHERE parent IS NULL "
            f"UNION ALL SELECT n.id, n.parent, n.name, n.kind, t.depth + 1, concat(t.path, '/', n.name), concat(t.place, '/', {step.format(a='n')}) FROM {{nodes}} n JOIN tree t ON n.parent = t.id) SELECT * FROM tree",
            nodes=self.collections,
        )

    def _found(self, ref: str, kind: str) -> DataFrame:
        return self.tree().where((F.col("kind") == kind) & ((F.col("id").cast("string") == ref) | (F.col("name") == ref))).orderBy("place").limit(1)

    def find_collection(self, ref: str) -> DataFrame:
        """The first collection with that id or name: those without a set first, then set by set, a set's own before those of the sets in it."""
        return self._found(ref, "collection")

    def find_set(self, ref: str) -> DataFrame:
        """The first set with that id or name, a set before those in it."""
        return self._found(ref, "set")

    def create_collection(self, name: str, parent: str | None = None) -> tuple[DataFrame, dict]:
        """Collections with one of that name in a set (by id or name; an unknown one is the root), and the collection: one that was there already counts as created, too."""
        inside = self.find_set(parent).first() if parent else None
        below = inside["id"] if inside else None
        there = self.collections.where((F.col("name") == name) & (F.col("kind") == "collection") & F.col("parent").eqNullSafe(F.lit(below).cast("long"))).orderBy("id").first()
        if there:
            return self.collections, {"name": name, "id": str(there["id"]), "created": True}
        new = (self.collections.agg(F.max("id")).first()[0] or 0) + 1
        row = self.collections.sparkSession.createDataFrame([(new, below, name, "collection")], "id long, parent long, name string, kind string")
        return self.collections.unionByName(row), {"name": name, "id": str(new), "created": True}

    def add_to_collection(self, ref: str, photo_ids: DataFrame) -> tuple[DataFrame, Report]:
        """Members with the known ones of the photos added to a collection, each once; nothing is added where there is no such collection."""
        target = self.find_collection(ref).first()
        if target is None:
            return self.members, Report(photo_ids.count(), 0, 0, (f"collection not found: {ref}",))
        known = photo_ids.select("photo_id").join(self.photos.select("photo_id"), "photo_id", "left_semi")
        return self.members.unionByName(known.select(F.lit(target["id"]).cast("long").alias("collection_id"), "photo_id")).distinct(), self._reported(photo_ids)

    def list_presets(self) -> DataFrame:
        """Presets with their folders."""
        return self.presets.drop("settings")

    def find_preset(self, ref: str) -> DataFrame:
        """The preset of that id, else the first of that name by folder."""
        rank = F.when(F.col("preset_id") == ref, 0).otherwise(1)
        return self.presets.where((F.col("preset_id") == ref) | (F.col("name") == ref)).orderBy(rank, "folder", "preset_id").limit(1)

    def apply_preset(self, photo_ids: DataFrame, ref: str) -> tuple[DataFrame, Report]:
        """Photos with a preset, by id or else first name, laid over their settings."""
        chosen = self.find_preset(ref).first()
        if chosen is None:
            return self.photos, Report(photo_ids.count(), 0, 0, (f"preset not found: {ref}",))
        laid = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in sorted((chosen["settings"] or {}).items())])) if chosen["settings"] else F.from_json(F.lit("{}"), "map<string,string>")
        return self._changed(photo_ids, develop=store.overlay(F.col("develop"), laid))


def shown(photos: DataFrame, include_develop: bool) -> DataFrame:
    """Photos as JSON (``photo_id``, ``json``): absent parts of ``exif`` are left out, settings are there if asked for."""
    none = lambda: F.from_json(F.lit("{}"), photos.schema["exif"].dataType)
    parts = ["photo_id", "path", *([F.coalesce("exif", none()).alias("exif")] if "exif" in photos.columns else [])]
    return photos.select("photo_id", F.to_json(F.struct(*parts, *([F.col("develop").alias("current_develop")] if include_develop else []))).alias("json"))


def same_selection(planned: DataFrame, engine: Engine) -> bool:
    """Whether a plan is for just the photos that are selected."""
    return planner.same_photos(planned, engine.selected())


def dispatch(engine: Engine, kind: str, payload: dict, made: DataFrame | None = None) -> tuple[Engine, dict]:
    """Does one job of the bridge: the engine after it, and its answer; an unknown kind is an error.

    ``made`` are thumbnails or probe renders that a host has made for the job.
    """
    spark = engine.photos.sparkSession
    ids = lambda: spark.createDataFrame([(i,) for i in payload.get("photo_ids") or []], "photo_id long")
    rows = lambda df: [r.asDict(True) for r in df.collect()]

    def batch(field: str, change: tuple[DataFrame, Report]) -> tuple[Engine, dict]:
        return replace(engine, **{field: change[0]}), change[1].answer()

    def created(made_: tuple[DataFrame, dict]) -> tuple[Engine, dict]:
        return replace(engine, collections=made_[0]), {"status": "ok", "data": made_[1]}

    adjustments = lambda: spark.createDataFrame([(a["photo_id"], {k: str(v) for k, v in (a.get("develop") or {}).items()}) for a in payload.get("adjustments") or []], "photo_id long, develop map<string,string>")
    same: dict[str, Callable[[], dict]] = {
        "test": lambda: {"status": "ok"}, "get_selected_photos": lambda: {"status": "ok", "photos": rows(engine.selected(True))}, "get_catalog_photos": lambda: {"status": "ok", "photos": rows(engine.catalog(True))},
        "get_thumbnails": lambda: {"status": "ok", "thumbnails": rows(engine.thumbnails(made, ids())) if made is not None else []}, "render_probe": lambda: {"status": "ok", "thumbnails": rows(made.join(adjustments().select("photo_id"), "photo_id", "left_semi")) if made is not None else []},
        "list_collections": lambda: {"status": "ok", "data": {"collections": rows(engine.tree().orderBy("place"))}}, "list_develop_presets": lambda: {"status": "ok", "data": {"presets": rows(engine.list_presets())}},
    }
    changing: dict[str, Callable[[], tuple[Engine, dict]]] = {
        "apply_adjustments": lambda: batch("photos", engine.apply_adjustments(adjustments())), "set_rating": lambda: batch("photos", engine.set_rating(ids(), payload["rating"])), "set_flag_color": lambda: batch("photos", engine.set_flag_color(ids(), payload.get("flag"), payload.get("color"))),
        "set_keywords": lambda: batch("photos", engine.set_keywords(ids(), payload.get("add"), payload.get("remove"))), "add_to_collection": lambda: batch("members", engine.add_to_collection(payload["collection"], ids())), "apply_develop_preset": lambda: batch("photos", engine.apply_preset(ids(), payload["preset"])),
        "create_collection": lambda: created(engine.create_collection(payload["name"], payload.get("parent"))),
    }
    if kind in same:
        return engine, same[kind]()
    return changing[kind]() if kind in changing else (engine, {"status": "error", "error": f"unknown type: {kind}"})


class BridgeError(RuntimeError):
    """A job that couldn't be done: the bridge is gone, its queue is full, nobody answered in time, or the answer was an error."""


@dataclass
class Bridge:
    """Asks an engine by way of the job queue, as a caller outside the host does; ``clock`` gives microseconds."""

    engine: Engine
    ledger: Ledger
    clock: Callable[[], int]

    def __post_init__(self) -> None:
        self.payloads: dict[int, tuple[str, dict]] = {}
        self.answers: dict[int, dict] = {}
        self.last = 0

    def status(self) -> dict:
        """Whether the host polls, how long ago it did, and how many jobs wait."""
        now = self.clock()
        return {"connected": self.ledger.connected(now), "last_poll_s_ago": self.ledger.seconds_since_poll(now), "pending_jobs": self.ledger.pending()}

    def submit(self, kind: str, payload: dict | None = None) -> int:
        """Puts a job into the queue; an error if that is full."""
        self.last += 1
        taken, gone = self.ledger.submit(self.last, self.clock())
        for job in gone:
            self.payloads.pop(job, None)
            self.answers.pop(job, None)
        if not taken:
            raise BridgeError(f"{self.ledger.most} jobs wait already")
        self.payloads[self.last] = (kind, payload or {})
        return self.last

    def poll(self, made: DataFrame | None = None) -> int | None:
        """What the host does at each poll: takes the next job, does it, and hands in its answer; a failure is an answer, too."""
        job = self.ledger.poll(self.clock())
        if job is None:
            return None
        try:
            self.engine, answer = dispatch(self.engine, *self.payloads.pop(job), made)
        except (ValueError, KeyError) as e:
            answer = {"status": "error", "error": str(e)}
        self.hand_in(job, answer)
        return job

    def hand_in(self, job: int, answer: dict) -> bool:
        """Takes an answer; false if its job is unknown."""
        known = self.ledger.result(job, answer.get("status")) is not None
        if known:
            self.answers[job] = answer
        return known

    def fetch(self, job: int) -> dict:
        """The answer of a job, which is forgotten then; an error if there is none yet, or it is one."""
        state = self.ledger.take(job)
        if state not in ("done", "failed"):
            raise BridgeError(f"no answer to job {job}")
        answer = self.answers.pop(job)
        if state == "failed":
            raise BridgeError(answer.get("error") or f"job {job} failed")
        return answer

    def require(self) -> None:
        """An error unless the host polls."""
        if not self.ledger.connected(self.clock()):
            raise BridgeError("the host isn't connected")

    def run(self, kind: str, payload: dict | None = None, made: DataFrame | None = None) -> dict:
        """A whole round: submit, let the host poll until the job is done, fetch."""
        job = self.submit(kind, payload)
        while self.ledger.status(job) == "pending" and self.poll(made) is not None:
            pass
        return self.fetch(job)


def autocorrect(photos: DataFrame, tables: dict[str, DataFrame], models: DataFrame, axes: frozenset[str] = AXES, forced_embedded: bool = False) -> planner.Planned:
    """The whole way from signed photos and keyed tables to a plan: references, measures, the series' response, settings.

    An error where no photo can be measured.
    """
    seeds = records.seed_vectors(tables["pictures"], tables["source_raw"], tables["previews"])
    embedded = forced_embedded or seeds.isEmpty()
    rows = records.measures(photos, tables, embedded)
    if rows.isEmpty():
        raise ValueError("no photo can be measured: " + ("neutral renders or the cameras' own pictures are missing" if embedded else "current renders are missing"))
    return planner.plan(planner.series_response(rows, models), seeds, axes, forced_embedded)
