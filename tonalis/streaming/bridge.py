"""The job bridge: queues replayed over a batch of events, and kept as the state of a stream.

Events are ``worker`` (the queue), ``ts``, ``seq`` (their order at one time),
``kind`` (submit, poll, result, wait), ``job_id`` (not for polls) and ``status``
(ok, or what went wrong, for results).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ship_package
from .queue import MOST, SILENCE, STALE, Ledger

REPLAYED = "worker long, seq long, kind string, job_id long, outcome string, waiting long"
_EVENT = ("worker", "seq", "kind", "job_id", "status", "us")


def _plain(events: DataFrame) -> DataFrame:
    return events.select(F.col("worker").cast("long").alias("worker"), F.col("seq").cast("long").alias("seq"), "kind", F.col("job_id").cast("long").alias("job_id"), "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def spans(events: DataFrame, stale: float = STALE) -> DataFrame:
    """Adds ``span``: events of a queue fall into spans that can be replayed apart.

    A submission more than ``stale`` after the one before evicts every older job,
    so nothing before it matters after it.  Such places are found from one row for
    each queue and stretch of ``stale`` seconds: where a stretch has none, the
    first submission after it begins a span.  It also ends the one before, as an
    event of the kind ``end``.
    """
    stretch = F.floor(F.col("us") / F.lit(int(stale * 1e6)))
    dealt = events.withColumn("stretch", stretch)
    each = dealt.groupBy("worker", "stretch").agg(F.min(F.when(F.col("kind") == "submit", F.struct("us", "seq"))).alias("first"))
    order = W.partitionBy("worker").orderBy("stretch")
    before = F.last(F.when(F.col("first").isNotNull(), F.col("stretch")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = each.withColumn("before", before).withColumn("starts", F.col("first").isNotNull() & (F.col("before").isNull() | (F.col("stretch") - F.col("before") > 1)))
    counted = starts.withColumn("span", F.sum(F.col("starts").cast("long")).over(order))
    early = F.col("starts") & (F.struct("us", "seq") < F.col("first"))
    joined = dealt.join(counted.select("worker", "stretch", "first", "starts", "span"), ["worker", "stretch"])
    whole = joined.withColumn("span", F.when(early, F.col("span") - 1).otherwise(F.col("span"))).drop("stretch", "first", "starts")
    none = lambda t: F.lit(None).cast(t)
    ends = counted.where("starts").select("worker", F.col("first.seq").alias("seq"), F.lit("end").alias("kind"), none("long").alias("job_id"), none("string").alias("status"), F.col("first.us").alias("us"), (F.col("span") - 1).alias("span"))
    return whole.select(ends.columns).unionByName(ends)


def replay(events: DataFrame, stale: float = STALE, most: int = MOST) -> DataFrame:
    """What becomes of each event, and of each job that is evicted, by the rules of ``Ledger``.

    Spans of a queue are replayed apart, each an event at a time, so a task holds
    the jobs of one queue and no more than ``stale`` seconds of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queue, out = None, Ledger(stale, most), []
        schema = pa.schema([("worker", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("job_id", pa.int64()), ("outcome", pa.string()), ("waiting", pa.int64())])
        for batch in batches:
            for worker, seq, kind, job, status, us, span in zip(*(batch[c].to_pylist() for c in (*_EVENT, "span")), strict=True):
                if now != (worker, span):
                    now, queue = (worker, span), Ledger(stale, most)
                if kind == "end":  # whatever is left goes as the next span's first job comes, which then waits alone
                    out += [(worker, seq, "evict", j, "evicted", 1) for j in queue.jobs]
                else:
                    out += [(worker, seq, *o) for o in queue.step(kind, job, status, us)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
            out = []

    ship_package(events.sparkSession)
    cut = spans(_plain(events), stale)
    return cut.repartition("worker", "span").sortWithinPartitions("worker", "span", "us", "seq").mapInArrow(work, REPLAYED)


def jobs(replayed: DataFrame) -> DataFrame:
    """The last status of each submitted job: rejected, pending, in_progress, done, failed or evicted, and the events that took and ended it.

    A job's rows meet by queue and number; a result that came too late is no
    part of them.
    """
    known = replayed.where("job_id IS NOT NULL AND outcome NOT IN ('unknown', 'ignored')")
    # a poll and a result may come in any order, and a later result overrides an earlier one
    step = F.when(F.col("kind") == "submit", 0).when(F.col("kind") == "evict", 2).otherwise(1)
    last = F.max(F.struct(step.alias("step"), F.when(F.col("kind") == "poll", F.lit(0)).otherwise(1).alias("ends"), "seq", "outcome"))
    return known.where("kind <> 'wait'").groupBy("worker", "job_id").agg(last.alias("l"), F.min(F.when(F.col("kind") == "poll", F.col("seq"))).alias("polled_by"), F.max(F.when(F.col("kind") == "result", F.col("seq"))).alias("result_by")).select("worker", "job_id", F.col("l.outcome").alias("status"), "polled_by", "result_by")


def pending(replayed: DataFrame) -> DataFrame:
    """Most jobs waiting at once in each queue, and how many were turned away."""
    return replayed.groupBy("worker").agg(F.max("waiting").alias("most"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))


def heartbeat_gaps(events: DataFrame, seconds: float = SILENCE) -> DataFrame:
    """Polls more than ``seconds`` after the queue's last one."""
    order = W.partitionBy("worker").orderBy("ts", "seq")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / F.lit(1e6)
    return events.where("kind = 'poll'").withColumn("gap", gap).where(F.col("gap") > seconds).select("worker", F.col("seq").alias("job_id"), "gap")


def heartbeat(events: DataFrame, now: Column, seconds: float = SILENCE) -> DataFrame:
    """For each queue the last poll's age in seconds at ``now``, null without any, whether it is connected, and whether callers must be refused."""
    last = events.groupBy("worker").agg(F.max(F.when(F.col("kind") == "poll", F.unix_micros("ts"))).alias("last"))
    age = (F.unix_micros(now) - F.col("last")) / F.lit(1e6)
    return last.select("worker", age.alias("seconds_since_poll"), F.coalesce(age <= seconds, F.lit(False)).alias("connected"))


def waited(replayed: DataFrame, events: DataFrame, seconds: float) -> DataFrame:
    """What a caller that submits a job and waits ``seconds`` gets: ok, error, timeout, or saturated.

    A result counts if it comes within the time and its job is known then.
    """
    at = events.select("worker", "seq", F.unix_micros("ts").alias("us"), "status")
    of = lambda kind, name: replayed.where(F.col("kind") == kind).select("worker", "job_id", "seq", "outcome").join(at, ["worker", "seq"]).select("worker", "job_id", F.col("us").alias(name), "outcome")
    first = of("result", "ended").where("outcome <> 'unknown'").groupBy("worker", "job_id").agg(F.min(F.struct("ended", "outcome")).alias("r"))
    both = of("submit", "submitted").join(first, ["worker", "job_id"], "left")
    late = F.col("r").isNull() | (F.col("r.ended") - F.col("submitted") > int(seconds * 1e6))
    answer = F.when(F.col("outcome") == "rejected", "saturated").when(late, "timeout").when(F.col("r.outcome") == "done", "ok").otherwise("error")
    return both.select("worker", "job_id", answer.alias("answer"))


def late_results(events: DataFrame, requests: DataFrame, least: float = 15.0, each: float = 0.4) -> DataFrame:
    """Thumbnails (``generation``, ``photo_id``, ``ts``) that came for ``requests`` (``generation``, ``photos``, ``ts``): delivered, late after ``max(least, each * photos)`` seconds, or of an older generation than the newest request by then.

    Requests are as many as users ask, so the newest one at a time is found by a
    window over requests and results together, for each ``worker``.
    """
    both = requests.select("worker", "ts", F.lit(0).alias("o"), F.col("generation").alias("asked"), F.lit(None).cast("long").alias("generation"), F.lit(None).cast("long").alias("photo_id")).unionByName(events.select("worker", "ts", F.lit(1).alias("o"), F.lit(None).cast("long").alias("asked"), "generation", "photo_id"))
    newest = F.max("asked").over(W.partitionBy("worker").orderBy("ts", "o").rowsBetween(W.unboundedPreceding, 0))
    came = both.withColumn("newest", newest).where("o = 1").drop("asked", "o")
    limit = F.greatest(F.lit(least), F.col("photos") * F.lit(each))
    of = requests.select("worker", "generation", F.col("ts").alias("asked_at"), limit.alias("limit"))
    joined = came.join(of, ["worker", "generation"], "left")
    late = (F.unix_micros("ts") - F.unix_micros("asked_at")) / F.lit(1e6) > F.col("limit")
    state = F.when(F.col("asked_at").isNull() | (F.col("generation") < F.col("newest")), "superseded").when(late, "late").otherwise("delivered")
    return joined.select("worker", "generation", "photo_id", state.alias("state"))


def stale_files(files: DataFrame, current: Column) -> DataFrame:
    """Files (``generation``) two generations old or more, which are purged."""
    return files.where(F.col("generation") <= current - 2)


#: Kinds of jobs, what each needs, and the kind of answer.
ROUTES = {
    "test": ((), "photos"), "get_selected_photos": ((), "photos"), "get_catalog_photos": ((), "photos"), "get_thumbnails": ((), "thumbnails"), "render_probe": (("adjustments",), "thumbnails"), "apply_adjustments": (("adjustments",), "report"), "set_rating": (("photo_ids", "rating"), "report"),
    "set_flag_color": (("photo_ids",), "report"), "set_keywords": (("photo_ids",), "report"), "list_collections": ((), "data"), "create_collection": (("name",), "data"), "add_to_collection": (("collection", "photo_ids"), "report"), "list_develop_presets": ((), "data"), "apply_develop_preset": (("photo_ids", "preset"), "report"),
}


def routed(jobs: DataFrame) -> DataFrame:
    """Jobs (``type``, ``payload`` as JSON) with the kind of ``answer`` that they get and the ``missing`` parts of their payload; an unknown type is an ``error``."""
    answer = F.lit("error")
    missing = F.array().cast("array<string>")
    for name, (needs, gives) in ROUTES.items():
        answer = F.when(F.col("type") == name, gives).otherwise(answer)
        if needs:
            absent = F.array(*[F.when(F.get_json_object("payload", f"$.{n}").isNull(), F.lit(n)) for n in needs])
            missing = F.when(F.col("type") == name, F.array_compact(absent)).otherwise(missing)
    return jobs.withColumn("answer", answer).withColumn("missing", missing)


def report(errors: Column, applied: Column, total: Column) -> list[Column]:
    """Status, message and summary of a batch: ok if anything was applied or there was nothing to do; the first five errors, and how many more."""
    ok = (applied > 0) | (total == 0)
    more = F.when(F.size(errors) > 5, F.concat(F.lit(" | +"), (F.size(errors) - 5).cast("string"), F.lit(" more"))).otherwise("")
    summary = F.when(F.size(errors) > 0, F.concat(F.array_join(F.slice(errors, 1, 5), " | "), more))
    message = F.when(~ok, F.concat(F.lit("0/"), total.cast("string"), F.lit(" applied. "), F.coalesce(F.get(errors, F.lit(0)), F.lit("no matching photo"))))
    return [F.when(ok, "ok").otherwise("error").alias("status"), message.alias("error"), summary.alias("errors_summary")]


def queue_stream(events: DataFrame, stale: float = STALE, most: int = MOST, delay: str = "0 seconds") -> DataFrame:
    """``replay`` of a stream: each queue is the state of its key.

    Events of a queue are applied in the order of their times within a micro-batch.
    Once the watermark is ``stale`` seconds beyond a queue's last event, its state
    is dropped, as its jobs are all stale; so the state is bounded.  Needs a state
    store that knows timers (RocksDB).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.kept = handle, handle.getValueState("queue", "state string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            queue, out, last = Ledger(stale, most), [], 0
            if self.kept.exists():
                queue.load(self.kept.get()[0])
            batch = pd.concat(list(rows)).sort_values(["us", "seq"])
            whole = lambda x: None if pd.isna(x) else int(x)
            for seq, kind, job, status, us in zip(batch["seq"], batch["kind"], batch["job_id"], batch["status"], batch["us"], strict=True):
                out += [(key[0], int(seq), *o) for o in queue.step(kind, whole(job), status, int(us))]
                last = max(last, int(us))
            self.kept.update((queue.dump(),))
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(last // 1000 + int(stale * 1000) + 1)
            found = pd.DataFrame(out, columns=[f.split()[0] for f in REPLAYED.split(", ")])
            yield found.astype({"job_id": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            self.kept.clear()
            yield pd.DataFrame(columns=[f.split()[0] for f in REPLAYED.split(", ")]).astype({"job_id": "Int64", "worker": "int64", "seq": "int64", "waiting": "int64"})

        def close(self) -> None:
            pass

    ship_package(events.sparkSession)
    timed = events.withWatermark("ts", delay).select(F.col("worker").cast("long").alias("worker"), F.col("seq").cast("long").alias("seq"), "kind", F.col("job_id").cast("long").alias("job_id"), "status", F.unix_micros("ts").alias("us"), "ts")
    return timed.groupBy("worker").transformWithStateInPandas(Processor(), REPLAYED, "append", "eventTime")
