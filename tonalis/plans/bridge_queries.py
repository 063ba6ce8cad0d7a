"""Queries over the job bridge, each with its DuckDB twin: a recursion that applies one event of every queue a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming import bridge
from . import fixtures as fx, oracle as o
from .photo_queries import query, r6

_EVENTS = """ev AS (SELECT worker, job_id AS seq, kind, status, epoch_us(ts) AS us, row_number() OVER w AS i,
  CASE WHEN kind <> 'poll' THEN last_value(CASE WHEN kind = 'submit' THEN job_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS job FROM jobs WINDOW w AS (PARTITION BY worker ORDER BY ts, job_id))"""


def _replayed(stale: float = 900.0, most: int = 100) -> str:
    pack = lambda st, q: f"struct_pack(j := x.j, since := x.since, st := {st}, q := {q})"
    first = "list_position(list_transform(kept, lambda x: x.q AND x.st = 'pending'), true)"
    ended = pack("CASE WHEN x.j = job THEN CASE WHEN status = 'ok' THEN 'done' ELSE 'failed' END ELSE x.st END", "x.q")
    taken = pack("CASE WHEN n = p THEN 'in_progress' ELSE x.st END", "x.q AND n > coalesce(nullif(p, 0), len(kept))")
    return f"""run AS (
  SELECT worker, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BIGINT AS job, NULL::VARCHAR AS outcome, []::BIGINT[] AS gone, []::STRUCT(j BIGINT, since BIGINT, st VARCHAR, q BOOLEAN)[] AS held FROM (SELECT DISTINCT worker FROM ev)
  UNION ALL
  SELECT worker, i, seq, kind, CASE WHEN kind = 'poll' THEN kept[nullif(p, 0)].j ELSE job END,
    CASE kind WHEN 'submit' THEN CASE WHEN full_ THEN 'rejected' ELSE 'pending' END WHEN 'poll' THEN CASE WHEN coalesce(p, 0) > 0 THEN 'in_progress' ELSE 'empty' END
      ELSE CASE WHEN NOT list_contains(list_transform(kept, lambda x: x.j), coalesce(job, -1)) THEN 'unknown' WHEN status = 'ok' THEN 'done' ELSE 'failed' END END,
    gone,
    CASE kind WHEN 'submit' THEN CASE WHEN full_ THEN kept ELSE list_append(kept, struct_pack(j := job, since := us, st := 'pending', q := true)) END
      WHEN 'poll' THEN list_transform(kept, lambda x, n: {taken}) ELSE list_transform(kept, lambda x: {ended}) END
  FROM (SELECT *, {first} AS p, len(list_filter(kept, lambda x: x.q)) >= {most} AS full_ FROM (
    SELECT e.worker, e.i, e.seq, e.kind, e.job, e.status, e.us,
      CASE WHEN e.kind = 'submit' THEN list_filter(r.held, lambda x: e.us - x.since <= {stale * 1e6:.0f}) ELSE r.held END AS kept,
      CASE WHEN e.kind = 'submit' THEN list_transform(list_filter(r.held, lambda x: e.us - x.since > {stale * 1e6:.0f}), lambda x: x.j) ELSE []::BIGINT[] END AS gone
    FROM run r JOIN ev e ON e.worker = r.worker AND e.i = r.i + 1) a) b),
replayed AS (SELECT worker, seq, kind, job AS job_id, outcome, CAST(len(list_filter(held, lambda x: x.q)) AS BIGINT) AS waiting FROM run WHERE i > 0
  UNION ALL SELECT worker, seq, 'evict', unnest(gone), 'evicted', CAST(len(list_filter(held, lambda x: x.q)) AS BIGINT) FROM run WHERE i > 0)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((o.JOBS, _EVENTS, *parts)) + "\n"


def _short(spark: SparkSession, d: str) -> DataFrame:
    """Queues of three places whose jobs stay for two days, so that some are turned away."""
    return bridge.replay(fx.queue_events(spark, d), stale=172_800.0, most=3)


@query(_with(_replayed()) + "SELECT worker, seq, kind, job_id, outcome, waiting FROM replayed")
def job_queue(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every event of every queue."""
    return bridge.replay(fx.queue_events(spark, d))


@query(_with(_replayed(172_800.0, 3)) + "SELECT worker, seq, kind, job_id, outcome, waiting FROM replayed")
def job_queue_short(spark: SparkSession, d: str) -> DataFrame:
    """The same for queues of three places and two days."""
    return _short(spark, d)


_JOBS = """SELECT worker, job_id, arg_max(outcome, struct_pack(s := CASE kind WHEN 'submit' THEN 0 WHEN 'evict' THEN 2 ELSE 1 END, e := CASE WHEN kind = 'poll' THEN 0 ELSE 1 END, n := seq)) AS status, min(CASE WHEN kind = 'poll' THEN seq END) AS polled_by, max(CASE WHEN kind = 'result' THEN seq END) AS result_by
FROM replayed WHERE job_id IS NOT NULL AND outcome NOT IN ('unknown', 'ignored') GROUP BY 1, 2"""


@query(_with(_replayed(172_800.0, 3)) + _JOBS)
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """The last status of every job, and the events that took and ended it."""
    return bridge.jobs(_short(spark, d))


@query(_with(_replayed()) + "SELECT worker, seq, job_id FROM replayed WHERE outcome = 'evicted'")
def job_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that are stale when another is submitted, and the event that evicts them."""
    return bridge.replay(fx.queue_events(spark, d)).where("outcome = 'evicted'").select("worker", "seq", "job_id")


@query(_with(_replayed(172_800.0, 3)) + "SELECT worker, max(waiting) AS most, count(*) FILTER (outcome = 'rejected') AS rejected FROM replayed GROUP BY 1")
def queue_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Longest queue of each worker, and jobs turned away."""
    return bridge.pending(_short(spark, d))


@query(_with(_replayed(172_800.0, 3), "s AS (SELECT p.worker, p.job_id, p.outcome, e.us FROM replayed p JOIN ev e USING (worker, seq) WHERE p.kind = 'submit')", "t AS (SELECT p.worker, p.job_id, min(e.us) AS us, arg_min(p.outcome, struct_pack(a := e.us, b := p.outcome)) AS outcome FROM replayed p JOIN ev e USING (worker, seq) WHERE p.kind = 'result' AND p.outcome <> 'unknown' GROUP BY 1, 2)")
       + "SELECT s.worker, s.job_id, CASE WHEN s.outcome = 'rejected' THEN 'saturated' WHEN t.us IS NULL OR t.us - s.us > 36000000000 THEN 'timeout' WHEN t.outcome = 'done' THEN 'ok' ELSE 'error' END AS answer FROM s LEFT JOIN t USING (worker, job_id)")
def job_results(spark: SparkSession, d: str) -> DataFrame:
    """What a caller gets that waits ten hours for its job."""
    events = fx.queue_events(spark, d)
    return bridge.waited(bridge.replay(events, stale=172_800.0, most=3), events, 36_000.0)


@query(o.with_(o.JOBS) + "SELECT worker, job_id, round(gap, 6) AS gap FROM (SELECT *, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY worker ORDER BY ts, job_id)))/1e6 AS gap FROM jobs WHERE kind='poll') WHERE gap > 5")
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Silences of a worker."""
    return r6(bridge.heartbeat_gaps(fx.queue_events(spark, d)), "gap")


@query(o.with_(o.JOBS, "n AS (SELECT epoch_us(max(ts)) AS us FROM events)") + "SELECT worker, round((us - last) / 1e6, 6) AS seconds_since_poll, coalesce((us - last) / 1e6 <= 86400, false) AS connected FROM (SELECT worker, max(CASE WHEN kind='poll' THEN epoch_us(ts) END) AS last FROM jobs GROUP BY 1), n")
def bridge_status(spark: SparkSession, d: str) -> DataFrame:
    """Age of each worker's last poll at the end of the events; connected if it is under a day old."""
    events = fx.queue_events(spark, d)
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return r6(bridge.heartbeat(events, now, 86_400.0), "seconds_since_poll")


_TYPES = list(bridge.ROUTES)


@query("WITH j AS (SELECT event_id AS job_id, CASE WHEN event_id % 16 < 14 THEN (" + str(_TYPES) + ")[event_id % 16 + 1] ELSE 'other' END AS type, CASE event_id % 3 WHEN 0 THEN ['photo_ids', 'rating', 'adjustments'] WHEN 1 THEN ['photo_ids', 'collection', 'name', 'preset'] ELSE []::VARCHAR[] END AS has FROM events)"
       "SELECT job_id, type, coalesce((MAP {" + ", ".join(f"'{t}': '{g}'" for t, (_, g) in bridge.ROUTES.items()) + "})[type], 'error') AS answer, array_to_string(list_filter(coalesce((MAP {" + ", ".join(f"'{t}': {list(n) or '[]::VARCHAR[]'}" for t, (n, _) in bridge.ROUTES.items()) + "})[type], []::VARCHAR[]), lambda n: NOT list_contains(has, n)), ',') AS missing FROM j")  # fmt: skip
def job_routes(spark: SparkSession, d: str) -> DataFrame:
    """What every kind of job is answered with, and what its payload lacks."""
    n = F.col("event_id")
    kind = F.when(n % 16 < 14, F.element_at(F.array(*map(F.lit, _TYPES)), (n % 16 + 1).cast("int"))).otherwise("other")
    payload = F.when(n % 3 == 0, F.lit('{"photo_ids": [1], "rating": 3, "adjustments": []}')).when(n % 3 == 1, F.lit('{"photo_ids": [], "collection": "c", "name": "n", "preset": "p"}')).otherwise("{}")
    jobs = fx.table(spark, d, "events").select(n.alias("job_id"), kind.alias("type"), payload.alias("payload"))
    return bridge.routed(jobs).select("job_id", "type", "answer", F.array_join("missing", ",").alias("missing"))


_NAMED = "list_transform(range(o_orderkey % 9), lambda i: 'uuid not found: ' || i)"


@query(f"SELECT id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT ok THEN '0/' || total || ' applied. ' || coalesce(e[1], 'no matching photo') END AS error, CASE WHEN len(e) > 0 THEN array_to_string(e[1:5], ' | ') || CASE WHEN len(e) > 5 THEN ' | +' || (len(e) - 5) || ' more' ELSE '' END END AS errors_summary FROM (SELECT o_orderkey AS id, {_NAMED} AS e, o_custkey % 5 AS total, (o_custkey % 5 > 0 AND o_orderkey % 2 = 0) OR o_custkey % 5 = 0 AS ok FROM orders)")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of changes is answered with."""
    n, total = F.col("o_orderkey"), F.col("o_custkey") % 5
    errors = F.when(n % 9 > 0, F.transform(F.sequence(F.lit(0).cast("long"), n % 9 - 1), lambda i: F.concat(F.lit("uuid not found: "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return fx.table(spark, d, "orders").select(n.alias("id"), *bridge.report(errors, F.when(n % 2 == 0, total).otherwise(F.lit(0)), total))


@query("""WITH q AS (SELECT user_id AS worker, event_id AS generation, ts, 1 + event_id % 60 AS photos FROM events WHERE event_type = 'click'),
r AS (SELECT user_id AS worker, event_id AS photo_id, ts, event_id - 1 - event_id % 40 AS g FROM events WHERE event_type <> 'click'),
j AS (SELECT r.*, (SELECT max(generation) FROM q WHERE q.worker = r.worker AND q.ts <= r.ts) AS newest FROM r),
k AS (SELECT j.worker, j.photo_id, j.ts, CASE WHEN j.photo_id % 3 = 0 THEN j.newest ELSE j.g END AS generation, j.newest FROM j)
SELECT k.worker, k.generation, k.photo_id, CASE WHEN q.ts IS NULL OR k.generation < k.newest THEN 'superseded' WHEN (epoch_us(k.ts) - epoch_us(q.ts)) / 1e6 > greatest(15.0e0, q.photos * 0.4e0) THEN 'late' ELSE 'delivered' END AS state FROM k LEFT JOIN q ON q.worker = k.worker AND q.generation = k.generation""")
def late_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails that come in time, too late, or for a request that another has replaced."""
    from pyspark.sql import Window as W

    e = fx.table(spark, d, "events").select(F.col("user_id").alias("worker"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    asked = e.where("event_type = 'click'").select("worker", F.col("event_id").alias("generation"), "ts", (F.col("event_id") % 60 + 1).alias("photos"))
    newest = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(W.partitionBy("worker").orderBy("ts").rangeBetween(W.unboundedPreceding, 0))
    came = e.withColumn("newest", newest).where("event_type <> 'click'").select("worker", F.when(F.col("event_id") % 3 == 0, F.col("newest")).otherwise(F.col("event_id") - 1 - F.col("event_id") % 40).alias("generation"), F.col("event_id").alias("photo_id"), "ts")
    return bridge.late_results(came, asked)


@query("SELECT event_id AS file, event_id // 10 AS generation FROM events WHERE event_id // 10 <= 20 - 2")
def purged_files(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnail files two generations old."""
    files = fx.table(spark, d, "events").select(F.col("event_id").alias("file"), F.expr("event_id div 10").alias("generation"))
    return bridge.stale_files(files, F.lit(20))
