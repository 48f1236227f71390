"""Registered queries of keyed state, nested machines, their feed, and stream-stream joins: the events table as a stream, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.catalogue import _QUERIES, _SQL, _event_stream
from quillspark.streaming import state

#: Longer than the events' time: no task is forgotten within the queries.
LONG = 90 * 24 * 3600


def register(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


# ---- the store of fields ---------------------------------------------------------------------------------------

_COMMAND = "CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'view' THEN 'get' WHEN event_type = 'click' THEN 'update' WHEN event_type = 'purchase' THEN 'extend' WHEN event_id % 4 = 0 THEN 'delete' ELSE 'exists' END"

#: A key lives while every command since its last set came before the last renewal ran out, and none of them was a delete.
_STORE = f"""c AS (SELECT user_id::VARCHAR AS key, ts, event_id AS n, {_COMMAND} AS command FROM events),
s AS (SELECT *, count(*) FILTER (command = 'set') OVER (PARTITION BY key ORDER BY ts, n) AS seg,
        CASE command WHEN 'set' THEN ts + INTERVAL 24 HOURS WHEN 'update' THEN ts + INTERVAL 24 HOURS WHEN 'extend' THEN ts + INTERVAL 36 HOURS END AS until FROM c),
g AS (SELECT *, ts >= last_value(until IGNORE NULLS) OVER (PARTITION BY key, seg ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap,
        count(*) FILTER (command = 'delete') OVER (PARTITION BY key, seg ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS gone FROM s),
l AS (SELECT *, seg > 0 AND NOT gone AND NOT coalesce(bool_or(gap) OVER (PARTITION BY key, seg ORDER BY ts, n), false) AS alive FROM g),
f AS (SELECT *, max(CASE WHEN command = 'set' THEN n END) OVER w AS opened, {", ".join(f"last_value(CASE WHEN command = 'update' AND alive AND n % 3 = {k} THEN n END IGNORE NULLS) OVER w AS f{k}" for k in range(3))}
      FROM l WINDOW w AS (PARTITION BY key, seg ORDER BY ts, n))"""
_FIELDS = "'{' || concat_ws(', ', '\"f0\": ' || f0, '\"f1\": ' || f1, '\"f2\": ' || f2, '\"opened\": ' || opened) || '}'"


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_stream(spark, sf).withColumn("command", F.expr(_COMMAND))
    name = F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"))
    fields = F.when(F.col("command") == "set", F.to_json(F.struct(F.col("event_id").alias("opened")))).when(F.col("command") == "update", F.to_json(F.create_map(name, F.col("event_id"))))
    return e.select(F.col("user_id").cast("string").alias("key"), "command", fields.alias("fields"), F.when(F.col("command") == "extend", 36 * 3600).cast("long").alias("seconds"), "ts", F.col("event_id").alias("order"))


@register(f"WITH {_STORE} SELECT key, n AS event_id, command, alive AS ok, CASE WHEN command = 'get' AND alive THEN {_FIELDS} END AS fields FROM f")
def stream_field_store(spark: SparkSession, sf: str) -> DataFrame:
    """Commands on a store with life times: signups set, views get, clicks update, purchases extend, errors delete or ask."""
    rows, _ = state.run_with_state(state.field_store(_commands(spark, sf), 24 * 3600, shared=True), "field-store")
    return rows.select("key", F.col("order").alias("event_id"), "command", "ok", "fields")


@register(f"""WITH {_STORE}, e AS (SELECT *, last_value(until IGNORE NULLS) OVER (PARTITION BY key, seg ORDER BY ts, n) AS last, row_number() OVER (PARTITION BY key ORDER BY ts DESC, n DESC) AS k FROM f)
SELECT key, unnest(['f0', 'f1', 'f2', 'opened']) AS name, unnest([f0, f1, f2, opened]) AS value FROM e WHERE k = 1 AND alive AND command <> 'delete' AND last > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def stored_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What the store holds after all commands, read from its checkpoint: the fields of keys that live; timers have ended the others."""
    _, folder = state.run_with_state(state.field_store(_commands(spark, sf), 24 * 3600, shared=True), "field-store")
    held = state.stored(spark, folder).withColumn("value", F.col("value").cast("long"))
    # fields that were never updated have no entry; the others of the same key do
    every = held.select("key").distinct().select("key", F.explode(F.array(*[F.lit(n) for n in ("f0", "f1", "f2", "opened")])).alias("name"))
    return every.join(held, ["key", "name"], "left")


# ---- nested machines -------------------------------------------------------------------------------------------

_KIND = """CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'frame_extraction' ELSE 'scene_detection' END
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'ocr_frame' ELSE 'frame_description' END
  WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'audio_conversion' WHEN 1 THEN 'asr' WHEN 2 THEN 'diarization' ELSE 'classification' END
  ELSE CASE WHEN event_id % 2 = 0 THEN 'summary' ELSE 'save' END END"""


def _first(kinds: str, since: str) -> str:
    """The first answer of each kind after a step began."""
    return f"SELECT e.id, e.kind, min(e.moment) AS moment, arg_min(e.bad, e.moment) AS bad FROM e JOIN {since} s ON e.id = s.id AND e.moment > s.moment WHERE e.kind IN ({kinds}) GROUP BY e.id, e.kind"


#: Both branches and the task around them, each step as a query of its own.
_NESTED = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, struct_pack(t := ts, n := event_id) AS moment, {_KIND} AS kind, coalesce(value > 150, false) AS bad FROM events),
r AS (SELECT id, min(moment) AS moment FROM e WHERE kind = 'request' GROUP BY id),
frames AS ({_first("'frame_extraction'", "r")}), v1 AS (SELECT id, moment FROM frames WHERE NOT bad),
scene AS ({_first("'scene_detection'", "v1")}),
both_ AS ({_first("'ocr_frame', 'frame_description'", "scene")}),
v_end AS (SELECT id, moment, 'frame_extraction' AS errors FROM frames WHERE bad UNION ALL
  SELECT id, max(b.moment), concat_ws(',', CASE WHEN any_value(s.bad) THEN 'scene_detection' END, CASE WHEN bool_or(b.bad AND b.kind = 'ocr_frame') THEN 'ocr_frame' END, CASE WHEN bool_or(b.bad AND b.kind = 'frame_description') THEN 'frame_description' END)
  FROM both_ b JOIN scene s USING (id) GROUP BY id HAVING count(*) = 2),
sound AS ({_first("'audio_conversion'", "r")}), a1 AS (SELECT id, moment FROM sound WHERE NOT bad),
three AS ({_first("'asr', 'diarization', 'classification'", "a1")}),
a_end AS (SELECT id, moment, 'audio_conversion' AS errors FROM sound WHERE bad UNION ALL
  SELECT id, max(moment), concat_ws(',', {", ".join(f"CASE WHEN bool_or(bad AND kind = '{k}') THEN '{k}' END" for k in ("asr", "diarization", "classification"))}) FROM three GROUP BY id HAVING count(*) = 3),
ends AS (SELECT id, moment, 'video' AS branch, errors FROM v_end UNION ALL SELECT id, moment, 'audio', errors FROM a_end),
t_bad AS (SELECT id, min(moment) AS moment, arg_min(branch || '(' || errors || ')', moment) AS errors FROM ends WHERE errors <> '' GROUP BY id),
t1 AS (SELECT id, max(moment) AS moment FROM ends GROUP BY id HAVING count(*) = 2 AND count(*) FILTER (errors <> '') = 0),
summary AS ({_first("'summary'", "t1")}), t2 AS (SELECT id, moment FROM summary WHERE NOT bad),
saved AS ({_first("'save'", "t2")}),
steps AS (
  SELECT id, m AS machine, CASE m WHEN 'task' THEN 'parallel_analysis' WHEN 'video' THEN 'frame_extraction' ELSE 'audio_conversion' END AS step, moment, '' AS errors FROM r, unnest(['task', 'video', 'audio']) u(m)
  UNION ALL SELECT id, 'video', 'scene_detection', moment, '' FROM v1 UNION ALL SELECT id, 'video', 'frame_analysis', moment, '' FROM scene
  UNION ALL SELECT id, 'audio', 'parallel_processing', moment, '' FROM a1
  UNION ALL SELECT id, branch, CASE WHEN errors = '' THEN 'complete' ELSE 'failed' END, moment, errors FROM ends
  UNION ALL SELECT id, 'task', 'failed', moment, errors FROM t_bad
  UNION ALL SELECT id, 'task', 'summary', moment, '' FROM t1
  UNION ALL SELECT id, 'task', CASE WHEN bad THEN 'failed' ELSE 'save' END, moment, CASE WHEN bad THEN 'summary' ELSE '' END FROM summary
  UNION ALL SELECT id, 'task', CASE WHEN bad THEN 'failed' ELSE 'complete' END, moment, CASE WHEN bad THEN 'save' ELSE '' END FROM saved)
SELECT id AS correlation_id, machine, step, strftime(moment.t, '%Y-%m-%d %H:%M:%S') AS since, errors FROM steps"""


def _tasks(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    e = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.expr(_KIND).alias("event"), F.when(F.col("value") > 150, "failed").otherwise("ok").alias("status"), "ts", F.col("event_id").alias("order"))
    return state.run_with_state(state.nested_machines(e, seconds=LONG, shared=True), "nested-video")


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("since")


@register(_NESTED)
def stream_nested_video(spark: SparkSession, sf: str) -> DataFrame:
    """The video task with a machine for its frames and one for its sound inside; users are tasks, their events the answers."""
    rows, _ = _tasks(spark, sf)
    return rows.select(F.col("key").alias("correlation_id"), "machine", "step", _time("since"), "errors")


@register(_NESTED)
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps as the feed of the changes of the machines' state, read back from the checkpoint."""
    _, folder = _tasks(spark, sf)
    return state.steps_taken(spark, folder).select(F.col("key").alias("correlation_id"), "machine", "step", _time("since"), "errors")


# ---- joins of two streams --------------------------------------------------------------------------------------


def _two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    requests = _event_stream(spark, sf).where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").alias("request_ts"))
    answers = _event_stream(spark, sf).where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("answer_id"), F.col("ts").alias("answer_ts"))
    return requests, answers


_FITS = "FROM events s {} JOIN events v ON v.user_id = s.user_id AND v.event_type = 'view' AND v.ts BETWEEN s.ts AND s.ts + INTERVAL 6 HOURS WHERE s.event_type = 'signup'"


@register(f"SELECT s.event_id AS request_id, v.event_id AS answer_id {_FITS.format('')}")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Signups as requests, views as answers, two streams joined on the user within six hours."""
    rows, _ = state.run_with_state(state.answered(*_two_sides(spark, sf), "6 HOURS"), "stream-join")
    return rows.select("request_id", "answer_id")


@register(f"""SELECT s.event_id AS request_id, v.event_id AS answer_id {_FITS.format("LEFT")}
  AND (v.event_id IS NOT NULL OR s.ts < (SELECT min(m) FROM (SELECT max(ts) AS m FROM events WHERE event_type IN ('signup', 'view') GROUP BY event_type)) - INTERVAL 10 MINUTES - INTERVAL 6 HOURS)""")
def stream_join_outer(spark: SparkSession, sf: str) -> DataFrame:
    """The same with requests that no answer reached, once the watermark, which follows the side that is behind, has passed the time for it."""
    rows, _ = state.run_with_state(state.answered(*_two_sides(spark, sf), "6 HOURS", "left_outer"), "stream-join-outer")
    return rows.select("request_id", "answer_id")
