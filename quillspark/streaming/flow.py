"""Orchestration as stateful streams: fan-in, step machines, duplicates, timeouts, dead letters, windows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Steps of each modality in order (fixed values).
STEPS = {
    "document": ("analysis", "summary", "save", "complete"),
    "audio": ("parallel_processing", "summary", "save", "complete"),
    "video": ("parallel_analysis", "summary", "save", "complete"),
    "image": ("parallel", "merge", "save", "complete"),
}
#: Branches that answer a parallel step; other steps are answered by an event of their own name (fixed values).
PARALLEL = {
    "audio": {"parallel_processing": ("asr", "diarization", "classification")},
    "video": {"parallel_analysis": ("video", "audio")},
    "image": {"parallel": ("description", "ocr")},
}
TASK_SECONDS = 1800
STATE_SECONDS = 24 * 3600
#: Buckets of keys that share a state.  A batch rewrites the states of the buckets it touches; what has outlived its time leaves them.
BUCKETS = 1024


def event_time(df: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A watermarked event time; zoneless timestamps are read in the session's zone first."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def distinct_messages(df: DataFrame, key: str = "message_id") -> DataFrame:
    """Each message once, within the watermark."""
    return df.dropDuplicatesWithinWatermark([key])


def fan_in(results: DataFrame, branches: Sequence[str], timeout_seconds: int = TASK_SECONDS, key: str = "correlation_id", order: str | None = None) -> DataFrame:
    """(key, outcome, errors, results): one row per key, when all branches have answered or the time is up.

    Input: (key, branch, status, result, ts) with a watermark on ts.  The state holds the earliest answer of each branch by
    (ts, order), order being a column of whole numbers if given, whichever chunk of rows brings it before the key is finished; so repeated
    messages change nothing, and a finished key answers once only.  error and failed both count as failures.

    A state holds a bucket of keys (``BUCKETS``) with the deadline of each; a finished key's answers are dropped from it."""
    wanted = tuple(branches)
    none: tuple = (None, None, None, None)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got: dict[str, dict[str, tuple[str, str, int, int]]] = {}  # the answers of keys that are open
        until: dict[str, int] = {}
        done: set[str] = set()
        if state.exists:
            keys, deadlines, ended, *answers = state.get
            until, done = dict(zip(keys, deadlines, strict=True)), {n for n, e in zip(keys, ended, strict=True) if e}
            places = [(n, w) for n in keys if n not in done for w in wanted]
            for (n, w), found in zip(places, zip(*answers, strict=True), strict=True):
                got.setdefault(n, {}).update({w: found} if found[2] is not None else {})
        watermark, last, out = state.getCurrentWatermarkMs(), {}, []
        for df in () if state.hasTimedOut else batches:
            orders = [0] * len(df) if order is None else df[order].tolist()
            for n, branch, status, text, at, o in zip(df["_key"], df["branch"], df["status"], df["result"], _all_micros(df["ts"]), orders, strict=True):
                last[n] = max(last.get(n, 0), at // 1000)
                if branch in wanted and n not in done:
                    held = got.setdefault(n, {})
                    if branch not in held or (at, o) < held[branch][2:]:
                        held[branch] = (status, text, at, int(o))
        for n, at in last.items():
            answers_of = got.setdefault(n, {}) if n not in done else {}
            if n not in done and len(answers_of) == len(wanted):
                errors = "; ".join(f"{b}: {answers_of[b][1]}" for b in wanted if answers_of[b][0] in ("error", "failed"))
                out.append((n, "failed" if errors else "complete", errors, _texts(got.pop(n), wanted)))
                done.add(n)
            until[n] = max(at, watermark) + 1000 * (STATE_SECONDS if n in done else timeout_seconds)
        for n in [n for n, at in until.items() if at < watermark]:
            if n not in done:
                missing = ",".join(b for b in wanted if b not in got.get(n, {}))
                out.append((n, "timeout", f"PROCESSING_TIMEOUT: {missing}", _texts(got.pop(n, {}), wanted)))
            done.discard(n)
            del until[n]
        if until:
            flat = [got.get(n, {}).get(w, none) for n in until if n not in done for w in wanted]
            state.update((list(until), list(until.values()), [n in done for n in until], *([f[c] for f in flat] for c in range(4))))
            state.setTimeoutTimestamp(min(until.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "outcome", "errors", "results"])

    held = "keys array<string>, deadlines array<long>, ended array<boolean>, statuses array<string>, texts array<string>, times array<long>, orders array<long>"
    columns = ["branch", "status", "result", "ts", *([] if order is None else [order])]
    return _in_buckets(results, key, columns).applyInPandasWithState(
        run, "key string, outcome string, errors string, results array<string>", held, "append", GroupStateTimeout.EventTimeTimeout
    )


def _in_buckets(rows: DataFrame, key: str, columns: Sequence[str]) -> GroupedData:
    """Rows (_key, columns) grouped by a bucket of keys: a state per key costs milliseconds a key, so keys share calls and states."""
    return rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), F.col(key).cast("string").alias("_key"), *dict.fromkeys(columns)).groupBy("_bucket")


def _micros(ts: pd.Timestamp) -> int:
    return ts.as_unit("ns").value // 1000


def _all_micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _texts(got: dict[str, tuple], wanted: Sequence[str]) -> list[str | None]:
    return [got[b][1] if b in got else None for b in wanted]


def next_step(steps: Sequence[str], step: str | None, event: str, status: str) -> str | None:
    """The step after an event; an event that isn't the current step's answer, or comes after the end, changes nothing."""
    if step is None:
        return steps[0] if event == "request" else None
    if step == steps[-1] or step.startswith("error") or event != step:
        return step
    return f"error:{event}" if status in ("error", "failed") else steps[steps.index(step) + 1]


def advance(steps: Sequence[str], parallel: dict[str, Sequence[str]], step: str | None, answered: dict[str, str], event: str, status: str) -> tuple[str | None, dict[str, str]]:
    """(step, statuses of its branches so far) after an event.  A parallel step ends with the last branch's first answer, as failed if any branch failed."""
    branches = parallel.get(step, ()) if step else ()
    if event in branches:
        answered = {event: status} | answered
        if len(answered) < len(branches):
            return step, answered
        event, status = step, "failed" if {"error", "failed"} & set(answered.values()) else status
    after = next_step(steps, step, event, status)
    return after, answered if after == step else {}


def step_machine(events: DataFrame, modality: str, key: str = "correlation_id", order: str | None = None) -> DataFrame:
    """(key, step, ts) whenever a key's step changes.  Input: (key, event, status, ts) with a watermark.

    A key's events of one micro-batch are taken by (ts, order), order being a column of whole numbers if given, whichever
    chunks of rows bring them: of each chunk only what the machine can react to is kept."""
    steps, parallel = STEPS[modality], PARALLEL.get(modality, {})
    known = {"request", *steps[:-1], *(b for branches in parallel.values() for b in branches)}
    by = ["ts"] if order is None else ["ts", order]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at: dict[str, tuple[str, dict[str, str]]] = {}
        until: dict[str, int] = {}
        if state.exists:
            keys, deadlines, where, names, statuses = state.get
            until = dict(zip(keys, deadlines, strict=True))
            at = {n: (step, dict(zip(a, b, strict=True))) for n, step, a, b in zip(keys, where, names, statuses, strict=True)}
        watermark, last, out, parts = state.getCurrentWatermarkMs(), {}, [], []
        for df in () if state.hasTimedOut else batches:
            last |= dict.fromkeys(df["_key"], 0)
            parts.append(df.loc[df["event"].isin(known), ["_key", *by, "event", "status"]])
        if parts:
            rows = pd.concat(parts).sort_values(by, kind="stable")
            for n, event, status, ts in zip(rows["_key"], rows["event"], rows["status"], rows["ts"], strict=True):
                step, answered = at.get(n, (None, {}))
                after, answered = advance(steps, parallel, step, answered, event, status)
                if after is not None:
                    at[n] = after, answered
                if after != step:
                    out.append((n, after, ts))
            last |= dict(zip(rows["_key"], (t // 1000 for t in _all_micros(rows["ts"])), strict=True))
        for n, moment in last.items():
            if n in at:
                until[n] = max(moment, watermark) + 1000 * STATE_SECONDS
        for n in [n for n, moment in until.items() if moment < watermark]:
            del at[n], until[n]
        if until:
            state.update((list(until), list(until.values()), [at[n][0] for n in until], [list(at[n][1]) for n in until], [list(at[n][1].values()) for n in until]))
            state.setTimeoutTimestamp(min(until.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "step", "ts"])

    held = "keys array<string>, deadlines array<long>, steps array<string>, names array<array<string>>, statuses array<array<string>>"
    return _in_buckets(events, key, ["event", "status", *by]).applyInPandasWithState(run, "key string, step string, ts timestamp", held, "append", GroupStateTimeout.EventTimeTimeout)


def split_batch(guard: Callable[[DataFrame], DataFrame], good: Callable[[DataFrame], Any], bad: Callable[[DataFrame], Any]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows that the guard gives no error go to ``good``, the others to ``bad`` (retries, dead letters)."""

    def run(batch: DataFrame, _: int) -> None:
        rows = guard(batch).persist()
        good(rows.where("error is null").drop("error"))
        bad(rows.where("error is not null"))
        rows.unpersist()

    return run


def tumbling_counts(df: DataFrame, size: str, *keys: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(df: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """The rows of a stream over all input there is, as a table in memory (tests and bounded runs)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """The rows that a stream appends over all input there is, as files in the folder that driver and executors share."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
