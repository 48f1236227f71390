"""Keyed state on RocksDB: a store of fields with life times, nested step machines, the feed of their changes, and stream-stream joins.

The processors here run in ``transformWithStateInPandas``: each key has several states of its own (values and maps), timers in event time end
what has outlived its time, and the changes of a state can be read back from the checkpoint (``changes``).  For many keys, ``shared``
lets the keys of a bucket share states, timers and calls, since a call and several state calls a key cost 12 to 20 ms of a core."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flow import BUCKETS, STATE_SECONDS, _all_micros, _micros, shared_folder

#: What keyed state needs: states on RocksDB, with a log of changes in the checkpoint.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for the streams started inside."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_with_state(stream: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """(rows that a stream appends over all input there is, its folder in the shared storage).  A folder given again goes on from its checkpoint."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with stateful(spark):
        out = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), folder


def changes(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The feed of a state's changes: (batch_id, change_type, key, map_key, value), a row for each put or removal of each batch."""
    with stateful(spark):
        feed = spark.read.format("statestore").option("stateVarName", state).option("readChangeFeed", True).option("changeStartBatchId", 0).load(f"{folder}/state")
    value = "map_value" if "map_value" in feed.columns else next(c for c in feed.columns if c in ("value", "user_map_value", "list_element"))
    key = next((c for c in feed.columns if c in ("user_map_key", "map_key")), None)
    return feed.select("batch_id", "change_type", "key", (F.col(key) if key else F.lit(None)).alias("map_key"), F.col(value).alias("value"))


def _sorted(rows: Iterator[pd.DataFrame], columns: list[str], keep: set[str] | None = None) -> pd.DataFrame:
    """A key's rows of a micro-batch by (ts, order), whichever chunks bring them; ``keep``: of these events only."""
    parts = [(df if keep is None else df.loc[df["event"].isin(keep)])[["ts", "order", *columns]] for df in rows]
    return pd.concat(parts).sort_values(["ts", "order"], kind="stable")


def _grouped(rows: DataFrame, shared: bool) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket") if shared else rows.groupBy("key")


def _columns(rows: Iterable[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True)))


def _one_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The bucket's only timer, in milliseconds; None: none."""
    before = list(handle.listTimers())
    for timer in before:
        if timer != at:
            handle.deleteTimer(timer)
    if at is not None and at not in before:
        handle.registerTimer(at)


# ---- a store of fields with a life time ------------------------------------------------------------------------


class FieldStore(StatefulProcessor):
    """Fields under a key until they outlive their time.  set replaces all fields and starts their time anew; update
    adds to the fields of a living key and starts its time anew; get, exists and extend (to ``seconds`` from now) answer whether
    the key lives; delete ends it.  Time is event time: what a command finds depends on its own time stamp only."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def take(self, now: int, command: str, text: str | None, seconds: float | None, expires: int | None, held: dict[str, str]) -> tuple[bool, str | None, int | None, dict[str, str]]:
        """(did the key live, answer, expires, fields) after a command."""
        alive = expires is not None and now < expires
        answer = None
        new = {k: json.dumps(v, sort_keys=True) for k, v in json.loads(text).items()} if isinstance(text, str) and text else {}
        life = int(seconds) if seconds is not None and seconds == seconds else self.seconds
        if command == "set":
            held, expires, alive = new, now + 1_000_000 * self.seconds, True
        elif not alive:
            held, expires = {}, None
        elif command == "update":
            held, expires = held | new, now + 1_000_000 * self.seconds
        elif command == "extend":
            expires = now + 1_000_000 * life
        elif command == "delete":
            held, expires = {}, None
        elif command == "get":
            answer = "{" + ", ".join(f"{json.dumps(k)}: {held[k]}" for k in sorted(held)) + "}"
        return alive, answer, expires, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "expires long")
        self.fields = handle.getMapState("fields", "name string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expires = self.life.get()[0] if self.life.exists() else None
        before = expires
        held = {k[0]: v[0] for k, v in self.fields.iterator()} if expires is not None else {}
        was, out = dict(held), []
        for ts, order, command, text, seconds in _sorted(rows, ["command", "fields", "seconds"]).itertuples(index=False):
            alive, answer, expires, held = self.take(_micros(ts), command, text, seconds, expires, held)
            out.append((key[0], ts, order, command, alive, answer))
        for name in was.keys() - held.keys():
            self.fields.removeKey((name,))
        for name, value in held.items():
            if was.get(name) != value:
                self.fields.updateValue((name,), (value,))
        if expires != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if expires is None:
                self.life.clear()
            else:
                self.life.update((expires,))
                self.handle.registerTimer(-(-expires // 1000))
        yield pd.DataFrame(out, columns=["key", "ts", "order", "command", "ok", "fields"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists() and self.life.get()[0] <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            self.life.clear()
            self.fields.clear()
        yield from ()

    def close(self) -> None:
        pass


class SharedFieldStore(FieldStore):
    """The same for a bucket of keys: one state with the life and the fields of each living key, and one timer for the first that ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stores = handle.getValueState("stores", "keys array<string>, expires array<long>, names array<array<string>>, texts array<array<string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stores, out = self._load(), []
        df = _sorted(rows, ["key", "command", "fields", "seconds"])
        for now, (ts, order, n, command, text, seconds) in zip(_all_micros(df["ts"]), df.itertuples(index=False), strict=True):
            alive, answer, expires, held = self.take(now, command, text, seconds, *stores.get(n, (None, {})))
            if expires is None:
                stores.pop(n, None)
            else:
                stores[n] = expires, held
            out.append((n, ts, order, command, alive, answer))
        self._save(stores)
        _one_timer(self.handle, min((-(-expires // 1000) for expires, _ in stores.values()), default=None))
        yield pd.DataFrame(out, columns=["key", "ts", "order", "command", "ok", "fields"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        stores = {n: store for n, store in self._load().items() if store[0] > now}
        self._save(stores)
        if stores:
            self.handle.registerTimer(min(-(-expires // 1000) for expires, _ in stores.values()))
        yield from ()

    def _load(self) -> dict[str, tuple[int, dict[str, str]]]:
        state = self.stores.get()
        return {n: (expires, dict(zip(names, texts, strict=True))) for n, expires, names, texts in zip(*state, strict=True)} if state else {}

    def _save(self, stores: dict[str, tuple[int, dict[str, str]]]) -> None:
        if stores:
            fields = [held for _, held in stores.values()]
            self.stores.update((list(stores), [expires for expires, _ in stores.values()], [list(f) for f in fields], [list(f.values()) for f in fields]))
        else:
            self.stores.clear()


def field_store(commands: DataFrame, seconds: int = STATE_SECONDS, shared: bool = False) -> DataFrame:
    """(key, ts, order, command, ok, fields) for every command: did the key live, and, for get, its fields as JSON.
    Input: (key string, command, fields, seconds, ts, order): fields a JSON object for set and update, seconds for extend, a watermark on ts,
    order a whole number that tells commands of one time apart.  ``shared``: buckets of keys share states (``stored`` reads them back)."""
    processor = (SharedFieldStore if shared else FieldStore)(seconds)
    return _grouped(commands, shared).transformWithStateInPandas(processor, "key string, ts timestamp, order long, command string, ok boolean, fields string", "append", "EventTime")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, value): what a shared store of fields holds, read from its checkpoint."""
    with stateful(spark):
        held = spark.read.format("statestore").option("stateVarName", "stores").load(f"{folder}/state")
    each = held.select(F.explode(F.arrays_zip("value.keys", "value.names", "value.texts")).alias("s"))
    return each.select(F.col("s.keys").alias("key"), F.explode(F.arrays_zip("s.names", "s.texts")).alias("f")).select("key", F.col("f.names").alias("name"), F.col("f.texts").alias("value"))


# ---- nested step machines --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """Stages in order, each with the answers that end it.  A failed answer of a ``fatal`` stage ends the machine at once, others are
    reported at its end.  A machine whose name is an answer of another one's stage is a branch of it: its end is that answer."""

    name: str
    stages: dict[str, tuple[str, ...]]
    fatal: frozenset[str] = frozenset()


#: A video task: its frames and its sound are analysed side by side, each by a machine of its own (fixed values).
VIDEO_TASK = (
    Machine("task", {"parallel_analysis": ("video", "audio"), "summary": ("summary",), "save": ("save",)}, frozenset({"parallel_analysis", "summary", "save"})),
    Machine("video", {"frame_extraction": ("frame_extraction",), "scene_detection": ("scene_detection",), "frame_analysis": ("ocr_frame", "frame_description")}, frozenset({"frame_extraction"})),
    Machine("audio", {"audio_conversion": ("audio_conversion",), "parallel_processing": ("asr", "diarization", "classification")}, frozenset({"audio_conversion"})),
)


@dataclass
class Place:
    """Where a machine stands: its stage, the answers to it so far, and what has failed ('' for an answer that hasn't)."""

    step: str
    answers: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)


def answer(machines: tuple[Machine, ...], places: dict[str, Place], event: str, problem: str) -> list[tuple[str, str, str]]:
    """(machine, step, errors) for every change that an event brings; ``problem``: '' or what has failed.  Events that no
    machine waits for, and repeated ones, change nothing."""
    out = []
    if event == "request":
        if not places:
            for m in machines:
                places[m.name] = Place(next(iter(m.stages)))
                out.append((m.name, places[m.name].step, ""))
        return out
    for m in machines:
        at = places.get(m.name)
        if at is None or event not in m.stages.get(at.step, ()) or event in at.answers:
            continue
        at.answers[event] = problem
        wanted, names = m.stages[at.step], list(m.stages)
        if problem and at.step in m.fatal:
            at.failed.append(problem)
            at.step = "failed"
        elif len(at.answers) == len(wanted):
            at.failed += [at.answers[a] for a in wanted if at.answers[a]]
            after = names.index(at.step) + 1
            at.step = names[after] if after < len(names) else "failed" if at.failed else "complete"
        else:
            continue
        at.answers = {}
        ended = at.step in ("failed", "complete")
        errors = ",".join(at.failed) if ended else ""
        out.append((m.name, at.step, errors))
        if ended:
            out += answer(machines, places, m.name, f"{m.name}({errors})" if errors else "")
    return out


class NestedMachines(StatefulProcessor):
    """All machines of a task: where each stands, by name, and the steps they have taken, by machine and step."""

    def __init__(self, machines: tuple[Machine, ...], seconds: int) -> None:
        self.machines, self.seconds = machines, seconds
        self.known = {"request", *(a for m in machines for answers in m.stages.values() for a in answers)} - {m.name for m in machines}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", "machine string", "step string, answers array<string>, problems array<string>, failed array<string>")
        self.steps = handle.getMapState("steps", "machine string, step string", "since timestamp, errors string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        places = {k[0]: Place(v[0], dict(zip(v[1], v[2], strict=True)), list(v[3])) for k, v in self.places.iterator()}
        out, last = [], None
        for ts, _, event, status in _sorted(rows, ["event", "status"], self.known).itertuples(index=False):
            problem = event if status in ("error", "failed") else ""
            for machine, step, errors in answer(self.machines, places, event, problem):
                out.append((key[0], machine, step, ts, errors))
            last = ts
        if last is not None and places:
            for name, at in places.items():
                self.places.updateValue((name,), (at.step, list(at.answers), list(at.answers.values()), at.failed))
            for _, machine, step, ts, errors in out:
                self.steps.updateValue((machine, step), (ts.to_pydatetime(), errors))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(_micros(last) // 1000, timerValues.getCurrentWatermarkInMs()) + 1000 * self.seconds)
        if out:
            yield pd.DataFrame(out, columns=["key", "machine", "step", "since", "errors"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.places.clear()
        self.steps.clear()
        yield from ()

    def close(self) -> None:
        pass


class SharedNestedMachines(NestedMachines):
    """The same for a bucket of tasks: one state with the places of all machines, a list of the steps taken, and one timer for the first task to be forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # an element for each machine of each task
        self.tasks = handle.getValueState("tasks", "keys array<string>, until array<long>, machines array<string>, steps array<string>, answers array<array<string>>, problems array<array<string>>, failed array<array<string>>")
        # an element for all steps of a batch: the feed gives a single element of a list that is appended
        self.steps = handle.getListState("steps", "keys array<string>, machines array<string>, steps array<string>, since array<timestamp>, errors array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tasks, until = self._load()
        out, last = [], {}
        for ts, _, n, event, status in _sorted(rows, ["key", "event", "status"], self.known).itertuples(index=False):
            if event != "request" and n not in tasks:
                continue
            problem = event if status in ("error", "failed") else ""
            for machine, step, errors in answer(self.machines, tasks.setdefault(n, {}), event, problem):
                out.append((n, machine, step, ts, errors))
            last[n] = ts
        if last:
            watermark = timerValues.getCurrentWatermarkInMs()
            for n, ts in last.items():
                until[n] = max(_micros(ts) // 1000, watermark) + 1000 * self.seconds
            self._save(tasks, until)
            _one_timer(self.handle, min(until.values()))
        if out:
            self.steps.appendValue(_columns((n, machine, step, ts.to_pydatetime(), errors) for n, machine, step, ts, errors in out))
            yield pd.DataFrame(out, columns=["key", "machine", "step", "since", "errors"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        tasks, until = self._load()
        until = {n: moment for n, moment in until.items() if moment > watermark}
        self._save(tasks, until)
        if until:
            self.steps.put([_columns(s for element in self.steps.get() for s in zip(*element, strict=True) if s[0] in until)])
            self.handle.registerTimer(min(until.values()))
        else:
            self.steps.clear()
        yield from ()

    def _load(self) -> tuple[dict[str, dict[str, Place]], dict[str, int]]:
        tasks, until, state = {}, {}, self.tasks.get()
        for n, moment, machine, step, answers, problems, failed in zip(*state, strict=True) if state else ():
            tasks.setdefault(n, {})[machine] = Place(step, dict(zip(answers, problems, strict=True)), list(failed))
            until[n] = moment
        return tasks, until

    def _save(self, tasks: dict[str, dict[str, Place]], until: dict[str, int]) -> None:
        flat = [(n, moment, machine, p.step, list(p.answers), list(p.answers.values()), p.failed) for n, moment in until.items() for machine, p in tasks[n].items()]
        if flat:
            self.tasks.update(_columns(flat))
        else:
            self.tasks.clear()


def nested_machines(events: DataFrame, machines: tuple[Machine, ...] = VIDEO_TASK, seconds: int = STATE_SECONDS, shared: bool = False) -> DataFrame:
    """(key, machine, step, since, errors) whenever a machine of a key takes a step.  Input: (key string, event, status, ts, order) with a watermark
    on ts; error and failed both count as failures.  A task without an event for ``seconds`` is forgotten.
    ``shared``: buckets of tasks share states (``steps_taken`` reads their feed)."""
    processor = (SharedNestedMachines if shared else NestedMachines)(machines, seconds)
    return _grouped(events, shared).transformWithStateInPandas(processor, "key string, machine string, step string, since timestamp, errors string", "append", "EventTime")


def steps_taken(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, key, machine, step, since, errors): the feed of the steps of shared machines.  Where tasks have been forgotten, the steps of
    the others in their bucket were written again, so a step counts when it first comes."""
    feed = changes(spark, folder, "steps").where("change_type <> 'delete'")
    each = feed.select("batch_id", F.explode(F.arrays_zip("value.keys", "value.machines", "value.steps", "value.since", "value.errors")).alias("s"))
    each = each.select("batch_id", F.col("s.keys").alias("key"), F.col("s.machines").alias("machine"), F.col("s.steps").alias("step"), "s.since", "s.errors")
    return each.groupBy("key", "machine", "step", "since", "errors").agg(F.min("batch_id").alias("batch_id"))


# ---- joins of two streams --------------------------------------------------------------------------------------


def answered(requests: DataFrame, answers: DataFrame, within: str, how: str = "inner") -> DataFrame:
    """Requests (key, request_ts, ...) with the answers (key, answer_ts, ...) of their key that come within a time after them.  Both sides
    need a watermark: with it, Spark keeps a request until no answer can reach it any more, and then (``how`` left_outer) gives it without one."""
    a, b = requests.withColumnRenamed("key", "request_key"), answers.withColumnRenamed("key", "answer_key")
    fits = F.expr(f"request_key = answer_key AND answer_ts >= request_ts AND answer_ts <= request_ts + INTERVAL {within}")
    return a.join(b, fits, how).withColumnRenamed("request_key", "key").drop("answer_key")
