"""Keyed state: restarts from the checkpoint, timers, nested machines against a plain loop, joins with late rows."""

import datetime as dt
import json
import random

import pytest

from quillspark.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def feed(spark, folder, rows, schema):
    """One more file of the input of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "1 hour")


COMMANDS = "key string, command string, fields string, seconds long, ts timestamp, order long"


def test_store_goes_on_from_its_checkpoint(spark, tmp_path):
    first = [("a", "set", '{"x": 1, "y": {"z": [1, 2]}}', None, at(0), 1), ("a", "update", '{"x": 2}', None, at(1), 2), ("b", "get", None, None, at(1), 3), ("b", "update", '{"x": 1}', None, at(1), 4), ("c", "set", '{"q": "é"}', None, at(1), 5)]
    second = [("a", "get", None, None, at(2), 6), ("a", "extend", None, 7200, at(2), 7), ("c", "exists", None, None, at(2.5), 8), ("c", "delete", None, None, at(3), 9), ("c", "exists", None, None, at(3), 10)]
    third = [("a", "exists", None, None, at(3.9), 11), ("a", "get", None, None, at(4), 12), ("d", "set", "{}", None, at(30), 13)]
    folder = None
    for rows in (first, second, third):  # a new query each time, from the same checkpoint
        feed(spark, tmp_path / "in", rows, COMMANDS)
        out, folder = state.run_with_state(state.field_store(stream(spark, tmp_path / "in", COMMANDS), 6 * 3600), "store", folder or str(tmp_path / "out"))
    got = {r["order"]: (r["ok"], r["fields"]) for r in out.collect()}
    assert {k for k, (ok, _) in got.items() if ok} == {1, 2, 5, 6, 7, 8, 9, 11, 13} and len(got) == 13
    assert json.loads(got[6][1]) == {"x": 2, "y": {"z": [1, 2]}} and got[12] == (False, None)  # 2 hours from 2 o'clock are over
    feed(spark, tmp_path / "in", [("d", "exists", None, None, at(31), 14)], COMMANDS)
    _, folder = state.run_with_state(state.field_store(stream(spark, tmp_path / "in", COMMANDS), 6 * 3600), "store", folder)
    with state.stateful(spark):
        held = spark.read.format("statestore").option("stateVarName", "life").load(f"{folder}/state")
        assert [r["key"]["key"] for r in held.collect()] == ["d"]  # timers have ended the others


def plain(events):
    """The nested video task by hand."""
    rows, t = [], {"video": {}, "audio": {}, "task": {}}
    stage, bad, ended = {}, {"video": [], "audio": []}, {}

    def go(m, step, k, errors=""):
        stage[m] = step
        rows.append((m, step, k, errors))

    def finish(m, k):
        errors = ",".join(bad[m])
        go(m, "failed" if errors else "complete", k, errors)
        ended[m] = errors
        if stage["task"] == "parallel_analysis":
            if errors:
                go("task", "failed", k, f"{m}({errors})")
            elif len(ended) == 2 and not any(ended.values()):
                go("task", "summary", k)

    for k, (e, failed) in enumerate(events):
        if e == "request":
            if not stage:
                for m, s in (("task", "parallel_analysis"), ("video", "frame_extraction"), ("audio", "audio_conversion")):
                    go(m, s, k)
        elif not stage:
            continue
        elif e in ("frame_extraction", "audio_conversion"):
            m, after = ("video", "scene_detection") if e == "frame_extraction" else ("audio", "parallel_processing")
            if stage[m] == e:
                if failed:
                    bad[m].append(e)
                    finish(m, k)
                else:
                    go(m, after, k)
        elif e == "scene_detection":
            if stage["video"] == e:
                bad["video"] += [e] * failed
                go("video", "frame_analysis", k)
        elif e in ("ocr_frame", "frame_description") and stage["video"] == "frame_analysis" and e not in t["video"]:
            t["video"][e] = failed
            if len(t["video"]) == 2:
                bad["video"] += [x for x in ("ocr_frame", "frame_description") if t["video"][x]]
                finish("video", k)
        elif e in ("asr", "diarization", "classification") and stage["audio"] == "parallel_processing" and e not in t["audio"]:
            t["audio"][e] = failed
            if len(t["audio"]) == 3:
                bad["audio"] += [x for x in ("asr", "diarization", "classification") if t["audio"][x]]
                finish("audio", k)
        elif e in ("summary", "save") and stage["task"] == e:
            go("task", "failed" if failed else {"summary": "save", "save": "complete"}[e], k, e if failed else "")
    return rows


KINDS = ("request", "frame_extraction", "scene_detection", "ocr_frame", "frame_description", "audio_conversion", "asr", "diarization", "classification", "summary", "save")


def test_machines_against_a_plain_loop():
    rng = random.Random(0)
    ends = set()
    for _ in range(3000):
        events = [("request", False)] * (rng.random() < 0.95) + [(rng.choice(KINDS), rng.random() < 0.1) for _ in range(rng.randrange(60))]
        places, got = {}, []
        for k, (e, failed) in enumerate(events):
            got += [(m, s, k, x) for m, s, x in state.answer(state.VIDEO_TASK, places, e, e if failed else "")]
        want = plain(events)
        assert got == want
        ends |= {(m, s) for m, s, _, _ in want}
    assert {("task", "complete"), ("task", "failed"), ("video", "failed"), ("audio", "complete")} <= ends


def test_nested_stream_over_several_batches(spark, tmp_path):
    schema = "key string, event string, status string, ts timestamp, order long"
    rng = random.Random(2)
    tasks = {f"t{i}": [("request", False), *((rng.choice(KINDS), rng.random() < 0.05) for _ in range(80))] for i in range(12)}
    rows = [(k, e, "error" if f else "ok", at(n / 10), n) for k, events in tasks.items() for n, (e, f) in enumerate(events)]
    for part in range(3):  # late answers come with the next batch
        feed(spark, tmp_path / "in", [r for r in rows if r[4] // 27 == part], schema)
    out, folder = state.run_with_state(state.nested_machines(stream(spark, tmp_path / "in", schema)), "nested", str(tmp_path / "out"))
    want = sorted((k, m, s, at(n / 10), x) for k, events in tasks.items() for m, s, n, x in plain(events))
    assert sorted(map(tuple, out.collect())) == want
    log = state.changes(spark, folder, "steps")
    assert log.select("batch_id").distinct().count() > 1
    assert sorted((r["key"]["key"], *r["map_key"], *r["value"]) for r in log.where("change_type = 'update'").collect()) == want


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_join_of_streams(spark, tmp_path, how):
    left, right = "key string, request_ts timestamp, request long", "key string, answer_ts timestamp, answer long"
    feed(spark, tmp_path / "l", [("a", at(0), 1), ("b", at(0), 2), ("c", at(1), 3)], left)
    feed(spark, tmp_path / "r", [("a", at(1), 11), ("a", at(2), 12), ("b", at(5), 13), ("a", at(-1), 14)], right)

    def run():
        requests = spark.readStream.schema(left).parquet(str(tmp_path / "l")).withWatermark("request_ts", "1 hour")
        answers = spark.readStream.schema(right).parquet(str(tmp_path / "r")).withWatermark("answer_ts", "1 hour")
        return state.run_with_state(state.answered(requests, answers, "3 HOURS", how), "join", str(tmp_path / "out"))[0]

    assert sorted((r["request"], r["answer"]) for r in run().where("answer is not null").collect()) == [(1, 11), (1, 12)]
    feed(spark, tmp_path / "l", [("d", at(20), 4), ("e", at(40), 5)], left)
    feed(spark, tmp_path / "r", [("d", at(21), 15), ("e", at(42), 16)], right)
    run()
    feed(spark, tmp_path / "l", [("a", at(2), 6)], left)  # long after the watermark has passed: dropped
    feed(spark, tmp_path / "r", [("a", at(3), 17), ("c", at(2), 18)], right)
    got = sorted(((r["request"], r["answer"]) for r in run().collect()), key=lambda x: (x[0], x[1] or 0))
    pairs = [(1, 11), (1, 12), (4, 15), (5, 16)]
    assert got == (pairs if how == "inner" else sorted([*pairs, (2, None), (3, None)], key=lambda x: (x[0], x[1] or 0)))




# ---- buckets of keys that share states -------------------------------------------------------------------------


def variables(spark, folder, name):
    with state.stateful(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state")


def test_tasks_share_states(spark, tmp_path, monkeypatch):
    """The same steps as with states of their own, over batches between which tasks are forgotten and begun again; two states for all tasks."""
    monkeypatch.setattr(state, "BUCKETS", 2)
    schema = "key string, event string, status string, ts timestamp, order long"
    rng = random.Random(5)
    # t0 to t5 rest after the first batch, are forgotten in the third and begun again in the fourth
    for batch, (hour, tasks) in enumerate([(0, range(12)), (9, range(6, 12)), (11, range(6, 10)), (13, range(14)), (22, range(3))]):
        rows = []
        for i in tasks:
            events = [("request", False), *((rng.choice(KINDS), rng.random() < 0.05) for _ in range(25))]
            rows += [(None if i == 7 else f"t{i}", e, "error" if f else "ok", at(hour + n / 25), 1000 * batch + n) for n, (e, f) in enumerate(events)]
        rng.shuffle(rows)
        feed(spark, tmp_path / "in", rows, schema)
    got = {}
    for shared in (False, True):
        source = state.nested_machines(stream(spark, tmp_path / "in", schema), seconds=4 * 3600, shared=shared)
        out, folder = state.run_with_state(source, "tasks", str(tmp_path / f"out{shared}"))
        got[shared] = sorted(map(str, out.collect()))
    assert got[True] == got[False] and len(got[True]) > 100
    begun = [r for r in got[True] if "'t1'" in r and "parallel_analysis" in r]
    assert len(begun) == 2  # forgotten and begun again
    assert 0 < variables(spark, folder, "tasks").count() <= 2
    held = {k for r in variables(spark, folder, "tasks").collect() for k in r["value"]["keys"]}
    assert "t0" in held and held == {k for r in variables(spark, folder, "steps").collect() for k in r["list_element"]["keys"]}


def test_feed_of_shared_tasks(spark, tmp_path, monkeypatch):
    """Every step once, in its batch, although steps are written again where other tasks of their bucket have been forgotten."""
    monkeypatch.setattr(state, "BUCKETS", 1)
    schema = "key string, event string, status string, ts timestamp, order long"
    for batch, (hour, tasks) in enumerate([(0, "abc"), (9, "bc"), (11, "c"), (13, "ac")]):
        events = ("request", "frame_extraction", "audio_conversion") if batch == 0 else ("request", "scene_detection", "asr", "ocr_frame")
        feed(spark, tmp_path / "in", [(k, e, "ok", at(hour + n / 10), 10 * batch + n) for k in tasks for n, e in enumerate(events)], schema)
    got = {}
    for shared in (False, True):
        source = state.nested_machines(stream(spark, tmp_path / "in", schema), seconds=4 * 3600, shared=shared)
        out, folder = state.run_with_state(source, "feed", str(tmp_path / f"out{shared}"))
        if shared:
            log = state.steps_taken(spark, folder).select("batch_id", "key", "machine", "step", "since", "errors")
        else:
            log = state.changes(spark, folder, "steps").where("change_type = 'update'").select("batch_id", "key.key", "map_key.*", "value.*")
        got[shared] = sorted(map(tuple, log.collect()))
        assert sorted(r[1:] for r in got[shared]) == sorted(map(tuple, out.collect()))
    assert got[True] == got[False] and len({r[0] for r in got[True]}) > 2
    assert state.changes(spark, folder, "steps").where("change_type = 'update'").count()  # something was written again


def test_stores_share_states(spark, tmp_path, monkeypatch):
    """The same answers and fields as with states of their own, over batches between which keys end and are set again; two states for all keys."""
    monkeypatch.setattr(state, "BUCKETS", 2)
    rng = random.Random(7)
    order = 0
    for hour in (0, 3, 9, 12, 20):
        rows = []
        for _ in range(160):
            order += 1
            command = rng.choice(("set", "get", "update", "update", "extend", "delete", "exists", "get"))
            fields = json.dumps({rng.choice("xyz"): rng.choice([1, "é", [None, {"q": 2.5}]])}) if command in ("set", "update") else None
            key = rng.choice([None, *(f"k{i}" for i in range(14 if hour < 20 else 4))])
            rows.append((key, command, fields, rng.choice([None, 7200, 30000]) if command == "extend" else None, at(hour + rng.randrange(8) / 4), order))
        feed(spark, tmp_path / "in", rows, COMMANDS)
    got, folders = {}, {}
    for shared in (False, True):
        out, folders[shared] = state.run_with_state(state.field_store(stream(spark, tmp_path / "in", COMMANDS), 6 * 3600, shared=shared), "stores", str(tmp_path / f"out{shared}"))
        got[shared] = sorted(map(str, out.collect()))
    assert got[True] == got[False] and len(got[True]) == 800
    assert 0 < variables(spark, folders[True], "stores").count() <= 2
    own = variables(spark, folders[False], "fields").selectExpr("key.key", "user_map_key.name", "user_map_value.value").collect()
    held = state.stored(spark, folders[True]).collect()
    assert sorted(map(str, held)) == sorted(map(str, own)) and held
