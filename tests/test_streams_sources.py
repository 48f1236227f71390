import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.sources import readers
from quillspark.streaming import flow

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, name, batches, schema):
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_fan_in_keeps_the_earliest_answer_of_all_chunks(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, branch string, status string, result string, ts timestamp, id long"
    rows = [("k", b, "failed" if i == 0 else "ok", f"{b}{i}", at(100 + max(i, 1)), i) for i in range(20, -1, -1) for b in ("ocr", "description")]
    s = _stream(spark, tmp_path, "chunks", [rows, [("k", "ocr", "ok", "later", at(0), -1)]], schema).withWatermark("ts", "10 minutes")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        got = flow.run_once(flow.fan_in(s, ("description", "ocr"), order="id"), "fan_in_chunks", str(tmp_path / "ckc")).collect()
    finally:
        spark.conf.set(size, before)
    assert [(r["outcome"], r["errors"], r["results"]) for r in got if r["key"] == "k"] == [("failed", "description: description0; ocr: ocr0", ["description0", "ocr0"])]


def test_fan_in(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, branch string, status string, result string, ts timestamp"
    batches = [
        [("a", "ocr", "ok", "o", at(1)), ("b", "ocr", "ok", "o", at(1)), ("c", "description", "ok", "d", at(2))],
        [("a", "ocr", "ok", "again", at(3)), ("a", "description", "ok", "d", at(4)), ("c", "ocr", "failed", "bad", at(4))],
        [("a", "description", "ok", "twice", at(5)), ("x", "ocr", "ok", "late", at(9000))],
        [("y", "ocr", "ok", "z", at(20000))],
        [("z", "ocr", "ok", "z", at(40000))],
    ]
    s = _stream(spark, tmp_path, "in", batches, schema).withWatermark("ts", "1 second")
    got = {(r["key"], r["outcome"], r["errors"]) for r in flow.run_once(flow.fan_in(s, ("description", "ocr")), "fan_in", str(tmp_path / "ck")).collect()}
    assert ("a", "complete", "") in got and ("c", "failed", "ocr: bad") in got and ("b", "timeout", "PROCESSING_TIMEOUT: description") in got
    assert len([g for g in got if g[0] == "a"]) == 1


def test_steps(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, event string, status string, ts timestamp"
    rows = [("a", "request", "ok", at(0)), ("a", "analysis", "ok", at(1)), ("a", "analysis", "ok", at(2)), ("a", "summary", "failed", at(3)), ("a", "save", "ok", at(4)), ("b", "analysis", "ok", at(1))]
    s = _stream(spark, tmp_path, "steps", [rows[:3], rows[3:]], schema).withWatermark("ts", "1 minute")
    got = [r["step"] for r in flow.run_once(flow.step_machine(s, "document"), "steps", str(tmp_path / "ck")).orderBy("ts").collect()]
    assert got == ["analysis", "summary", "error:summary"]
    assert flow.next_step(flow.STEPS["image"], "save", "save", "ok") == "complete"


def test_steps_of_parallel_branches_in_any_order_of_chunks(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, event string, status string, ts timestamp, id long"
    a = ["asr", "request", "asr", "noise", "asr", "classification", "summary", "diarization", "save", "summary", "save"]
    rows = [("a", e, "ok", at(i // 2), i) for i, e in enumerate(a)] + [("b", e, "failed" if e == "asr" else "ok", at(i), i) for i, e in enumerate(("request", "asr", "asr", "diarization", "classification", "summary"))]
    s = _stream(spark, tmp_path, "branches", [rows[::-1]], schema).withWatermark("ts", "1 minute")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        got = flow.run_once(flow.step_machine(s, "audio", order="id"), "branches", str(tmp_path / "ckb")).orderBy("key", "ts", "step").collect()
    finally:
        spark.conf.set(size, before)
    assert [(r["key"], r["step"], (r["ts"] - T0).seconds) for r in got] == [
        ("a", "parallel_processing", 0), ("a", "summary", 3), ("a", "save", 4), ("a", "complete", 5),
        ("b", "parallel_processing", 0), ("b", "error:parallel_processing", 4),
    ]


def test_windows_match_batch(spark, tmp_path):
    schema = "message_id string, user string, ts timestamp"
    rows = [(f"m{i % 40}", f"u{i % 3}", T0 + dt.timedelta(minutes=i)) for i in range(50)]
    s = _stream(spark, tmp_path, "w", [rows[:25], rows[25:]], schema)
    want = flow.tumbling_counts(spark.createDataFrame(rows, schema), "10 minutes", "user")
    got = flow.run_once(flow.tumbling_counts(flow.event_time(s), "10 minutes", "user"), "win", str(tmp_path / "c1"), "complete")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    uniq = flow.run_once(flow.distinct_messages(flow.event_time(s, late="2 hours")), "uniq", str(tmp_path / "c2"))
    assert uniq.count() == 40


def test_dead_letters(spark):
    good, bad = [], []
    run = flow.split_batch(lambda b: b.withColumn("error", F.when(F.col("v") < 0, "NEGATIVE")), lambda d: good.extend(d.collect()), lambda d: bad.extend(d.collect()))
    run(spark.createDataFrame([(1,), (-1,)], "v int"), 0)
    assert [r["v"] for r in good] == [1] and [(r["v"], r["error"]) for r in bad] == [(-1, "NEGATIVE")]


def test_text_files(spark, tmp_path):
    for name, b in {"a": "é".encode(), "b": "﻿mark".encode(), "c": "中文".encode("gbk"), "d": b" \n", "e": "漢".encode("big5")}.items():
        (tmp_path / f"{name}.txt").write_bytes(b)
    got = {r["path"][-5]: (r["text"], r["error"]) for r in readers.text_files(spark, str(tmp_path), "*.txt").collect()}
    assert got["a"] == ("é", None) and got["b"] == ("mark", None) and got["c"] == ("中文", None) and got["d"][1] == "empty file"


def test_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_bytes('﻿"a","b"\n"1","x,y"\n"-",""\n'.encode())
    df = readers.csv_table(spark, str(tmp_path / "ok.csv"))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.collect()] == [("1", "x,y"), ("-", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    (tmp_path / "none.csv").write_text("")
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            readers.csv_table(spark, str(tmp_path / f"{name}.csv"))


def test_csv_of_several_files_with_line_breaks(spark, tmp_path):
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "x.csv").write_text('a,b\n"line\nbreak","say ""so"", then"\n2,y\n')
    (tmp_path / "many" / "y.csv").write_text("a,b\n3,z\n4\n")
    with pytest.raises(ValueError, match="y.csv"):
        readers.csv_table(spark, str(tmp_path / "many"))
    assert readers.csv_table(spark, str(tmp_path / "many"), checked=1).count() == 4
    got = sorted(map(tuple, readers.csv_table(spark, str(tmp_path / "many" / "x.csv")).collect()))
    assert got == [("2", "y"), ("line\nbreak", 'say "so", then')]


def test_books_and_layouts(spark, tmp_path):
    files = spark.createDataFrame([("p", b"x"), ("q", b"!")], "path string, content binary")

    def book(b):
        if b == b"!":
            raise OSError("broken")
        return {"s1": [["a", None], [1, 2]], "empty": [], "s2": ValueError("sheet")}

    got = sorted(map(tuple, readers.workbook_rows(files, book).select("path", "sheet", "row_no", "error").collect()), key=str)
    assert ("p", "s1", 1, None) in got and ("p", "s2", -1, "sheet") in got and ("q", None, -1, "broken") in got and len(got) == 4
    e = readers.layout_elements(files, lambda b: [{"content": "c", "y": 3.0, "origin": "BOTTOMLEFT", "page": 1}]).first()
    assert (e["y"], e["page"]) == (-3.0, 1)
    v = spark.createDataFrame([("v", 21.0), ("w", 1.0)], "path string, duration double")
    got = [(r["path"], r["first_frame"], r["end_frame"]) for r in readers.frame_ranges(v).orderBy("path", "part").collect()]
    assert got == [("v", 0, 3), ("v", 3, 6), ("v", 6, 9), ("v", 9, 11), ("w", 0, 1)]


def test_chunk_files_and_export(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "1", "payload": {"type": "document", "text": "t", "page_numbers": [1, 2]}}]')
    r = readers.read_chunks(spark, str(tmp_path / "c.json")).first()
    assert (r["id"], r["text"], r["page_numbers"]) == ("1", "t", [1, 2])
    got = readers.export(spark.createDataFrame([(i, [i]) for i in range(5)], "a int, b array<int>"), str(tmp_path / "out"), 2)
    assert got["json"] is None and got["csv"] and spark.read.parquet(f"{tmp_path}/out/parquet").count() == 3


def test_models(spark):
    v = spark.range(1).select(models.embed(F.lit("a b a"), dim=16).alias("v")).first()["v"]
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6)
    assert spark.range(1).select(models.describe(F.lit(b"abc"), F.lit("see")).alias("d")).first()["d"] == "see: 3 bytes"

    @models.register("t")
    def base():
        return "base"

    assert models.handler("t", "odd") is base
    with pytest.raises(KeyError):
        models.handler("none", "x")
    r = spark.createDataFrame([("asr", "transformers", '{"audio": 1}'), ("asr", "ollama", "{}"), ("asr", "transformers", "{}"), ("fly", "x", "{}")], "task string, engine string, data string")
    got = [(x["success"], x["result"], x["error"]) for x in models.infer(r, {("asr", "transformers"): lambda d: "heard"}).collect()]
    assert got == [(True, "heard", None), (False, None, "engine not supported"), (False, None, "missing data"), (False, None, "unknown task")]
    o = spark.range(1).select(models.engine_options(F.create_map(F.lit("max_length"), F.lit(5), F.lit("odd"), F.lit(1))).alias("o")).first()["o"]
    assert o == {"num_predict": 5}
    rows = models.media_rows(spark.createDataFrame([("p", b"x")], "path string, content binary"), lambda p, c: [{"start": 0.0, "text": "hi"}], "start double, text string").collect()
    assert rows[0]["text"] == "hi"


def test_fan_in_of_many_keys_shares_states(spark, tmp_path):
    """3000 keys over three batches, one of them without a key: as by a loop, and the states kept are those of buckets, not of keys."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, branch string, status string, result string, ts timestamp, id long"
    keys = [None, *(f"k{n}" for n in range(3000))]
    first = [(k, "ocr" if n % 2 else "other", "ok", f"o{n}", at(n % 50), n) for n, k in enumerate(keys)]
    second = [(k, b, "failed" if n % 7 == 0 else "ok", f"{b[0]}{n}", at(60), n) for n, k in enumerate(keys) if n % 3 for b in ("ocr", "description")]
    late = [("late", "ocr", "ok", "x", at(9000), 0)]
    s = _stream(spark, tmp_path, "many", [first, second, late, [("last", "ocr", "ok", "x", at(9100), 0)]], schema).withWatermark("ts", "1 second")
    got = {r["key"]: (r["outcome"], r["results"]) for r in flow.run_once(flow.fan_in(s, ("description", "ocr"), order="id"), "fan_in_many", str(tmp_path / "ckm")).collect()}
    want = {}
    for n, k in enumerate(keys):
        ocr = f"o{n}" if n % 2 or n % 3 else None
        if n % 3:
            want[k] = ("failed" if n % 7 == 0 else "complete", [f"d{n}", ocr])
        else:
            want[k] = ("timeout", [None, ocr])
    assert {k: v for k, v in got.items() if k not in ("late", "last")} == want
    assert spark.read.format("statestore").load(str(tmp_path / "ckm")).count() <= flow.BUCKETS


def test_steps_of_many_keys_share_states(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "correlation_id string, event string, status string, ts timestamp, id long"
    events = ("request", "asr", "diarization", "classification", "summary")
    rows = [[(f"k{n}", events[i], "ok", at(10 * i + n % 5), n) for n in range(2500) for i in part] for part in ((1, 0), (3, 1), (2,), (4,))]
    s = _stream(spark, tmp_path, "many-steps", rows, schema).withWatermark("ts", "1 minute")
    got = sorted((r["key"], r["step"]) for r in flow.run_once(flow.step_machine(s, "audio", order="id"), "many_steps", str(tmp_path / "cks")).collect())
    assert got == sorted((f"k{n}", step) for n in range(2500) for step in ("parallel_processing", "summary", "save"))
    assert spark.read.format("statestore").load(str(tmp_path / "cks")).count() <= flow.BUCKETS
