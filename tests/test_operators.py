import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import estimated_tokens
from quillspark.operators import assets, cache, envelopes, packing, registry, summarize, temporal, vector
from quillspark.plans import catalogue


def greedy(weights, limit, joiner):
    chunks, total = [], 0
    for w in weights:
        if chunks and total + joiner + w <= limit:
            chunks[-1].append(w)
            total += joiner + w
        else:
            chunks.append([w])
            total = w
    return chunks


@pytest.mark.parametrize("joiner", [0, 2])
def test_packing_against_a_loop(spark, joiner):
    rng = random.Random(joiner)
    rows = [(k, [rng.randrange(0, 30) for _ in range(rng.randrange(0, 40))]) for k in range(30)] + [(99, [50]), (98, [10, 10]), (97, [20])]
    df = spark.createDataFrame(rows, "k int, w array<long>").withColumn("items", F.transform("w", lambda x: x.cast("string")))
    got = {}
    for r in packing.packed(df, ["k"], "items", "w", 20, ",", joiner).orderBy("k", "chunk_index").collect():
        got.setdefault(r["k"], []).append([int(x) for x in r["text"].split(",")])
        assert r["tokens"] == sum(got[r["k"]][-1]) + joiner * (r["n_items"] - 1)
    assert got == {k: greedy(w, 20, joiner) for k, w in rows if w}


def test_long_sentences_are_cut(spark):
    df = spark.createDataFrame([(1, "a b\n" + "w " * 25 + "\nc"), (2, ""), (3, None)], "k int, t string")
    got = [(r["chunk_index"], r["tokens"]) for r in packing.chunk_sentences(df, "k", "t", 10).collect()]
    assert sorted(got) == [(0, 2), (1, 10), (2, 10), (3, 5), (4, 1)]


def test_html_chunks(spark):
    page = "<p>one two</p>\n\n<div>" + "x" * 5000 + " y z" * 30 + "</div><br/>tail"
    rows = packing.chunk_html(spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "no tags")], "k int, h string"), "k", "h", 20).collect()
    assert {r["k"] for r in rows} == {1, 4}
    assert sum(len(r["text"]) for r in rows if r["k"] == 1) >= 5000
    assert all(len(r["text"]) <= 60 or r["tokens"] <= 30 for r in rows)


def test_elements_and_tables(spark):
    e = spark.createDataFrame([("d", 2, 1.0, 0, "text", "c c"), ("d", 1, 5.0, 1, "table", "b"), ("d", None, 9.0, 2, "text", "a a a")], "k string, page int, y double, pos int, type string, content string")
    got = packing.pack_elements(e, "k", 4).orderBy("chunk_index").collect()
    assert [(r["text"], r["element_types"], r["page_numbers"]) for r in got] == [("a a a\n\nb", ["table", "text"], [0, 1]), ("c c", ["text"], [2])]
    t = spark.createDataFrame([(1, ["h"], [["r1"], ["r2 " + "w " * 50], ["r3"]])], "k int, h array<string>, r array<array<string>>")
    rows = packing.pack_table_rows(t, "k", "h", "r", 20).orderBy("chunk_index").collect()
    assert [(r["first"], r["n_rows"]) for r in rows] == [(0, 1), (1, 1), (2, 1)] and rows[0]["text"].startswith("| h |\n| --- |\n| r1 |")
    wide = spark.createDataFrame([(1, ["id", *[f"c{i}" for i in range(40)]])], "k int, h array<string>")
    cols = packing.pack_table_columns(wide, "k", "h", 40).orderBy("chunk_index").collect()
    assert all(r["columns"][0] == "id" for r in cols) and [c for r in cols for c in r["columns"][1:]] == [f"c{i}" for i in range(40)]


def _span(spark, rows, names):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("bin_size", [None, 1.5])
def test_speakers(spark, bin_size):
    speech = _span(spark, [("f", 0, 0.0, 2.0), ("f", 1, 2.0, 6.0), ("f", 2, 9.0, 9.5), ("f", 3, 10.0, 14.0)], "k string, pos int, s1 double, e1 double")
    turns = _span(spark, [("f", 0, 2.0, 3.0, "late"), ("f", 1, 3.0, 4.0, "b"), ("f", 2, 4.0, 5.0, "b"), ("f", 3, 10.0, 11.5, "one"), ("f", 4, 11.5, 13.0, "one"), ("f", 5, 12.0, 13.8, "two")], "k string, turn_pos int, s2 double, e2 double, speaker string")
    got = {r["pos"]: r["speaker"] for r in temporal.best_speaker(speech, turns, "k", bin_size).collect()}
    assert got == {0: None, 1: "late", 2: None, 3: "two"}  # touching is none; the first of equals; the longest single turn
    left = temporal.overlap_join(speech, turns, "k", "left", bin_size)
    assert left.where("pos = 0").select("speaker").first()[0] is None


def test_labels(spark):
    speech = _span(spark, [("f", 0, 0.0, 2.0), ("f", 1, 5.0, 6.0)], "k string, pos int, s1 double, e1 double")
    seg = spark.createDataFrame([("f", 0.0, 1.0, [("x", 0.5), ("y", 0.4)]), ("f", 1.0, 3.0, [("x", 0.9)])], "k string, s2 double, e2 double, top_classes array<struct<label:string,probability:double>>")
    assert {r["pos"]: r["labels"] for r in temporal.overlapping_labels(speech, seg, "k").collect()} == {0: ["x"], 1: []}


def test_scenes(spark):
    rows = [("one", 0, None), *[("flat", i, 1.0) for i in range(4)], *[("spike", i, 9.0 if i == 2 else 1.0) for i in range(5)]]
    got = temporal.scenes(spark.createDataFrame(rows, "v string, i int, diff double"), "v", "i").collect()
    assert [(r["v"], r["i"], r["at"]) for r in got] == [("spike", 2, 4.0)]


ENVELOPE = '{"message_id": 1, "correlation_id": 1, "timestamp": "%s", "source_service": 1, "target_service": "me", "message_type": 1, "priority": null, "payload": {"request_id": 1, "action": "%s", "parameters": {"asset_path": null, "version_id": 1, "primary_filename": 1, "status": 1}}, "retry_count": 0, "ttl": 60}'


def test_guards(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:01:00"))
    cases = [
        (ENVELOPE % ("2024-01-01T00:00:00Z", "document_processing"), None),
        (ENVELOPE % ("2023-12-31T23:59:59Z", "document_processing"), "MESSAGE_EXPIRED"),
        (ENVELOPE % ("soon", "document_processing"), None),
        (ENVELOPE % ("soon", "other"), "UNKNOWN_ACTION"),
        ((ENVELOPE % ("soon", "other")).replace('"me"', '"you"'), "WRONG_TARGET"),
        ((ENVELOPE % ("2020-01-01T00:00:00Z", "x")).replace('"ttl"', '"tt"'), "INVALID_FORMAT"),
        ((ENVELOPE % ("soon", "document_processing")).replace('"asset_path": null, ', ""), "INVALID_FORMAT"),
        ("no json", "INVALID_FORMAT"),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string")
    got = {r["i"]: r["e"] for r in df.select("i", envelopes.error_code(F.col("v"), now, "me", ["document_processing"]).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    assert df.limit(1).select(envelopes.reduced(F.col("v"))).first()[0]


def test_routing(spark):
    names = ["A.PDF", "x.tar.png", "noext", "v.MKV", "s.m4a", "."]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = {r["filename"]: (r["modality"], r["topic"]) for r in envelopes.route(df, envelopes.topics(spark)).collect()}
    assert [got[n][0] for n in names] == ["document", "image", "unknown", "video", "audio", "unknown"]
    assert got["A.PDF"][1] == "document-processing-requests" and got["."][1] is None
    c = F.col("filename")
    assert [r[0] for r in df.select(envelopes.analyser(c)).collect()] == ["pdf", None, None, None, None, None]
    assert [r[0] for r in df.select(envelopes.processing_mode(c, F.lit("ocr"))).collect()][:2] == ["ocr", "default"]
    assert spark.range(1).select(envelopes.mime_type(F.lit("a.mp3"), F.lit("audio/mp3"))).first()[0] == "audio/mpeg"


def test_priorities(spark):
    def plain(items):
        """The sequential rule, written out."""
        have = sorted((p, n) for n, p in items if p and p > 0)
        used, out, nxt = [], {}, 1
        for p, n in have:
            if sum(q == p for q, _ in have) > 1:
                while nxt in used:
                    nxt += 1
                first = p not in used
                got = p if first else nxt
                nxt = nxt if first else nxt + 1
            else:
                got = p
            used.append(got)
            out[n] = got
        top = max(used, default=0)
        for k, (n, _) in enumerate(sorted((n, p) for n, p in items if not p)):
            out[n] = top + k + 1
        return out

    rng = random.Random(5)
    tasks = {t: [(f"m{i:02d}", rng.choice([None, 1, 1, 2, 3, 5, 9])) for i in range(rng.randrange(1, 9))] for t in range(25)}
    df = spark.createDataFrame([(t, n, "1", p) for t, items in tasks.items() for n, p in items], "task int, name string, version string, priority int")
    rows = registry.priorities(df)
    got = {}
    for r in rows.collect():
        got.setdefault(r["task"], {})[r["name"]] = r["new_priority"]
    assert got == {t: plain(items) for t, items in tasks.items()}
    shifted, given = registry.insert_priority(rows.where("task = 0"), 1)
    assert min(r["new_priority"] for r in shifted.collect()) >= 1 + (min(got[0].values()) == 1)
    with pytest.raises(ValueError):
        registry.insert_priority(rows, 0)


def test_transitions(spark):
    v = spark.createDataFrame([("m", "1", "production"), ("m", "2", "staging"), ("n", "1", "production")], "name string, version string, stage string")
    got = {(r["name"], r["version"]): r["stage"] for r in registry.transition(v, "m", "2", "production").collect()}
    assert got == {("m", "1"): "archived", ("m", "2"): "production", ("n", "1"): "production"}
    refused = registry.transition(v, "m", "1", "staging").where("error is not null").collect()
    assert [(r["version"], r["stage"]) for r in refused] == [("1", "production")]
    new = spark.createDataFrame([("m", "none", 1), ("z", "none", 1), ("m", "none", 2)], "name string, stage string, seq int")
    got = sorted((r["name"], r["version"]) for r in registry.register_version(v, new).where("stage = 'none'").collect())
    assert got == [("m", "3"), ("m", "4"), ("z", "1")]
    assert {r["version"] for r in registry.latest_versions(spark.createDataFrame([("a", "9"), ("a", "10")], "name string, version string")).collect()} == {"10"}


def test_config(spark):
    rows = spark.createDataFrame(registry.flatten_config({"gpu": {"count": 2, "name": "big"}, "api": {"port": "gpu"}}), "path string, key string, value string")
    assert sorted((r["path"], r["match_type"]) for r in registry.search_config(rows, "GPU").collect()) == [("api.port", "value"), ("gpu", "key")]
    r = registry.config_report(rows, ["gpu", "db"]).first()
    assert (r["missing"], r["n_items"]) == (["db"], 5)


def test_assets(spark):
    ts = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d} 00:00:00"))
    a = spark.createDataFrame([("p", "1", "archived", 1), ("p", "2", "archived", 2), ("q", "1", "active", 1)], "asset_path string, version_id string, status string, d int")
    a = a.withColumn("upload_date", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)))
    a = assets.with_retention(a, 1, 1)
    left, gone = assets.destroy_due(a, ts(4), ["asset_path"])
    assert {(r["version_id"], r["drop_object"]) for r in gone.collect()} == {("1", False), ("2", True)}
    assert [r["asset_path"] for r in left.collect()] == ["q"]
    due = assets.archive_due(a, ts(2))
    assert {r["asset_path"]: r["status"] for r in due.collect()}["q"] == "archived"
    assert assets.archive_due(due, ts(2)).exceptAll(due).isEmpty()  # running it again changes nothing
    users = spark.createDataFrame([("u", ["list"])], "username string, permissions array<string>")
    after, bad = assets.create_users(users, spark.createDataFrame([("u", ["list"]), ("v", ["fly"]), ("w", ["upload"])], "username string, permissions array<string>"))
    assert {r["username"] for r in after.collect()} == {"u", "w"} and {r["error"] for r in bad.collect()} == {"duplicate user", "unknown permission"}
    commits = spark.createDataFrame([], "path string, branch string, version string, ts long")
    up = spark.createDataFrame([("p", "b", "x", 1)], "path string, branch string, content string, ts long")
    once = assets.commit(commits, up)
    assert assets.commit(once, up.withColumn("ts", F.lit(2).cast("long"))).count() == once.count() == 1
    m = spark.range(1).select(assets.merge_associated(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(9))).alias("m")).first()["m"]
    assert m == {"a": 9, "b": 2}


def test_vectors(spark):
    for bad in ({"query_text": ""}, {"query_text": "q", "limit": 0}, {"query_text": "q", "embedding_type": "x"}):
        with pytest.raises(ValueError):
            vector.request(**bad)
    rows = [("1", "t", "text", "active", "f", "s1", "ann", [1.0, 0.0]), ("2", "t", "text", "active", "g", "s2", "bob", [1.0, 0.0]), ("3", "t", "text", "inactive", "f", "s1", "ann", [1.0, 0.0]), ("4", "t", "summary", "active", "f", "s1", None, [0.0, 1.0]), ("5", "t", "text", "active", "f", "s1", "ann", [0.0, 0.0])]
    p = spark.createDataFrame(rows, "id string, type string, embedding_type string, status string, filename string, source string, speaker string, vec array<float>")
    ids = lambda **k: [r["id"] for r in vector.top_k(p, [1.0, 0.0], 5, vector.metadata_filter(**k)).collect()]
    assert ids(embedding_type="text") == ["1", "2"]
    assert ids(embedding_type="text", filename=["f"]) == ids(embedding_type="text", filename="f") == ["1"]
    assert ids(embedding_type="summary", speaker="nobody") == ["4"]
    assert ids(embedding_type="text", speaker=["bob"]) == ["2"]


def test_nearest_k_for_every_query(spark):
    rng = np.random.default_rng(3)
    e = [(i, f"f{i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 6)))]
    e += [(100 + i, "copy", e[7][2]) for i in range(8)] + [(200, "null", None), (201, "zero", [0.0] * 6)]
    q = [(f"q{i}", e[i][2]) for i in (3, 7, 11)] + [("none", None), ("zero", [0.0] * 6)]
    entries, queries = spark.createDataFrame(e, "id long, name string, vec array<float>"), spark.createDataFrame(q, "query string, qvec array<float>")
    unit = lambda v: np.array(v, "f4").astype("f8") / np.linalg.norm(np.array(v, "f4").astype("f8"))
    want = {n: sorted((-round(float(unit(v) @ unit(x)), 9), i, name) for i, name, x in e if x and any(x))[:5] for n, v in q[:3]}
    for blocks in ((1024, 8192), (2, 20)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(vector, "QUERY_BLOCK", blocks[0])
            m.setattr(vector, "ENTRY_BLOCK", blocks[1])
            got = vector.nearest_k(entries, queries, 5, keep=["name"]).collect()
        for n in want:
            assert sorted((-r["score"], r["id"], r["name"]) for r in got if r["query"] == n) == want[n]
        assert {r["query"] for r in got} == set(want)


def test_searches_take_every_query(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0 and embedding is not null").collect()}
    for name in ("topk_all", "filtered_topk_all", "topk_in_list_all"):
        assert {r["query"] for r in catalogue.queries()[name](spark, sf).collect()} == ids
    without = catalogue.queries()["topk_all"](spark, sf).where("source is null")
    assert without.count() > 0


def test_cache(spark):
    now = F.lit(10)
    c = spark.createDataFrame([("a", "old", 5, [1.0, 0.0], "s"), ("b", "live", 20, [1.0, 0.0], "s"), ("c", "other", 20, [1.0, 0.0], "z")], "key string, value string, expires_at int, vec array<double>, scope string")
    calls = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    out, made = cache.read_through(c, calls, now, lambda m: m.select("key", F.lit("new").alias("value")))
    assert sorted((r["key"], r["value"]) for r in out.collect()) == [("a", "new"), ("a", "new"), ("b", "live")] and made.count() == 1
    q = spark.createDataFrame([(1, "none", "s", [0.8, 0.6]), (2, "none", "s", [0.7, 0.7142]), (3, "c", "q", [1.0, 0.0])], "query int, key string, scope string, qvec array<double>")
    got = {r["query"]: (r["value"], r["how"]) for r in cache.semantic_or_exact(c, q, now, 0.8).collect()}
    assert got == {1: ("live", "similar"), 2: (None, "miss"), 3: ("other", "exact")}
    trace = spark.createDataFrame([("x", i, k, b) for i, (k, b) in enumerate([("a", 1), ("b", 1), ("a", 1), ("c", 1), ("b", 1), ("d", 9)])], "cache string, pos long, key string, bytes long")
    got = [(r["hit"], r["evicted"]) for r in cache.lru_evictions(trace, "cache", 2, 9).orderBy("pos").collect()]
    assert got == [(False, ""), (False, ""), (True, ""), (False, "b"), (False, "a"), (False, "c,b")]


def test_summaries_read_whole_texts(spark):
    talk = "Alpha beta gamma. "
    rows = [(1, i, "x" * 70 + f"{i}. Nothing{i} else{i}. " + ("The launch of the rocket, the launch is late." if i in (3, 6) else f"Some{i}.")) for i in range(8)]
    rows += [(2, i, talk * 3 + f"Word{i} other{i}.") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = {r["k"]: r["summary"] for r in summarize.layered_summary(df, "k", "i", "t").collect()}
    assert "rocket" in got[1] and "Alpha" in got[2]  # turns 3 and 6, after 60 characters
    batches = {r["k"]: r for r in summarize.batch_summary(df, "k", "i", "t", limit=120).collect()}
    assert "rocket" in batches[1]["summary"]
    # with a summariser that keeps every second word, summaries are batched until they fit
    half = lambda ts: " ".join([w for t in ts if t for w in t.split()][::2])
    calls = [(7, i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(64)] + [(8, 0, "just one"), (9, 0, None)]
    many = spark.createDataFrame(calls, "k int, i int, t string")
    out = {r["k"]: (r["summary"], r["n_batches"]) for r in summarize.batch_summary(many, "k", "i", "t", summarise=F.udf(half, "string"), limit=60).collect()}

    def tokens(t):
        return spark.range(1).select(estimated_tokens(F.lit(t))).first()[0]

    items, n = [c[2] for c in calls[:64]], None
    while True:
        weight = [tokens(t) for t in items]
        at = iter(items)
        made = [half([next(at) for _ in g]) for g in greedy(weight, 60, 0)]
        n, before, after, items = n or len(made), sum(weight), sum(map(tokens, made)), made
        if len(items) == 1 or after <= 60 or after >= before:
            break
    want = items[0] if len(items) == 1 else half(items)
    assert out[7] == (want, n) and out[8] == ("just", 1) and set(out) == {7, 8, 9}


def test_summaries(spark):
    rows = [(k, i, f"t{i} " * 5) for k, n in ((1, 1), (2, 5), (3, 23), (4, 0)) for i in range(n)]
    got = {r["k"]: (r["layers"], r["summary"]) for r in summarize.layered_summary(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1, 3: 2}
    assert got[1][1] == "t0 " * 5
    fi = envelopes.fan_in(spark.createDataFrame([("c", "ocr", 2, "failed", "late"), ("c", "ocr", 1, "ok", "x"), ("c", "description", 3, "error", "boom"), ("d", "ocr", 1, "ok", "x")], "correlation_id string, branch string, ts int, status string, result string"), envelopes.BRANCHES["image"])
    assert [(r["correlation_id"], r["errors"]) for r in fi.collect()] == [("c", "description: boom")]


def test_segment_means_in_the_order_of_the_file(spark, tmp_path):
    """Three discounts whose sum depends on the order, spread over two files, beside a single one: which mean is larger is decided by the order of the rows."""
    grid = [k / 100 for k in range(11)]
    odd = [(a, b, c) for a in grid for b in grid for c in grid if (a + b) + c != a + (b + c)][:60]
    first = [(n, 1, "A", "F", a) for n, (a, _, _) in enumerate(odd)]
    rest = [(n, 1, "A", "F", x) for n, (_, b, c) in enumerate(odd) for x in (b, c)] + [(n, 1, flag, "O", (b + c + a) / 3) for n, (a, b, c) in enumerate(odd) for flag in "AR"]
    rest += [(n, 1, "B", "F", (a + (b + c)) / 3) for n, (a, b, c) in enumerate(odd)]
    for rows in (first, rest):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double").coalesce(1).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    files = sorted((tmp_path / "lineitem.parquet").glob("*.parquet"))
    in_order = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    sums: dict = {}
    for r in in_order:
        s, n = sums.get((r[0], r[2] + r[3]), (0.0, 0))
        sums[r[0], r[2] + r[3]] = (s + r[4], n + 1)
    want = set()
    for order in range(len(odd)):
        means = sorted((-s / n, label) for (k, label), (s, n) in sums.items() if k == order)
        want |= {(order, label, rank) for rank, (_, label) in enumerate(means, 1)}
    got = {(r["l_orderkey"], r["label"], r["rank"]) for r in catalogue.queries()["segment_top5"](spark, str(tmp_path)).collect()}
    assert got == want


def test_permitted_users_are_dealt_over_tasks(spark):
    """Users of one file and one branch: their pairs come from several tasks."""
    users = spark.range(0, 400, 1, 1).selectExpr("id as user", "1 as branch", "array('list') as permissions")
    out = assets.permitted(users, spark.range(5).selectExpr("id as asset", "1 as branch"), "list").withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert len({(r["user"], r["asset"]) for r in rows}) == len(rows) == 2000
    assert len({r["task"] for r in rows}) == 4


def test_sentences_are_chunked_by_several_tasks(spark):
    docs = spark.range(0, 400, 1, 1).selectExpr("id as k", "concat('a b c', char(10), 'd e', char(10), string(id)) as t")
    rows = packing.chunk_sentences(docs, "k", "t", 5).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["k"], r["chunk_index"], r["tokens"], r["text"]) for r in rows) == [x for k in range(400) for x in ((k, 0, 5, "a b c d e"), (k, 1, 1, str(k)))]
    assert len({r["task"] for r in rows}) == 4
