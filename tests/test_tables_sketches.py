"""Table functions, stored sketches, phrase conversion and batches of uploads and users, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tables
from quillspark.functions import text as T
from quillspark.operators import assets, packing, sketches
from quillspark.operators.ordering import written


def greedy(items, limit, sep, joiner):
    out = []
    for k, (w, t) in enumerate(items):
        w = w or 0
        if out and out[-1][2] + joiner + w <= limit:
            out[-1][1] += 1
            out[-1][2] += joiner + w
        else:
            out.append([k, 1, w, []])
        out[-1][3] += [t] if t is not None else []
    return [(k, *c[:3], sep.join(c[3])) for k, c in enumerate(out)]


@pytest.mark.parametrize(("limit", "joiner"), [(20, 1), (5, 0)])
def test_packed_rows(spark, limit, joiner):
    rng = random.Random(limit)
    rows = [(k, i, rng.choice([None, *range(9), 40]), rng.choice([None, f"t{i}"])) for k in (None, "a", "b c") for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "my key string, pos int, w int, text string".replace("my key", "`my key`")).repartition(5)
    got = {}
    for r in tables.pack_rows(df, "my key", ["pos"], "w", "text", limit, " ", joiner).collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    want = {k: greedy([(w, t) for q, _, w, t in rows if q == k], limit, " ", joiner) for k, _, _, _ in rows}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert tables.pack_rows(df.limit(0), "my key", ["pos"], "w", None, limit).count() == 0
    with pytest.raises(Exception, match="nothing"):
        tables.pack_rows(df, "my key", ["nothing"], "w", "text", limit)


def test_one_key_with_all_rows(spark):
    """300 000 rows of one key: a stream through one task, equal to the fold on a part of it."""
    rows = spark.range(300_000).selectExpr("'hot' as k", "id as pos", "id * 7919 % 13 as w")
    got = tables.pack_rows(rows, "k", ["pos"], "w", None, 50)
    total = got.agg(F.sum("n_items"), F.sum("tokens"), F.max("tokens"), F.count("*"), F.max("chunk_index")).first()
    assert total[0] == 300_000 and total[1] == rows.agg(F.sum("w")).first()[0] and total[2] <= 50 and total[3] == total[4] + 1
    some = rows.where("pos < 2000").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("r")).select("k", F.col("r.w").alias("w"), F.transform("r", lambda x: x.pos.cast("string")).alias("items"))
    fold = packing.packed(some, ["k"], "items", "w", 50)
    assert sorted(tuple(r)[:5] for r in tables.pack_rows(rows.where("pos < 2000"), "k", ["pos"], "w", None, 50).collect()) == sorted(tuple(r)[:5] for r in fold.collect())


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 10 as day", "if(id % 3 = 0, 'a', 'b') as g", "cast(if(id % 50 = 0, null, id * 31 % 20000) as string) as item", "double(id % 1000) as v")
    daily = written(sketches.daily(rows, F.col("day"), ["g"], "item", "v"), "daily")
    assert daily.count() == 20
    merged = sketches.merged(daily, ["g"])
    whole = sketches.daily(rows, F.lit(0), ["g"], "item", "v")
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count_distinct("item").alias("d"), F.count("*").alias("n")).collect()}
    one = {r["g"]: r for r in merged.select("g", "n", sketches.distinct().alias("hll"), sketches.distinct("theta").alias("theta"), sketches.quantile(0.9).alias("q")).collect()}
    two = {r["g"]: r for r in whole.select("g", "n", sketches.distinct().alias("hll")).collect()}
    for g, r in one.items():
        assert r["n"] == two[g]["n"] == exact[g]["n"] and r["hll"] == two[g]["hll"]
        assert abs(r["hll"] - exact[g]["d"]) < 0.06 * exact[g]["d"] and abs(r["theta"] - exact[g]["d"]) < 0.06 * exact[g]["d"] and abs(r["q"] - 900) < 30
    sides = sketches.merged(daily.where("day < 5"), []).select(F.col("theta").alias("a")).join(sketches.merged(daily.where("day >= 3"), []).select(F.col("theta").alias("b")))
    early, late = ({r[0] for r in rows.where(f"item is not null and {c}").select("item").distinct().collect()} for c in ("day < 5", "day >= 3"))
    about = sides.select(sketches.only_in("a", "b")).first()[0]
    assert abs(about - len(early - late)) < 0.1 * len(early) + 5


def test_phrases(spark):
    rng = random.Random(2)
    table = {"".join(rng.choice("abc国") for _ in range(rng.randrange(1, 5))): rng.choice(["X", "", "国國", "a"]) for _ in range(25)} | {"": "never"}
    texts = ["".join(rng.choice("abc国d") for _ in range(rng.randrange(0, 80))) for _ in range(60)] + [None, ""]
    plain = re.compile("|".join(map(re.escape, sorted((k for k in table if k), key=len, reverse=True))))
    want = [None if t is None else plain.sub(lambda m: table[m[0]], t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["c"] for r in df.select("i", T.to_traditional(F.col("t"), table).alias("c")).orderBy("i").collect()]
    assert got == want


def test_repeats_within_a_batch(spark):
    """Two new users of one name; equal uploads in a row, apart, and around a deletion."""
    users = spark.createDataFrame([("old", ["list"])], "username string, permissions array<string>")
    new = spark.createDataFrame([("a", ["list"]), ("a", ["upload"]), ("a", ["fly"]), ("old", ["list"]), ("b", ["fly"]), ("b", ["list"])], users.schema)
    after, bad = assets.create_users(users, new)
    assert sorted(r["username"] for r in after.collect()) == ["a", "b", "old"]
    assert sorted((r["username"], r["error"]) for r in bad.collect()) == [("a", "duplicate user"), ("a", "unknown permission"), ("b", "unknown permission"), ("old", "duplicate user")]
    none = spark.createDataFrame([], "path string, branch string, version string, ts long")
    up = lambda *rows: spark.createDataFrame([("p", "main", c, t) for c, t in rows], "path string, branch string, content string, ts long")
    first = assets.commit(none, up(("x", 1), ("x", 2), ("y", 3), ("x", 4), (None, 5), (None, 6), ("x", 7), (None, 8)))
    assert sorted(r["ts"] for r in first.collect()) == [1, 3, 4, 5, 7, 8]
    assert assets.standing(first).count() == 0 and assets.commit(first, up((None, 9))).count() == 6
    again = assets.commit(first, up(("x", 10), ("x", 11)))
    assert [r["ts"] for r in assets.standing(again).collect()] == [10]
    assert assets.commit(none, up((None, 1))).count() == 0


def test_estimate_depends_on_the_items_only(spark):
    """A sketch that one task has filled, and the same items by ten days' sketches merged."""
    rows = spark.range(0, 30_000, 1, 1).selectExpr("id % 10 as day", "'a' as g", "id % 2500 as item", "double(id) as v")
    days = sketches.merged(sketches.daily(rows, F.col("day"), ["g"], "item", "v"), ["g"])
    whole = sketches.daily(rows, F.lit(0), ["g"], "item", "v")
    a, b = (df.select(sketches.distinct()).first()[0] for df in (days, whole))
    assert a == b and abs(a - 2500) < 125


def test_packed_rows_pass_in_batches(spark):
    """Keys longer than a batch: as the table function packs them, without a call for every row."""
    rows = spark.range(3000).selectExpr("id % 3 as k", "int(id) as pos", "int(id * 7 % 13) as w", "if(id % 5 = 0, null, string(id)) as text")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "50")
    try:
        out = tables.pack_rows(rows, "k", ["pos"], "w", "text", 40, ",", 1)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set(size, before)
    call = F.udtf(tables.PackRows)(rows.asTable(), F.lit("k"), F.lit("pos"), F.lit("w"), F.lit("text"), F.lit(40), F.lit(","), F.lit(1))
    assert got == sorted(map(tuple, call.collect()))
    assert "UDTF" not in out._jdf.queryExecution().toString()
