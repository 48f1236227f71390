"""Frame distances, ranks and carried values, the inverted file, configurations and priorities against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import configs, frames, index, ordering, registry, temporal, vector


def plain_ssim(x, y):
    """Window by window, pixel by pixel."""
    c1, c2, out = (0.01 * 255) ** 2, (0.03 * 255) ** 2, []
    for i in range(len(x) - 2):
        for j in range(len(x[0]) - 2):
            a = [x[i + p][j + q] for p in range(3) for q in range(3)]
            b = [y[i + p][j + q] for p in range(3) for q in range(3)]
            ma, mb = sum(a) / 9, sum(b) / 9
            va, vb = sum((v - ma) ** 2 for v in a) / 8, sum((v - mb) ** 2 for v in b) / 8
            cov = sum((v - ma) * (w - mb) for v, w in zip(a, b, strict=True)) / 8
            out.append((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)))
    return sum(out) / len(out)


def plain_small(x):
    """Area average at 32 × 32."""
    h, w = len(x), len(x[0])
    if h <= 32 and w <= 32:
        return x
    out = []
    for i in range(32):
        row = []
        for j in range(32):
            total = area = 0.0
            for p in range(h):
                for q in range(w):
                    part = max(0, min((i + 1) * h / 32, p + 1) - max(i * h / 32, p)) * max(0, min((j + 1) * w / 32, q + 1) - max(j * w / 32, q))
                    total, area = total + part * x[p][q], area + part
            row.append(total / area)
        out.append(row)
    return out


@pytest.mark.parametrize(("h", "w"), [(8, 8), (40, 48), (5, 3)])
def test_distances_against_loops(h, w):
    rng = np.random.default_rng(h)
    x = rng.integers(0, 256, (4, h, w)).astype("f8")
    y = np.stack([x[0] + 1, rng.integers(0, 256, (h, w)), np.clip(x[2] + rng.normal(0, 40, (h, w)), 0, 255), x[3] * 0.2])
    got = frames.distances(x, y)
    for k in range(4):
        small = np.abs(np.array(plain_small(x[k].tolist())) - np.array(plain_small(y[k].tolist()))).mean() if max(h, w) > 32 else np.abs(x[k] - y[k]).mean()
        want = 0.1 if small < 5 else np.abs(x[k] - y[k]).mean() * (1 - plain_ssim(x[k].tolist(), y[k].tolist()))
        assert abs(got[k] - want) < 1e-9
    assert got[0] == 0.1


def test_frames_over_blocks_and_batches(spark):
    rng = np.random.default_rng(0)
    rows = [(int(v), i, [float(p) for p in rng.integers(0, 256, 24)], 4) for v, n in ((0, 70), (1, 1), (2, 30)) for i in range(n)]
    rows += [(3, 0, None, 4), (3, 1, [1.0] * 24, 4), (3, 2, [200.0] * 12, 4), (3, 3, [9.0] * 4, 2), (3, 4, [99.0] * 4, 2)]
    df = spark.createDataFrame(rows, "video long, frame long, pixels array<double>, width int").repartition(5)
    got = {(r["video"], r["frame"]): r["diff"] for r in frames.frame_distances(df, "video", "frame", block_rows=16).collect()}
    assert len(got) == len(rows)
    of = {(v, i): np.array(p).reshape(-1, 4) for v, i, p, w in rows if p and w == 4}
    for v, i, _, _ in rows:
        if v < 3 and i:
            assert abs(got[v, i] - frames.distances(of[v, i][None], of[v, i - 1][None])[0]) < 1e-9
        else:
            assert got[v, i] is None
    assert frames.frame_distances(df.limit(0), "video", "frame").count() == 0


def test_as_of_with_a_hot_key(spark):
    """One key with half of all rows, cut into many blocks; nulls, ties and keys without a right side."""
    rng = random.Random(1)
    right = [(0, t, t * 10) for t in rng.sample(range(2000), 60)] + [(k, 5, k) for k in range(1, 20)] + [(None, 3, 77)]
    left = [(0, rng.randrange(2000), i) for i in range(1500)] + [(k, t, 5000 + 10 * k + t) for k in range(1, 25) for t in (4, 5, 6)] + [(None, 2, 9000), (None, 4, 9001)]
    a = spark.createDataFrame(left, "k long, t long, id long")
    b = spark.createDataFrame(right, "k long, t long, v long")
    import quillspark.operators.ordering as o

    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(0)), allowMissingColumns=True)
    blocks = o.last_before(both, "k", "v", F.asc("t"), F.asc("side"), block_rows=37).where("side = 1")
    for got in (blocks, temporal.as_of(a, b, "k", "t", "v")):
        found = {r["id"]: r["v"] for r in got.collect()}
        want = {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for k, t, i in left}
        assert found == want


def test_ranked(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 as v", "id % 3 as g").repartition(7)
    assert [r["v"] for r in ordering.ranked(rows, F.asc("v")).orderBy("_rank").collect()] == list(range(5000))
    assert sorted(r["_rank"] for r in ordering.ranked(rows, F.asc("g")).select("_rank").collect()) == list(range(5000))


def test_inverted_file(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1e200] * 16, 0)]
    e = spark.createDataFrame(rows, "id long, vec array<double>, tag int").repartition(4)
    q = e.where("id % 100 = 0 and vec is not null").selectExpr("id as query", "vec as qvec")
    made = index.build(e, keep=["tag"])
    assert sorted(r["id"] for r in made.posted(spark).select("id").collect()) == [*range(900), 902]
    exact = vector.nearest_k(e, q, 5, keep=["tag"])
    probes = index.tuned(made, e, 5, 0.95)
    assert probes < len(made.centroids) / 2
    found = index.search(made, q, 5, probes)
    assert found.columns == exact.columns and index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    every = index.search(made, q, 5, len(made.centroids))  # all lists: exact
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert index.search(index.build(e.limit(0)), q, 5, 3).count() == 0


def test_nearest_by_scope_and_magnitude(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    scale = [10.0 ** int(k) for k in rng.integers(-200, 200, 60)]
    rows = [(f"k{i}", (x[i] * scale[i]).tolist(), "a" if i % 3 else None, f"k{(i * 7) % 60}") for i in range(60)]
    e = spark.createDataFrame([r[:3] for r in rows], "key string, vec array<double>, scope string")
    q = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "query string, qvec array<double>, scope string")
    got = {r["query"]: r["key"] for r in vector.nearest(e, q, 0.2, scope="scope", skip_same=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        best = max(((float(u[i] @ u[j]), rows[j][0]) for j in range(60) if j != i and rows[j][2] == rows[i][2]))
        assert got.get(f"k{i}") == (best[1] if best[0] >= 0.2 else None)


CONFIGS = [{"a": {"Path": "/x/A", "deep": {"a": [1, {"path": "no"}, []], "n": None}}, "b": {}, "c": "aPAth", "d": 5}, {}, {"storage": {"x": 1}, "e": []}, None]


def walk(data, path=""):
    if isinstance(data, dict):
        for k, v in data.items():
            at = f"{path}.{k}" if path else k
            if "path" in k.lower():
                yield at, "key"
            if isinstance(v, str) and "path" in v.lower():
                yield at, "value"
            yield from walk(v, at)


def count(data):
    return len(data) + sum(map(count, data.values() if isinstance(data, dict) else data)) if isinstance(data, dict | list) else 0


def test_configs(spark):
    docs = spark.createDataFrame([(i, None if c is None else json.dumps(c)) for i, c in enumerate(CONFIGS)] + [(9, "{broken")], "id long, config string")
    rows = configs.entries(docs, "id")
    got = sorted((r["id"], r["path"], r["match_type"]) for r in configs.search(rows, "PATH").collect())
    assert got == sorted((i, p, m) for i, c in enumerate(CONFIGS) if c for p, m in walk(c))
    assert not configs.search(rows, "PATH", case_sensitive=True).count()
    items = {(r["id"], r["section"]): r["items"] for r in configs.counts(rows, "id").collect()}
    assert items == {(i, k): count(v) for i, c in enumerate(CONFIGS) if c for k, v in c.items()}
    made = {r["id"]: r for r in configs.report(rows, docs, "id", ["storage", "b", "e"]).collect()}
    assert {i: r["n_items"] for i, r in made.items()} == {**{i: count(c or {}) for i, c in enumerate(CONFIGS)}, 9: 0}
    assert (made[0]["missing"], made[0]["empty"], made[2]["missing"], made[2]["empty"], made[9]["missing"]) == (["e", "storage"], ["b"], ["b"], ["e"], ["b", "e", "storage"])


def plain_priorities(items):
    """The rule by lists: [(priority or None, name)] in order → {name: number}."""
    taken, out, free = [], {}, 1
    have = sorted((p, n) for p, n in items if p)
    for p, n in have:
        same = sum(q == p for q, _ in have)
        if same > 1:
            while free in taken:
                free += 1
            if p == next(q for q, m in have if m == n) and n == min(m for q, m in have if q == p) and p not in taken:
                out[n] = p
            else:
                out[n], free = free, free + 1
        else:
            out[n] = p
        taken.append(out[n])
    top = max(taken, default=0)
    for n in sorted(n for p, n in items if not p):
        top += 1
        out[n] = top
    return out


def test_priorities_against_lists(spark):
    rng = random.Random(7)
    tasks = {t: [(rng.choice([None, *range(1, rng.choice([3, 8, 30]))]), n) for n in range(rng.randrange(1, 40))] for t in range(60)}
    df = spark.createDataFrame([(t, n, "1", p) for t, items in tasks.items() for p, n in items], "task int, name int, version string, priority int")
    got = {}
    for r in registry.priorities(df).collect():
        got.setdefault(r["task"], {})[r["name"]] = r["new_priority"]
    assert got == {t: plain_priorities(items) for t, items in tasks.items()}


def test_priorities_of_a_large_task():
    """A million models of one task, most of them with a number of others: one pass."""
    models = [("t", 1 + k // 2, k) for k in range(1_000_000)]
    numbers = [n for _, n in registry.renumbered(models)]
    assert len(numbers) == 1_000_000 and numbers[:4] == [1, 2, 3, 4] and len(set(numbers)) == 1_000_000


def test_overlaps_of_long_and_short_intervals(spark):
    """Intervals of very different lengths meet once each; a long one lies in a few bins."""
    rng = random.Random(11)
    make = lambda n: [(rng.randrange(3), i, s, s + rng.choice([0.0, 0.5, 3.0, 40.0, 9000.0, 10.0**6])) for i, s in enumerate(rng.uniform(-50, 5000) for _ in range(n))]
    a, b = make(80), make(90)
    left = spark.createDataFrame(a, "k int, i int, s1 double, e1 double")
    right = spark.createDataFrame(b, "k int, j int, s2 double, e2 double")
    want = sorted((k, i, j) for k, i, s, e in a for q, j, t, f in b if k == q and s < f and t < e)
    got = temporal.overlap_join(left, right, "k", "inner", 2.0)
    assert sorted((r["k"], r["i"], r["j"]) for r in got.collect()) == want
    every = temporal.overlap_join(left, right, "k", "left", 2.0)
    assert every.where("j is null").count() == sum(not any(k == q and s < f and t < e for q, _, t, f in b) for k, _, s, e in a)
