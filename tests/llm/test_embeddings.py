import math

import numpy as np
import pytest

from quillspark.llm import embedding_dedup as e


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    n, comp = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(ok):
        for j, b in ok[:k]:
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize(("dim", "group"), [(8, 64), (64, 4096), (2, 37)])
def test_links(spark, monkeypatch, dim, group):
    monkeypatch.setattr(e, "GROUP", group)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(240, dim)) * np.linspace(2, 0.3, dim)
    x[100:170] = x[:70] + rng.normal(size=(70, dim)) * 0.3
    x[170:200] = x[3] * rng.uniform(0.5, 2, size=(30, 1))
    x[200:215] = x[7]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [None] + [1.0] * (dim - 1)), (904, [float("inf")] * dim), (905, []), (906, [1.0] * (dim + 1)), (907, [2.0] * (dim + 1))]
    df = spark.createDataFrame([(i, v, 0) for i, v in reversed(rows)], "vec_id long, embedding array<float>, vec int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(df, 0.9).collect()}
    assert got == brute(rows, 0.9)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert e.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = e.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 1, 1, True)", "(1, 1, 1, True)", "(2, 0, 2, True)", "(None, 0, None, False)"]


def test_components_keep_their_precision(spark, monkeypatch):
    """Pairs whose cosine passes or misses the threshold only in double precision, over several groups."""
    monkeypatch.setattr(e, "GROUP", 16)
    angle = math.acos(0.9)
    rows = [(k, [math.cos(t), math.sin(t), 0.0]) for k, t in enumerate(i * 0.1 + d for i in range(40) for d in (0.0, angle - 1e-9, angle + 1e-9))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert got == brute(rows, 0.9)


def test_group_count():
    assert e.group_count(0, 64, 8) == e.group_count(4096, 64, 8) == 1
    assert e.group_count(51282, 64, 6) == 4  # as few as occupy six cores
    assert e.group_count(51282, 64, 4000) == 13  # none below GROUP for more cores
    assert e.group_count(10**6, 64, 6) == 62  # none beyond GROUP_BYTES


@pytest.mark.parametrize("exponent", [200, -200])
def test_magnitudes(spark, exponent):
    """Parallel vectors link whatever their length; products of their components overflow or vanish."""
    scale = 10.0**exponent
    rows = [(1, [1.0, 2.0, 3.0]), (2, [scale, 2 * scale, 3 * scale]), (3, [2 * scale, 4 * scale, 6.0000001 * scale]), (4, [3.0, -4.0, 0.5]), (5, [scale, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_vectors(df, 0.9).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
