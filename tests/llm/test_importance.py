import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import common, importance

from .test_exact_sharding_substring import frame, texts


def brute(rows, target, percent, longest, least, buckets):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(feats(x))
    for x in target:
        t.update(feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        f = feats(x)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (plus(big_s, buckets))) / ((s[b] + 1) * plus(big_t, buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return sorted(repr((*r, None)[:6]) for r in out)


def plus(n, buckets):
    return float(n + buckets)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample(spark, longest, monkeypatch):
    monkeypatch.setattr(importance, "HEAD_WORDS", 9)  # most features are in the tail
    monkeypatch.setattr(importance, "HEAD_PAIRS", 5)
    monkeypatch.setattr(importance, "KEPT", 40)
    monkeypatch.setattr(importance, "PART_BYTES", 50)
    odd = ["ÀB cD'e--f 1,2\x00z " * 9, "w1 " * 5000, "x" * 3000]
    rows = [*enumerate([*texts(), *odd]), (None, "w1 w2 " * 20), (3, "w5 " * 30), (3, "w5 " * 30)]
    target = ["w1 w2 w3 w9", None, "", "w7 w8 é"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(frame(spark, rows), t, 25, longest, 20, buckets=101).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, target, 25, longest, 20, 101)


def test_edges(spark):
    t = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(frame(spark, []), t).count() == 0
    rows = [(i, "a b " * 10) for i in range(20)]
    got = importance.resample(frame(spark, rows), t.limit(0), 10).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 20
    assert importance.resample(frame(spark, [(1, None), (2, "")]), t).where("rank is null and weight = 0 and n_features = 0").count() == 2


def test_words_across_parts(monkeypatch):
    text = ("ab CD é9," * 40).encode()
    whole = [w for part in importance.words_of(text) for w in part]
    monkeypatch.setattr(importance, "PART_BYTES", 7)
    assert [w for part in importance.words_of(text) for w in part] == whole
    head = importance.Head({b"ab": zlib.crc32(b"ab")}, {(b"ab", b"cd"): zlib.crc32(b"ab cd")}, 97)
    parts = [f for _, f in head.features(text, 3)]
    monkeypatch.undo()
    assert sorted(np.concatenate(parts)) == sorted(np.concatenate([f for _, f in importance.Head(buckets=97).features(text, 3)]))


def test_ranked(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as v", "id % 2 as rank_").repartition(5)
    got = common.ranked(rows, rows["v"]).orderBy("rank").collect()
    assert [r["v"] for r in got] == list(range(1000)) and [r["rank"] for r in got] == list(range(1000))
