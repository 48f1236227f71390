import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, ngram_join, packing, wordhash
from quillspark.llm.queries import tokenizer_file

from .test_exact_sharding_substring import frame, texts, thue_morse

VOCAB = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [4096, 16])
def test_pack(spark, capacity):
    from tokenizers import Tokenizer

    rows = [*enumerate(texts()), (None, "no id"), (4, "again"), (4, "again"), (90, "ΑΣ <|endoftext|>x\x1cy İ ﬁ I'LL 12.5 À́"), (91, "A" * 3000)]
    got = [r.asDict() for r in packing.pack(frame(spark, rows), VOCAB, capacity).collect()]
    whole = Tokenizer.from_file(VOCAB)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    for i in ids:
        if i == 4:
            continue
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert len(seqs) <= 1.1 * sum(r["length"] for r in got) / capacity + 2
    assert packing.pack(frame(spark, []), VOCAB).count() == 0


def test_differencing():
    rng = random.Random(0)
    for n, k in ((0, 1), (1, 3), (7, 3), (200, 9), (50, 50), (30, 40)):
        w = [rng.randrange(1, 100) for _ in range(n)]
        got = packing.differencing(w, k)
        assert sorted(i for g in got for i in g) == list(range(n)) and len(got) <= k
    w = [rng.randrange(1, 100) for _ in range(400)]
    sums = [sum(w[i] for i in g) for g in packing.differencing(w, 8)]
    assert max(sums) - min(sums) <= 20


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts(seed):
    rng = random.Random(seed)
    out = texts(seed)
    words = [f"v{i}" for i in range(400)]
    for size in (5, 30, 120):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + size // 14)):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            if rng.random() < 0.3:
                w += [rng.choice(words) for _ in range(rng.randrange(1 + size // 10))]
            out.append(" ".join(w))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(8):  # families that link past their centre
        other = list(base)
        for _ in range(rng.randrange(4, 9)):
            other[rng.randrange(len(other))] = rng.choice(words) + "x"
        for _ in range(5):
            w = list(other)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words) + "y"
            out.append(" ".join(w))
    rng.shuffle(out)
    return [*out, "a", "A", "a b", "a b"]


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 4, 85), (1, 5, 80), (2, 2, 60), (3, 4, 85), (4, 1, 90)])
def test_near_duplicates(spark, seed, k, percent):
    rows = list(enumerate(near_texts(seed)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows), k, percent).collect()}
    want = brute(rows, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_near_edges(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f"), (5, None), (6, "")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("5", 0, 5), ("6", 0, 6), ("9", 2, 3), ("None", 2, None)]
    stay = ngram_join.drop_near_duplicates(frame(spark, rows).withColumn("_stay", F.lit(1)).withColumn("row", F.lit(2)))
    assert stay.columns[-2:] == ["_stay", "row"]
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["3", "5", "6", "None"]
    # rows of one id with different texts are separate documents
    rows = [(3, "a b c d e f"), (3, "g h i j k l"), (8, "g h i j k l"), (8, "m n o p q r"), (8, "")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 2, 3), (3, 2, 3), (8, 0, 8), (8, 2, 3), (8, 2, 8)]
    assert sorted(r["text"] for r in ngram_join.drop_near_duplicates(frame(spark, rows)).collect()) == ["", "a b c d e f", "g h i j k l", "m n o p q r"]


def test_near_colliding_words(spark):
    """Words that a polynomial modulo 2**64 can't tell apart."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y z"), (2, f"{other} x y z"), (3, f"{word} x y z")]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(frame(spark, rows), 4, 85).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize(("own", "seed"), [(4, 0), (3, 1), (2, 2)])
def test_near_shared_passage(spark, own, seed):
    """Documents of one passage and some words of their own: no links among those of four, links past every centre for fewer."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(43)]
    rows = []
    for i in range(60):
        w = [*passage, *(f"o{i}x{j}" for j in range(own))] if i % 3 else [f"o{i}x{j}" for j in range(rng.randrange(own + 1))] + passage[rng.randrange(3) :]
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_near_names_of_clashing_hashes():
    """n-grams that share the first lane get names of their own."""
    entry = lambda run, h, m: {"bucket": 0, "hash": wordhash.planes(np.array(h, "u8")), "more": wordhash.planes(np.array(m, "u8")), "times": wordhash.planes(np.ones(len(h), "u4")), "run": run}
    got = ngram_join._frequencies(pa.Table.from_pylist([entry(1, [5, 5, 6], [1, 2, 3]), entry(2, [5, 5, 6, 7], [1, 2, 3, 9])]))
    names = [wordhash.unplane(x.as_py(), "u8").tolist() for x in got.column("name")]
    assert names == [[5, 8, 6]] * 2 and got.column("bucket").to_pylist() == [1, 2]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in comp}


def test_clear_stored(spark):
    df = common.stored(spark.range(3).toDF("id"), "test")
    assert df.count() == 3
    common.clear_stored(spark)
    with pytest.raises(Exception, match="exist"):
        common.stored(df, "test")
