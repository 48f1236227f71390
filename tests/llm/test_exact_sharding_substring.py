import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, sharding, substring, wordhash

SCHEMA = "doc_id long, text string, id string, hash string, bucket string"


def texts(seed=0):
    """Random documents with copies, shared passages, blanks, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "漢字", "a.b", "😀"]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.5:
            k = rng.randrange(len(body) + 1)
            cut = rng.randrange(0, 20)
            body[k:k] = passage[cut : cut + rng.randrange(5, 30)]
        out.append(rng.choice([" ", "\n", "\t "]).join(body))
    out += [out[3], out[3].replace(" ", "  "), "", None, "  \n", out[5] + " x", " ".join(rng.choice(words) for _ in range(6000)), out[5], "one"]
    out.append(out[-3] + " tail " + out[-3])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def test_exact_groups(spark):
    rows = list(enumerate(texts()))
    got = {r["id"]: r for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t in rows}
    for i, t in rows:
        group = [j for j, _ in rows if norm[j] == norm[i]]
        keep = min(group, key=lambda j: (-len(dict(rows)[j] or ""), j))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), keep == i)
        assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0
    stay = exact_dedup.exact_dedup(frame(spark, rows))
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert stay.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")


def test_exact_null_ids(spark):
    got = exact_dedup.duplicate_groups(frame(spark, [(None, "a b"), (1, "ab"), (2, "c")])).collect()
    assert {(r["id"], r["keep_id"], r["kept"]) for r in got} == {(None, None, True), (1, None, False), (2, 2, True)}
    assert len(got) == 3


def test_exact_repeated_rows(spark):
    """Of rows that repeat their id one stays; a row of the same id in another group goes; columns of any name are kept."""
    rows = [(4, "a b", 1), (4, "a b", 2), (4, "ab", 3), (4, "long text", 4), (7, "long  text", 5), (None, "n", 6), (None, "n", 7), (9, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stay long").withColumn("row", F.col("_stay")).withColumn("recipe", F.lit("r"))
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, (r["text"] or "").replace(" ", "")) for r in got.collect())
    assert kept == [(0, "n"), (4, "ab"), (7, "longtext"), (9, "")]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def brute_repeats(rows, width):
    seen = {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "width"), [(0, 13), (1, 13), (2, 7)])
def test_repeats(spark, seed, width):
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    got = {r["doc_id"]: r for r in substring.remove_repeats(frame(spark, rows), width).collect()}
    want = brute_repeats(rows, width)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert any(n for _, n, _ in want.values())
    for r in got.values():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


def test_repeats_edges(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    same = "a b c d e f g h i j k l m n"
    got = substring.remove_repeats(frame(spark, [(None, same), (1, same), (1, same), (2, same)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 14)]


def plain_words(rows):
    return {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}


@pytest.mark.parametrize(("seed", "width"), [(0, 13), (2, 7)])
def test_factors(spark, seed, width):
    """Every factor is a run of words of its source, a document of smaller id; long copies are few factors."""
    rows = list(enumerate(texts(seed)))
    words = plain_words(rows)
    got = substring.factors(frame(spark, rows), width).collect()
    for r in got:
        assert r["source"] < r["doc_id"] and r["end"] - r["start"] >= width
        assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["source"]][r["source_start"] : r["source_start"] + r["end"] - r["start"]]
    last = rows[-1][0]  # two copies of a text of 6000 words
    mine = [r for r in got if r["doc_id"] == last]
    assert max(r["end"] - r["start"] for r in mine) > 5000 and len(mine) < 40


def test_greedy_parse():
    lanes = lambda words: (np.array(words, "u8"), np.array(words, "u8"))
    text = lanes([1, 2, 3, 4, 5, 6, 7, 8, 9, 50, 51, 52])
    blocks = {(1, 0): (0, lanes([9, 2, 3, 4, 5, 6, 70])), (2, 0): (0, lanes([4, 5, 6, 7, 8, 9, 50, 51])), (3, 0): (0, lanes([5, 6, 7]))}
    seeds = (np.array([1, 3, 4, 9]), np.array([1, 2, 3, 9]), np.array([1, 0, 0, substring.NONE]))
    found = substring.matches(text, seeds, blocks, 3)
    assert found == [(1, 6, 1, 1), (3, 11, 2, 0), (4, 7, 3, 0)]
    assert substring.greedy(found) == [(1, 6, 1, 1), (3, 11, 2, 0)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_repeats_colliding_words(spark):
    """Words that a polynomial modulo 2**64 can't tell apart."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(12))
    got = substring.remove_repeats(frame(spark, [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"{word} {tail}")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 13}


def test_repeats_hot_phrase(spark):
    """A phrase of every document, in many partitions, reaches its hash range once a run of texts; rows of one id."""
    rng = random.Random(5)
    hot = " ".join(f"h{i}" for i in range(20))
    rows = [(i, f"{' '.join(rng.choice('xyz') + str(rng.randrange(99)) for _ in range(rng.randrange(30)))} {hot} e{i}") for i in range(600)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows).repartition(7)).collect()}
    assert got == brute_repeats(rows, 13)
    batch = pa.RecordBatch.from_pydict({"row": [i for i, _ in rows], "doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    sent = [wordhash.unplane(x.as_py(), "u8", substring.ANCHOR_BYTES) for b in substring._anchors(13, 4, True)(iter([batch])) if b.column("bucket")[0].as_py() >= 0 for x in b.column("hash")]
    assert np.unique(np.concatenate(sent), return_counts=True)[1].max() == 1
    same = [(1, hot), (1, hot + " more"), (2, "a " + hot), (None, hot)]
    assert sorted((r["n_words"], r["n_removed"]) for r in substring.remove_repeats(frame(spark, same)).collect()) == [(20, 0), (20, 0), (21, 0), (21, 20)]


def test_word_hash_edges():
    long = ("x" * 700 + " ") * 4000 + "y" * (3 << 20) + " z"
    _, _, counts = wordhash.word_hashes(pa.array([long, None, "", " A\x0bb\xa0c "]))
    assert counts.tolist() == [4002, 0, 0, 2]
    one, two = wordhash.word_hashes(pa.array(["A b", "a b"]), lower=True)[:2]
    assert one[0] == one[2] and two[0] == two[2]
    a = np.array([5, 5, 5, 1], "u8")
    b = np.array([2, 1, 2, 9], "u8")
    by = wordhash.order(a, b)
    assert list(zip(a[by].tolist(), b[by].tolist(), strict=True)) == [(1, 9), (5, 1), (5, 2), (5, 2)]


@pytest.mark.parametrize("limit", [1, 50, 400, 100_000])
def test_shards(spark, limit):
    rows = [*enumerate(texts()), (None, "null key"), (7, "again"), (7, "again")]
    got = sharding.shard(frame(spark, rows), limit).collect()
    assert len(got) == len(rows)
    sizes, n = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    for r in got:
        assert (r["shard_bytes"], r["shard_rows"]) == (sizes[r["shard"]], n[r["shard"]])
        assert len(r["shard"]) == r["depth"]
        assert r["oversized"] == (sizes[r["shard"]] > limit)
        assert sizes[r["shard"]] <= limit or n[r["shard"]] == 1 or r["depth"] == sharding.DEEPEST
    names = set(sizes)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for a in names:  # only oversized buckets were split
        if a:
            up = [b for b in names if b.startswith(a[:-1])]
            assert sum(sizes[b] for b in up) > limit and sum(n[b] for b in up) > 1
    assert sharding.shard(frame(spark, []), limit).count() == 0


def test_equal_rows_are_split(spark):
    """Rows that repeat key and text share a hash; their numbers go on where it ends."""
    rows = [(7, "x" * 1000)] * 200 + [(i, "y" * 500) for i in range(60)] + [(8, "z" * 30_000)] * 3
    got = sharding.shard(frame(spark, rows), 20_000).collect()
    sizes, n = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    assert len(got) == len(rows) and all((r["shard_bytes"], r["shard_rows"], len(r["shard"])) == (sizes[r["shard"]], n[r["shard"]], r["depth"]) for r in got)
    assert all(sizes[s] <= 20_000 or n[s] == 1 for s in sizes)
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    assert len({r["shard"] for r in got if r["bytes"] == 1000}) == 16 and len({r["shard"] for r in got if r["bytes"] == 30_000}) == 3


@pytest.mark.parametrize("size", [1, 5])
def test_anchors_that_collide(spark, monkeypatch, size):
    """One long text and another made of its passages: anchors of a text that share the bytes sent are all kept."""
    monkeypatch.setattr(substring, "ANCHOR_BYTES", size)
    rng = random.Random(3)
    a = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    b = [w for k in range(0, 3000, 100) for w in [f"own{k}", *a[k : k + 30]]]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows, 13) and got[2][1] == 900


def test_chunks_of_other_scripts(spark):
    """A text moved by one letter keeps its chunks, whatever its script."""
    rng = random.Random(9)
    for letters in ("абвгдежзиклмнопрстуфхцчшыьэюя", "אבגדהוזחטיכלמנסעפצקרשת", "".join(map(chr, range(0x4E00, 0x4E40)))):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        made = frame(spark, [(1, text), (2, letters[0] + text)]).select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()
        one, two = (r["c"] for r in sorted(made, key=lambda r: r["doc_id"]))
        assert "".join(one) == text and len(set(one) & set(two)) >= 0.9 * len(one) and len(one) > 20


def test_exact_smallest_id(spark):
    low = -(2**63)
    got = exact_dedup.duplicate_groups(frame(spark, [(low, "a b"), (1, "a b"), (2**63 - 1, "a b")])).collect()
    assert {(r["id"], r["keep_id"], r["kept"]) for r in got} == {(low, low, True), (1, low, False), (2**63 - 1, low, False)}
