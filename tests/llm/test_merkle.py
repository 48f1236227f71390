import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, n string, digest string, id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def tree(digests):
    """(root, siblings of each leaf as (left, right) per level) by plain loops."""
    paths, where, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, at in enumerate(where):
            first = at // 3 * 3
            paths[leaf].append((level[first:at], level[at + 1 : first + 3]))
        where = [at // 3 for at in where]
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def brute(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0], leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2]))]) for s in order}
    root, above = tree([built[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        subroot, paths = built[s]
        for (_, i, leaf, r), path in zip(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2])), paths, strict=True):
            whole = path + above[k]
            d = leaf_of(tampered(r))
            for left, right in whole:
                d = sha("".join([*left, d, *right]))
            out.append((i, leaf, subroot, root, sha("".join(x for pair in whole for side in pair for x in side)), d, d == root))
    return sorted(map(repr, out))


def tampered(r):
    hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return (r[0], r[1].replace("\n", ""), *r[2:]) if hit else r


def run(spark, rows, height):
    docs = spark.createDataFrame([(*r, "t", "p", "n", "d", "i") for r in rows], SCHEMA).repartition(3)
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(docs, text=F.replace("text", F.lit("\n"), F.lit(""))))
    made = merkle.manifest(docs, other=other, height=height)
    got = merkle.verify(made.withColumn("found", F.coalesce("other", "leaf")), "found")
    return sorted(repr(tuple(r)) for r in got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    rng = random.Random(height)
    rows = [(rng.randrange(10**6), rng.choice(["a\nb", "", None, "é😀", "x\n\n"]), rng.choice(["en", None]), rng.choice(["s", "s", "s", "t", "ü", "u"]), rng.choice([1, None])) for _ in range(130)]
    rows += [(None, "no id", "en", "s", 1), (None, None, None, None, None), (7, "twice", "en", "t", 1), (7, "twice", "en", "t", 1), (7, "other\n", "en", "t", 1), (-5, "alone", "de", "", 2), (9, "x" * 100_000 + "\n", "de", "long", None)]
    assert run(spark, rows, height) == brute(rows, tampered)


@pytest.mark.parametrize("n", [1, 4, 28])
def test_one_group(spark, n):
    rows = [(i, f"text {i}\n", "en", "s", 1) for i in range(n)]
    assert run(spark, rows, 2) == brute(rows, tampered)


def test_empty_and_proofs(spark):
    assert run(spark, [], 6) == []
    for n in range(1, 60):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        top, received = merkle.upward(leaves, merkle.levels(n))
        assert [merkle.fold(d, p) for d, p in zip(leaves, merkle.downward(received, merkle.levels(n), b""), strict=True)] == [top] * n
        assert top.hex() == tree([d.hex() for d in leaves])[0]
