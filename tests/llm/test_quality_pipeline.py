import zlib

import numpy as np
import pytest

from quillspark.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    judged = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in judged]) > 0.95


def plain_features(text):
    """The features by plain counting."""
    words, n, m = text.split(), max(len(text), 1), max(len(text.split()), 1)
    count = lambda keep: sum(map(keep, text))
    space, upper, lower = b" \t\n\x0b\x0c\r", count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122)
    high, digits = count(lambda c: c >= 128), count(lambda c: 48 <= c <= 57)
    blank, stops, bars = count(lambda c: c in space), count(lambda c: c in b",.;:?"), count(lambda c: c == 124)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k, letters = max(len(lines), 1), max(upper + lower + high, 1)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(len(text)), np.log1p(len(words)), (n - blank) / m, sum(len(w) > 24 for w in set(words)) / max(len(set(words)), 1),
        upper / letters, digits / n, blank / n, (len(text) - lower - upper - digits - blank - stops - bars - high) / n, text.count(b"!") / n,
        bars / n, high / n, len(set(words)) / m, max(map(words.count, set(words)), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, (m - len(triples)) / m, np.log1p(len(lines)), 1 - len(set(lines)) / k,
        np.log1p(len(text) / k), stops / m, sum(w[:1].isupper() for w in words) / m, sum(w[-1] in b"!#$%&*~^@=<>" for w in words) / m,
        len(set(text) & set(range(33, 48))) / 15,
    ]


def test_features_against_plain_counting(monkeypatch):
    from .test_exact_sharding_substring import texts

    some = [t[:3000].encode() for t in texts() if t] + [b"", b" ", "É!! | A\x0b9?\n\n é= ".encode(), b"word " * 30 + b"x" * 40]
    whole = [quality.features(t) for t in some]
    assert np.allclose(whole, [plain_features(t) for t in some])
    monkeypatch.setattr("quillspark.llm.wordhash.SLICE_BYTES", 50)  # part by part
    monkeypatch.setattr(quality, "SLICE_BYTES", 50)
    lines = [t for t in some if b"\n" not in t]  # a cut at a line break leaves it out
    assert np.allclose([quality.features(t)[3:] for t in lines], [plain_features(t)[3:] for t in lines], rtol=0.2)


def test_features_of_a_long_text():
    """100 MB in bounded memory and time."""
    import resource
    import time

    rng = np.random.default_rng(0)
    some = b" ".join(b"w%d" % i for i in rng.integers(0, 1 << 40, 150_000)) + b"\n"
    text = some * (100_000_000 // len(some))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = quality.features(text)
    assert got[0] == np.log1p(len(text)) and got[11] < 0.1
    assert time.time() - began < 120 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000


def test_sample_of_documents_with_labels(spark, monkeypatch):
    """Labels without a document take no place in the sample, and a repeated id counts once."""
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    docs = spark.createDataFrame([(i % 60, "good prose " * 9 if i % 60 % 2 else "BAD!! " * 9) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), set(y.tolist()))) or {"base": 0.0, "single": [], "pairs": []})
    quality.learn(docs, labels)
    assert seen == [(40, {0.0, 1.0})]


def test_only_text_matters(spark):
    """Labels of held-out rows, and all columns but the text, leave scores alone."""
    docs = spark.createDataFrame([(i, ("good prose of many words %d " % i) * 3 if i % 3 else "BAD!! " * 30, "en", "s", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(i % 3 > 0)) for i in range(200)]
    flip = [(i, q ^ (zlib.crc32(str(i).encode()) % 4 == 2)) for i, q in labels]
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flip))
    assert a == b
    assert all((s >= 0.7) == (i % 3 > 0) for i, s in a.items())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, quality string, extra int"
    docs = spark.createDataFrame([(1, None, None, "x", 1), (2, "", "en", "y", 2), (None, "some text", "en", "z", 3), (2, "", "en", "y", 2)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 for r in got)
    assert quality.keep_good(docs, none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (7, None)], "doc_id long, quality int")
    assert quality.keep_good(docs, one).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), one).count() == 0


@pytest.mark.parametrize("n", [1, 200])
def test_lookup_sum(n):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # a pure interaction
    model = quality.fit(x, y)
    want = []
    for row in x[:n]:
        z = model["base"] + sum(t[int((c <= row[f]).sum())] for f, (c, t) in enumerate(model["single"]))
        z += sum(t[int((cf <= row[f]).sum()), int((ce <= row[e]).sum())] for f, e, cf, ce, t in model["pairs"])
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(quality.score(model, x[:n]), want)
    assert ((quality.score(model, x) > 0.5) == y).mean() > 0.9


def test_pipeline(spark, tmp_path):
    """run() against a plain version of the stages' decisions on the rows each stage gets."""
    import re
    import shutil

    import corpus_pipeline as c

    from .test_pack_join import brute
    from .test_pii import brute as spans

    for t in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs.columns]
    frames = [docs]
    for _, stage in c.STAGES:
        frames.append(stage(spark, frames[-1], str(tmp_path)))
        frames[-1].persist()
    rows = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    assert all(f.columns == kept[0] for f in frames[:-1])
    good = {r["doc_id"] for r in quality.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r["predicted"]}
    assert set(rows[1]) == good and len(good) < len(rows[0])
    norm = {}
    for i, t in rows[1].items():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t), []).append(i)
    assert set(rows[2]) == {min(g, key=lambda i: (-len(rows[1][i]), i)) for g in norm.values()}
    assert set(rows[3]) == {i for i, (_, k) in brute(list(rows[2].items()), 5, 80).items() if i == k}
    for i, t in rows[4].items():
        base = spans(rows[3][i])
        assert not any(s in t for s in (rows[3][i][a:b] for a, b, _ in base))
    assert {r["doc_id"] for r in frames[-1].collect()} == set(rows[4])
    ran = c.run(spark, str(tmp_path))
    assert ran.columns == frames[-1].columns and ran.count() == frames[-1].count()


def test_pipeline_edges(spark, tmp_path, monkeypatch):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table through run(); its own tables are deleted."""
    import corpus_pipeline as c
    from quillspark.llm.common import tables_written

    monkeypatch.setattr(quality, "ACCEPT", 0.0)  # every document stays
    prose = "one two three four five six seven eight nine ten"
    rows = [(1, prose), (1, prose), (2, prose + " eleven"), (3, None), (4, ""), (None, "no id here"), (5, "me@a.example.org wrote this text"), (6, prose.upper() + "\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _stay int, row int")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for f in "ab":
        spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{f}/labels.parquet")
    before = tables_written(spark)
    got = c.run(spark, f"{tmp_path}/a").collect()
    assert tables_written(spark) == before + 1
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "5", "None"]
    assert c.run(spark, f"{tmp_path}/b").count() == 0
