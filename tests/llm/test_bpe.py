import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import bpe, packing
from quillspark.llm.queries import op13_bpe, tokenizer_file

from .test_exact_sharding_substring import frame, texts

VOCAB = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), ids


def shared_texts():
    """Documents with long passages in common, cut inside words, without blanks, and in several scripts."""
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma's", "12.5", "漢字かな", "Привет", "é́", "<|endoftext|>", "a\x1cb", "x" * 40, "ΑΣ", "İ", "ﬁ", "I'LL"]
    passage = [" ".join(rng.choice(words) for _ in range(rng.randrange(900, 1500))) for _ in range(4)]
    dense = ["".join(rng.choice(words) for _ in range(800)) for _ in range(2)]
    out = []
    for _ in range(40):
        own = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))) for _ in range(3)]
        a, b = rng.sample(passage, 2)
        cut = rng.randrange(len(a))
        out.append(rng.choice([" ", "", "\n"]).join([own[0], a[cut:], own[1], rng.choice(dense), own[2], b]))
    return [*out, out[0], passage[0], passage[0] * 3, "\n".join(passage * 30), dense[0] * 4]


@pytest.mark.parametrize("small", [True, False])
def test_ids_equal_the_library(spark, library, monkeypatch, small):
    """Shared chunks sent to all tasks, or joined with the texts."""
    if not small:
        monkeypatch.setattr(bpe, "BROADCAST_BYTES", 0)
    rows = [*enumerate([*texts(), *shared_texts()]), (None, "no id"), (None, "no id"), (3, shared_texts()[1]), (3, "again")]
    got = bpe.encode(frame(spark, rows), VOCAB).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *digests(library, t))) for i, t in rows)
    short = bpe.encode(frame(spark, rows), VOCAB, ids=False)
    assert sorted(map(repr, short.drop("ids").collect())) == sorted(repr(r) for r in spark.createDataFrame([tuple(r)[:4] for r in got], short.drop("ids").schema).collect())
    assert bpe.encode(frame(spark, []), VOCAB).count() == 0


def test_each_shared_chunk_is_encoded_once(spark):
    rows = [(i, t) for i, t in enumerate(shared_texts())]
    docs = frame(spark, rows).selectExpr("doc_id as row", "doc_id", "text")
    shared = {r["row"]: r["chunks"] for r in bpe.shared_chunks(docs).collect()}
    places = {}
    for row, found in shared.items():
        for c in found:
            places.setdefault((c["a"], c["b"]), []).append((row, c["place"], c["own"]))
            s, e = bpe.chunks(dict(rows)[row].encode())[c["place"]]
            assert e > s
    assert len(places) > 20 and all(len(p) > 1 and [x[2] for x in sorted(p)] == [True] + [False] * (len(p) - 1) for p in places.values())


def test_decode(spark, library):
    rows = list(enumerate(shared_texts()))
    got = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(frame(spark, rows), VOCAB), VOCAB).collect()}
    assert got == {i: library.decode(digests(library, t)[3], skip_special_tokens=False) for i, t in rows}


def test_chunks(monkeypatch):
    rng = random.Random(1)
    raw = " ".join("".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 9))) for _ in range(40000)).encode()
    got = bpe.chunks(raw)
    assert got[0][0] == 0 and got[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert all(raw[s:e].decode() is not None and e - s <= bpe.MAX_CHUNK for s, e in got)
    shifted = bpe.chunks(b"one more word " + raw)
    names = lambda cut, text: {text[s:e] for s, e in cut}
    assert len(names(got, raw) & names(shifted, b"one more word " + raw)) > 0.9 * len(got)
    whole = bpe.places(raw)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 1000)
    assert bpe.places(raw) == whole


def test_joins_that_disagree_take_in_the_neighbour(library):
    """A vocabulary that merges across blanks near one word: the chunks around it are encoded in place."""

    class Merging(packing.WordIds):
        def text(self, text):
            return super().text(text.replace("beta gamma", "betagamma"))

    known = Merging(VOCAB)
    raw = b"one alpha beta gamma delta two " * 300
    cut = bpe.chunks(raw)
    shared = {k: (k, 0, False) for k in range(len(cut))}
    for start, end, name in bpe.plan(known, raw, shared):
        assert name is None or not (raw[:end].endswith(b"beta") or raw[start:].startswith(b"gamma"))


def test_registered(spark, library):
    import duckdb

    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = op13_bpe(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((i, *digests(library, t)[:3]) for i, t in docs)
