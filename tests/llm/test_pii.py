import hashlib
import random
import re

import numpy as np

from quillspark.llm import pii

from .test_exact_sharding_substring import frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_against_plain_patterns():
    rng = random.Random(0)
    bits = ["a.b", "@", ".", "x-y", "+1", "(555)", " ", "-", "0123", "45.7", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "me@a.b.co", "@@", "+49 (30) 1234-5678", "é", "..", "%", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("") == []


def test_long_texts_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "1." * 100_000, "+" * 100_000, "1 " * 100_000, "a@" * 100_000, "x@" + "a-" * 100_000):
        pii.base_spans(text)


def test_field_carries_labels():
    field = pii.estimate(["write to jo.lee@mail.example.com now", "call +1 (736) 555-2678 or v1.2 build 33.44", "card 4111 1111 1111 1111 end", "at 10.0.0.1 was some.name.part"] * 20)
    text = "Ask jo.lee at jo.lee@mail.example.com. Section 12.5 of foo.bar. Phone (736) 555-2678, that is +1 (736) 555-2678."
    base = pii.base_spans(text)
    spans = pii.all_spans(text, base, field)
    extra = {(text[s:e], k) for s, e, k in spans if (s, e, k) not in base}
    assert extra == {("jo.lee", "email"), ("(736) 555-2678", "phone")}
    assert set(base) <= set(spans)
    assert pii.all_spans("jo.lee and 555-2678 and (736) 555-2678", [], field) == []


def test_repeated_number_is_no_card(spark):
    """A number that fails the checksum, however often it stands there, is linked only to itself and gains no label."""
    text = "Mail me@a.example.org. Number 9870157079875996 again 9870157079875996 and 9870157079875996, card 4111 1111 1111 1111."
    field = pii.estimate([text] * 50)
    base = pii.base_spans(text)
    assert pii.all_spans(text, base, field) == base
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id = 646")
    assert {(r["n_card"], "card" in r["spans"]) for r in pii.find_pii(docs).collect()} == {(0, False)}


def test_potentials_over_all_documents(spark):
    """Counts of all rows, however long or often repeated, and however they are cut into partitions."""
    texts = ["write to jo.lee@mail.example.com now", "call +1 (736) 555-2678 or v1.2 build 33.44", "x " * 30_000 + "at 10.0.0.1", "no data"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = pii.estimate(texts)
    for n in (1, 5):
        got = pii.fit(docs.repartition(n))
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_messages_against_enumeration():
    rng = np.random.default_rng(0)
    unary = rng.normal(size=(4, 3))
    edges = [(0, 1, rng.normal(size=(3, 3)) * 0.3), (1, 2, rng.normal(size=(3, 3)) * 0.3), (2, 3, rng.normal(size=(3, 3)) * 0.3)]
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(p[y[i], y[j]] for i, j, p in edges))
        for i in range(4):
            want[i, y[i]] += w
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii.marginals(unary, edges), want, atol=1e-5)
    loop = pii.marginals(unary, [*edges, (0, 3, np.zeros((3, 3)))])
    assert np.allclose(loop, want, atol=1e-4)


def test_frame(spark):
    text = "é jo.lee@mail.example.com, then 10.0.0.1 and 10.0.0.300 +1 (736) 555-2678"
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, [(1, text), (2, None), (3, ""), (None, "none"), (4, text)])).collect()}
    said = ",".join(f"{k}:{s}:{e}" for s, e, k in brute(text))
    assert got[1]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["clean_text"] == "é <email>, then <ip> and 10.0.0.300 <phone>"
    assert (got[2]["spans"], got[2]["clean_text"], got[3]["clean_text"], got[None]["clean_text"]) == ("", None, "", "none")
    assert pii.find_pii(frame(spark, [])).count() == 0
    out = {r["doc_id"]: r for r in pii.redact_documents(frame(spark, [(1, text), (2, None)])).collect()}
    assert out[1]["text"].startswith("é <email>") and out[2]["text"] is None and out[1]["id"] == "x"


def test_shared_tables_against_single_edges():
    """The field over what skip links reach gives the marginals of the field over all candidates."""
    rng = np.random.default_rng(4)
    n, k = 60, 5
    field = {"chain": rng.normal(size=(k, k)) * 0.4, "skip": rng.normal(size=(k, k)) * 0.4}
    unary = rng.normal(size=(n, k))
    seen = np.zeros(n, bool)
    seen[[0, 9, 20, 33, 47]] = True
    for i in np.flatnonzero(seen):
        unary[i] = np.where(np.arange(k) == 1 + i % 4, 0.0, -50.0)
    chain = np.stack((np.arange(n - 1), np.arange(1, n)), axis=1)
    skip = np.array([(0, 3), (9, 12), (12, 15), (20, 29), (36, 40)])
    whole = pii.marginals(unary, [*((i, j, field["chain"]) for i, j in chain), *((i, j, field["skip"]) for i, j in skip)])
    asked = pii.anchored(seen, skip) & ~seen
    assert set(np.flatnonzero(asked)) == {3, 12, 15, 29}
    use = np.flatnonzero(pii._reached(n, np.concatenate((chain, skip)), asked, seen))
    number = np.full(n, -1)
    number[use] = np.arange(len(use))
    part = pii.settled(unary[use], [(e[(e >= 0).all(axis=1)], field[name]) for e, name in ((number[chain], "chain"), (number[skip], "skip"))])
    assert len(use) < n and np.allclose(part[number[asked]], whole[asked], atol=1e-4)


def test_long_log_in_bounded_memory():
    """Megabytes of addresses and names: the field holds a few numbers per candidate."""
    import tracemalloc

    rng = np.random.default_rng(0)
    lines = [f"10.0.{a % 256}.{b % 256} user.n{a % 3000} wrote to user.n{b % 3000}@mail.example.com\n" for a, b in rng.integers(0, 10**6, (20_000, 2)).tolist()]
    text = "".join(lines)
    field = pii.estimate(lines[:50])
    base = pii.base_spans(text)
    tracemalloc.start()
    spans = pii.all_spans(text, base, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) > len(base) and peak < 80 * len(text)
