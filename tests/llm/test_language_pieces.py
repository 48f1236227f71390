import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, pieces
from quillspark.llm.queries import tokenizer_file

from .test_exact_sharding_substring import frame, texts

SF = "/root/testdata/sf0.01"
MODEL = tokenizer_file("piece_bpe_32k.model")


def best_segmentation(v, text):
    """Plain whole-text search, every end over every start."""
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        top, got = -np.inf, None
        for start in range(max(0, end - v.longest), end):
            if (p := text[start:end]) in v.score and best[start] + v.score[p][0] > top:
                top, got = best[start] + v.score[p][0], start
        if text[end - 1] not in v.score and best[end - 1] + v.unknown_score > top:
            top, got = best[end - 1] + v.unknown_score, end - 1
        best.append(top)
        back.append(got)
    out, at = [], len(text)
    while at:
        p = text[back[at] : at]
        out.append([v.score[p][1]] if p in v.score else [v.byte_id[b] for b in p.encode()])
        at = back[at]
    return [i for part in reversed(out) for i in part]


ODD = ["", " ", "  a  b ", "\n\n x", "漢字テスト 😀😀", "x" * 3000, "ab" * 1500, "thethe" * 40, "\x00 \x7f é́", " the quick", "don't stop"]


def test_unigram_stream_against_whole_search():
    """The pieces' scores taken as those of a unigram model."""
    v = pieces.Vocabulary(MODEL)
    v.merges = False
    for t in [*ODD, *(t for t in texts() if t)]:
        whole = best_segmentation(v, v.prepared(t[:3000]))
        parts = list(v.stream(v.prepared(t[:3000])))
        assert [i for p in parts for i in p] == whole == v.encode(t[:3000])
        assert v.decode(whole) == t[:3000]
    assert len(list(v.stream(v.prepared("one two three " * 50)))) > 20  # committed on the way


def test_stream_against_merging():
    """The search finds what merging a whole part in rank order makes; ids are committed on the way, from a short window."""
    v = pieces.Vocabulary(MODEL)
    assert v.merges and v.by_word
    rng = random.Random(1)
    odd = ["".join(rng.choice("abtheinorsué\u200b漢") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t in [*odd, "ab" * 700, "thethe" * 40, "x" * 999, "e" * 63 + "s" * 64]:
        ids = [[v.score[p][1]] if p in v.score else [v.byte_id[b] for b in p.encode()] for p in v.merge(v.prepared(t))]
        assert [i for part in v.stream(v.prepared(t)) for i in part] == [i for part in ids for i in part]
    v.commits = v.longest_open = 0
    long = " ".join(t for t in texts() if t)
    parts = list(v.stream(v.prepared(long)))
    assert v.commits == len(parts) > len(long) / 40 and v.longest_open <= 4 * v.longest
    v.commits = 0
    v.encode("anewword another")
    first = v.commits
    v.encode("anewword another")  # remembered
    assert 2 <= first == v.commits


def test_ids_are_the_librarys(spark):
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Vocabulary(MODEL)
    assert sp.encode("und", out_type=str) == ["▁und"]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    whole = [*ODD, "und", "das", "a▁b", "x▁", "▁▁▁", "<unk><0x41>", "漢字" * 400, "aé" * 90 + "\u200b\u0301", *(t for t in texts() if t), *(r["text"] for r in rows if r["text"])]
    for t in whole:
        want = sp.encode(t)
        assert v.encode(t) == v.encode(t) == want
        assert [i for part in v.stream(v.prepared(t[:2000])) for i in part] == sp.encode(t[:2000])
    got = pieces.encode(frame(spark, list(enumerate(whole))), MODEL).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: sp.encode(t) for i, t in enumerate(whole)}


def test_decoding_agrees_with_the_library():
    import sentencepiece

    sp, v = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Vocabulary(MODEL)
    for t in ODD:
        assert sp.decode(v.encode(t)) == v.decode(sp.encode(t)) == t


def test_piece_frames(spark):
    rows = [*enumerate(texts()), (None, "no id"), (3, "again")]
    df = frame(spark, rows)
    enc = pieces.encode(df, MODEL)
    assert {r["ids"] is None for r in enc.where("doc_id = 43").collect()} == {rows[43][1] is None}
    back = sorted((str(r["doc_id"]), r["text"] or "") for r in pieces.decode(enc, MODEL).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert all(r["round_trip"] for r in pieces.digest(df, MODEL).collect())
    assert pieces.encode(frame(spark, []), MODEL).count() == 0


def test_visible_text_against_patterns():
    import html
    import re

    plain = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    rng = random.Random(0)
    bits = ["<", ">", "<!--", "-->", "<script", "<SCRIPT x>", "</script>", "</Script  >", "<style>", "</style>", "a", " ", "&amp;", "<b>", "</b>", "--", "!"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert langid.visible_text(page) == html.unescape(plain.sub(" ", page)), page


@pytest.mark.parametrize("bit", ["<!--", "<script>", "<", "<style", "</script ", "<!-->", "&", "<script></style>"])
def test_visible_text_stays_linear(bit):
    import time

    began = time.time()
    langid.visible_text(bit * (5_000_000 // len(bit)))
    assert time.time() - began < 20


def test_language_on_pages(spark):
    """Held out: the language folder of an address names the page's language; the pages are scored without it."""
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    folder = r"^([^:]+://[^/]+)/[A-Za-z]{2}(?=[/?#]|$)"
    truth = {r["page_id"]: r["suffix"] for r in langid.evidence(pages.where(F.col("url").rlike(folder))).collect()}
    got = langid.identify(pages.withColumn("url", F.regexp_replace("url", folder, "$1")), docs).collect()
    assert len(got) == pages.count() and len(truth) > 100
    judged = [r for r in got if r["page_id"] in truth]
    assert not any(r["suffix"] == truth[r["page_id"]] for r in judged)
    assert np.mean([r["lang"] == truth[r["page_id"]] for r in judged]) > 0.95
    assert np.mean([r["text_lang"] == truth[r["page_id"]] for r in judged if r["text_lang"]]) > 0.9
    assert {r["lang"] for r in got} <= {r["lang"] for r in docs.collect()}


def test_fusion_against_plain_python(spark):
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("the cat and the dog sat on the mat", "en"), ("der hund und die katze auf der matte", "de")] * 5)], "doc_id long, text string, lang string")
    html = lambda lang, body: f"<html{f' lang={lang!r}' if lang else ''}><script>the the</script><p>{body}</p></html>"
    raw = [
        (1, "http://a.x.de/", html("de", "der hund und die katze")), (2, "http://a.x.de/en/1", html("en", "the cat and the dog")),
        (3, "http://a.x.de/z", html(None, "")), (4, None, None), (5, "nonsense", ""), (6, "https://b.x.de/q", html("de", "die matte")),
        (7, "https://c.y.com/fr/", html("fr", "hund the")), (8, "http://a.x.de/", html("de", "der hund und die katze")),
    ]
    pages = spark.createDataFrame([(*r, "k", 1) for r in raw], "page_id long, url string, html string, host string, lang int")
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    langs, logp = langid.learn(docs)
    ev = {r["page_id"]: r for r in langid.evidence(pages).collect()}
    ll, p = {}, {}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, r in ev.items():
        s = langid.trigram_slots(langid.visible_text(r["html"])) if r["html"] else []
        ll[i] = logp[:, s].sum(axis=1) / max(1, len(s) / langid.TEXT_WEIGHT) if len(s) else np.zeros(len(langs))
        p[i] = soft(ll[i])
    total = sum(p.values()) + langid.SMOOTH
    def sums(key, value):
        return sum((p[i] for i in ev if ev[i][key] == value), np.zeros(len(langs)))
    for i, r in ev.items():
        x = ll[i].copy()
        for key in ("declared", "suffix"):
            if r[key]:
                x += np.log((sums(key, r[key]) + langid.SMOOTH) / (total + langid.SMOOTH))
        if r["host"]:
            wide = total / total.sum()
            if r["domain"]:
                d = sums("domain", r["domain"]) + langid.PRIOR_ROWS * wide
                wide = d / d.sum()
            x += np.log(sums("host", r["host"]) + langid.PRIOR_ROWS * wide)
        else:
            x += np.log(total / total.sum())
        assert got[i]["confidence"] == pytest.approx(soft(x).max(), abs=2e-6)
        assert got[i]["lang"] == langs[int(soft(x).argmax())]
    assert (got[1]["lang"], got[2]["lang"], got[4]["declared"], got[5]["host"], got[2]["suffix"]) == ("de", "en", None, None, "en")
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in langid.identify(pages, docs.limit(0)).collect()} == {None}


def test_pages_of_opening_tags(spark):
    """A page that opens <html> over and over is read in linear time; the first tag alone declares the language."""
    import time

    pages = [(1, "http://a.example/x", "<html " * 800_000), (2, None, "<p><HTML\nclass='x' lang = \"DE\"><html lang=fr>"), (3, "x", "<htmlx lang=fr><html lang='es'>"), (4, "", None), (5, "x", "<html>lang=en"), (6, "x", "lang " * 10)]
    df = spark.createDataFrame([(*p, "h", "d") for p in pages], "page_id long, url string, html string, host string, domain string").cache()
    df.count()
    began = time.time()
    got = {r["page_id"]: r["declared"] for r in langid.evidence(df).collect()}
    assert got == {1: None, 2: "de", 3: "es", 4: None, 5: None, 6: None} and time.time() - began < 5


def test_training_sample(spark, monkeypatch):
    """The smallest hashes, never more than asked for, whatever the number of documents or copies of one."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 20)
    docs = spark.range(3000).selectExpr("id % 1000 as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    rows = langid.training_sample(docs).collect()
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(20).collect()
    assert sorted(int(r["text"].split()[1]) % 1000 for r in rows) == sorted(r["doc_id"] for r in ids)
    assert langid.training_sample(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 0
