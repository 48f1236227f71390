"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host.

    P(l | page)  ~  P(text | l) P(declared | l) P(suffix | l) P(l | host)

P(text | l) comes from byte trigrams of the visible text, learnt from at most TRAIN_DOCS labelled documents (those with the smallest hashes of their ids, rows without an id left out); its log
is divided by the number of trigrams over TEXT_WEIGHT, so that a long text doesn't drown all other evidence.
P(declared | l) and P(suffix | l) are estimated from the pages themselves, by summing the text's posteriors per
declared value and per suffix.  P(l | host) is smoothed along global -> registered domain -> host: the counts of the
wider level, scaled to PRIOR_ROWS, are added to those of the narrower one.  All counts are grouped aggregates with map-side
combine; a host that holds a third of all pages is a few sums per task.

The suffix is the two-letter folder that starts the address' path or, without one, the two-letter end of its host; the
registered domain is taken to be the last two labels of the host.

Null or empty pages have no text evidence; missing evidence of any kind drops out of the product.  Repeated rows are scored alike.
Empty tables of pages give no rows; without labelled documents every language is null.  Extra columns are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, stored

#: Labelled documents to learn from, at most; slots for trigrams; how many trigrams count in full; weight of the wider level.
TRAIN_DOCS, SLOTS, TEXT_WEIGHT, PRIOR_ROWS = 6000, 1 << 15, 60.0, 20.0
#: Added to every count.
SMOOTH = 0.5

_HIDDEN = re.compile(r"<(script|style)\b", re.I)
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def visible_text(page: str) -> str:
    """Text of a page without tags, comments, scripts and styles, each a blank.  One scan: an opening without an end
    is searched for its end once; it then counts as a tag."""
    out, at, closed = [], 0, {"comment": True, "script": True, "style": True}
    while (lt := page.find("<", at)) >= 0:
        end = -1
        if closed["comment"] and page.startswith("<!--", lt):
            got = page.find("-->", lt + 4)
            closed["comment"], end = got >= 0, got + 3 if got >= 0 else -1
        elif m := _HIDDEN.match(page, lt):
            name = m[1].lower()
            if closed[name]:
                got = _END[name].search(page, m.end())
                closed[name], end = got is not None, got.end() if got else -1
        if end < 0:
            end = page.find(">", lt) + 1
            if not end:
                break  # no tag ends any more
        out += [page[at:lt], " "]
        at = end
    return html_.unescape("".join([*out, page[at:]]))


def trigram_slots(text: str) -> np.ndarray:
    """Slot of each byte trigram of the lower-cased letters of a text, runs of other characters as one space."""
    raw = np.frombuffer(text.lower().encode(), "u1")
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each word
    b = np.where(letter, raw, 32)[keep].astype("u4")
    if len(b) < 3:
        return np.zeros(0, "u4")
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(SLOTS, "i8"))
            total[lang] += np.bincount(trigram_slots(text), minlength=SLOTS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "slot", "n"])


def training_sample(docs: DataFrame) -> DataFrame:
    """(text, lang) of the TRAIN_DOCS labelled documents whose ids have the smallest hashes, each id once, with the text that sorts first."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64("doc_id")
    # ids that can't be among them are left out before the sort; a bound on the hash, never on their number
    some = known.agg(F.approx_count_distinct("doc_id", 0.05).alias("n")).first()["n"]
    below = min(2**63 - 1, 2**64 * 4 * TRAIN_DOCS // max(1, some) - 2**63)
    ids = stored(known.where(h <= below).select("doc_id").distinct().orderBy(h, "doc_id").limit(TRAIN_DOCS), "sample")
    each = known.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"))  # broadcast: TRAIN_DOCS ids
    return each.select("t.text", "t.lang")


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(slot | language)) from the training sample."""
    counted = training_sample(docs).mapInArrow(_count_slots, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns")).orderBy("lang").collect()  # a row per language, of SLOTS numbers at most
    counts = np.full((len(rows), SLOTS), SMOOTH)
    for k, r in enumerate(rows):
        counts[k, r["slots"]] += r["ns"]
    return [r["lang"] for r in rows], np.log(counts / counts.sum(axis=1, keepdims=True))


def _text_scores(langs: list[str], logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)))
            for k, page in enumerate(batch.column(3).to_pylist()):
                slots = trigram_slots(visible_text(page)) if page else ()
                if len(slots):
                    out[k] = logp[:, slots].sum(axis=1) / max(1.0, len(slots) / TEXT_WEIGHT)
                    out[k] -= out[k].max()
            scores = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="i4") * len(langs)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), batch.column(5), scores], names=["page_id", "host", "domain", "declared", "suffix", "ll"])

    return run


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, html, declared, suffix: what an address and the markup say, null where they don't."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    blank = lambda c: F.when(c != "", c)
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.substring_index(F.substr(page, F.regexp_instr(page, F.lit(r"(?i)<html\b"))), ">", 1)  # the first <html> only
    declared = F.when(F.regexp_instr(page, F.lit(r"(?i)<html\b")) > 0, F.regexp_extract(tag, r"(?is)^<html\b.*?\blang\s*+=\s*+[\"']?([A-Za-z]{2,3})", 1)).otherwise("")
    folder = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1)
    tail = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return pages.select(
        "page_id",
        blank(host).alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.col("html").cast("string").alias("html"),
        F.lower(blank(declared)).alias("declared"),
        F.lower(F.coalesce(blank(folder), blank(tail))).alias("suffix"),
    )


def _sums(rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(len(langs))])


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host) for every page."""
    langs, logp = learn(docs)
    n = len(langs)
    if not n:
        return evidence(pages).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    scored = evidence(pages).mapInArrow(_text_scores(langs, logp), "page_id long, host string, domain string, declared string, suffix string, ll array<double>")
    norm = lambda ll: F.transform(ll, lambda v: F.exp(v - F.array_max(ll)) / F.aggregate(ll, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(ll))))
    rows = stored(scored.withColumn("p", norm(F.col("ll"))), "page-evidence")

    whole = rows.agg(*[F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)]).first()
    total = [float(v) + SMOOTH for v in whole]
    sums = [F.col(f"s{k}") for k in range(n)]

    def likelihood(key: str) -> DataFrame:
        """log P(value | language) for each value of a kind of evidence."""
        return stored(_sums(rows, key, langs).select(key, F.array(*[F.log((s + SMOOTH) / F.lit(t + SMOOTH)) for s, t in zip(sums, total, strict=True)]).alias(f"l_{key}")), f"of-{key}")

    every = sum(total)
    base = [PRIOR_ROWS * t / every for t in total]
    domains = _sums(rows, "domain", langs).select("domain", F.array(*[(s + b) for s, b in zip(sums, base, strict=True)]).alias("d"))
    domains = stored(domains.select("domain", F.transform("d", lambda v: v / F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("d")), "domains")
    hosts = _sums(rows.withColumn("host", F.struct("host", "domain")).where("host.host is not null"), "host", langs)
    hosts = hosts.select("host.host", "host.domain", F.array(*sums).alias("s")).join(domains, "domain", "left")
    wide = F.coalesce("d", F.array(*[F.lit(t / every) for t in total]))
    hosts = hosts.select("host", F.zip_with("s", wide, lambda s, d: F.log(s + d * PRIOR_ROWS)).alias("l_host"))
    hosts = stored(hosts, "hosts")

    out = rows
    for key, table in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        out = sized_join(out, table, key, "left", 32 + 8 * n)
    parts = [F.coalesce(F.col(c), F.array(*[F.lit(0.0)] * n)) for c in ("l_declared", "l_suffix", "l_host")]
    fused = F.col("ll")
    for p in parts:
        fused = F.zip_with(fused, p, lambda a, b: a + b)
    # without a host the prior is the global one
    fused = F.when(F.col("l_host").isNull(), F.zip_with(fused, F.array(*[F.lit(float(np.log(t / every))) for t in total]), lambda a, b: a + b)).otherwise(fused)
    out = out.withColumn("post", norm(fused))
    named = lambda p: F.element_at(F.array(*[F.lit(v) for v in langs]), F.array_position(p, F.array_max(p)).cast("int"))
    text_lang = F.when(F.array_min("ll") < 0, named(F.col("p")))
    return out.select("page_id", named(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"), text_lang.alias("text_lang"), "declared", "suffix", "host")
