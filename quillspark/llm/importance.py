"""Importance resampling towards a target: documents are drawn with odds that follow how much likelier their words are there.

Features are the runs of 1 to ``longest`` consecutive words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS.
Exact totals per bucket over all documents and all target texts give each bucket an integer gain, a document's weight is
the sum of its features' gains, and the highest weights plus Gumbel noise (a hash of the id) are drawn.

Head-tail vocabulary.  Text is skewed: few words make up most features.  The most frequent HEAD_WORDS words and HEAD_PAIRS
pairs are sent to all tasks with the state of their CRC, which is their bucket as well; a CRC runs on from a state, so a longer run
that starts with a head word or pair is hashed from the next word on.  A feature outside the head takes its CRC directly.  Both add to
the same totals, so the head decides how fast a feature is found, never what it counts.  The head is found by
counting all documents, each task with at most KEPT candidates in memory.

Texts are read part by part, so a very long one needs no more memory.  Null and empty texts, and those without words, have no
features and weight 0.  A null id is hashed as the empty text and comes last among ties; repeated rows are drawn as rows of
their own.  Empty tables give no rows; without target texts T is 0.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Any
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

#: Buckets; words and pairs of the head; candidates for it that a task holds; bytes of a text taken at once.
BUCKETS, HEAD_WORDS, HEAD_PAIRS, KEPT, PART_BYTES = 10_000, 1 << 16, 1 << 15, 1 << 18, 1 << 20
#: Bytes of a head word at most: with the numbers above, the bound on what is broadcast (some 12 MB).
HEAD_BYTES = 64
_CAPITALS, _WORD = range(0x41, 0x5B), {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A to Z; every byte that is no part of a word becomes a blank (words are cut bytewise, as separators are ASCII).
_TABLE = bytes(b + 32 if b in _CAPITALS else b if b in _WORD else 32 for b in range(256))


_SEPARATOR = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in range(128) if _TABLE[b] == 32) + b"]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    at = 0
    while at < len(text):
        end = at + PART_BYTES
        if end < len(text):
            m = _SEPARATOR.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


class Head:
    """CRC states of frequent words and pairs, from which their buckets follow; everything else is computed."""

    def __init__(self, words: dict[bytes, int] | None = None, pairs: dict[tuple[bytes, bytes], int] | None = None, buckets: int = BUCKETS) -> None:
        self.words, self.pairs, self.buckets = words or {}, pairs or {}, buckets

    def features(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number of words, buckets of the features) of each part of a text; a run across a part's border belongs to the later part."""
        known, pairs, n, last = self.words, self.pairs, self.buckets, []
        for own in words_of(text):
            words = last + own
            states = [known[w] if w in known else crc32(w) for w in words]
            found = [np.array(states[len(last) :], "i8") % n]
            for size in range(2, longest + 1):
                if size == 2:
                    states = [pairs[v, w] if (v, w) in pairs else crc32(b" " + w, s) for s, v, w in zip(states, words, words[1:], strict=False)]
                else:
                    states = [crc32(b" " + w, s) for s, w in zip(states, words[size - 1 :], strict=False)]
                found.append(np.array(states[max(0, len(last) - size + 1) :], "i8") % n)  # runs before end in the part before
            last = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
            yield len(own), np.concatenate(found)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    for text in batch.column(column).cast(pa.large_string()).cast(pa.large_binary()):
        yield text.as_py()


def _frequent(longest: int):
    """(first, second, n): counts of a task's most frequent words and pairs.  Beyond KEPT candidates the rarer half goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[Any] = Counter()
        for batch in batches:
            for text in _texts(batch, 0):
                for words in words_of(text or b""):
                    count.update(words)
                    if longest > 1:
                        count.update(zip(words, words[1:], strict=False))
                if len(count) > KEPT:
                    count = Counter(dict(count.most_common(KEPT // 2)))
        best: list = []
        for pair, most in ((False, HEAD_WORDS), (True, HEAD_PAIRS)):
            of = Counter({k: v for k, v in count.items() if isinstance(k, tuple) == pair and max(map(len, k) if pair else (len(k),)) <= HEAD_BYTES})
            best += of.most_common(most)
        first = [k[0] if isinstance(k, tuple) else k for k, _ in best]
        second = [k[1] if isinstance(k, tuple) else None for k, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array([v for _, v in best], pa.int64())], names=["first", "second", "n"])

    return run


def head(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, text: str = "text") -> Head:
    """The head of all documents: what has at least the count, in steps of a sixteenth of a doubling, from which on no more than HEAD_WORDS
    words and HEAD_PAIRS pairs are left.  So no more come to the driver, from all tasks together."""
    rows = docs.select(F.col(text).cast("string")).mapInArrow(_frequent(longest), "first binary, second binary, n long")
    counts = stored(rows.groupBy("first", "second").agg(F.sum("n").alias("n")), "frequent")
    counts = counts.withColumn("pair", F.col("second").isNotNull()).withColumn("step", F.floor(F.log2("n") * 16))
    left, least = {False: HEAD_WORDS, True: HEAD_PAIRS}, {False: 1 << 30, True: 1 << 30}
    for r in sorted(counts.groupBy("pair", "step").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["step"]):  # some 2000 rows at most
        left[r["pair"]] -= r["k"]
        if left[r["pair"]] >= 0:
            least[r["pair"]] = r["step"]
    words = {bytes(r["first"]): crc32(r["first"]) for r in counts.where(~F.col("pair") & (F.col("step") >= least[False])).collect()}
    pairs = counts.where(F.col("pair") & (F.col("step") >= least[True])).collect() if longest > 1 else []
    return Head(words, {(bytes(r["first"]), bytes(r["second"])): crc32(r["first"] + b" " + r["second"]) for r in pairs}, buckets)


def _totals(shared: Any, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(known.buckets, "i8")
        for batch in batches:
            for text in _texts(batch, 0):
                for _, found in known.features(text or b"", longest):
                    total += np.bincount(found, minlength=known.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, shared: Any, longest: int, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all ``docs`` per bucket."""
    rows = docs.select(F.col(text).cast("string")).mapInArrow(_totals(shared, longest), "bucket long, n long")
    total = np.zeros(buckets, "i8")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight."""
    s, t, n = source.astype("f8"), target.astype("f8"), float(len(source))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype("i8")


def _weights(shared: Any, gain: Any, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_bucket = shared.value, gain.value
        for batch in batches:
            words, size, weight = ([0] * batch.num_rows for _ in range(3))
            for k, text in enumerate(_texts(batch, 1)):
                for n, found in known.features(text or b"", longest):
                    words[k] += n
                    size[k] += len(found)
                    weight[k] += int(by_bucket[found].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, size, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, least_words: int = 20, seed: str = "2024", buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``.

    Of the N rows with ``least_words`` words, the floor(percent * N / 100) of highest score are drawn and ranked from 1 on, ties to the
    smaller id; the others' rank is null."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(head(docs, longest, buckets, text))
    gain = context.broadcast(gains(bucket_totals(docs, shared, longest, buckets, text), bucket_totals(target, shared, longest, buckets, text)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weighed = rows.mapInArrow(_weights(shared, gain, longest), "doc_id long, n_words long, n_features long, weight long")
    said = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), said), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranked(able, *order).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
