"""Quality of texts by a generalised additive model with pairwise interactions.

Each text gives FEATURES numbers (lengths, shares of character classes, repetition).  A feature is cut into bins at
quantiles; the model is an intercept, a lookup table per feature and a lookup table per chosen pair of features.
The tables are learnt by boosting shallow trees in turn, one feature at a time and round after round, so that
correlated features share the credit; pairs are chosen by how much of the remaining gradient they explain.  A
score is a sum of looked-up values, one vectorised addition per table, through the logistic function.

Learning uses at most TRAIN_ROWS labelled documents, those of the smallest hash of the id; every document is scored.
Null and empty texts have the features of an empty text and get a score like any other.  Labels, language, source and
id are no features.  Null labels and unlabelled rows are not learnt from; without two labels the score is the share of
ones, or 0.5.  Of rows that repeat a labelled id one is learnt from; all are scored, alike if their texts are.  Empty tables
give no rows; extra columns are ignored (keep_good keeps them).  Words of long texts are counted as hashes, part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from .common import stored
from .wordhash import SLICE_BYTES, grams, parts

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 250, 120, 0.1, 4
#: Score from which a document is predicted to be good.
ACCEPT = 0.7

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "space", "punct", "marks", "bars",
    "high_bytes", "distinct_words", "top_word", "repeats_next", "repeats_near", "lines", "repeated_lines", "line_length",
    "stops", "capital_words", "marked_words", "punct_kinds",
)

_CLASS = np.zeros(256, "u1")  # 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 bar, 7 other ASCII, 8 beyond ASCII
_CLASS[:] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[44, 46, 59, 58, 63]] = 5
_CLASS[124] = 6
_MARKED = np.zeros(256, bool)
_MARKED[list(b"!#$%&*~^@=<>")] = True


def _line_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the lines that aren't blank, a stretch of text at a time."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE_BYTES else text.find(b"\n", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        lines = [x for x in text[at:end].split(b"\n") if x.strip()]
        yield np.frombuffer(b"".join(map(xxh3_64_digest, lines)), "u8")
        at = end + 1


def features(text: bytes) -> list[float]:
    """The FEATURES of one text (UTF-8)."""
    n = max(len(text), 1)
    by_byte, hashes, lengths, capital, marked = np.zeros(256, "i8"), [np.zeros(0, "u8")], [np.zeros(0, "i8")], 0, 0
    for part in parts(text):
        raw = np.frombuffer(part, "u1")
        by_byte += np.bincount(raw, minlength=256)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _CLASS[raw] == 4, [True]))))
        starts, ends = edge[::2], edge[1::2]
        capital += np.count_nonzero(_CLASS[raw[starts]] == 2)
        marked += np.count_nonzero(_MARKED[raw[ends - 1]])
        lengths.append(ends - starts)
        hashes.append(np.frombuffer(b"".join(map(xxh3_64_digest, part.split())), "u8"))
    kind = np.bincount(_CLASS, weights=by_byte, minlength=9)
    words, lengths = np.concatenate(hashes), np.concatenate(lengths)
    m = max(len(words), 1)
    seen, first, times = np.unique(words, return_index=True, return_counts=True)
    lines = np.concatenate([np.zeros(0, "u8"), *_line_hashes(text)])
    k = max(len(lines), 1)
    letters = max(kind[1] + kind[2] + kind[8], 1)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        (n - kind[4]) / m,
        np.count_nonzero(lengths[first] > 24) / max(len(seen), 1),
        kind[2] / letters,
        kind[3] / n,
        kind[4] / n,
        kind[7] / n,
        by_byte[33] / n,
        kind[6] / n,
        kind[8] / n,
        len(seen) / m,
        times.max(initial=0) / m,
        np.count_nonzero(words[1:] == words[:-1]) / m,
        (m - len(np.unique(grams(words, 3)))) / m,
        np.log1p(len(lines)),
        1 - len(np.unique(lines)) / k,
        np.log1p(len(text) / k),
        kind[5] / m,
        capital / m,
        marked / m,
        np.count_nonzero(by_byte[33:48]) / 15,
    ]


def _rows(column: pa.Array) -> np.ndarray:
    return np.array([features((t.as_py() or "").encode()) for t in column], "f8").reshape(-1, len(FEATURES))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _rows(batch.column(1))
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * len(FEATURES)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), vec, batch.column(2)], names=["doc_id", "x", "y"])


# ---- the model -------------------------------------------------------------------------------------------------


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best piecewise-constant step over ordered bins: gradients g and weights h per bin → value per bin."""
    edges = [0, len(g)]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                won = gain(a, c) + gain(c, b) - gain(a, b)
                if won.max() > best[0]:
                    best = (won.max(), int(c[won.argmax()]))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model of rows x (one column per feature) and labels y of 0 and 1."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 0.01), 0.99)
        return {"base": float(np.log(p / (1 - p))), "single": [], "pairs": []}
    base = float(np.log(y.mean() / (1 - y.mean())))
    cuts = [_cuts(c, BINS) for c in x.T]
    bins = [np.searchsorted(q, c, "right") for q, c in zip(cuts, x.T, strict=True)]
    tables = [np.zeros(len(q) + 1) for q in cuts]
    logit = np.full(len(y), base)
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-logit))
            step = RATE * _tree(np.bincount(b, y - p, len(tables[f])), np.bincount(b, p * (1 - p), len(tables[f])), LEAVES)
            tables[f] += step
            logit += step[b]
    coarse_cuts = [_cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(q, c, "right") for q, c in zip(coarse_cuts, x.T, strict=True)]
    p = 1 / (1 + np.exp(-logit))
    worth = []
    for f in range(x.shape[1]):
        for e in range(f):
            width = len(coarse_cuts[e]) + 1
            cell = coarse[f] * width + coarse[e]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            worth.append(((g * g / (h + 1)).sum(), f, e))
    pairs = [(f, e, np.zeros((len(coarse_cuts[f]) + 1, len(coarse_cuts[e]) + 1))) for _, f, e in sorted(worth, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for f, e, table in pairs:
            p = 1 / (1 + np.exp(-logit))
            cell = coarse[f] * table.shape[1] + coarse[e]
            g = np.bincount(cell, y - p, table.size).reshape(table.shape)
            h = np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
            # a shallow tree: the best cut of f, then on each side steps along e
            cg, ch = g.sum(axis=1).cumsum(), h.sum(axis=1).cumsum()
            cut = int(((cg**2 / (ch + 1)) + (cg[-1] - cg) ** 2 / (ch[-1] - ch + 1)).argmax()) + 1
            step = np.zeros(table.shape)
            for part in (slice(0, cut), slice(cut, None)):
                if g[part].size:
                    step[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 3)
            table += RATE * step
            logit += RATE * step.ravel()[cell]
    return {"base": base, "single": list(zip(cuts, tables, strict=True)), "pairs": [(f, e, coarse_cuts[f], coarse_cuts[e], t) for f, e, t in pairs]}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for rows x."""
    logit = np.full(len(x), model["base"])
    for f, (cuts, table) in enumerate(model["single"]):
        logit += table[np.searchsorted(cuts, x[:, f], "right")]
    for f, e, cf, ce, table in model["pairs"]:
        logit += table[np.searchsorted(cf, x[:, f], "right"), np.searchsorted(ce, x[:, e], "right")]
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of at most TRAIN_ROWS labelled documents; labels: (doc_id, quality).  An id with several labels counts with
    the greatest, one with several texts with the text of the least features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where("y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).join(rows.select("doc_id"), "doc_id", "left_semi")
    known = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "labelled")
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # broadcast: TRAIN_ROWS ids and labels
    each = rows.mapInArrow(_extract, "doc_id long, x array<double>, y int").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    sample = sorted((tuple(r["x"]), r["y"]) for r in each.select("x", "y").collect())  # TRAIN_ROWS rows
    return fit(np.array([x for x, _ in sample], "f8").reshape(-1, len(FEATURES)), np.array([y for _, y in sample], "f8"))


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(model, _rows(batch.column(1))))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, in one pass over the texts."""
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, all their columns: nulls, empty texts and repeated rows by their scores."""
    model, at = learn(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(model, _rows(batch.column(at))) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
