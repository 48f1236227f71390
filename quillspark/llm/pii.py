"""Personal data: pattern matches, and a skip-chain conditional random field that carries their labels over a document.

Patterns find emails, ip addresses, card numbers and phone numbers in whole texts; these base spans always stay.
The field's variables are a document's candidates: the base spans, whose labels are observed, and mentions that
no pattern accepts but that look like a part or a variant of personal data (a name part of an address, a number
written without its prefix, ...).  Neighbours in the text share a chain potential; candidates of equal or similar
key, however distant, share a skip potential.  Loopy sum-product messages run until they settle.  A mention becomes a span
of a kind if its marginal favours that kind and a path of skip links leads from it to a base span: what only looks like
personal data, however often it is repeated, stays as it is.

Unary, chain and skip potentials are smoothed counts over all documents: how often a shape has a label (unlinked
mentions that no pattern accepts count as none), which labels follow each other, how often the two ends of a skip link
have the same one.  The counts are sums, made by Spark; only they reach the driver.  Chain potentials
are held within CHAIN_BOUND, so that no run of neighbours outweighs what skip links say.

Null and empty texts have no spans; repeated rows have the same ones; empty tables give no rows; extra columns are ignored
(redact_documents keeps them).  Matching is linear in the length of the text; no text is cut.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Skip links that are taken to agree and to disagree before any is counted.
AGREE, DISAGREE = 19.0, 1.0
#: Marginal probability from which a mention becomes a span; rounds of messages at most; damping.
DECIDE, ROUNDS, DAMPING = 0.8, 30, 0.3
#: Edges whose messages are computed at once; bound of a chain potential either way (neighbours say something about a mention, never all).
EDGES, CHAIN_BOUND = 1 << 16, 1.0
#: Digits or characters two keys must share to count as similar.
SHARED_DIGITS, SHARED_CHARS = 7, 5

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Mentions that may belong to personal data: a dotted or mixed name, or a run of digit groups.
_MENTION = re.compile(r"(?<![\w.@%+-])(?:[A-Za-z][A-Za-z0-9_%+-]*+(?:\.[A-Za-z0-9_%+-]++)++|[(]?[0-9]{2,}(?:[ ().-]{1,2}[0-9]++)*+)(?![\w@])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the longest run before each @ (after the last match), the domain follows it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            # the greedy domain must end in a label that follows a dot
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of every maximal dotted chain."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [(s, e, "ip") for s, e in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# ---- the field -------------------------------------------------------------------------------------------------

LABELS = ("none", *KINDS)
SHAPES = 8


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and the mentions outside them (kind ''), in text order."""
    out, k = [*base], 0
    bounds = sorted((s, e) for s, e, _ in base)
    reach = 0
    for m in _MENTION.finditer(text):
        while k < len(bounds) and bounds[k][0] < m.end():
            reach = max(reach, bounds[k][1])
            k += 1
        if m.start() >= reach and m.end() - m.start() >= SHARED_CHARS:
            out.append((m.start(), m.end(), ""))
    return sorted(out, key=lambda x: (x[0], x[1]))


def shape(span: str) -> int:
    """A coarse class of how a mention is written; that a pattern accepted it is not part of it."""
    digits = sum(c.isdigit() for c in span)
    if not digits or any(c.isalpha() for c in span):
        return 0 if "." in span else 1
    if span.count(".") == 3:
        return 2
    return 3 + (digits >= 7) + (digits >= 10) + (digits >= 12) + (digits >= 16)


def keys(span: str, kind: str) -> list[str]:
    """What two mentions of one entity share: an address' name part, or the last digits."""
    if kind == "email" or not any(c.isdigit() for c in span) or any(c.isalpha() for c in span):
        name = span.split("@")[0].lower()
        return ["a" + name] if len(name) >= SHARED_CHARS else []
    digits = "".join(c for c in span if c.isdigit())
    if span.count(".") == 3:
        return ["i" + span]
    return ["d" + digits[-SHARED_DIGITS:]] if len(digits) >= SHARED_DIGITS else []


def skip_links(text: str, found: list[tuple[int, int, str]]) -> np.ndarray:
    """Every mention is linked to the nearest earlier and the first one of its key: equal labels still reach all of
    them, with two links each instead of all pairs.  Rows (earlier, later), each once."""
    seen: dict[str, tuple[int, int]] = {}
    links = array("q")
    for i, (s, e, kind) in enumerate(found):
        for k in keys(text[s:e], kind):
            if k in seen:
                first, last = seen[k]
                links.extend((first, i) if first == last else (first, i, last, i))
                seen[k] = (first, i)
            else:
                seen[k] = (i, i)
    return np.unique(np.frombuffer(links, "i8").reshape(-1, 2), axis=0) if links else np.zeros((0, 2), "i8")


COUNTS = SHAPES * len(LABELS) + len(LABELS) ** 2 + 2


def count(text: str, total: np.ndarray) -> None:
    """Add a text's counts to ``total``: labels by shape, label pairs of neighbours, skip links that disagree and agree."""
    n = len(LABELS)
    unary, chain, same = total[: SHAPES * n].reshape(SHAPES, n), total[SHAPES * n : -2].reshape(n, n), total[-2:]
    found = candidates(text, base_spans(text))
    links = skip_links(text, found)
    linked = set(links.ravel().tolist())
    # the label of a linked mention is what the field is asked for
    label = [LABELS.index(k) if k else (None if i in linked else 0) for i, (_, _, k) in enumerate(found)]
    for (s, e, _), y in zip(found, label, strict=True):
        if y is not None:
            unary[min(shape(text[s:e]), SHAPES - 1), y] += 1
    for a, b in zip(label, label[1:], strict=False):
        if a is not None and b is not None:
            chain[a, b] += 1
    for i, j in links.tolist():
        if label[i] is not None and label[j] is not None:
            same[int(label[i] == label[j])] += 1


def potentials(total: np.ndarray) -> dict[str, np.ndarray]:
    """Log potentials from summed counts."""
    n = len(LABELS)
    unary, joint, same = 0.5 + total[: SHAPES * n].reshape(SHAPES, n), 0.5 + total[SHAPES * n : -2].reshape(n, n), total[-2:]
    unary = np.log(unary / unary.sum(axis=1, keepdims=True))
    joint = joint / joint.sum()
    chain = np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)))
    agree = (same[1] + AGREE) / (same.sum() + AGREE + DISAGREE)
    skip = np.full((n, n), np.log((1 - agree) / (n - 1)))
    np.fill_diagonal(skip, np.log(agree))
    return {"unary": unary, "chain": np.clip(chain, -CHAIN_BOUND, CHAIN_BOUND), "skip": skip}


def estimate(texts: list[str]) -> dict[str, np.ndarray]:
    """Log potentials of these texts."""
    total = np.zeros(COUNTS)
    for text in texts:
        count(text, total)
    return potentials(total)


def marginals(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product over edges (i, j, log potential of their labels)."""
    tables = {id(t): t for _, _, t in edges}
    return settled(unary, [(np.array([(i, j) for i, j, t in edges if id(t) == k], "i8").reshape(-1, 2), t) for k, t in tables.items()])


def settled(unary: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product in the log domain: all messages of a round at once, damped, until they settle.  groups: (edges (i, j), the log
    potential they share), so a round is a few products of (edges, labels) with (labels, labels) arrays, EDGES edges at a time."""
    n, k = unary.shape
    edges = np.concatenate([np.zeros((0, 2), "i4"), *(e.astype("i4") for e, _ in groups)])
    m, unary = len(edges), unary.astype("f4")
    # message e runs along edge e, message e + m back
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    cuts, at = [], 0
    for e, t in groups:
        table = np.exp(t).astype("f4")
        for a in range(at, at + len(e), EDGES):
            b = min(a + EDGES, at + len(e))
            cuts += [(a, b, a + m, table), (a + m, b + m, a, table.T)]
        at += len(e)
    msg = np.zeros((2 * m, k), "f4")

    def believed() -> np.ndarray:
        belief = unary.copy()
        for a, b, _, _ in cuts:
            for x in range(k):
                np.add.at(belief[:, x], dst[a:b], msg[a:b, x])
        return belief

    for _ in range(ROUNDS if m else 0):
        belief, out, moved = believed(), np.empty_like(msg), 0.0
        for a, b, back, table in cuts:
            got = belief[src[a:b]] - msg[back : back + b - a]
            got -= got.max(axis=1, keepdims=True)
            new = np.log(np.exp(got) @ table)
            new -= new.max(axis=1, keepdims=True)
            moved = max(moved, float(np.abs(new - msg[a:b]).max()))
            out[a:b] = DAMPING * msg[a:b] + (1 - DAMPING) * new
        msg = out
        if moved < 2e-6:
            break
    p = believed().astype("f8")
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _reached(n: int, edges: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n nodes can be reached from the marked ones over edges, not going on from those in ``stop``."""
    both = np.concatenate((edges, edges[:, ::-1]))
    both = both[np.argsort(both[:, 0], kind="stable")]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    reach, open_ = start.copy(), np.flatnonzero(start)
    while len(open_):
        size = first[open_ + 1] - first[open_]
        at = np.repeat(first[open_] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        to = np.unique(both[at, 1])
        to = to[~reach[to]]
        reach[to] = True
        open_ = to[~stop[to]]
    return reach


def anchored(base: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Candidates that skip links join and from which a path of them leads to a base span."""
    linked = np.zeros(len(base), bool)
    linked[links.ravel()] = True
    return _reached(len(base), links, linked & base, np.zeros(len(base), bool))


def all_spans(text: str, base: list[tuple[int, int, str]], field: dict[str, np.ndarray]) -> list[tuple[int, int, str]]:
    """Base spans and those the field adds.  Labels are asked for only where skip links lead to a base span; as base spans
    are observed, what lies behind them, and what no edge joins to these mentions, can't change an answer and is left out."""
    if not base:
        return []
    found = candidates(text, base)
    if len(found) == len(base):
        return base
    links = skip_links(text, found)
    seen = np.array([bool(kind) for _, _, kind in found])
    asked = anchored(seen, links) & ~seen
    if not asked.any():
        return base
    chain = np.stack((np.arange(len(found) - 1), np.arange(1, len(found))), axis=1)
    use = np.flatnonzero(_reached(len(found), np.concatenate((chain, links)), asked, seen))
    number = np.full(len(found), -1)
    number[use] = np.arange(len(use))
    chain, skip = (x[(x >= 0).all(axis=1)] for x in (number[chain], number[links]))
    unary = np.empty((len(use), len(LABELS)))
    for k, i in enumerate(use.tolist()):
        s, e, kind = found[i]
        unary[k] = np.where(np.arange(len(LABELS)) == LABELS.index(kind), 0.0, -50.0) if kind else field["unary"][min(shape(text[s:e]), SHAPES - 1)]
    p = settled(unary, [(chain, field["chain"]), (skip, field["skip"])])
    extra = []
    for k in np.flatnonzero(asked[use] & (p.argmax(axis=1) > 0) & (p.max(axis=1) >= DECIDE)).tolist():
        s, e, _ = found[use[k]]
        extra.append((s, e, LABELS[int(p[k].argmax())]))
    return sorted([*base, *extra], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTS)
    for batch in batches:
        for text in batch.column(0):
            count(text.as_py(), total)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTS)), pa.array(total)], names=["i", "n"])


def fit(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Potentials from the counts over all documents whose text holds an @ or a digit; COUNTS numbers come back."""
    rows = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[@0-9]"))
    total = np.zeros(COUNTS)
    for r in rows.mapInArrow(_counts, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return potentials(total)


def _scan(field: dict[str, np.ndarray], redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text) if text else []
                spans = all_spans(text, base, field) if base else []
                said = lambda x: ",".join(f"{k}:{s}:{e}" for s, e, k in x)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                clean = None
                if redact and text is not None:
                    parts, at = [], 0
                    for s, e, k in spans:
                        if e > at:
                            parts += [text[at:s] if s > at else "", f"<{k}>" if s >= at else ""]
                            at = e
                    clean = "".join(parts) + text[at:]
                rows.append((i, *counts, hashlib.sha256(said(base).encode()).hexdigest(), said(spans), clean))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean_text"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", redact: bool = True, field: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text) per row; clean_text, with every span
    replaced by <kind>, only if ``redact``.  spans: kind:start:end in code points, comma-joined."""
    field = field or fit(docs, text)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean_text string"
    return rows.mapInArrow(_scan(field, redact), schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in their texts; n_chars, where present, follows."""
    field = fit(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(names.index("text"))], names=["doc_id", "text"])
            clean = next(_scan(field, True)(iter([two]))).column("clean_text")
            columns = list(batch.columns)
            columns[names.index("text")] = clean
            if "n_chars" in names:
                n = [None if t is None else len(t) for t in clean.to_pylist()]
                columns[names.index("n_chars")] = pa.array(n, pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
