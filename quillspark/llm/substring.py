"""Repeated passages by relative Lempel-Ziv parsing: every document is factored against blocks of earlier documents.

A phrase (``width`` consecutive words) is repeated if it also stands in a document of smaller id.

1. Seeds.  The anchor of a phrase is the leftmost smallest hash among the ANCHOR-word grams in it, so equal phrases
   have equal anchors.  Each anchor that two documents have gets a source: its place in a document of smaller id.
2. Reference blocks.  Documents that are sources are cut into blocks of BLOCK words (with a margin, so that every phrase
   lies whole in one block); a document is joined with the blocks that two of its seeds point to with the same shift.
3. Parsing.  From each seed the match with its block is extended both ways as far as the words agree.  From left to
   right, the match that reaches furthest from the end of the last one is taken: these are the factors, each with its
   source and place there.  Factors of ``width`` words or more are duplicate spans.
4. Factor boundaries.  A phrase that lies in no one factor (it straddles two, its anchor's source has other words
   around it, or its seed stands alone) is looked up in an index of just these phrases.  The earliest document of a phrase has it in no factor
   and so brings it to the index: no repeated phrase is missed, and what a factor covers needs no look-up.

Words are compared by 128-bit hashes.  An anchor or phrase that many documents of a worker's run of texts have is
combined there: all but its earliest document find their source in the run, and only that one goes to the hash range.
A range therefore sees it once a run, not once a document; the number of ranges follows from the measured bytes.

Null or short texts have no phrase and lose nothing.  Rows of equal id are kept apart, and none is a source for another.
Null ids neither lose words nor serve as source.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored
from .wordhash import blobs, by_bucket, dealt, edges, firsts, fragment, gathered, grams, parts, planes, ranges, runs, scatter, text_bytes, unplane, word_hashes

#: Words of a phrase, and of the gram that anchors it; words of a reference block, and of its margins.
WIDTH, ANCHOR, BLOCK, MARGIN = 13, 6, 128, 16
#: Bytes of an anchor's hash that are sent within its range.  Anchors taken for equal by mistake are all kept: they get a wrong source at
#: worst, which the parse finds out, and their phrases go to the index.
ANCHOR_BYTES = 5
#: Bytes of text parsed at once (with the blocks they point to).
PARSE_BYTES = 2 << 20
#: Place of a seed without a source: an anchor that others have, in its earliest document.
NONE = 2**32 - 1

_SEEDS, _SEEDS_SQL = blobs(["hash", "doc", "row", "pos", "flag", "src", "at"])
_FOUND, _FOUND_SQL = blobs(["hash", "more", "doc", "row", "pos", "end", "src", "at"])


def _phrases(a: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each phrase, its first word, the first word of its anchor, hash of every anchor gram)."""
    k = min(ANCHOR, width)
    small, n = grams(a, k), len(a) - width + 1
    if n <= 0:
        none = np.zeros(0, "i8")
        return none, none, none, small
    low, at, reach, span = small, np.arange(len(small)), 1, width - k + 1
    while reach < span:  # sliding minimum by doubling; the left one of equal ones stays
        step = min(reach, span - reach)
        less = low[step:] < low[:-step]
        low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
        reach += step
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return owner[inside], inside, at[inside], small


def _several(h: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose h stands alone, the others sorted by h and keys)."""
    by = np.argsort(h, kind="stable")
    size = np.diff(edges(firsts(h[by])))
    many = np.repeat(size > 1, size)
    rest = by[many]
    return by[~many], rest[np.lexsort([k[rest] for k in (*reversed(keys), h)])]


def _leaders(new: np.ndarray) -> np.ndarray:
    """For each member of a run its first member."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, "i8")


def _pass_on(got: pa.Table, schema: pa.Schema) -> pa.Table:
    """Rows meant for a group of rows go on to it."""
    bucket = pa.array(-1 - got.column("bucket").to_numpy())
    return got.set_column(got.schema.get_field_index("bucket"), "bucket", bucket).select(schema.names)


def _batch(got: pa.RecordBatch | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A batch with all columns of the schema."""
    if got is not None:
        columns = [got.column(n) if n in got.schema.names else pa.nulls(got.num_rows, pa.binary()) for n in schema.names]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


# ---- seeds -----------------------------------------------------------------------------------------------------


def _anchors(width: int, n: int, unique: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1))
            a, _, counts = word_hashes(batch.column(2))
            owner, _, at, small = _phrases(a, counts, width)
            keep = firsts(at)
            owner, at = owner[keep], at[keep]
            h, pos = small[at], at - (np.cumsum(counts) - counts)[owner]
            row, doc = row[owner], doc[owner]
            alone, more = _several(h, doc, row, pos)
            more = more[firsts(h[more], row[more])]  # one place per text
            first = _leaders(firsts(h[more]))
            late = doc[more] > doc[more][first]
            shared = np.zeros(len(more), bool)
            shared[first[late]] = True
            lead, local = more[~late], more[late]
            send = np.concatenate((alone, lead))
            flag = np.concatenate((np.zeros(len(alone), bool), shared[first[~late]]))
            out = {"hash": h[send], "row": row[send], "pos": pos[send].astype("u4"), "flag": flag} | ({} if unique else {"doc": doc[send]})
            yield from _batch(scatter(fragment(h[send], n), out, {"hash": ANCHOR_BYTES}), _SEEDS)
            src = more[first[late]]
            yield from _batch(scatter(-1 - dealt(row[local], n), {"row": row[local], "pos": pos[local].astype("u4"), "src": row[src], "at": pos[src].astype("u4")}), _SEEDS)

    return run


def _sources(n: int, unique: bool):
    """A range of anchors: each place of an anchor that others have gets its source, the first place of the smallest id."""

    def run(got: pa.Table) -> pa.Table:
        if got.column("bucket")[0].as_py() < 0:
            return _pass_on(got, _SEEDS)
        row, pos, flag = (gathered(got, x, k) for x, k in (("row", "i8"), ("pos", "u4"), ("flag", "?")))
        h, doc = gathered(got, "hash", "u8", ANCHOR_BYTES), row if unique else gathered(got, "doc", "i8")
        alone, more = _several(h, doc, row, pos)  # a text's own anchors differ, also where their bytes sent don't
        new = firsts(h[more])
        first = _leaders(new)
        late = doc[more] > doc[more][first]
        known = np.logical_or.reduceat(late | flag[more], np.flatnonzero(new)) if len(more) else late
        shared = np.repeat(known, np.diff(edges(new)))
        alone, more, src, late = alone[flag[alone]], more[shared], more[first[shared]], late[shared]
        use = np.concatenate((alone, more))
        of = np.concatenate((alone, src))
        at = np.where(np.concatenate((np.zeros(len(alone), bool), late)), pos[of], NONE).astype("u4")
        out = {"row": row[use], "pos": pos[use], "src": row[of], "at": at}
        return pa.Table.from_batches(_batch(scatter(dealt(row[use], n), out), _SEEDS), schema=_SEEDS)

    return run


def _seeds_of_rows(got: pa.Table) -> pa.Table:
    """(row, pos, src, at, needs): a row's seeds by place, and the reference blocks that two of them with one shift point to."""
    row, pos, src, at = (gathered(got, x, k) for x, k in (("row", "i8"), ("pos", "u4"), ("src", "i8"), ("at", "u4")))
    by = np.lexsort((pos, row))
    row, pos, src, at = row[by], pos[by], src[by], at[by]
    edge = edges(firsts(row))
    cut = list(zip(edge[:-1], edge[1:], strict=True))
    use = np.flatnonzero(at != NONE)
    shift = at[use].astype("i8") - pos[use]
    along = np.lexsort((shift, src[use], row[use]))
    use, shift = use[along], shift[along]
    size = np.diff(edges(firsts(row[use], src[use], shift)))
    use = use[np.repeat(size > 1, size)]
    block = at[use].astype("i8") // BLOCK
    use, block = (x[np.lexsort((block, src[use], row[use]))] for x in (use, block))
    one = firsts(row[use], src[use], block)
    use, block = use[one], block[one]
    offsets = np.append(np.searchsorted(row[use], row[edge[:-1]]), len(use))
    needs = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.StructArray.from_arrays([pa.array(src[use]), pa.array(block)], names=["src", "block"]))
    cells = [pa.array([planes(x[s:e]) for s, e in cut], pa.binary()) for x in (pos, src, at)]
    return pa.table([pa.array(row[edge[:-1]]), *cells, needs], names=["row", "pos", "src", "at", "needs"])


# ---- reference blocks and parsing ------------------------------------------------------------------------------


def _blocks(margin: int):
    """(src, block, words): the blocks asked for of a text, each with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            src, block, words = [], [], []
            for row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                own, first = [], 0  # words from index ``first`` on
                stream = parts(text.as_py().encode())
                for number in sorted(wanted):
                    lo, hi = max(0, number * BLOCK - margin), (number + 1) * BLOCK + margin
                    while first + len(own) < hi and (part := next(stream, None)) is not None:
                        drop = min(lo - first, len(own))  # words that no later block has
                        own, first = own[drop:] + part.split(), first + drop
                    src.append(row), block.append(number), words.append(b" ".join(own[lo - first : hi - first]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(block, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], names=["src", "block", "words"])

    return run


def _agree(x: tuple, i: int, y: tuple, j: int) -> int:
    """How many words from i and j on are the same."""
    n = min(len(x[0]) - i, len(y[0]) - j)
    differ = (x[0][i : i + n] != y[0][j : j + n]) | (x[1][i : i + n] != y[1][j : j + n])
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def matches(text: tuple, seeds: tuple, blocks: dict, width: int) -> list[tuple[int, int, int, int]]:
    """(start, end, source, start there) of the longest match around each seed.  text and blocks: pairs of hash lanes of
    their words; blocks: (source, number) → (index of its first word, lanes)."""
    out: list[list[int]] = []
    last: dict[tuple[int, int], int] = {}  # per source and shift: its latest match in ``out``
    back = (text[0][::-1], text[1][::-1])
    n = len(text[0])
    for p, s, q in zip(*(x.tolist() for x in seeds), strict=True):
        if q == NONE:
            continue
        shift = q - p
        k = last.get((s, shift))
        if k is not None and out[k][1] >= p + ANCHOR:
            continue
        if (s, q // BLOCK) not in blocks:
            continue  # a seed that stands alone
        first, block = blocks[s, q // BLOCK]
        j = q - first
        end = p + _agree(text, p, block, j)
        start = p - _agree(back, n - p, (block[0][::-1], block[1][::-1]), len(block[0]) - j)
        if k is not None and start <= out[k][1]:  # goes on from the block before
            out[k][1] = max(out[k][1], end)
        elif end > start:
            last[s, shift] = len(out)
            out.append([start, end, s, start + shift])
    return [tuple(m) for m in out if m[1] - m[0] >= width]


def greedy(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The factors of a left-to-right parse: of the matches that reach back to the end of the last factor, the one that
    reaches furthest.  A factor keeps its whole match, so it may overlap the one before."""
    found, out, at, k, best = sorted(found), [], 0, 0, None
    while True:
        while k < len(found) and found[k][0] <= at:
            if best is None or found[k][1] > best[1]:
                best = found[k]
            k += 1
        if best is not None and best[1] > at:
            out.append(best)
            at = best[1]
        elif k < len(found):
            at = found[k][0]
        else:
            return out


def _parse(width: int, n: int, unique: bool):
    """Factors go to their row's group, phrases in no factor whose anchor others have to the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2, PARSE_BYTES):
            row, doc = (batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1))
            a, b, counts = word_hashes(batch.column(2))
            owner, inside, at, small = _phrases(a, counts, width)
            begin = np.append(0, np.cumsum(counts))
            cut = np.searchsorted(owner, np.arange(len(row) + 1))
            lists = batch.column(6)
            around = lists.flatten()
            ba, bb, size = word_hashes(around.field("words")) if len(around) else (a[:0], b[:0], np.zeros(0, "i8"))
            edge, taken = np.append(0, np.cumsum(size)), 0
            of, numbers = (around.field(x).to_pylist() if len(around) else [] for x in ("src", "block"))
            factors, open_ = [], np.zeros(len(inside), bool)
            for i in range(len(row)):
                pos, src, there = (unplane(batch.column(k)[i].as_py(), t) for k, t in ((3, "u4"), (4, "i8"), (5, "u4")))
                count = len(lists[i]) if lists[i].is_valid else 0
                known = {(of[k], numbers[k]): (max(0, numbers[k] * BLOCK - max(MARGIN, width)), (ba[edge[k] : edge[k + 1]], bb[edge[k] : edge[k + 1]])) for k in range(taken, taken + count)}
                taken += count
                own, phrases = slice(begin[i], begin[i + 1]), slice(cut[i], cut[i + 1])
                # a seed holds for every place of its anchor in the text
                want = small[begin[i] + pos.astype("i8")]
                by = np.argsort(want)
                places = at[phrases][firsts(at[phrases])]
                near = np.searchsorted(want[by], small[places])
                hit = want[by][np.minimum(near, len(by) - 1)] == small[places]
                k = by[near[hit]]
                mine = greedy(matches((a[own], b[own]), (places[hit] - begin[i], src[k], there[k]), known, width))
                factors += [(row[i], *m) for m in mine]
                left = np.repeat(hit, np.diff(edges(firsts(at[phrases]))))
                start = inside[phrases] - begin[i]
                for s, e, _, _ in mine:
                    left[np.searchsorted(start, s) : np.searchsorted(start, e - width, "right")] = False
                open_[phrases] = left
            if factors:
                r, s, e, src, there = (np.array(x, "i8") for x in zip(*factors, strict=True))
                yield from _batch(scatter(-1 - dealt(r, n), {"row": r, "pos": s.astype("u4"), "end": e.astype("u4"), "src": src, "at": there.astype("u4")}), _FOUND)
            w = inside[open_]
            x, y, own = grams(a, width, 0)[w], grams(b, width, 1)[w], owner[open_]
            r, d, pos = row[own], doc[own], w - begin[own]
            alone, more = _several(x, y, d, r, pos)
            first = _leaders(firsts(x[more], y[more]))
            late = d[more] > d[more][first]
            send, local, src = np.concatenate((alone, more[~late])), more[late], more[first[late]]
            out = {"hash": x[send], "more": y[send], "row": r[send], "pos": pos[send].astype("u4")} | ({} if unique else {"doc": d[send]})
            yield from _batch(scatter(fragment(x[send], n), out), _FOUND)
            yield from _batch(scatter(-1 - dealt(r[local], n), {"row": r[local], "pos": pos[local].astype("u4"), "end": (pos[local] + width).astype("u4"), "src": r[src], "at": pos[src].astype("u4")}), _FOUND)

    return run


def _index(width: int, n: int, unique: bool):
    """A range of the index of phrases in no factor: those that a document of smaller id has."""

    def run(got: pa.Table) -> pa.Table:
        if got.column("bucket")[0].as_py() < 0:
            return _pass_on(got, _FOUND)
        a, b, row, pos = (gathered(got, x, k) for x, k in (("hash", "u8"), ("more", "u8"), ("row", "i8"), ("pos", "u4")))
        doc = row if unique else gathered(got, "doc", "i8")
        _, more = _several(a, b, doc, row, pos)
        first = _leaders(firsts(a[more], b[more]))
        late = doc[more] > doc[more][first]
        use, src = more[late], more[first[late]]
        out = {"row": row[use], "pos": pos[use], "end": pos[use] + np.uint32(width), "src": row[src], "at": pos[src]}
        return pa.Table.from_batches(_batch(scatter(dealt(row[use], n), out), _FOUND), schema=_FOUND)

    return run


def _found_in_rows(got: pa.Table) -> pa.Table:
    """(row, pos, end, src, at): a row's duplicate spans by place."""
    row, pos, end, src, at = (gathered(got, x, k) for x, k in (("row", "i8"), ("pos", "u4"), ("end", "u4"), ("src", "i8"), ("at", "u4")))
    by = np.lexsort((end, pos, row))
    edge = edges(firsts(row[by]))
    cut = list(zip(edge[:-1], edge[1:], strict=True))
    return pa.table([pa.array(row[by][edge[:-1]]), *(pa.array([planes(x[by][s:e]) for s, e in cut], pa.binary()) for x in (pos, end, src, at))], names=["row", "pos", "end", "src", "at"])


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(rows (row, doc_id, text) with a number of its own each, whether that is the id)."""
    rows, row, unique = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    return rows.select(F.col(row).alias("row"), "doc_id", "text"), unique


def _duplicate_spans(rows: DataFrame, unique: bool, width: int) -> DataFrame:
    """(row, pos, end, src, at) for each row with repeated phrases, as blobs of numbers."""
    n = ranges(rows, text_bytes(rows))
    texts = rows.where("doc_id is not null and text is not null")
    seeds = by_bucket(texts.mapInArrow(_anchors(width, n, unique), _SEEDS_SQL), n).applyInArrow(_sources(n, unique), _SEEDS_SQL)
    seeds = by_bucket(seeds, n).applyInArrow(_seeds_of_rows, "row long, pos binary, src binary, at binary, needs array<struct<src:long,block:long>>")
    seeds = stored(seeds, "seeds")

    # both joins of the texts below use one shuffle of them
    pairs = seeds.select("row", F.explode("needs").alias("need")).select("row", "need.src", "need.block")
    wanted = pairs.groupBy(F.col("src").alias("row")).agg(F.collect_set("block").alias("wanted"))
    blocks = texts.join(wanted.hint("merge"), "row").select("row", "doc_id", "text", "wanted").mapInArrow(_blocks(max(MARGIN, width)), "src long, block long, words string")
    around = pairs.join(blocks.hint("merge"), ["src", "block"]).groupBy("row").agg(F.collect_list(F.struct("src", "block", "words")).alias("blocks"))

    joined = texts.join(seeds.drop("needs").hint("merge"), "row").join(around.hint("merge"), "row", "left")
    parsed = joined.select("row", "doc_id", "text", "pos", "src", "at", "blocks").mapInArrow(_parse(width, n, unique), _FOUND_SQL)
    found = by_bucket(parsed, n).applyInArrow(_index(width, n, unique), _FOUND_SQL)
    return stored(by_bucket(found, n).applyInArrow(_found_in_rows, "row long, pos binary, end binary, src binary, at binary"), "repeats")


def factors(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, end, source, source_start): duplicate spans of the parse, in words, end exclusive; words start..end
    are those from source_start on of ``source``, a smaller doc_id."""
    rows, unique = _keyed(docs)
    names = {n: (pa.int64(), t) for n, t in (("pos", "u4"), ("end", "u4"), ("src", "i8"), ("at", "u4"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = {n: [unplane(x.as_py(), t).astype("i8") for x in batch.column(n)] for n, (_, t) in names.items()}
            row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), [len(x) for x in cells["pos"]])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *(pa.array(np.concatenate([*x, np.zeros(0, "i8")])) for x in cells.values())], names=["row", *names])

    spans = _duplicate_spans(rows, unique, width).mapInArrow(run, "row long, pos long, end long, src long, at long")
    ids = rows.select("row", "doc_id")
    spans = spans.join(ids.hint("merge"), "row").join(ids.select(F.col("row").alias("src"), F.col("doc_id").alias("source")).hint("merge"), "src")
    return spans.select("doc_id", F.col("pos").alias("start"), "end", "source", F.col("at").alias("source_start"))


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans sorted by start → disjoint ones that cover the same words."""
    if not len(starts):
        return []
    far = np.maximum.accumulate(ends)
    gap = np.flatnonzero(starts[1:] > far[:-1])
    return list(zip(starts[np.append(0, gap + 1)].tolist(), far[np.append(gap, len(far) - 1)].tolist(), strict=True))


def without(text: bytes, spans: list[tuple[int, int]]) -> Iterator[tuple[int, list[bytes]]]:
    """(words, those that stay) of each part of a text."""
    n, k = 0, 0
    for part in parts(text):
        words, kept, at = part.split(), [], 0
        while k < len(spans) and spans[k][0] < n + len(words):
            s, e = spans[k]
            kept += words[at : max(at, s - n)]
            at = max(at, min(e - n, len(words)))
            if e > n + len(words):
                break  # it goes on in the next part
            k += 1
        n += len(words)
        yield len(words), kept + words[at:]


def _strip(texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "kept_text": []}
            for text, pos, end in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                spans = union(*(unplane(x.as_py(), "u4").astype("i8") for x in (pos, end))) if pos.is_valid else []
                sha, words, kept, pieces = hashlib.sha256(), 0, 0, []
                for n, stay in without((text.as_py() or "").encode(), spans):
                    joined = (b" " if kept and stay else b"") + b" ".join(stay)
                    sha.update(joined)
                    words, kept = words + n, kept + len(stay)
                    if texts_too:
                        pieces.append(joined)
                out["n_words"].append(words)
                out["n_removed"].append(words - kept)
                out["kept_sha256"].append(sha.hexdigest())
                out["spans"].append([{"first": s, "end": e} for s, e in spans])
                out["kept_text"].append(b"".join(pieces).decode() if texts_too else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept_text"], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept_text) for every row of ``docs``; spans are the
    runs of words removed, end exclusive; kept_text only if ``texts``."""
    rows, unique = _keyed(docs)
    found = _duplicate_spans(rows, unique, width).select("row", "pos", "end")
    joined = rows.join(found.hint("merge"), "row", "left").select("doc_id", "text", "pos", "end")
    return joined.mapInArrow(_strip(texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>, kept_text string")
