"""BPE encoding and decoding with reuse of content-defined chunks: what documents share is encoded once.

1. Chunks.  A rolling hash over the last 32 bytes cuts texts where the content says so, so that equal passages, wherever they stand, fall
   into equal chunks.  A chunk is named by 128 bits of hash; only names are counted and joined, texts stay where they are.
2. Owners.  Of the places of a chunk that occurs several times, the first (by row and place) owns it.  The owner encodes the
   chunk, once, and publishes the ids; all other places borrow them.
3. Joins.  What lies between borrowed or published ids is encoded in its document.  Ids at a chunk's edges depend on what stands
   beside it, so a join is encoded again as a whole: from the last white space of the chunk before it to the first of the chunk
   behind it.  Then the ids of the join with a word more on either side must be those of word, join and word put together; while they
   aren't, the join takes in the neighbouring chunk as well and is encoded again.  So ids equal those of the whole text.
4. Documents that borrow are put together from their parts in order, as a stream: ids are hashed and decoded as they come.

Documents without shared chunks are finished where they are read.  The list of a document's shared chunks is broadcast if its
measured size is small, else the texts are shuffled once to meet it.  A chunk that a third of all documents hold is an
aggregate with map-side combine and two joins that adaptive execution splits.

Decoding joins the vocabulary's entries by blanks, as the vocabulary has no decoder.  Null and empty texts have no ids.  Very long texts are
encoded in pieces cut at white space, which the vocabulary drops.  Repeated rows, also of null ids, are documents of their own.  Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import BROADCAST_BYTES, numbered, stored
from .packing import WordIds, word_ids
from .wordhash import mix

#: Bytes of a chunk at least and at most (but for a text's last); a place in 2**CUT_BITS ends one.
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 10
#: Bytes hashed at once, bytes encoded at once, bytes that the hash looks back on.
SLICE_BYTES, PIECE_BYTES, LOOK_BACK = 1 << 20, 1 << 20, 32
#: A number for each byte value.
_GEAR = (mix(np.arange(1, 257, dtype="u8")) >> np.uint64(32)).astype("u4")
_BLANK = re.compile(rb"[ \t\n\r]")


def places(raw: bytes) -> list[int]:
    """Ends of possible chunks: where the hash of the last LOOK_BACK bytes is small, between two characters."""
    out = []
    for at in range(0, len(raw), SLICE_BYTES):
        first = max(0, at - LOOK_BACK + 1)
        part = np.frombuffer(raw, "u1", min(len(raw), at + SLICE_BYTES + 1) - first, first)
        h, step = _GEAR[part], 1
        while step < LOOK_BACK:  # h[i] sums the last ``step`` bytes, the one k back shifted by k bits
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        end = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS) == 0) & (part[1:] & 0xC0 != 0x80)) + first + 1
        out.append(end[(end > at) & (end <= at + SLICE_BYTES)])
    return np.concatenate(out).tolist() if out else []


def chunks(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks."""
    ends, out, at, n = places(raw), [], 0, len(raw)
    while at < n:
        k = bisect_left(ends, at + MIN_CHUNK)
        end = ends[k] if k < len(ends) and ends[k] <= at + MAX_CHUNK else at + MAX_CHUNK
        if end >= n or n - at <= MIN_CHUNK:
            end = n
        while end < n and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end))
        at = end
    return out


def core(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a chunk between its first and its last white space: its ids don't depend on what stands around the chunk.  Empty if it has no two."""
    m = _BLANK.search(raw, start, end)
    if not m:
        return start, start
    last = max(raw.rfind(c, start, end) for c in (b" ", b"\t", b"\n", b"\r"))
    return m.end(), max(last, m.end())


def _encoded(known: WordIds, raw: bytes, start: int, end: int) -> Iterator[bytes]:
    """Ids of a part of a text that starts and ends at white space or the text's ends, piece by piece."""
    while start < end:
        stop = min(end, start + PIECE_BYTES)
        if stop < end:
            m = _BLANK.search(raw, stop, end)
            stop = m.start() if m else end
        yield known.ids(raw[start:stop].decode())
        start = stop


def _before(raw: bytes, at: int) -> int:
    """Where the word that ends before ``at`` starts."""
    return max(raw.rfind(c, 0, max(0, at - 1)) for c in (b" ", b"\t", b"\n", b"\r")) + 1


def _behind(raw: bytes, at: int) -> int:
    """Where the word that starts at ``at`` ends."""
    m = _BLANK.search(raw, min(at + 1, len(raw)))
    return m.start() if m else len(raw)


def agrees(known: WordIds, raw: bytes, start: int, end: int) -> tuple[bool, bool]:
    """Whether encoding a join together with the word before it, and with the one behind it, gives the ids of both put together.
    Of the join, its first and last word take part."""
    ids = lambda a, b: known.text(raw[a:b].decode())
    same = lambda a, b, c: ids(a, c) == ids(a, b) + ids(b, c)
    left = start == 0 or same(_before(raw, start), start, min(end, _behind(raw, start)))
    return left, end == len(raw) or same(max(start, _before(raw, end)), end, _behind(raw, end))


def plan(known: WordIds, raw: bytes, shared: dict[int, tuple[int, int, bool]]) -> list[tuple[int, int, tuple | None]]:
    """(start, end, name) of a document's parts in order; name: of the shared chunk whose core it is, None for joins."""
    cores = []
    for k, (s, e) in enumerate(chunks(raw)):
        if k in shared:
            a, b = core(raw, s, e)
            if a < b:
                cores.append((a, b, shared[k]))
    while True:
        edges = [0, *(x for a, b, _ in cores for x in (a, b)), len(raw)]
        joins = list(zip(edges[::2], edges[1::2], strict=True))
        fine = [agrees(known, raw, a, b) for a, b in joins]
        keep = [fine[k][1] and fine[k + 1][0] for k in range(len(cores))]
        if all(keep):
            out = []
            for k, (a, b) in enumerate(joins):
                out += ([(a, b, None)] if b > a else []) + ([cores[k]] if k < len(cores) else [])
            return out
        cores = [c for c, k in zip(cores, keep, strict=True) if k]


def _left_out(raw: bytes, shared: dict[int, tuple[int, int, bool]], parts: list) -> list[tuple[int, int, tuple]]:
    """The cores that a document owns and that a join took in."""
    used = {name for _, _, name in parts if name}
    if not any(name[2] and name not in used for name in shared.values()):
        return []
    out = []
    for k, (s, e) in enumerate(chunks(raw)):
        if k in shared and shared[k][2] and shared[k] not in used:
            a, b = core(raw, s, e)
            if a < b:
                out.append((a, b, shared[k]))
    return out


class Result:
    """Ids of one document as they come: counted, hashed and decoded; kept only if asked for."""

    def __init__(self, tokens: list[bytes], keep: bool) -> None:
        self.tokens, self.n, self.ids, self.text = tokens, 0, sha256(), sha256()
        self.kept: list[np.ndarray] | None = [] if keep else None

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            said = b" ".join(map(self.tokens.__getitem__, ids.tolist()))
            self.text.update(b" " + said if self.n else said)
            self.ids.update(ids.astype("<u4").tobytes())
            self.n += len(ids)
            if self.kept is not None:
                self.kept.append(ids)

    def row(self) -> tuple:
        ids = None if self.kept is None else np.concatenate([np.zeros(0, "u4"), *self.kept]).tolist()
        return self.n, self.ids.hexdigest(), self.text.hexdigest(), ids


def tokens_of(known: WordIds) -> list[bytes]:
    """The vocabulary's entries by id."""
    size = known.whole.get_vocab_size(with_added_tokens=True)
    return [(known.whole.id_to_token(i) or "").encode() for i in range(size)]


_tokens: dict[str, list[bytes]] = {}


def _loaded(path: str) -> tuple[WordIds, list[bytes], str]:
    """(vocabulary, its entries, type in which ids travel) of this worker process."""
    known = word_ids(path)
    if path not in _tokens:
        _tokens[path] = tokens_of(known)
    return known, _tokens[path], "<u2" if len(_tokens[path]) <= 1 << 16 else "<u4"


# ---- names of chunks -------------------------------------------------------------------------------------------


def _raw(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.large_string()).cast(pa.large_binary()):
        yield text.as_py() or b""


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, row, place) of every chunk."""
    for batch in batches:
        names, rows, at = bytearray(), [], []
        for row, raw in zip(batch.column(0).to_pylist(), _raw(batch, 1), strict=True):
            view = memoryview(raw)
            for k, (s, e) in enumerate(chunks(raw)):
                names += xxh3_128_intdigest(view[s:e]).to_bytes(16, "little")
                rows.append(row)
                at.append(k)
        both = np.frombuffer(bytes(names), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(rows, pa.int64()), pa.array(at, pa.int64())], names=["a", "b", "row", "place"])


def shared_chunks(rows: DataFrame) -> DataFrame:
    """(row, chunks): of each row (row, text) its chunks that occur several times: (place, a, b, own)."""
    refs = stored(rows.where("text is not null and text <> ''").select("row", "text").mapInArrow(_names, "a long, b long, row long, place long"), "chunks")
    owner = refs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("owner")).where("n > 1")
    owner = stored(owner.select("a", "b", "owner"), "owners")
    used = refs.join(owner.hint("merge"), ["a", "b"])
    own = (F.col("owner.row") == F.col("row")) & (F.col("owner.place") == F.col("place"))
    return stored(used.groupBy("row").agg(F.collect_list(F.struct("place", "a", "b", own.alias("own"))).alias("chunks")), "shared")


# ---- encoding --------------------------------------------------------------------------------------------------

_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>"
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("own", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int64()))])
_PART_SQL = f"row long, doc_id long, part long, a long, b long, own binary, {_OUT}"


def _encode(path: str, keep: bool):
    """Finished documents (part null), published chunks (row null), and the parts of documents that borrow some."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        known, tokens, width = _loaded(path)
        none = (None,) * 4
        for row, doc, raw, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch, 2), batch.column(3).to_pylist(), strict=True):
            shared = {c["place"]: (c["a"], c["b"], c["own"]) for c in some or ()}
            parts = plan(known, raw, shared) if shared else [(0, len(raw), None)]
            borrows = any(name and not name[2] for _, _, name in parts)
            result, k = Result(tokens, keep), 0
            for start, end, name in parts:
                if name and not name[2]:
                    yield row, doc, k, *name[:2], None, *none
                    k += 1
                    continue
                published = []
                for ids in _encoded(known, raw, start, end):
                    ids = np.frombuffer(ids, "<u4")
                    if name:
                        published.append(ids)
                    if borrows:
                        yield row, doc, k, None, None, ids.astype(width).tobytes(), *none
                        k += 1
                    else:
                        result.add(ids)
                if name:
                    yield None, None, None, *name[:2], np.concatenate(published).astype(width).tobytes(), *none
            for start, end, name in _left_out(raw, shared, parts):  # others may borrow them all the same
                yield None, None, None, *name[:2], np.frombuffer(b"".join(_encoded(known, raw, start, end)), "<u4").astype(width).tobytes(), *none
            if not borrows:
                yield row, doc, None, None, None, None, *result.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = list(rows(batch.slice(at, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True) if some else [[]] * len(_PART), _PART, strict=True)], schema=_PART)

    return run


def _assemble(path: str, keep: bool):
    """(row, doc_id, part, ids), sorted by row and part → documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens, width = _loaded(path)
        names = ("row", "doc_id", "own")
        cells = (r for b in batches for r in zip(*(b.column(n) for n in names), strict=True))
        out = []
        for (_, doc), own in groupby(cells, key=lambda r: (r[0].as_py(), r[1].as_py())):
            result = Result(tokens, keep)
            for r in own:
                result.add(np.frombuffer(r[2].as_py(), width))
            out.append((doc, *result.row()))
            if len(out) >= 500:
                yield _documents(out)
                out = []
        yield _documents(out)

    return run


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), *((_PART.field(n).name, _PART.field(n).type) for n in ("n_tokens", "ids_sha256", "decoded_sha256", "ids"))]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every row; ids, a list, only if ``ids``.  ids_sha256: of the ids as little-endian
    unsigned 32-bit numbers; decoded_sha256: of the decoded text."""
    every, row, _ = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    rows = every.select(F.col(row).alias("row"), "doc_id", "text")
    shared = shared_chunks(rows)
    size = shared.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    small = 48 * size["n"] + 32 * size["k"] <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(shared) if small else shared.hint("merge"), "row", "left").select("row", "doc_id", "text", "chunks")
    made = stored(joined.mapInArrow(_encode(path, ids), _PART_SQL), "encoded")
    result = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    done = made.where("n_tokens is not null").select(*result)
    parts = made.where("part is not null").select("row", "doc_id", "part", "a", "b", "own")
    published = made.where("row is null and n_tokens is null").select("a", "b", "own")
    borrowed = parts.where("own is null").drop("own").join(published.hint("merge"), ["a", "b"])
    every = parts.where("own is not null").select("row", "doc_id", "part", "own").unionByName(borrowed.select("row", "doc_id", "part", "own"))
    sorted_ = every.repartition("row").sortWithinPartitions("row", "part")
    return done.unionByName(sorted_.mapInArrow(_assemble(path, ids), f"doc_id long, {_OUT}"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the vocabulary's entries, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tokens, _ = _loaded(path)
            texts = [None if x is None else b" ".join(map(tokens.__getitem__, x)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
