"""Packing of tokenised documents into windows by multiway Karmarkar-Karp differencing.

A document's ids (with the end id) are cut into full windows and a remainder, the remainder into equal pieces of at
most a quarter of a window.  Full windows stand alone; the other pieces are dealt by hash into blocks of about BLOCK.  In a block every piece starts as a partial
partition of k windows; the two partial partitions of the largest imbalance are merged, the fullest window
of one onto the emptiest of the other, until one is left: k windows of near-equal length.  k starts at the
least that could hold the tokens, and rises by one whenever a window exceeds the capacity.

Only (id, start, length, checksum) of a piece moves, never its ids.  Null and empty texts are one end id.  Any row
counts, also of a null or repeated id; with unique ids the sequences don't depend on how the table is cut into files.  Empty
tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tokens of a window, pieces of a block (a block is packed by one task), words whose ids a worker remembers and their longest.
CAPACITY, BLOCK, WORDS_KEPT, WORD_CHARS = 4096, 1000, 400_000, 64
END_ID = 2
#: The vocabulary's own way to cut a word into what it merges (fixed value).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Words of other characters are left to the tokenizer as a whole.
_PLAIN = re.compile("[!-ɏ]+")


class WordIds(dict):
    """word → its ids as little-endian 32-bit bytes, filled on demand.

    The vocabulary drops white space and never merges across it, so a text's ids are its words' ids in a row."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.cut, self.parts = self.whole.model, regex.compile(_CUT), {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        for b in range(256):
            shown.setdefault(b, chr(256 + len(shown) - len(printable)))
        self.shown = [shown[b] for b in range(256)]

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join([self.shown[b] for b in part.encode()]))]
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= WORD_CHARS and len(self.parts) < WORDS_KEPT:
            self.parts[part] = got
        return got

    def text(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            got = self.text(word)
        else:
            known = self.parts
            got = b"".join([known.get(p) or self._part(p) for p in self.cut.findall(unicodedata.normalize("NFC", word).lower())])
        if len(word) <= WORD_CHARS and len(self) < WORDS_KEPT:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.text(text)
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The vocabulary of this worker process.  It remembers the first words it meets, common ones among them, up to a bound."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _pieces(path: str, capacity: int):
    end, most = struct.pack("<I", END_ID), max(1, capacity // 4)

    def cuts(n: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces of n ids."""
        full = n - n % capacity
        parts = -(-(n % capacity) // most)
        edges = [*range(0, full + 1, capacity), *(full + (n % capacity) * k // parts for k in range(1, parts + 1))]
        return list(zip(edges, edges[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lo in range(0, batch.num_rows, 1000):
                known = word_ids(path)
                for i, text in zip(batch.column(0).slice(lo, 1000).to_pylist(), batch.column(1).slice(lo, 1000).to_pylist(), strict=True):
                    ids = known.ids(text or "") + end
                    n = len(ids) // 4
                    rows += [(i, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n) for s, e in cuts(n)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def differencing(weights: list[int], k: int) -> list[list[int]]:
    """k lists of positions in ``weights`` with near-equal sums, by Karmarkar-Karp differencing.

    A partial partition is kept as its non-empty windows only, fullest first; the others hold nothing."""
    heap: list[tuple] = [(-w, i, [w], [[i]]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, items = a + b, ia + ib
        else:  # the emptiest of a get the fullest of b that find no empty window
            if len(a) < len(b):
                a, b, ia, ib = b, a, ib, ia
            keep = len(a) - over
            tail, itail = a[keep:], ia[keep:]
            sums = a[:keep] + [x + y for x, y in zip(reversed(tail), b, strict=False)] + b[over:]
            items = ia[:keep] + [x + y for x, y in zip(reversed(itail), ib, strict=False)] + ib[over:]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[i] for i in order], [items[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), stamp, sums, items))
        stamp += 1
    return heap[0][3] if heap else []


def windows(weights: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity: their number rises from the least possible until none exceeds it."""
    k = -(-sum(weights) // capacity)
    while True:
        got = differencing(weights, k) if k else []
        if all(sum(weights[i] for i in w) <= capacity for w in got):
            return got
        k += 1


def _pack_block(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length = table.column("length").to_pylist()
        full = sum(n == capacity for n in length)
        groups = [[i] for i in range(full)] + [[full + i for i in w] for w in windows(length[full:], capacity)]
        sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
        first = table.column("block")[0].as_py() << 24 if len(length) else 0
        for g, members in enumerate(groups):
            at = 0
            for i in members:
                sequence[i], offset[i] = first + g, at
                at += length[i]
        return table.drop_columns("block").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_path, capacity), schema), "pieces")
    size = pieces.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start") == 0).alias("docs"), F.count_distinct("doc_id").alias("ids")).first()
    # pieces of one null or repeated id are spread as well, else a third of all rows could fall in one block
    salt = [] if size["docs"] == size["ids"] else [F.monotonically_increasing_id()]
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", *salt), F.lit(max(1, -(-size["n"] // BLOCK)))))
    return dealt.groupBy("block").applyInArrow(_pack_block(capacity), schema + ", sequence_id long, offset long")
