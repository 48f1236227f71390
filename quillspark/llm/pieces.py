"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read character by character.  Only a window as long as the longest piece is searched: a piece ending here started
inside it.  Each position keeps the last piece of the best segmentation up to it.  When the backpointer paths of all
positions that can still be extended pass one common boundary, everything before it is final, and its ids are committed.

What makes a segmentation the best one depends on the model.  For a model of piece scores (unigram) it is the largest sum,
an equally good path that starts earlier winning.  For a merge model (BPE), whose scores are merge ranks, it is the one in
which every two neighbours are what merging in rank order makes of their characters: exactly one segmentation has that
property, and it is the library's.  (No merge joins characters of different pieces of its result, so neighbours stay apart
when merged alone; and the first merge across a boundary of any other segmentation would also be made in that pair alone.)
Whether two pieces can be neighbours is remembered.

Characters of no piece become byte pieces (or the unknown id, one for a run of them in a merge model, as the public library
has it); in a unigram model their score is the lowest score less 10.

A vocabulary whose pieces never run from a character into the following white-space mark has a common boundary before
every word; the ids committed for a word are then remembered, and the search runs for words not yet known and long ones.
A path that doesn't converge keeps its backpointers (two numbers a character) until it does; that is all that is kept of
the text before the window.

Null texts encode to null; empty texts to no ids; repeated rows are encoded alike; empty tables give no rows; extra columns are
ignored.  Every text without the mark itself decodes to what it was.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Below the lowest score, for characters of no piece.
UNKNOWN_PENALTY = 10.0
#: Words and pairs of pieces that a worker remembers; longer words are searched each time.
WORDS_KEPT, PAIRS_KEPT, WORD_CHARS = 800_000, 1_000_000, 48
#: Rows that are encoded before their ids are handed on.
ROWS = 500


class _Words(dict):
    """word → its ids as little-endian 32-bit bytes, by the search of a vocabulary; the first words met are kept."""

    def __init__(self, search) -> None:
        self.search = search

    def __missing__(self, word: str) -> bytes:
        got = b"".join(struct.pack(f"<{len(ids)}I", *ids) for ids in self.search(word))
        if len(word) <= WORD_CHARS and len(self) < WORDS_KEPT:
            self[word] = got
        return got


class Vocabulary:
    """Pieces and scores of a SentencePiece model file, and the white-space handling its encoder applies."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.score = {p: (sp.get_score(i), i) for i, p in enumerate(self.pieces) if not special[i]}
        self.unknown = sp.unk_id()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte_id)
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)} if self.has_bytes else {}
        raw = lambda i: bytes([self.byte_of[i]]) if i in self.byte_of else b"" if sp.is_control(i) else (" ⁇ " if i == self.unknown else self.pieces[i]).encode()
        self.raw = [raw(i) for i in range(n)]
        self.longest = max(map(len, self.score))
        self.unknown_score = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        #: Character by character to (score, id), under "", of each piece.
        self.trie: dict = {}
        for p, value in self.score.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = value
        # pieces end before a mark that follows another character, and none holds a line break
        self.by_word = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score)
        spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec
        self.merges = spec.model_type == spec.BPE
        self.neighbours: dict[int, bool] = {}
        self.words = _Words(self.stream)
        #: How often ids were committed, and the longest stretch of characters with open paths.
        self.commits, self.longest_open = 0, 0

    def prepared(self, text: str) -> str:
        """Marks for spaces, and one in front."""
        return MARK + text.replace(" ", MARK) if text else ""

    def merge(self, text: str) -> list[str]:
        """A short text's pieces by merging: the neighbours of the best joint piece are joined, again and again."""
        score, parts = self.score, list(text)
        ranks = [got[0] if (got := score.get(a + b)) else -np.inf for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (top := max(ranks)) > -np.inf:
            k = ranks.index(top)
            parts[k] += parts.pop(k + 1)
            ranks.pop(k)
            if k:
                ranks[k - 1] = got[0] if (got := score.get(parts[k - 1] + parts[k])) else -np.inf
            if k < len(ranks):
                ranks[k] = got[0] if (got := score.get(parts[k] + parts[k + 1])) else -np.inf
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """In a merge model: can a piece come right after another (-1: at the start)?  Both by their codes: the id, or
        beyond all ids a character that is no piece."""
        n = len(self.pieces)
        text = lambda k: "" if k < 0 else chr(k - n) if k >= n else self.pieces[k]
        parts = [text(before), text(piece)] if before >= 0 else [text(piece)]
        got = self.merge("".join(parts)) == parts
        if len(self.neighbours) < PAIRS_KEPT:
            self.neighbours[before << 32 | piece] = got
        return got

    def stream(self, chars: Iterator[str] | str) -> Iterator[list[int]]:
        """Ids of prepared characters, committed as soon as they are final."""
        longest, root, merges, neighbours, n = self.longest, self.trie, self.merges, self.neighbours, len(self.pieces)
        base, end = 0, 0  # positions of the window's start and of what was read
        best: list[float] = [0.0]  # of positions base, base + 1, ...
        back: list[int] = [0]  # where the last piece of the best path there starts
        last: list[int] = [-1]  # and its code
        growing: list[tuple[int, dict]] = []  # starts from which a piece can still grow, and where it stands in the trie
        unknown_before = False
        for c in chars:
            growing.append((end, root))
            end += 1
            top, at, code, more, single = None, end - 1, n + ord(c), [], False
            for start, node in growing:
                node = node.get(c)
                if node is None:
                    continue
                more.append((start, node))
                value = node.get("")
                if value is None:
                    continue  # only the start of a piece
                single = start == end - 1
                if merges:
                    if top is None:  # there is only one
                        before = last[start - base]
                        fits = neighbours.get(before << 32 | value[1])
                        if fits or (fits is None and self.follows(before, value[1])):
                            top, at, code = 0.0, start, value[1]
                else:
                    total = best[start - base] + value[0]
                    if top is None or total > top:
                        top, at, code = total, start, value[1]
            growing = more
            if not merges:
                if not single and (top is None or best[-1] + self.unknown_score > top):
                    top, at, code = best[-1] + self.unknown_score, end - 1, n + ord(c)
                best.append(top)
            back.append(at)
            last.append(code)
            if end - base >= longest or not single or c == MARK:
                common = self._meet([end, *(s for s, _ in growing)], back, base)
                if common > base:
                    ids, unknown_before = self._ids(common, back, last, base, unknown_before)
                    yield ids
                    drop = common - base
                    best, back, last, base = [b - best[drop] for b in best[drop:]], back[drop:], last[drop:], common
                self.longest_open = max(self.longest_open, end - base)
        if end > base:
            yield self._ids(end, back, last, base, unknown_before)[0]

    @staticmethod
    def _meet(alive: list[int], back: list[int], base: int) -> int:
        """The last boundary on the paths of all given positions."""
        at = set(alive)
        while len(at) > 1:
            latest = max(at)
            at.discard(latest)
            at.add(back[latest - base])
        return at.pop()

    def _ids(self, end: int, back: list[int], last: list[int], base: int, unknown_before: bool) -> tuple[list[int], bool]:
        """(the ids of the path to ``end``, whether they end in an unknown character)."""
        self.commits += 1
        codes, n = [], len(self.pieces)
        while end > base:
            codes.append(last[end - base])
            end = back[end - base]
        out: list[int] = []
        for code in reversed(codes):
            if code < n:
                out.append(code)
            elif self.has_bytes:
                out += [self.byte_id[b] for b in chr(code - n).encode()]
            elif not (self.merges and unknown_before):  # the library makes a run of unknown characters one id
                out.append(self.unknown)
            unknown_before = code >= n
        return out, unknown_before

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        prepared = self.prepared(text)
        if self.by_word and self.has_bytes:
            return b"".join(map(self.words.__getitem__, _WORD.findall(prepared)))
        return b"".join(struct.pack(f"<{len(ids)}I", *ids) for ids in self.stream(prepared))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and runs of byte pieces, marks as spaces, without the one in front."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                texts = batch.column(1).slice(lo, ROWS).to_pylist()
                packed = [b"" if t is None else v.packed(t) for t in texts]
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype("i4")
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, ROWS), ids], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vocabulary(path)
            texts = [None if i is None else v.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip) per row: ids and decoded text as digests, so neither has to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, crc, sha, same = [], [], [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                ids = v.packed(t)
                back = v.decode(np.frombuffer(ids, "<u4").tolist())
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
