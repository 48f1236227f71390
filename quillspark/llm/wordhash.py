"""Words of many texts at once as 128-bit hashes: the inner loop of the n-gram and substring operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these separators are ASCII, so UTF-8 texts can be cut
bytewise.  A word's hash is the 128-bit XXH3 of its bytes, taken as two 64-bit lanes; a run of words has a polynomial of
its words' hashes in each lane, so different runs share both lanes with a chance of about 2**-118 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

#: Bytes of text a worker hashes at once (one longer text is taken alone), and bytes of it split into words at once.
RUN_BYTES, SLICE_BYTES = 2 << 20, 512 << 10
#: Bytes that a group of one hash range should hold, and tasks that an exchange has at most.
GROUP_BYTES, MOST_TASKS = 16 << 20, 1 << 15
_Q = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (in place where possible)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def parts(text: bytes) -> Iterator[bytes]:
    """A text in runs of about SLICE_BYTES, cut at white space."""
    at = 0
    while at < len(text):
        if len(text) - at <= SLICE_BYTES:
            end = len(text)
        else:
            m = _SPACE.search(text, at + SLICE_BYTES)
            end = m.start() if m else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first lane, second lane of each word of all texts in order, word counts per text)."""
    got, counts = [], np.zeros(len(texts), "i8")
    for i, text in enumerate(texts.cast(pa.large_string()).cast(pa.large_binary())):
        for part in parts(text.as_py() or b""):
            words = (part.lower() if lower else part).split()
            counts[i] += len(words)
            got.append(b"".join(map(xxh3_128_digest, words)))
    h = np.frombuffer(b"".join(got), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), counts


def grams(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """One lane's hash of every k consecutive words, also across texts: the caller keeps those inside one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(_Q[lane])
        h += words[j : j + n]
    h ^= np.uint64(k)
    return mix(h)


def order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order that sorts the 128-bit values (a, b): that of a, unless two values share a alone."""
    by = np.argsort(a, kind="stable")
    x, y = a[by], b[by]
    return np.lexsort((b, a)) if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any() else by


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Of sorted columns: where a new combination of values starts."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def edges(new: np.ndarray) -> np.ndarray:
    """Where the runs marked by ``firsts`` start, and where the last ends."""
    return np.append(np.flatnonzero(new), len(new))


def runs(batches: Iterator[pa.RecordBatch], column: int, size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into shorter ones of at most ``size`` bytes of text, or one row: what a worker holds at once."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype="i8")
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, "right"))
            hi = max(lo + 1, hi)
            yield batch.slice(lo, hi - lo)
            lo = hi


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """An integer array byte plane by byte plane, which the shuffle's codec packs well for ids; of its low ``width`` bytes."""
    return np.ascontiguousarray(a.view("u1").reshape(len(a), -1)[:, :width].T).tobytes()


def unplane(b: bytes, kind: str, width: int | None = None) -> np.ndarray:
    whole = np.dtype(kind).itemsize
    got = np.frombuffer(b, "u1").reshape(width or whole, -1).T
    if width and width < whole:
        got = np.concatenate((got, np.zeros((len(got), whole - width), "u1")), axis=1)
    return np.ascontiguousarray(got).reshape(-1).view(kind)


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray], width: dict[str, int] | None = None) -> pa.RecordBatch | None:
    """One row per bucket: (bucket, a blob for each column); ``width``: columns of which only low bytes are sent."""
    if not len(bucket):
        return None
    by = np.argsort(bucket, kind="stable")
    got = bucket[by]
    edge = edges(firsts(got))
    out = {"bucket": pa.array(got[edge[:-1]].astype("i8"))}
    for name, a in columns.items():
        a, w = a[by], (width or {}).get(name)
        out[name] = pa.array([planes(a[s:e], w) for s, e in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def gathered(table: pa.Table, name: str, kind: str, width: int | None = None) -> np.ndarray:
    """The blobs of a column put together again."""
    got = [unplane(b, kind, width) for b in table.column(name).to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, kind)


def blobs(names: list[str]) -> tuple[pa.Schema, str]:
    """The schema of rows (bucket, a blob per name), for Arrow and for Spark."""
    return pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in names)]), ", ".join(["bucket long", *(f"{n} binary" for n in names)])


def table(got: pa.RecordBatch | None, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([] if got is None else [got.select(schema.names)], schema=schema)


def fragment(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n contiguous ranges of the 64-bit order a hash lies in."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")


def dealt(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n groups a row number belongs to."""
    return (mix(h.astype("u8")) % np.uint64(n)).astype("i8")


def ranges(df: DataFrame, size: int) -> int:
    """How many hash ranges keep a group of ``size`` measured bytes in all near GROUP_BYTES; no fewer than tasks of a shuffle."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // GROUP_BYTES))


def by_bucket(df: DataFrame, n: int):
    """Rows grouped by bucket, in as many tasks as there are groups where the session's own number is less."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df if n <= usual else df.repartition(min(n, max(usual, MOST_TASKS)), "bucket")
    return spread.groupBy("bucket")


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, measured."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
