"""Shards by extendible hashing, in DataFrame functions only.

Every row has a hash of its key and text, so a key of any number of rows still splits.  The directory is indexed by the leading bits of the hash; a bucket whose bytes
exceed the limit is split on its next bit, all others stay as they are, until every shard fits.  Rows that repeat both key and text have one hash; where
they alone exceed the limit, the bits go on with those of a number among them.

The bytes per prefix are counted once, on a prefix a few bits longer than an even spread needs; all splits
up to that depth are decided from those counts by aggregates.  Buckets that are still too large are counted
again on further bits, and only they.  A row above the limit by itself gets a shard of its own, marked
oversized.

Nulls in the key or text: hashed as such, a null text has 0 bytes.  Empty tables give no shard.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, sized_join, stored

#: Bits counted beyond those an even spread needs, and bits added when a bucket is still too large.
SPARE_BITS = 4
DEEPEST = 62
#: Depths summed at a time.
STRIDE = 4


def _levels(counts: DataFrame, low: int, high: int) -> DataFrame:
    """(depth, prefix, bytes, n_rows, least, most) at every depth from low to high, from rows (p, bytes, n_rows, least, most) at depth high.  A few
    depths are summed at a time and the next ones start from the shortest of them, so the work is a few times the counts."""
    out, top = None, high
    while True:
        floor = max(low, top - STRIDE + 1)
        spread = counts.select(F.explode(F.sequence(F.lit(floor), F.lit(top))).alias("depth"), "p", "bytes", "n_rows", "least", "most")
        sums = [F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.min("least").alias("least"), F.max("most").alias("most")]
        part = spread.groupBy("depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix")).agg(*sums)
        part = stored(part, "levels")
        out = part if out is None else out.unionByName(part)
        if floor == low:
            return out
        counts = part.where(F.col("depth") == floor).select(F.expr("shiftright(prefix, 1)").alias("p"), "bytes", "n_rows", "least", "most")
        top = floor - 1


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, n_rows, alike, oversized): the leaves of the directory for rows (h, bytes); alike: of one hash."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    low, high = 0, min(DEEPEST, max(1, math.ceil(math.log2(max(total, 1) / limit + 1)) + SPARE_BITS))
    leaves, left = None, rows
    while True:
        # bytes of the longest prefixes, then of every shorter one: a bucket is a leaf if it fits and its parent does not
        counts = left.groupBy(F.call_function("shiftright", F.col("h"), F.lit(DEEPEST - high)).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows"), F.min("h").alias("least"), F.max("h").alias("most"))
        levels = _levels(counts, low, high)
        parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("parent_bytes"))
        node = levels.withColumn("up", F.expr("shiftright(prefix, 1)")).join(parent, ["depth", "up"], "left")
        leaf = node.where(((F.col("bytes") <= limit) | (F.col("least") == F.col("most"))) & (F.col("parent_bytes").isNull() | (F.col("parent_bytes") > limit)))
        # rows of one hash above the limit are a leaf where they first stand alone
        up_rows = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), (F.col("least") < F.col("most")).alias("parent_splits"))
        leaf = leaf.join(up_rows, ["depth", "up"], "left").where((F.col("depth") == low) | F.col("parent_splits").isNull() | F.col("parent_splits"))
        leaf = leaf.select("depth", "prefix", "bytes", "n_rows", (F.col("least") == F.col("most")).alias("alike"), (F.col("bytes") > limit).alias("oversized"))
        leaf = stored(leaf, "leaves")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        open_ = levels.where((F.col("depth") == high) & (F.col("bytes") > limit) & (F.col("least") < F.col("most"))).select(F.col("prefix").alias("open"))
        if high == DEEPEST or open_.isEmpty():
            return leaves
        bits = high
        left = left.join(open_, F.call_function("shiftright", F.col("h"), F.lit(DEEPEST - bits)) == F.col("open"), "left_semi")
        low, high = high + 1, min(DEEPEST, high + SPARE_BITS)


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, shard_rows, oversized) for every row; shard is the bit string of the
    directory's prefix.  The directory has as many rows as shards; it is joined on depth and prefix, one depth
    that occurs at a time found by a join on the shortest prefix, so its size is free."""
    h = F.call_function("shiftright", F.xxhash64(F.col(key), F.col(text)), F.lit(2)) + F.lit(2**61)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), h.alias("h"))
    leaves = directory(rows.select("h", "bytes"), limit)
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # at most DEEPEST + 1 numbers
    spread = rows.select("*", F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(h, {DEEPEST} - depth)")
    )
    leaf = leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"), (F.col("alike") & F.col("oversized") & (F.col("n_rows") > 1)).alias("repeats"), "oversized")
    out = spread.join(leaf, ["depth", "prefix"]).select("key", "bytes", _bits("prefix", "depth").alias("shard"), "depth", "shard_bytes", "shard_rows", "oversized", "repeats")
    if leaves.where("alike and oversized and n_rows > 1").isEmpty():
        return out.drop("repeats")
    return out.where("not repeats").drop("repeats").unionByName(_numbered_apart(out.where("repeats").drop("repeats"), limit))


def _bits(value: str, width: str) -> Column:
    return F.when(F.col(width) == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(value).cast("string"), 10, 2), F.col(width), F.lit("0")))


def _numbered_apart(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets of equal rows split on the bits of a number among them, as often as their bytes need."""
    placed = ranked(rows, F.asc("shard"))
    first = stored(placed.groupBy("shard").agg(F.min("rank").alias("first")), "repeats")
    # of n rows, a bucket of k more bits holds ceil(n / 2**k) at most
    hold = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))
    more = F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(F.col("shard_rows") / hold)))).cast("int")
    numbered = sized_join(placed, first, "shard", "inner", 80).withColumn("more", more).withColumn("number", F.expr("(rank - first) % shiftleft(1L, more)"))
    held = F.expr("(shard_rows - number + shiftleft(1L, more) - 1) div shiftleft(1L, more)")
    out = numbered.withColumn("held", held)
    return out.select("key", "bytes", F.concat("shard", _bits("number", "more")).alias("shard"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("held") * F.col("bytes")).alias("shard_bytes"), F.col("held").alias("shard_rows"), (F.col("held") * F.col("bytes") > limit).alias("oversized"))
