"""Merkle manifest of a dataset by time-forward processing, with a proof for every document.

A document's leaf is the SHA-256 of its columns.  The leaves of a group, by id, are hashed three at a time, level by level, to the
group's root; the groups' roots, by group, to the root of the dataset.

Time-forward processing: nodes are numbered so that a parent comes after its children (level, then place), and are processed
in that order.  A node sends its digest to its parent through a priority queue ordered by the receiver's number, so that a parent
finds its children's digests at the head of the queue.  The queue is external: a task holds the part for one block
of the tree (``height`` levels, 3**height leaves); what goes beyond the block is a row, and Spark's shuffle and sort bring it, by
(tree, block, place), to the task that needs it.  Then the order is reversed: every node sends to its children the digests beside them on top of
those it got itself, from the root down to the leaves, again through the queue; that is a leaf's proof.

A group may hold any share of the rows: places come from sorted ranges (``common.ranked``), and a group is as many blocks as it needs.

Nulls in any column are hashed as ``-``, so they differ from empty texts; null ids come first in a group, null groups first among groups.
Repeated rows are leaves of their own; rows of one id are ordered by their leaf.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, sized_join, stored

#: Children of a node; levels of the tree that one task works through at a time.
ARITY, HEIGHT = 3, 6
#: Columns that a leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a task sends on at once.
ROWS = 2000

#: Nodes of one level, to be hashed or to be given a proof.  ``tree``: the group's key; ``n``: nodes of the tree on this level;
#: id, name and other are carried from the leaves to their proofs.
_NODE = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("name", pa.string()), ("other", pa.binary())])
_NODE_SQL = "tree string, pos long, n long, digest binary, id long, name string, other binary"


def field(c: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and the value; a null as ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, columns: Sequence[str] = COLUMNS, **instead: Column) -> Column:
    """A row's leaf; ``instead``: values to hash in place of a column's."""
    return F.unhex(F.sha2(F.concat(*[field(instead.get(c, docs[c])) for c in columns]), 256))


def above(digests: list[bytes]) -> bytes:
    """The digest of a node from those of its children (as hex text)."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def upward(leaves: list[bytes], height: int) -> tuple[bytes, dict[tuple[int, int], list[bytes]]]:
    """(digest of the block's top, digests that each node has received from its children)."""
    if not height:
        return leaves[0], {}
    received: dict[tuple[int, int], list[bytes]] = {}
    queue = [((1, p // ARITY), p, d) for p, d in enumerate(leaves)]  # by receiver: a heap already
    digest = b""
    while queue:
        node = queue[0][0]
        got = []
        while queue and queue[0][0] == node:
            got.append(heapq.heappop(queue)[2])
        received[node], digest = got, above(got)
        level, place = node
        if level < height:
            heapq.heappush(queue, ((level + 1, place // ARITY), place, digest))
    return digest, received


def beside(left: list[bytes], right: list[bytes]) -> bytes:
    """One level of a proof: how many digests stand left and right of the path, and the digests."""
    return bytes((len(left), len(right))) + b"".join(left) + b"".join(right)


def downward(received: dict[tuple[int, int], list[bytes]], height: int, proof: bytes) -> list[bytes]:
    """The proofs of a block's leaves, given that of its top: nodes in reverse order, what they send ordered by receiver."""
    if not height:
        return [proof]
    out: dict[int, bytes] = {}
    queue = [((-height, 0), proof)]
    while queue:
        (level, place), proof = heapq.heappop(queue)
        got = received[-level, -place]
        for k in range(len(got)):
            mine = beside(got[:k], got[k + 1 :]) + proof
            if level == -1:
                out[k - place * ARITY] = mine
            else:
                heapq.heappush(queue, ((level + 1, place * ARITY - k), mine))
    return [out[k] for k in range(len(out))]


def steps(proof: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(digests left, digests right) of each level of a proof, from the leaf on."""
    at = 0
    while at < len(proof):
        left, both = proof[at], proof[at] + proof[at + 1]
        digests = [proof[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(both)]
        yield digests[:left], digests[left:]
        at += 2 + 32 * both


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for left, right in steps(proof):
        digest = above([*left, digest, *right])
    return digest


# ---- sweeps over all blocks ------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], names: Sequence[str], block: int) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """((tree, block), its rows) of rows sorted so."""
    rows = (dict(zip(names, r, strict=True)) for b in batches for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
    for key, own in groupby(rows, key=lambda r: (r["tree"], r["pos"] // block if r["pos"] >= 0 else r["n"])):
        yield key, list(own)


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _up(height: int):
    """A block's nodes → one node of the level above the block."""
    block = ARITY**height

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, place), own in _blocks(batches, ("tree", "pos", "n", "digest"), block):
            n = own[0]["n"]
            top, _ = upward([r["digest"] for r in own], height if n > block else levels(n))
            yield tree, place, -(-n // block), top, None, None, None

    return lambda batches: _sent(rows(batches), _NODE)


_PROOF = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), ("name", pa.string()), ("other", pa.binary()), ("top", pa.binary()), ("proof", pa.binary())])
_PROOF_SQL = "tree string, pos long, digest binary, id long, name string, other binary, top binary, proof binary"


def _down(height: int):
    """A block's nodes, after the proof of its top (pos -1, n: the block), → their own proofs."""
    block = ARITY**height

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (tree, _), own in _blocks(batches, ("tree", "pos", "n", "digest", "id", "name", "other"), block):
            message, nodes = own[0], own[1:]
            n = nodes[0]["n"]
            high = height if n > block else levels(n)
            _, received = upward([r["digest"] for r in nodes], high)
            for r, proof in zip(nodes, downward(received, high, message["digest"]), strict=True):
                yield tree, r["pos"], r["digest"], r["id"], r["name"], r["other"], message["other"], proof

    return lambda batches: _sent(rows(batches), _PROOF)


def _dealt(rows: DataFrame, height: int) -> DataFrame:
    """Rows by block, in order; the message to a block, if any, comes first."""
    block = F.when(F.col("pos") < 0, F.col("n")).otherwise(F.floor(F.col("pos") / ARITY**height))
    return rows.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").drop("block")


def climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """([nodes of every level at which a block ends], (tree, digest, depth) of each tree: its root and the level where it is one block)."""
    done = [nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("depth"))]
    open_, every = nodes.where("n > 1"), [nodes]
    while not open_.isEmpty():
        up = stored(_dealt(open_, height).mapInArrow(_up(height), _NODE_SQL), "nodes")
        done.append(up.where("n = 1").select("tree", "digest", F.lit(len(every) - 1).alias("depth")))
        open_ = up.where("n > 1")
        every.append(open_)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return every[: len(done) - 1] or every, stored(out, "roots")


def descend(every: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """(tree, pos, digest, id, name, other, top, proof) of the lowest level.  tops: (tree, depth, top, proof) for every tree; top is passed on."""
    message = lambda pos, digest: [F.lit(-1).cast("long").alias("pos"), F.col(pos).alias("n"), F.col(digest).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("top").alias("other")]
    sent = None
    for depth in reversed(range(len(every))):
        first = tops.where(F.col("depth") == depth).withColumn("block", F.lit(0).cast("long")).select("tree", *message("block", "proof"))
        first = first if sent is None else first.unionByName(sent)
        given = _dealt(every[depth].unionByName(first), height).mapInArrow(_down(height), _PROOF_SQL)
        if not depth:
            return given
        sent = stored(given.select("tree", *message("pos", "proof")), "proofs")
    raise AssertionError("no level")


def _placed(rows: DataFrame, *by: Column) -> DataFrame:
    """Nodes of the lowest level, from rows (tree, digest, id, name, other): their place in their tree and its size."""
    every = ranked(rows, F.asc("tree"), *by)
    trees = stored(every.groupBy("tree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    out = sized_join(every, trees, "tree", "inner", 40, "tree")
    return stored(out.select("tree", (F.col("rank") - F.col("first")).alias("pos"), "n", "digest", "id", "name", "other"), "leaves")


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "source", columns: Sequence[str] = COLUMNS, other: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof, other) for every row, digests and proof as bytes; ``steps`` reads a proof, ``fold`` follows it.
    ``other``: a digest of the row that is carried along; ``height``: levels of a block."""
    tree = F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit(""))
    nothing = F.lit(None).cast("string")
    leaves = docs.select(tree.alias("tree"), leaf(docs, columns).alias("digest"), F.col(id_col).cast("long").alias("id"), nothing.alias("name"), (F.lit(None).cast("binary") if other is None else other).alias("other"))
    own, subroots = climb(_placed(stored(leaves, "digests"), F.asc("id"), F.asc("digest"), F.asc("other")), height)

    none = F.lit(None)
    groups = subroots.select(F.lit("").alias("tree"), "digest", none.cast("long").alias("id"), F.col("tree").alias("name"), none.cast("binary").alias("other"))
    roots, root = climb(_placed(groups, F.asc("name")), height)
    top = root.select("tree", "depth", F.col("digest").alias("top"), F.lit(b"").alias("proof"))
    proofs = stored(descend(roots, top, height).select(F.col("name").alias("tree"), F.concat("top", "digest").alias("top"), "proof"), "group-proofs")
    tops = stored(sized_join(proofs, subroots.select("tree", "depth"), "tree", "inner", 24, "tree"), "tops")
    out = descend(own, tops, height)
    return out.select("id", F.col("digest").alias("leaf"), F.substring("top", 33, 32).alias("subroot"), F.substring("top", 1, 32).alias("root"), "proof", "other")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proof's digests hashed, and the root that the digest in the first column leads to, in place of digest and proof."""
    for batch in batches:
        said, roots = [], []
        for digest, proof in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            said.append(sha256("".join([d.hex() for d in chain.from_iterable(chain.from_iterable(steps(proof)))]).encode()).hexdigest())
            roots.append(fold(digest, proof).hex())
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(said, pa.string()), pa.array(roots, pa.string())], names=[*batch.schema.names[2:], "proof_sha256", "folded_root"])


def verify(rows: DataFrame, digest: str) -> DataFrame:
    """A manifest's rows with their digests as hex text, ``proof_sha256`` (of the proof's digests), ``folded_root`` (from ``digest``, a column, and
    the proof) and ``verified``: whether that is the root."""
    text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    out = rows.select(F.col(digest).alias("digest"), "proof", "id", *text).mapInArrow(_folded, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
