"""Near-duplicate vectors by PCA-ordered tiled comparison: exact links of cosine >= threshold.

The second moments of all vectors (summed by Spark) give a rotation whose first coordinates carry most of the
length.  Vectors are ordered by the first coordinate and cut into groups; two groups are compared only if their
intervals lie close enough for a pair to reach the threshold.  Each group travels once to each comparison it takes part in,
so there are as few groups as keep all cores busy and as GROUP_BYTES allows; components travel in the width they were given in.  In a pair of groups the products are
accumulated over the LEAD first coordinates, with the product of the suffix norms as a bound on the rest, then over
further coordinates for the pairs that can still reach the threshold, and at last in double precision on the given vectors.

No pairs are emitted: a comparison returns, per vector, how many it links to and the root of a local spanning
forest, which keeps every connection.  Equal vectors are one class beforehand, however many.

Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different
length link with nothing of another length.  A null id takes no part and gets a null component.  Repeated rows count as vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, stored

#: Vectors that a group need not go below, bytes of its vectors in double precision that it doesn't go beyond (but for GROUP vectors),
#: products of a tile, coordinates accumulated before the first bound.
GROUP, GROUP_BYTES, TILE, LEAD = 4096, 8 << 20, 1 << 22, 20
#: Slack of the single-precision bounds.
SLACK = 1e-4


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two to components of at most one: products neither overflow nor vanish, and cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            u = _unit(_matrix(batch.column(0), dim))
            total += u.T @ u
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    return run


def _jitter(ids: np.ndarray) -> np.ndarray:
    """A tiny number per id, so that many vectors of equal first coordinate still spread over groups."""
    return ((ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("f8") * 1e-16


def _place(dim: int, axis: np.ndarray, bounds: np.ndarray | None):
    """First coordinate of each vector, or the group it falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            y = _unit(_matrix(batch.column(2), dim)) @ axis + _jitter(ids)
            if bounds is None:
                yield pa.RecordBatch.from_arrays([pa.array(y)], names=["y"])
            else:
                group = np.searchsorted(bounds, y, "right")
                yield pa.RecordBatch.from_arrays([pa.array(group.astype("i8")), *batch.columns], names=["g", "rep", "m", "vec"])

    return run


def group_count(n: int, dim: int, cores: int) -> int:
    """Groups of ``n`` vectors: the pairs of groups occupy ``cores`` twice unless groups would fall below GROUP, within GROUP_BYTES a group."""
    most = max(GROUP, GROUP_BYTES // (8 * max(1, dim)))
    return max(1, -(-n // most), min(-(-n // GROUP), math.isqrt(4 * cores)))


def _blob(dim: int, edges: np.ndarray, reach: float, width: str):
    """A group as one row, with the range of groups it has to be compared with."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        lo = np.searchsorted(edges[1:], edges[g] - reach)
        hi = np.searchsorted(edges[:-1], edges[g + 1] + reach, "right") - 1
        x = _matrix(table.column("vec"), dim)
        return pa.table({"g": [g], "lo": [int(min(lo, g))], "hi": [int(max(hi, g))], "ids": [table.column("rep").to_numpy().astype("i8").tobytes()], "ms": [table.column("m").to_numpy().astype("i8").tobytes()], "vecs": [np.ascontiguousarray(x, width).tobytes()]})

    return run


def _candidates(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """(i, j) of linked pairs, tile by tile.  a, b: rotated, single precision; x, y: the given vectors."""
    dim = a.shape[1]
    lead = min(LEAD, dim)
    with_rest = lambda v: np.concatenate((v[:, :lead], np.sqrt((v[:, lead:] ** 2).sum(axis=1, keepdims=True))), axis=1)
    la, lb = with_rest(a), with_rest(b)
    need = threshold - SLACK
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    tile = max(1, TILE // max(1, len(b)))
    for i0 in range(0, len(a), tile):
        start = i0 if same else 0
        hit = np.flatnonzero((la[i0 : i0 + tile] @ lb[start:].T).ravel() >= need)
        i, j = np.divmod(hit, len(b) - start)
        i, j = i + i0, j + start
        if same:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            at, sofar = lead, (a[p, :lead] * b[q, :lead]).sum(axis=1)
            while at < dim and len(p):  # on to further coordinates, for pairs that can still reach it
                to = min(dim, 2 * at)
                sofar = sofar + (a[p, at:to] * b[q, at:to]).sum(axis=1)
                rest = np.sqrt((a[p, to:] ** 2).sum(axis=1) * (b[q, to:] ** 2).sum(axis=1))
                keep = sofar + rest >= need
                p, q, sofar, at = p[keep], q[keep], sofar[keep], to
            keep = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
            yield p[keep], q[keep]


def _compare(dim: int, rotation: np.ndarray, threshold: float, width: str):
    def run(table: pa.Table) -> pa.Table:
        parts = []
        same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        if not same and table.num_rows < 2:  # a group beside an empty one
            return pa.table({"id": pa.array([], "i8"), "links": pa.array([], "i8"), "root": pa.array([], "i8")})
        for row in sorted(table.to_pylist(), key=lambda r: r["g"]):
            x = _scaled(np.frombuffer(row["vecs"], width).reshape(-1, dim).astype("f8"))
            parts.append((np.frombuffer(row["ids"], "i8"), np.frombuffer(row["ms"], "i8"), x, (_unit(x) @ rotation).astype("f4")))
        (ia, ma, xa, ya), (ib, mb, xb, yb) = parts[0], parts[-1]
        shift = 0 if same else len(ia)
        ids = ia if same else np.concatenate((ia, ib))
        links, root = np.zeros(len(ids), "i8"), np.arange(len(ids))
        for p, q in _candidates(ya, yb, xa, xb, threshold, same):
            np.add.at(links, p, mb[q])
            np.add.at(links, q + shift, ma[p])
            q = q + shift
            while True:  # local components: the smaller root wins until both ends agree
                rp, rq = root[p], root[q]
                differ = rp != rq
                if not differ.any():
                    break
                p, q, low = p[differ], q[differ], np.minimum(rp, rq)[differ]
                np.minimum.at(root, rp[differ], low)
                np.minimum.at(root, rq[differ], low)
                while (root[root] != root).any():
                    root = root[root]
        got = np.flatnonzero(links)
        return pa.table({"id": ids[got], "links": links[got], "root": ids[root[got]]})

    return run


def _links(classes: DataFrame, dim: int, threshold: float, width: str) -> DataFrame:
    """(id, links, root) rows of all comparisons among class representatives of one length; ``width``: type in which components travel."""
    rows = classes.where(F.size("vec") == dim).select("rep", "m", "vec")
    sums = rows.select("vec").mapInArrow(_moments(dim), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dim * dim numbers
    moment = np.zeros((dim, dim))
    for r in sums:
        moment[r["i"], r["j"]] = r["v"]
    rotation = np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()
    groups = group_count(rows.count(), dim, rows.sparkSession.sparkContext.defaultParallelism)
    bounds = np.zeros(0)
    if groups > 1:
        y = rows.mapInArrow(_place(dim, rotation[:, 0], None), "y double")
        at = [k / groups for k in range(1, groups)]
        bounds = np.array(y.agg(F.percentile_approx("y", F.array(*[F.lit(v) for v in at]), 20 * groups).alias("q")).first()["q"])
    edges = np.concatenate(([-np.inf], bounds, [np.inf]))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    placed = rows.mapInArrow(_place(dim, rotation[:, 0], bounds), "g long, rep long, m long, vec array<double>")
    blobs = stored(placed.groupBy("g").applyInArrow(_blob(dim, edges, reach, width), "g long, lo long, hi long, ids binary, ms binary, vecs binary"), "groups")
    dealt = blobs.select("*", F.explode(F.sequence("lo", "hi")).alias("p")).select(F.least("g", "p").alias("a"), F.greatest("g", "p").alias("b"), "g", "ids", "ms", "vecs")
    return stored(dealt.groupBy("a", "b").applyInArrow(_compare(dim, rotation, threshold, width), "id long, links long, root long"), "vector-links")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    width = "f4" if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else "f8"
    vec = F.col(vec_col).cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine & F.col(id_col).isNotNull(), vec).alias("vec"))
    classes = stored(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    found = None
    for row in classes.select(F.size("vec").alias("dim")).distinct().collect():  # the lengths that occur, commonly one
        got = _links(classes, row["dim"], threshold, width)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, root long")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id").join(comp, F.col("rep") == comp["id"], "left")
    known = stored(known.select("vec", "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    out = rows.join(known, "vec", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
