"""Approximate similarity search by an inverted file: vectors are posted to the list of their nearest centroid, a query reads a few lists.

Centroids are fitted on at most SAMPLE vectors, those with the smallest hashes of their keys; every vector is posted.  ``vector.nearest_k`` is the
exact way beside it, and ``recall`` compares the two."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import ENTRY_BLOCK, QUERY_BLOCK, best_of, best_of_blocks, nearest_k, unit_rows

#: Vectors that the centroids are fitted on at most, rounds of fitting, lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 12, 4096
#: Vectors that ``tuned`` searches for.
TRIED = 500


@dataclass(frozen=True)
class Index:
    """Centroids, and the posted vectors: a table in shared storage with a folder per list, so that a search reads the lists it probes."""

    centroids: np.ndarray
    path: str
    key: str
    keep: tuple[str, ...]
    kinds: dict[str, str]
    size: int

    def posted(self, spark) -> DataFrame:
        fields = ", ".join([*(f"{c} {self.kinds[c]}" for c in (self.key, *self.keep)), "v array<double>", "list int"])
        return spark.read.schema(fields).parquet(self.path)


def fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors by cosine: spread-out first ones, then rounds of means."""
    lists = max(1, min(lists, len(x)))
    chosen = [0]
    nearest = x @ x[0]
    for _ in range(lists - 1):  # the vector that is least like any chosen one
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _nearest_lists(centroids: np.ndarray, names: Sequence[str], probes: int):
    """Rows → once for each of their ``probes`` nearest lists; those without a usable vector go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(pa.chunked_array([batch.column(batch.schema.names.index("v"))])) if batch.num_rows else np.zeros((0, centroids.shape[1]))
            fine = np.flatnonzero(~np.isnan(x).any(axis=1)) if x.shape[1] == centroids.shape[1] else np.zeros(0, "i8")
            scores = x[fine] @ centroids.T if len(fine) else np.zeros((0, len(centroids)))
            n = min(probes, len(centroids))
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(fine, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(best.reshape(-1).astype("i4"))], names=[*names, "list"])

    return run


def _few(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows with the smallest hashes of their keys.  Rows whose hash is far beyond theirs go before the sort, so that tasks
    don't send n rows each."""
    h = F.xxhash64(key)
    return rows.where(h <= min(2**63 - 1, 2**64 * 2 * n // max(1, total) - 2**63)).orderBy(h, key).limit(n)


def build(entries: DataFrame, key: str = "id", vec: str = "vec", keep: Sequence[str] = (), lists: int | None = None) -> Index:
    """The index of all entries with a usable vector; ``lists``: by default the root of their number."""
    from quillspark.streaming.flow import shared_folder

    rows = entries.select(key, *keep, F.col(vec).cast("array<double>").alias("v"))
    n = rows.count()
    lists = lists or max(1, min(MOST_LISTS, int(n**0.5)))
    sample = _few(rows.where("v is not null"), key, SAMPLE, n).select("v").toArrow()  # SAMPLE vectors
    x = unit_rows(sample.column("v")) if sample.num_rows else np.zeros((0, 1))
    x = x[~np.isnan(x).any(axis=1)]
    centroids = fitted(x, lists) if len(x) else np.zeros((1, 1))
    kinds = dict(rows.dtypes)
    names = [key, *keep, "v"]
    posted = rows.mapInArrow(_nearest_lists(centroids, names, 1), ", ".join([*(f"{c} {kinds[c]}" for c in names), "list int"]))
    path = f"{shared_folder(entries.sparkSession)}/index-{uuid.uuid4().hex}"
    posted.write.partitionBy("list").parquet(path)
    return Index(centroids, path, key, tuple(keep), kinds, n)


def search(index: Index, queries: DataFrame, k: int, probes: int, query_key: str = "query", digits: int = 9) -> DataFrame:
    """(query, key, kept columns, score): for each query row (query, qvec) the k best entries of its ``probes`` nearest lists.

    A list is joined with its queries in blocks on both sides, so a list of any share of the entries is many tasks."""
    rows = queries.select(query_key, F.col("qvec").cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)
    asked = rows.mapInArrow(_nearest_lists(index.centroids, [query_key, "v"], probes), f"{query_key} {kind[query_key]}, v array<double>, list int")
    posted = index.posted(queries.sparkSession)
    size = lambda df, n, per: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(n))
    both = F.broadcast(size(asked, "n_q", QUERY_BLOCK).join(size(posted, "n_e", ENTRY_BLOCK), "list"))  # a row per list, MOST_LISTS at most
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(both, "list").select(query_key, "v", "list", block(query_key, "n_q").alias("b"), every("n_e").alias("p"))
    e = posted.join(both, "list").select(index.key, *index.keep, "v", "list", block(index.key, "n_e").alias("p"), every("n_q").alias("b"))
    fields = ", ".join([f"{query_key} {kind[query_key]}", *(f"{c} {index.kinds[c]}" for c in (index.key, *index.keep)), "score double"])
    found = q.groupBy("list", "b", "p").cogroup(e.groupBy("list", "b", "p")).applyInArrow(best_of_blocks(k, index.key, query_key, index.keep, digits), fields)
    return best_of(found, k, query_key, index.key)


def tuned(index: Index, entries: DataFrame, k: int, target: float = 0.95, vec: str = "vec", among: DataFrame | None = None) -> int:
    """The least number of lists to probe that finds ``target`` of the k exact results of TRIED entries (those with the smallest hashes),
    taken from ``among`` if given."""
    key = index.key
    tried = _few((entries if among is None else among).where(F.col(vec).isNotNull()), key, TRIED, index.size).select(F.col(key).alias("query"), F.col(vec).alias("qvec"))
    exact = nearest_k(entries, tried, k, key, vec)
    lists = index.posted(entries.sparkSession).select(key, "list")
    rows = exact.join(lists, key).join(tried, "query").select("list", F.col("qvec").cast("array<double>").alias("v")).toArrow()  # TRIED * k rows
    if not rows.num_rows:
        return 1
    order = np.argsort(-(unit_rows(rows.column("v")) @ index.centroids.T), axis=1, kind="stable")
    need = np.sort((order == rows.column("list").to_numpy()[:, None]).argmax(axis=1) + 1)
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])


def recall(found: DataFrame, exact: DataFrame, query_key: str = "query", key: str = "id") -> DataFrame:
    """(query, recall): the share of each query's exact results that were found."""
    hit = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1.0).alias("hit")), [query_key, key], "left")
    return hit.groupBy(query_key).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
