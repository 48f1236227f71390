"""The vector table: filtered similarity search, upserts and payload changes, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scalars import content_to_embed, cosine

#: Queries and entries that one task compares.
QUERY_BLOCK, ENTRY_BLOCK = 1024, 8192
POINT_SCHEMA = (
    "id string, type string, embedding_type string, status string, filename string, source string, speaker string, "
    "asset_path string, version_id string, branch string, text string, summary string, vec array<float>"
)


def request(query_text: str, embedding_type: str = "text", limit: int = 5, **options) -> dict:
    """A validated search request."""
    if not query_text:
        raise ValueError("query_text must not be empty")
    if embedding_type not in ("summary", "text"):
        raise ValueError("embedding_type must be summary or text")
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie in 1..100")
    return {"query_text": query_text, "embedding_type": embedding_type, "limit": limit, **options}


def metadata_filter(embedding_type: str, kind: str | None = None, filename: str | Sequence[str] | None = None, source: str | None = None, speaker: str | Sequence[str] | None = None) -> Column:
    """Active points of an embedding type, and whatever else is asked for; a speaker counts for text only."""
    parts = [F.col("status") == "active", F.col("embedding_type") == embedding_type]
    one = lambda c, v: F.col(c) == v if isinstance(v, str) else F.col(c).isin(*v)
    if kind:
        parts.append(F.col("type") == kind)
    if filename:
        parts.append(one("filename", filename))
    if source:
        parts.append(F.col("source") == source)
    if speaker and embedding_type == "text":
        parts.append(one("speaker", speaker))
    return reduce(lambda a, b: a & b, parts)


def top_k(points: DataFrame, query: Sequence[float] | Column, k: int = 5, condition: Column | None = None, vec: str = "vec", key: str = "id") -> DataFrame:
    """The k points nearest to the query by cosine, best first, with score and without vectors.  The filter reaches the
    scan; each task keeps k rows (TakeOrderedAndProject)."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    rows = points if condition is None else points.where(condition)
    scored = rows.withColumn("score", cosine(F.col(vec), q)).where("score is not null").drop(vec)
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest(entries: DataFrame, queries: DataFrame, threshold: float, key: str = "key", vec: str = "vec", query_key: str = "query", scope: str | None = None, skip_same: bool = False) -> DataFrame:
    """(query, key, score): for each query row (query, qvec) the nearest entry, if its cosine reaches the threshold; of equal
    ones the larger key.  With ``scope`` only entries of the query's scope count, with ``skip_same`` none of its own key.

    Queries and entries are dealt into blocks; a pair of blocks is one task that returns a row per query, so neither side is
    broadcast and no pair becomes a row."""
    q, e = _blocks(entries, queries, key, vec, query_key, [], [], scope)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lv, rv = unit_rows(left.column("v")), unit_rows(right.column("v"))
        order = pc.sort_indices(right.column(key)).to_numpy()  # of equal scores the larger key
        scores = lv @ rv[order].T if len(lv) and len(rv) and lv.shape[1] == rv.shape[1] else np.full((len(lv), len(rv)), np.nan)
        if skip_same:
            names = pa.chunked_array([*left.column(query_key).chunks, *right.column(key).cast(left.column(query_key).type).chunks])
            codes = names.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            scores[codes[: len(lv), None] == codes[len(lv) :][order][None, :]] = np.nan
        scores[~(scores >= threshold)] = -np.inf
        best = scores.shape[1] - 1 - scores[:, ::-1].argmax(axis=1) if scores.shape[1] else np.zeros(len(lv), "i8")
        top = scores[np.arange(len(lv)), best] if scores.shape[1] else np.full(len(lv), -np.inf)
        hit = np.flatnonzero(top > -np.inf)
        return pa.table({query_key: left.column(query_key).take(pa.array(hit)), key: right.column(key).take(pa.array(order[best[hit]])), "score": pa.array(top[hit], pa.float64())})

    kinds = dict(queries.dtypes)[query_key], dict(entries.dtypes)[key]
    found = q.groupBy("s", "b", "p").cogroup(e.groupBy("s", "b", "p")).applyInArrow(run, f"{query_key} {kinds[0]}, {key} {kinds[1]}, score double")
    best = found.groupBy(query_key).agg(F.max(F.struct("score", F.col(key).alias("k"))).alias("b"))
    return best.select(query_key, F.col("b.k").alias(key), F.col("b.score").alias("score"))


def nearest_k(entries: DataFrame, queries: DataFrame, k: int, key: str = "id", vec: str = "vec", query_key: str = "query", keep: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(query, key, kept columns, score): for each query row (query, qvec) its k nearest entries by cosine, rounded to ``digits`` so
    that copies of a vector tie; of equal ones the smaller keys.  Blocks against blocks as in ``nearest``: a task returns at most k
    rows per query."""
    q, e = _blocks(entries, queries, key, vec, query_key, keep, ())
    kinds = dict(entries.dtypes)
    fields = ", ".join([f"{query_key} {dict(queries.dtypes)[query_key]}", *(f"{c} {kinds[c]}" for c in (key, *keep)), "score double"])
    found = q.groupBy("s", "b", "p").cogroup(e.groupBy("s", "b", "p")).applyInArrow(best_of_blocks(k, key, query_key, keep, digits), fields)
    return best_of(found, k, query_key, key)


def best_of_blocks(k: int, key: str, query_key: str, keep: Sequence[str], digits: int):
    """Queries and entries of one task (vectors in v) → the k best entries of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lv, rv = unit_rows(left.column("v")), unit_rows(right.column("v"))
        order = pc.sort_indices(right.column(key)).to_numpy()
        at, to, top = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]
        if len(lv) and len(rv) and lv.shape[1] == rv.shape[1]:
            scores = np.round(lv @ rv[order].T, digits)
            scores[np.isnan(scores)] = -np.inf
            n = min(k, scores.shape[1])
            least = np.partition(scores, -n, axis=1)[:, -n]
            for i, row in enumerate(scores):
                found = np.flatnonzero((row >= least[i]) & (row > -np.inf))
                found = found[np.argsort(-row[found], kind="stable")][:k]
                at.append(np.full(len(found), i))
                to.append(order[found])
                top.append(row[found])
        a, b = pa.array(np.concatenate(at)), pa.array(np.concatenate(to).astype("i8"))
        return pa.table({query_key: left.column(query_key).take(a), **{c: right.column(c).take(b) for c in (key, *keep)}, "score": pa.array(np.concatenate(top))})

    return run


def best_of(found: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """Of the rows of each query the k of highest score, ties to the smaller key."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _blocks(entries: DataFrame, queries: DataFrame, key: str, vec: str, query_key: str, keep: Sequence[str], keep_query: Sequence[str], scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and entries with their vectors as v, in every pair (s, b, p) of a block of queries and a block of entries of one scope s."""
    mark = F.lit("") if scope is None else F.coalesce(F.concat(F.lit("."), F.col(scope).cast("string")), F.lit(""))
    q = queries.select(query_key, F.col("qvec").cast("array<double>").alias("v"), *keep_query, mark.alias("s"))
    e = entries.select(key, F.col(vec).cast("array<double>").alias("v"), *keep, mark.alias("s"))
    size = lambda rows, n, per: rows.groupBy("s").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per)).cast("int").alias(n))
    both = size(q, "n_q", QUERY_BLOCK).join(size(e, "n_e", ENTRY_BLOCK), "s")  # a row per scope that both sides have
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(both, "s").select(query_key, "v", *keep_query, "s", block(query_key, "n_q").alias("b"), every("n_e").alias("p"))
    e = e.join(both, "s").select(key, "v", *keep, "s", block(key, "n_e").alias("p"), every("n_q").alias("b"))
    return q, e


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1; those that are null, zero or of another length than the first have no score.  Read from the flat
    buffer; scaled by powers of two first, so that products neither overflow nor vanish."""
    array = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    dim = int(next((n for n in sizes if n), 1))
    x = np.full((len(array), dim), np.nan)
    fine = sizes == dim
    x[fine] = array.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    top = np.abs(x).max(axis=1, keepdims=True)
    usable = np.isfinite(top) & (top > 0)
    x = np.ldexp(x, np.where(usable, -np.frexp(np.where(usable, top, 1.0))[1], 0))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full(x.shape, np.nan), where=usable)


def latest_by_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(points: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The table after a batch: of equal ids the batch's last row (column seq) counts; a batch row without type or
    content is left out; a missing id is made from the content, so the same chunk sent again replaces itself."""
    content = content_to_embed(F.col("embedding_type"), F.col("summary"), F.col("text"))
    new = batch.where((F.coalesce("type", F.lit("")) != "") & (content != "")).withColumn(key, F.coalesce(key, F.sha2(F.concat_ws("\x1f", "asset_path", "version_id", "type", "embedding_type", content), 256)))
    both = points.withColumn("seq", F.lit(-1).cast("long")).unionByName(new, allowMissingColumns=True)
    return latest_by_key(both, [key], F.desc("seq")).drop("seq")


def upsert_counts(batch: DataFrame) -> DataFrame:
    return batch.where(F.coalesce("type", F.lit("")) != "").groupBy("type").agg(F.count(F.lit(1)).alias("n_points"))


def set_payload(points: DataFrame, values: dict[str, str], asset_path: str, version_id: str, branch: str | None = None) -> DataFrame:
    """Payload fields changed on the points of an asset's version (and branch, if given)."""
    hit = (F.col("asset_path") == asset_path) & (F.col("version_id") == version_id)
    if branch is not None:
        hit &= F.col("branch") == branch
    return points.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete_points(points: DataFrame, kill: DataFrame, on: Sequence[str] = ("asset_path", "version_id")) -> DataFrame:
    return points.join(kill.select(*on).distinct(), list(on), "left_anti")


def update_or_insert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge: new values where there are any, else the old ones."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.alias("o"), new.alias("n")
    joined = a.join(b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in [*keys, *rest]])


def collection_stats(points: DataFrame, by: str) -> DataFrame:
    """Count per value; missing and empty values are left out."""
    return points.where(f"{by} is not null and {by} <> ''").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def distinct_sample(points: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(n_distinct, sample): distinct values counted, the first k in order.  The sample is a top-k over distinct values, so
    no task holds them all."""
    values = points.where(F.col(column).isNotNull()).select(column).distinct()
    sample = values.orderBy(column).limit(k).agg(F.array_sort(F.collect_list(column)).alias("sample"))
    return values.agg(F.count(F.lit(1)).alias("n_distinct")).join(sample, F.lit(True))


def collection_info(points: DataFrame, vec: str = "vec") -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.max(F.size(vec)).cast("long").alias("vector_size"), F.lit("cosine").alias("metric"))


def index_report(wanted: Sequence[str], existing: Sequence[str], columns: Sequence[str]) -> dict[str, list[str]]:
    """Keyword columns classified: statistics already kept, newly kept, or no such column."""
    return {"existing": [c for c in wanted if c in existing], "created": [c for c in wanted if c in columns and c not in existing], "errors": [c for c in wanted if c not in columns]}


def create_points(spark, table: str) -> None:
    """The table, partitioned by what every search filters on."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({POINT_SCHEMA}) USING parquet PARTITIONED BY (type, embedding_type)")
