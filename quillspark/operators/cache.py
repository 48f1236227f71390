"""Result caches as keyed tables: exact and by similarity, with life times and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import dynamic_ttl
from quillspark.operators.vector import latest_by_key, nearest


def alive(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def get_many(cache: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    return keys.join(alive(cache, now).select("key", "value"), "key", "left")


def put_many(cache: DataFrame, rows: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """The cache after new (key, value) rows; a new value replaces an old one."""
    new = rows.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds))).withColumn("_new", F.lit(1))
    return latest_by_key(cache.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True), ["key"], F.desc("_new")).drop("_new")


def read_through(cache: DataFrame, requests: DataFrame, now: Column, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers for all requests, newly computed rows): only keys without a live entry are computed, each once however often asked."""
    live = alive(cache, now).select("key", "value")
    missing = requests.join(live, "key", "left_anti").dropDuplicates(["key"])
    made = compute(missing).select("key", "value")
    return requests.join(live.unionByName(made), "key"), made


def semantic_or_exact(cache: DataFrame, queries: DataFrame, now: Column, threshold: float = 0.8, skip_same: bool = False) -> DataFrame:
    """(query, value, how): the nearest live entry of the same filter if similar enough, else the one of the exact key.  Queries:
    (query, key, scope, qvec), entries: (key, scope, vec, value); scope is the hash of filter and options, so equal vectors
    with different filters never answer each other."""
    live = alive(cache, now)
    near = nearest(live, queries.drop("key"), threshold, scope="scope", skip_same=skip_same).select("query", F.col("key").alias("hit"))
    out = queries.join(near, "query", "left").join(live.select("key", F.col("value").alias("exact")), "key", "left")
    out = out.join(live.select(F.col("key").alias("hit"), F.col("value").alias("similar")), "hit", "left")
    how = F.when(F.col("similar").isNotNull(), "similar").when(F.col("exact").isNotNull(), "exact").otherwise("miss")
    return out.select("query", F.coalesce("similar", "exact").alias("value"), how.alias("how"))


def nearest_key(entries: DataFrame, queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    return nearest(entries, queries, threshold)


def count_hits(hits: DataFrame, key: str = "key") -> DataFrame:
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


def extend_life(cache: DataFrame, hits: DataFrame, now: Column, ttl: int = 3600, growth: float = 0.01) -> DataFrame:
    """Entries that were hit live on from now, the longer the more hits they have."""
    rows = cache.join(count_hits(hits), "key", "left")
    life = F.make_dt_interval(secs=dynamic_ttl(F.lit(ttl), F.col("hits"), growth))
    return rows.withColumn("expires_at", F.when(F.col("hits") > 0, now + life).otherwise(F.col("expires_at"))).drop("hits")


def hit_statistics(accesses: DataFrame, group: str | None = None) -> DataFrame:
    """(hits, misses, hit_rate) of accesses with a boolean column hit."""
    hits, total = F.count_if("hit"), F.count(F.lit(1))
    aggs = [hits.alias("hits"), (total - hits).alias("misses"), (hits / F.greatest(total, F.lit(1))).alias("hit_rate")]
    return accesses.groupBy(group).agg(*aggs) if group else accesses.agg(*aggs)


def invalidate(cache: DataFrame, name: str) -> DataFrame:
    """Without the entries of one cache: keys that start with its name and a colon."""
    return cache.where(~F.startswith("key", F.lit(name + ":")))


def live_counters(counters: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return counters.join(alive(cache, now).select("key"), "key", "left_semi")


def lru_evictions(accesses: DataFrame, cache: str, capacity: int, max_bytes: int) -> DataFrame:
    """(cache, pos, key, hit, evicted): a trace of accesses (cache, pos, key, bytes) against a cache that evicts the least
    recently used entries while it holds too many or too large ones.  One task per cache, as the order decides."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for r in rows.sort_values("pos").itertuples(index=False):
            hit, gone = r.key in held, []
            size = held.pop(r.key, r.bytes)
            while held and (len(held) >= capacity or sum(held.values()) + size > max_bytes):
                old = next(iter(held))
                gone.append(old)
                del held[old]
            held[r.key] = size
            out.append((getattr(r, cache), r.pos, r.key, hit, ",".join(gone)))
        return pd.DataFrame(out, columns=[cache, "pos", "key", "hit", "evicted"])

    kind = dict(accesses.dtypes)
    return accesses.groupBy(cache).applyInPandas(run, f"{cache} {kind[cache]}, pos long, key string, hit boolean, evicted string")
