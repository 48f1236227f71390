"""Nested configurations as VARIANT values: every entry as a row, search, counts and validation per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import written


def entries(docs: DataFrame, key: str, config: str = "config") -> DataFrame:
    """(key, path, name, value, kind, section, depth, searched) of every entry of JSON documents, however deep: names of objects joined
    by dots, elements of lists with a null name.  ``searched``: reached through objects alone, as a search goes.

    Level by level: one explode of VARIANT values per level, only of those that hold something."""
    level = docs.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(config).cast("string")).alias("value"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("depth"), F.lit(True).alias("searched"))
    level = level.where("value is not null")
    out = None
    while True:
        dot = "concat_ws('.', nullif(t.path, ''), coalesce(e.key, concat('[', e.pos, ']')))"
        level = docs.sparkSession.sql(f"""
            SELECT t.`{key}`, {dot} AS path, e.key AS name, e.value AS value, schema_of_variant(e.value) AS kind,
                   coalesce(t.section, e.key) AS section, t.depth + 1 AS depth, t.searched AND e.key IS NOT NULL AS searched
            FROM {{level}} t, LATERAL variant_explode(t.value) e""", level=level)
        level = written(level, "config-level")
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        level = level.where("kind like 'OBJECT%' or kind like 'ARRAY%'")


def search(rows: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    """Entries whose name contains the text, and those whose value is a string that does, with match_type; an entry may be both."""
    low = (lambda c: c) if case_sensitive else F.lower
    want = F.lit(text if case_sensitive else text.lower())
    value = F.when(F.col("kind") == "STRING", F.col("value").cast("string"))
    hits = F.array(F.when(F.contains(low(F.col("name")), want), F.lit("key")), F.when(F.contains(low(value), want), F.lit("value")))
    return rows.where("searched").withColumn("match_type", F.explode(F.array_compact(hits)))


def counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, section, items): entries and list elements below each top section."""
    return rows.groupBy(key, "section").agg(F.count_if(F.col("depth") > 1).alias("items"))


def report(rows: DataFrame, docs: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(key, n_sections, n_items, missing, empty, valid) of each document: required sections that are absent or hold nothing."""
    holds = rows.where("depth = 2").select(key, "section").distinct().withColumn("holds", F.lit(True))
    tops = rows.where("depth = 1").select(key, "section", "kind").join(holds, [key, "section"], "left")
    nothing = F.col("holds").isNull() & ((F.col("kind").like("OBJECT%")) | (F.col("kind").like("ARRAY%")) | (F.col("kind") == "VOID"))
    by = tops.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"), F.collect_set("section").alias("there"), F.collect_set(F.when(nothing, F.col("section"))).alias("hollow"))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))
    want = F.array(*[F.lit(r) for r in required])
    none = F.array().cast("array<string>")
    out = docs.select(key).join(by, key, "left").join(n, key, "left")
    missing = F.array_sort(F.array_except(want, F.coalesce("there", none)))
    empty = F.array_sort(F.array_intersect(want, F.coalesce("hollow", none)))
    return out.select(key, F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_items", F.lit(0)).alias("n_items"), missing.alias("missing"), empty.alias("empty"), (F.size(missing) == 0).alias("valid"))
