"""Sketches that are stored and merged: distinct counts, set differences and quantiles over any span of days without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithms of the sketches' sizes (buckets, hashes) and the accuracy of quantiles: errors of about 1.6, 1.6 and 1.3 per cent.
HLL_BITS, THETA_BITS, KLL_K = 12, 12, 200


def daily(rows: DataFrame, day: Column, by: Sequence[str], item: str, number: str) -> DataFrame:
    """(day, by, n, hll, theta, kll): one row per day and group.  ``item`` is counted, ``number`` ranked; nulls are neither."""
    sketches = [F.hll_sketch_agg(item, HLL_BITS).alias("hll"), F.theta_sketch_agg(item, THETA_BITS).alias("theta"), F.kll_sketch_agg_double(F.col(number).cast("double"), KLL_K).alias("kll")]
    return rows.groupBy(day.alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), *sketches)


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of several days, or of several groups, as one."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def distinct(sketch: str = "hll") -> Column:
    """About how many distinct items a sketch has seen.  A sketch that one task has filled by itself counts along and estimates otherwise than
    an equal one that was merged: in a union with itself it counts as merged, so the estimate depends on the items only."""
    return F.hll_sketch_estimate(F.hll_union(sketch, sketch)) if sketch == "hll" else F.theta_sketch_estimate(sketch)


def only_in(a: str, b: str) -> Column:
    """About how many items of theta sketch a are not in b."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))


def quantile(q: float, sketch: str = "kll") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))
