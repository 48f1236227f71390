"""Order over whole tables without one task that holds them: ranks by sorted ranges, blocks of neighbours, values carried between blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of neighbours.
BLOCK_ROWS = 4096


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that driver and executors share: its lineage ends here."""
    from quillspark.streaming.flow import shared_folder

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` with _rank, 0, 1, 2, ... in the order ``by``: sorted in ranges, a range starts where the counts of those before it
    end (a row per range).  Rows that tie are spread over ranges."""
    order = [*by, F.col("_tie")]
    cut = rows.withColumn("_tie", F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    cut = written(cut.withColumn("_number", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_number", 33))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    out = cut.join(starts, "_part")
    return out.withColumn("_rank", F.col("_start") + F.col("_number").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_number")


def last_before(rows: DataFrame, key: str, value: str, *by: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``value`` carried forward: each row gets the last one that isn't null up to itself, of its key, in the order ``by``.

    Rows are cut into blocks by rank; inside a block a window carries on, and between blocks the last value of each block does, so
    a key may hold any share of the rows."""
    placed = ranked(rows.withColumn("_key", F.struct(key)), F.asc(key), *by).withColumn("_block", F.floor(F.col("_rank") / block_rows))
    placed = written(placed, "placed")
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy("_block", "_key").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    tails = placed.where(F.col(value).isNotNull()).groupBy("_block", "_key").agg(F.max_by(value, "_rank").alias("_tail"))
    every = placed.select("_block", "_key").distinct().join(tails, ["_block", "_key"], "left")  # a row per block and key
    carried = every.withColumn("_carried", F.last("_tail", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    out = placed.withColumn("_inner", inner).join(carried.drop("_tail"), ["_block", "_key"])
    return out.withColumn(value, F.coalesce("_inner", "_carried")).select(*rows.columns)
