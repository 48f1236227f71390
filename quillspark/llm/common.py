"""Helpers shared by the training-data operators: shared-folder tables, size-checked joins, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest key side, in bytes, that a join may broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or a fresh
    local folder where the setting is unset and everything runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Tables written per session.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def tables_written(spark: SparkSession) -> int:
    """How many tables this session's operators have written and not yet deleted."""
    return len(_written.get(spark, []))


def clear_stored(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables that this session's operators wrote, from the ``since``-th on (``keep_last``: but for the last one),
    once what was made of them has been saved elsewhere."""
    jvm, paths = spark.sparkContext._jvm, _written.get(spark, [])
    end = len(paths) - keep_last
    for name in paths[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del paths[since:end]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(df.sparkSession, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """(docs with a number of its own for each row, the number's column, whether it is the id).  The id is that number where
    none is null or repeats; otherwise the numbered rows are stored, so that they keep their numbers."""
    name = free_name(docs, "row")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("k")).first()
    if size["n"] == size["k"]:
        return docs.withColumn(name, F.col(id_col).cast("long")), name, True
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name, False


def sized_join(big: DataFrame, small: DataFrame, on: str, how: str, row_bytes: int | None = None, blob: str | None = None) -> DataFrame:
    """Join ``small`` to ``big``; broadcast it only if its measured size is below BROADCAST_BYTES.

    ``small`` should be a stored table: it is counted first.  ``row_bytes`` is the width of a row without
    the binary column ``blob``."""
    size = F.count(F.lit(1)) * F.lit(row_bytes or 16)
    if blob:
        size = size + F.coalesce(F.sum(F.length(blob)), F.lit(0))
    measured = small.agg(size.alias("b")).first()["b"]
    return big.join(F.broadcast(small) if measured <= BROADCAST_BYTES else small.hint("merge"), on, how)


def ranked(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` with ``rank``, 0, 1, 2, ... in the order ``by``, without bringing them all into one task: they are sorted in
    ranges, and a range starts where the counts of those before it end.  Rows that tie are spread over ranges at random.  Stored once, as
    ranges are cut by samples."""
    number, tie = free_name(rows, "number"), free_name(rows, "tie")
    order = [*by, F.col(tie)]
    cut = rows.withColumn(tie, F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
    cut = stored(cut.withColumn(number, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(number, 33).alias("part")
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("part", before.alias("start")), "ranges")
    out = sized_join(cut.withColumn("part", part), starts, "part", "inner", 24)
    return out.withColumn("rank", F.col("start") + F.col(number).bitwiseAND((1 << 33) - 1)).drop("part", "start", number)


def _stars(links: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that one has none: each component is a star around its smallest id."""
    row = links.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("k")).first()
    return row["n"] == row["k"] and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as rows (id, component): component is the smallest
    id reachable.  Ids without an edge do not appear.

    Alternates large-star and small-star steps.  Every step is an aggregate with map-side combine and a join
    with one row per node, so a hub with a third of all edges is split by adaptive execution; each round ends
    in a stored table.  The number of rounds grows with the logarithm of the longest path."""
    links = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = stored(small, "edges")
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
