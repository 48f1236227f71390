"""Intervals, frames and ordered events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import last_before


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def _level(start: str, end: str, bin_size: float) -> Column:
    """0 for intervals no longer than a bin, one more for each four times that."""
    bins = (F.col(end) - F.col(start)) / bin_size
    return F.when(bins > 1, F.ceil(F.log(bins) / math.log(4))).otherwise(F.lit(0)).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", bin_size: float | None = None) -> DataFrame:
    """Rows of one file whose open intervals (s1, e1) and (s2, e2) share a stretch; column overlap.

    With ``bin_size`` a file's intervals are first dealt into time bins, so that one long file is many small joins.  Bins are as wide as
    the longer interval of a pair needs, in steps of four, so that an interval of any length lies in a few bins of each width; a pair
    that shares several bins is kept in the bin where its shared stretch starts."""
    test = (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1"))
    if bin_size is None:
        out = left.join(right.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & test, how).drop("_k")
    else:
        widest = [rows.agg(F.max(_level(s, e, bin_size)).alias("m")).first()["m"] or 0 for rows, s, e in ((left, "s1", "e1"), (right, "s2", "e2"))]
        width = F.lit(bin_size) * F.pow(F.lit(4.0), F.col("_w"))

        def dealt(rows: DataFrame, s: str, e: str, own: str) -> DataFrame:
            rows = rows.withColumn(own, _level(s, e, bin_size)).withColumn("_w", F.explode(F.sequence(F.coalesce(own, F.lit(0)), F.lit(max(widest)))))
            return rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.greatest(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))))

        a, b = dealt(left, "s1", "e1", "_wa"), dealt(right, "s2", "e2", "_wb")
        once = (F.greatest("_wa", "_wb") == F.col("_w")) & (F.floor(F.greatest("s1", "s2") / width) == F.col("_b"))
        out = a.join(b, [key, "_w", "_b"]).where(test & once).drop("_w", "_b", "_wa", "_wb")
        if how == "left":
            out = left.join(out, left.columns, "left")
    return out.withColumn("overlap", overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


def best_speaker(speech: DataFrame, turns: DataFrame, key: str, bin_size: float | None = None) -> DataFrame:
    """Speech rows (key, pos, s1, e1, ...) with the speaker of the one turn (key, turn_pos, s2, e2, speaker) that overlaps
    most; of equal ones the first turn; none: null."""
    pairs = overlap_join(speech.select(key, "pos", "s1", "e1"), turns, key, "inner", bin_size)
    best = pairs.groupBy(key, "pos").agg(F.max(F.struct("overlap", (-F.col("turn_pos")).alias("neg"), "speaker")).alias("b"))
    return speech.join(best, [key, "pos"], "left").select(*speech.columns, F.col("b.speaker").alias("speaker"))


def overlapping_labels(speech: DataFrame, segments: DataFrame, key: str, threshold: float = 0.4, bin_size: float | None = None) -> DataFrame:
    """(key, pos, labels): distinct labels above the threshold of the segments (key, s2, e2, top_classes) that overlap."""
    pairs = overlap_join(speech.select(key, "pos", "s1", "e1"), segments, key, "inner", bin_size)
    labels = pairs.select(key, "pos", F.explode("top_classes").alias("c")).where(F.col("c.probability") > threshold)
    found = labels.groupBy(key, "pos").agg(F.array_sort(F.collect_set("c.label")).alias("labels"))
    return speech.select(key, "pos").join(found, [key, "pos"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def lag_difference(frames: DataFrame, key: str, order: str, value: str, near: float | None = None) -> DataFrame:
    """Distance to the frame before; near-identical frames get the constant 0.1; the first has none."""
    d = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    return frames.withColumn("diff", d if near is None else F.when(d < near, F.lit(0.1)).otherwise(d))


def scenes(frames: DataFrame, key: str, order: str, diff: str = "diff", fps: float = 0.5) -> DataFrame:
    """Frames whose difference exceeds median + 0.5 population deviations of their key, with their time."""
    level = frames.where(F.col(diff).isNotNull()).groupBy(key).agg((F.percentile(diff, 0.5) + 0.5 * F.stddev_pop(diff)).alias("threshold"))
    return frames.join(level, key).where(F.col(diff) > F.col("threshold")).withColumn("at", F.col(order) / fps)


def segment_means(frames: DataFrame, key: str, index: str, per_segment: int, k: int = 5, order: list[str] | None = None) -> DataFrame:
    """Frames (key, index, label, probability) → the k likeliest labels per segment by mean probability, four decimals.

    A mean of doubles depends on the order of its addends, and with it which of two equal means comes first.  ``order``: columns that fix this
    order; without it, it is the order in which rows arrive."""
    rows = frames.withColumn("segment", F.floor(F.col(index) / per_segment).cast("long"))
    if order is None:
        rows = rows.groupBy(key, "segment", "label").agg(F.avg("probability").alias("p"))
    else:
        upto = Window.partitionBy(key, "segment", "label").orderBy(*order)
        means = rows.repartition(key, "segment").withColumns({"p": F.avg("probability").over(upto.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead(F.lit(1)).over(upto)})
        rows = means.where("_next is null").select(key, "segment", "label", "p")
    w = Window.partitionBy(key, "segment").orderBy(F.desc("p"), "label")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(f"rank <= {k}").select(key, "segment", "label", "rank", F.round("p", 4).alias("probability"))


def uniform_samples(first: Column, last: Column, n: int) -> Column:
    """n frame numbers at the middle of equal stretches; halves are rounded to even."""
    size = (last - first) / float(n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(first + size / 2 + F.rint(size * i)).cast("long"))


def step_changes(events: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """Events whose step differs from the one before of the same key."""
    before = F.lag(step).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).where(~F.col(step).eqNullSafe(F.col("_before"))).drop("_before")


def transcript(rows: DataFrame, key: str, order: str, start: Column, speaker: Column, text: Column) -> DataFrame:
    """(key, transcript): '- {start}s [{speaker}]: {text}' lines in order; blank text is left out."""
    line = F.concat(F.lit("- "), start, F.lit("s ["), speaker, F.lit("]: "), text)
    items = rows.where(F.trim(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("items"))
    return items.select(key, F.array_join(F.transform("items", lambda i: i.line), "\n").alias("transcript"))


def final_transcript(rows: DataFrame, key: str, order: str) -> DataFrame:
    """'"{start}-{end}sec" "{speaker}": "{text}"' in order, blank-joined; rows lacking one of the four are left out."""
    line = F.concat(F.lit('"'), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit('sec" "'), F.col("speaker"), F.lit('": "'), F.col("text"), F.lit('"'))
    items = rows.where(line.isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("items"))
    return items.select(key, F.array_join(F.transform("items", lambda i: i.line), " ").alias("transcript"))


def attach_text(scene_rows: DataFrame, texts: DataFrame, index: str) -> DataFrame:
    """Scenes with the text read from their frame (file name → text); none: empty."""
    from quillspark.functions.text import scene_frame_name

    return scene_rows.withColumn("file", scene_frame_name(F.col(index))).join(texts, "file", "left").withColumn("text", F.coalesce("text", F.lit("")))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time: union, then the last value carried forward by
    blocks of neighbours, so that a key may hold any share of the rows."""
    a = left.select(key, at, *[c for c in left.columns if c not in (key, at)]).withColumn("_side", F.lit(1))
    b = right.select(key, at, F.col(value)).withColumn("_side", F.lit(0))
    rows = last_before(a.unionByName(b, allowMissingColumns=True), key, value, F.asc(at), F.asc("_side"))
    return rows.where("_side = 1").drop("_side")


def text_lines(rows: DataFrame, key: str, order: str, at: Column, text: Column) -> DataFrame:
    """(key, lines): '- {at}s: {text}' lines in order; blank text is left out."""
    line = F.concat(F.lit("- "), at, F.lit("s: "), text)
    items = rows.where(F.trim(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("items"))
    return items.select(key, F.array_join(F.transform("items", lambda i: i.line), "\n").alias("lines"))


def speaker_roster(turns: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    """(key, n_segments, n_speakers, speakers)."""
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct(speaker).alias("n_speakers"), F.array_sort(F.collect_set(speaker)).alias("speakers"))


def attach_scalar(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Rows with the columns of a single row, as scalar subqueries; none: nulls."""
    return rows.select("*", *[one.select(c).limit(1).scalar().alias(c) for c in one.columns])
