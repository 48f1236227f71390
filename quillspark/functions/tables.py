"""Table functions: rows of a key as they come, in order, with a few numbers of state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class PackRows:
    """Greedy chunks of a table's rows: (key, chunk_index, first, n_items, tokens, text).

    A row joins the open chunk while the total, joiners included, stays within the limit; a row over the limit stands alone.  The table is
    partitioned by its key and sorted by Spark; only the open chunk is held.  A row without a weight counts 0, one without text adds none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, weight: AnalyzeArgument, text: AnalyzeArgument, limit: AnalyzeArgument, sep: AnalyzeArgument, joiner: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in rows.dataType.fields]
        wanted = [key.value, *order.value.split(","), weight.value, *([text.value] if text.value else [])]
        if missing := [n for n in wanted if n not in names]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        fields = [rows.dataType[key.value], *(StructField(n, LongType()) for n in ("chunk_index", "first", "n_items", "tokens")), StructField("text", StringType())]
        return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn(f"`{key.value}`")], orderBy=[OrderingColumn(f"`{c}`") for c in order.value.split(",")])

    def __init__(self) -> None:
        self.chunk, self.first, self.n, self.total, self.parts = 0, 0, 0, 0, []
        self.key, self.sep = None, ""

    def eval(self, rows: Row, key: str, order: str, weight: str, text: str, limit: int, sep: str, joiner: int) -> Iterator[tuple]:
        w = rows[weight] or 0
        if self.n and self.total + joiner + w > limit:
            yield self._closed()
            self.chunk, self.first, self.n, self.total, self.parts = self.chunk + 1, self.first + self.n, 0, 0, []
        self.total += w + (joiner if self.n else 0)
        self.n += 1
        self.key, self.sep = rows[key], sep
        if text and rows[text] is not None:
            self.parts.append(rows[text])

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self._closed()

    def _closed(self) -> tuple:
        return self.key, self.chunk, self.first, self.n, self.total, self.sep.join(self.parts)


def _fold(limit: int, sep: str, joiner: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``PackRows`` over batches of (key, weight, text) sorted by key and order: a row is a turn of a loop, not a call."""
    names = ["key", "chunk_index", "first", "n_items", "tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, kind = None, None  # key, chunk, first, rows, total, texts
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for key, w, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = w or 0
                if open_ is not None and open_[0] == key and open_[4] + joiner + w <= limit:
                    open_[3] += 1
                    open_[4] += joiner + w
                else:
                    if open_ is not None:
                        out.append(open_)
                    same = open_ is not None and open_[0] == key
                    open_ = [key, open_[1] + 1 if same else 0, open_[2] + open_[3] if same else 0, 1, w, []]
                if text is not None:
                    open_[5].append(text)
            if out:
                yield table(out, kind)
        if open_ is not None:
            yield table([open_], kind)

    def table(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
        *numbers, texts = zip(*rows, strict=True)
        arrays = [pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(numbers)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([sep.join(t) for t in texts], pa.string())], names)

    return run


def pack_rows(rows: DataFrame, key: str, order: list[str], weight: str, text: str | None, limit: int, sep: str = " ", joiner: int = 0) -> DataFrame:
    """The chunks of each key's rows, in order, as ``PackRows`` gives them.  A key of any number of rows is one stream through one task.

    Spark deals rows by key and sorts them; keys then pass through the fold in Arrow batches.  The table function itself, for SQL text, takes
    each row by a call of its own, some 80 microseconds of a core."""
    sorted_ = rows.repartition(F.col(f"`{key}`")).sortWithinPartitions(*(F.col(f"`{c}`") for c in [key, *order]))
    given = sorted_.select(F.col(f"`{key}`").alias("key"), F.col(f"`{weight}`").cast("long").alias("w"), (F.col(f"`{text}`") if text else F.lit(None)).cast("string").alias("text"))
    fields = [StructField("key", rows.schema[key].dataType), *(StructField(n, LongType()) for n in ("chunk_index", "first", "n_items", "tokens")), StructField("text", StringType())]
    return given.mapInArrow(_fold(limit, sep, joiner), StructType(fields)).withColumnRenamed("key", key)
