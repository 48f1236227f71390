"""Readers and writers: text and tables with their encodings, files, streams, chunk tables, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Encodings in the order they are tried (fixed values).
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "big5", "cp1252")
CHUNK_SCHEMA = (
    "id string, document_id string, type string, embedding_type string, text string, filename string, source string, chunk_index long, "
    "page_numbers array<long>, element_types array<string>, char_count long, upload_time string, asset_path string, version_id string, status string"
)


def binary_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(content: Column) -> Column:
    """Text of bytes in the first encoding that fits, without a byte-order mark; null where none does."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            for e in ENCODINGS:
                try:
                    return bytes(b).decode(e).removeprefix("﻿")
                except UnicodeDecodeError:
                    continue
            return None

        return s.map(one, na_action="ignore")

    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(run(content))


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text, error): blank or undecodable files have an error."""
    rows = binary_files(spark, path, glob).select("path", decoded(F.col("content")).alias("text"))
    error = F.when(F.col("text").isNull(), "no encoding fits").when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty file")
    return rows.withColumn("error", error)


def csv_table(spark: SparkSession, path: str, checked: int = 1000) -> DataFrame:
    """Every value as text, by the header's names; quotes inside quoted values are doubled, and quoted values may hold line breaks.

    Records are parsed first.  If one of the first ``checked`` records of any file has another number of fields than the header,
    ValueError names the files; so it does for a path without a header.  A file with another header than the others fails the read."""
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    names = spark.read.csv(path, inferSchema=False, **options).columns
    if not names:
        raise ValueError(f"{path} is empty")
    bad = "_odd_record"
    while bad in names:
        bad += "_"
    schema = StructType([StructField(n, StringType()) for n in [*names, bad]])
    parsed = spark.read.schema(schema).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=False, **options)
    names_of = [F.col(f"`{n.replace('`', '``')}`") for n in names]
    places = parsed.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))  # a file is one task's, its records number through
    first = places.groupBy("_file").agg(F.min("_at").alias("first"), F.min(F.when(F.col(bad).isNotNull(), F.col("_at"))).alias("odd"), F.count(names_of[0]).alias("n"))
    # Spark refuses to read the odd records' column alone, so the count of another stays in the plan
    odd = [r["_file"] for r in first.where((F.col("odd") - F.col("first") < checked) & (F.col("n") >= 0)).select("_file").limit(10).collect()]
    if odd:
        raise ValueError(f"records differ in their number of fields in {', '.join(sorted(odd))}")
    return parsed.drop(bad).toDF(*[c.removeprefix("\ufeff").strip('"') for c in names])


def workbook_rows(files: DataFrame, open_book: Callable[[bytes], dict[str, list[list]]]) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells, error) of spreadsheets (path, content).  ``open_book`` gives the rows of each
    sheet; empty sheets are left out, a sheet that fails gives one error row, and the file fails only if all do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    book = open_book(bytes(content))
                except Exception as problem:  # the file's failure is its result
                    out.append((path, -1, None, -1, None, str(problem)))
                    continue
                for k, (name, rows) in enumerate(book.items()):
                    if isinstance(rows, Exception):
                        out.append((path, k, name, -1, None, str(rows)))
                    else:
                        out += [(path, k, name, i, ["" if c is None else str(c) for c in r], None) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "sheet_no", "sheet", "row_no", "cells", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, row_no int, cells array<string>, error string")


def layout_elements(files: DataFrame, convert: Callable[[bytes], list[dict]]) -> DataFrame:
    """(path, pos, type, page, y, content) from a layout converter; a bottom-left origin gets its height negated for sorting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for path, content in zip(df["path"], df["content"], strict=True):
                for k, e in enumerate(convert(bytes(content))):
                    y = -e["y"] if e.get("origin") == "BOTTOMLEFT" else e.get("y", 0.0)
                    out.append((path, k, e.get("type", "text"), e.get("page"), float(y), e["content"]))
            yield pd.DataFrame(out, columns=["path", "pos", "type", "page", "y", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, pos int, type string, page int, y double, content string")


def page_images(files: DataFrame, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, page, image) from a page renderer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(p, k, i) for p, c in zip(df["path"], df["content"], strict=True) for k, i in enumerate(render(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, image binary")


def frame_ranges(videos: DataFrame, parts: int = 4, fps: float = 0.5) -> DataFrame:
    """(path, part, first_frame, end_frame) of videos (path, duration): up to ``parts`` time ranges, decoded one per task."""
    n = F.ceil(F.col("duration") * fps)
    size = F.greatest(F.lit(1), F.ceil(n / parts))
    rows = videos.select("path", n.alias("n"), size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return rows.where(F.col("part") * F.col("size") < F.col("n")).select("path", "part", (F.col("part") * F.col("size")).alias("first_frame"), F.least("n", (F.col("part") + 1) * F.col("size")).alias("end_frame"))


def decode_frames(ranges: DataFrame, decode: Callable[[str, int, int], list[tuple[int, bytes]]]) -> DataFrame:
    """(path, frame_index, image) of frame ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(r.path, i, b) for r in df.itertuples() for i, b in decode(r.path, int(r.first_frame), int(r.end_frame))]
            yield pd.DataFrame(rows, columns=["path", "frame_index", "image"])

    return ranges.mapInPandas(run, "path string, frame_index long, image binary")


def frame_directory(spark: SparkSession, path: str) -> DataFrame:
    """(frame_no, path, content) of the pictures in a folder, by name."""
    from pyspark.sql import Window

    files = binary_files(spark, path, "*.{jpg,jpeg,png}", recursive=False)
    return files.select((F.row_number().over(Window.partitionBy(F.regexp_replace("path", "/[^/]*$", "")).orderBy("path")) - 1).alias("frame_no"), "path", "content")


def audio_form(files: DataFrame) -> DataFrame:
    """What to do with media (has_video, sample_rate, channels, codec): extract, convert, or keep 16 kHz mono wave files."""
    fine = (F.col("sample_rate") == 16000) & (F.col("channels") == 1) & F.col("codec").startswith("pcm")
    return files.withColumn("audio_action", F.when(F.col("has_video"), "extract").when(F.coalesce(fine, F.lit(False)), "keep").otherwise("convert"))


def message_stream(spark: SparkSession, kind: str, location: str, schema: str = "value string", start: str = "latest") -> DataFrame:
    """A stream of messages (column value): from Kafka topics, or from files in a folder."""
    if kind == "kafka":
        servers, names = location.split("/", 1)
        rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", names).option("startingOffsets", start).load()
        return rows.select(F.col("value").cast("string").alias("value"), "topic", "timestamp")
    if kind == "files":
        return spark.readStream.schema(schema).format("text" if schema == "value string" else "parquet").load(location)
    raise ValueError(f"unknown kind of stream: {kind}")


def message_sink(stream: DataFrame, kind: str, location: str, checkpoint: str):
    """A started query that writes (topic, value) to Kafka, or to files partitioned by topic."""
    out = stream.select("topic", "value").writeStream.option("checkpointLocation", checkpoint)
    if kind == "kafka":
        return out.format("kafka").option("kafka.bootstrap.servers", location).start()
    return out.format("parquet").partitionBy("topic").option("path", location).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files: JSON lists of {id, payload}."""
    payload = ", ".join(f"{p.strip().replace(' ', ': ', 1)}" for p in _fields(CHUNK_SCHEMA)[1:])
    rows = spark.read.schema(f"id string, payload struct<{payload}>").json(path, multiLine=True)
    return rows.select("id", "payload.*")


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").partitionBy("type").parquet(path)


def export(df: DataFrame, path: str, max_samples: int | None = None) -> dict[str, str | None]:
    """A dataset as JSON, CSV and Parquet; a format that can't hold it gets its error instead.  A cap keeps one row more than it
    says, as it is checked after a row."""
    rows = df if max_samples is None else df.limit(max_samples + 1)
    out: dict[str, str | None] = {}
    for kind in ("json", "csv", "parquet"):
        try:
            getattr(rows.write.mode("overwrite"), kind)(f"{path}/{kind}")
            out[kind] = None
        except Exception as problem:
            out[kind] = str(problem).splitlines()[0]
    return out


def scroll(points: DataFrame, n: int = 1000) -> DataFrame:
    """The first points, with their payload."""
    return points.limit(n)
