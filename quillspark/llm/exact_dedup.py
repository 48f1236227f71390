"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks where the content says so (after a pair of certain
characters, between MIN_CHUNK and MAX_CHUNK characters), each chunk is replaced by its identifier, and two
texts are equal when their ordered identifier lists are.  Long texts move once, chunk by chunk, to build the
dictionary of distinct chunks; after that only lists of identifiers move.

Identifiers are 64-bit chunk hashes that the dictionary verifies: chunks whose hash stands for two different
contents are named by the whole chunk's SHA-256 instead, so no two contents share an identifier.

Nulls count as empty texts; all texts of nothing but white space are equal.  Rows with a null id take part as
any other row and sort before all ids.  Repeated rows form one group.  Empty tables give no rows.  Extra columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, at least and at most (but for the last).
MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Deleted before texts are compared.
BLANK = r"[\x20\x09-\x0D]+"
#: A chunk ends after a character of the first class followed by one of the second, about 1 place in 100 of prose, or, in
#: scripts beyond ASCII, after a character that stands two places before as well, about 1 in 30.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[aeiou0-5][dgklmpz,.;6-9]|([^\x00-\x7F]).\1|\z)|.{{1,{MAX_CHUNK}}}"


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, chunk): every distinct chunk once."""
    rows = docs.select(F.explode(chunks(_normal(F.col(text)))).alias("chunk"))
    return rows.select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(id, n_chars, text_sha256, recipe): the verified identifier list of each row; ``more`` columns go with it."""
    shared = chunk_dictionary(docs, text).groupBy("hash").count().where("count > 1")
    clashes = shared.agg(F.collect_set("hash").alias("h")).scalar()
    name = lambda c: F.when(F.array_contains(F.col("clashes"), F.xxhash64(c)), F.sha2(c, 256)).otherwise(F.hex(F.xxhash64(c)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("_t"), _normal(F.col(text)).alias("_n"), *more)
    return rows.withColumn("clashes", clashes).select(
        "id",
        F.length(F.coalesce("_t", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("_n", 256).alias("text_sha256"),
        F.array_join(F.transform(chunks(F.col("_n")), name), ",").alias("recipe"),
        *rows.columns[3:],
    )


def _groups(docs: DataFrame, id_col: str, text: str, row: str) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, row, keep_row); the first row of those with the id that stays is the one."""
    from .common import stored

    made = stored(recipes(docs, id_col, text, F.col(row).alias("row")), "recipes")
    order = F.struct(F.col("n_chars"), F.col("id").isNull().alias("null"), F.bitwise_not("id").alias("id"), F.bitwise_not("row").alias("row"))
    best = made.groupBy("recipe").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own, so that the join has a shuffle on both sides and can split a hot recipe
    best = best.select("recipe", "group_size", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))
    return made.join(stored(best, "groups"), "recipe").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row", "keep_row"
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, keep_id (most code points, then smallest id), group_size, kept, text_sha256.  Rows that
    repeat the id that stays are all marked kept.

    Groups are made by an aggregate with map-side combine, and a join back that adaptive execution splits, so
    one group may hold any share of the rows."""
    return _groups(docs.select(id_col, text), id_col, text, id_col).drop("row", "keep_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, all its columns; also of rows that repeat their id."""
    from .common import numbered

    every, row, _ = numbered(docs, id_col)
    stay = _groups(every.select(id_col, text, row), id_col, text, row).where("row = keep_row").select(F.col("row").alias(row))
    return every.join(stay, row, "left_semi").select(*docs.columns)
