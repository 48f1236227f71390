"""Greedy packing in order: chunks that stay within a token budget, as a fold over an array of weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


#: Items of a block.  A fold copies its state at every step, so positions are gathered block by block and texts not at all.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """Positions (from 0) of the items where a run starts.  step(state, item) → (the next state, does a run start here?)."""
    none = F.array().cast("array<int>").alias("starts")
    fields = lambda acc: [acc[name].alias(name) for name in state]

    def inner(acc: Column, item: Column) -> Column:
        new, here = step(acc, item)
        return F.struct(F.when(here, F.array_append(acc.starts, acc.i)).otherwise(acc.starts).alias("starts"), (acc.i + 1).alias("i"), *(c.alias(name) for name, c in new.items()))

    def outer(acc: Column, block: Column) -> Column:
        first = F.struct(none, (block * BLOCK).alias("i"), *fields(acc))
        return _let(F.aggregate(F.slice(items, block * BLOCK + 1, BLOCK), first, inner), lambda got: F.struct(F.concat(acc.starts, got.starts).alias("starts"), *fields(got)))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(none, *(c.alias(name) for name, c in state.items())), outer, lambda acc: acc.starts)


def _runs(items: Column, starts: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` (first, number of items) of each run."""
    return _let(starts, lambda at: F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda first, end: body(first, F.coalesce(end, F.size(items)) - first)))


def chunks(items: Column, weights: Column, limit: int | Column, sep: str = " ", joiner: int = 0) -> Column:
    """array<struct<first,n_items,tokens,text>>: an item joins the open chunk while the total, joiners included, stays within
    the limit; an item over the limit stands alone.  Linear in the items; a null array gives null."""

    def step(acc: Column, w: Column) -> tuple[dict[str, Column], Column]:
        fits = (acc.total >= 0) & (acc.total + joiner + w <= limit)
        return {"total": F.when(fits, acc.total + joiner + w).otherwise(w).cast("long")}, ~fits

    def chunk(items: Column, weights: Column, first: Column, n: Column) -> Column:
        total = F.aggregate(F.slice(weights, first + 1, n), F.lit(0).cast("long"), lambda s, x: s + x) + (n - 1) * joiner
        return F.struct(first.cast("long").alias("first"), n.cast("long").alias("n_items"), total.cast("long").alias("tokens"), F.array_join(F.slice(items, first + 1, n), sep).alias("text"))

    whole = lambda x, w: _runs(x, _starts(w, {"total": F.lit(-1).cast("long")}, step), lambda first, n: chunk(x, w, first, n))
    return _let(items, lambda x: _let(weights, lambda w: F.when(w.isNotNull(), whole(x, w))))


def packed(df: DataFrame, keys: list[str], items: str, weights: str, limit: int, sep: str = " ", joiner: int = 0) -> DataFrame:
    """(keys, chunk_index, first, n_items, tokens, text): the chunks of each row's items."""
    rows = df.select(*keys, F.posexplode(chunks(F.col(items), F.col(weights), limit, sep, joiner)).alias("chunk_index", "c"))
    return rows.select(*keys, F.col("chunk_index").cast("long").alias("chunk_index"), "c.first", "c.n_items", "c.tokens", "c.text")


def _exploded(df: DataFrame, key: str, parts: Column) -> DataFrame:
    """(key, chunk_index, tokens, text) from an array of (tokens, text) per row, numbered by its places."""
    rows = df.select(key, F.posexplode(parts).alias("chunk_index", "c"))
    return rows.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.tokens").alias("tokens"), F.col("c.text").alias("text"))


def chunk_sentences(docs: DataFrame, key: str, text: str, limit: int = 400, counter=T.word_tokens, joiner: int = 0) -> DataFrame:
    """Chunks of sentences within the budget; a sentence over it is cut into runs of words.
    (key, chunk_index, tokens, text).  All within a row; null and blank texts have no chunk.  The work is in the fold, not in reading, so
    rows are dealt over all tasks first, however few row groups hold them."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(key, text).repartition(tasks)
    light = lambda c: F.struct(c.tokens.alias("tokens"), c.text.alias("text"))
    cut = lambda c: _let(F.split(c.text, rf"{T.SPACE}+"), lambda words: F.transform(chunks(words, F.transform(words, counter), limit, " ", joiner), light))
    rows = docs.select(key, T.sentences(F.col(text)).alias("_items"))
    rows = rows.select(key, chunks(F.col("_items"), F.transform("_items", counter), limit, " ", joiner).alias("_c"))
    return _exploded(rows, key, F.flatten(F.transform("_c", lambda c: F.when(c.tokens > limit, cut(c)).otherwise(F.array(light(c))))))


def numbered(df: DataFrame, key: str, order: list[str], name: str = "chunk_index") -> DataFrame:
    """Consecutive numbers from 0 per key."""
    from pyspark.sql import Window

    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def html_parts(html: Column, limit: int = 400, counter=T.word_tokens) -> Column:
    """Tags and text regrouped: a part closes at an end tag, a self-closing tag, or beyond 80 % of the budget."""

    def step(acc: Column, token: Column) -> tuple[dict[str, Column], Column]:
        text = F.concat(acc.open, token)
        close = T.strip(token).rlike(r"^</[^>]+>$|^<[^>]+/>$") | (counter(text) > limit * 0.8)
        return {"open": F.when(close, F.lit("")).otherwise(text)}, acc.open == ""

    part = lambda tokens: lambda first, n: T.strip(F.array_join(F.slice(tokens, first + 1, n), ""))
    return _let(T.tag_tokens(html), lambda tokens: F.filter(_runs(tokens, _starts(tokens, {"open": F.lit("")}, step), part(tokens)), lambda p: p != ""))


def chunk_html(pages: DataFrame, key: str, html: str, limit: int = 400, counter=T.word_tokens) -> DataFrame:
    """Chunks of HTML parts (of lines where there is one part at most); a part over 1.5 budgets is cut into slices of three
    characters per token.  (key, chunk_index, tokens, text).  All within a row, so nothing is shuffled."""
    rows = pages.select(key, T.collapse_blank_lines(F.coalesce(F.col(html), F.lit(""))).alias("_h"))
    rows = rows.select(key, "_h", html_parts(F.col("_h"), limit, counter).alias("_p"))
    lines = F.filter(F.transform(F.split("_h", "\n"), T.strip), lambda p: p != "")
    rows = rows.select(key, F.when(F.size("_p") <= 1, lines).otherwise(F.col("_p")).alias("_items"))
    rows = rows.select(key, chunks(F.col("_items"), F.transform("_items", counter), limit, "\n").alias("_c"))
    width = 3 * limit

    def parts(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(c.text) - 1) / width)).cast("int"))
        cuts = F.filter(F.transform(starts, lambda i: T.strip(F.substring(c.text, i * width + 1, F.lit(width)))), lambda p: p != "")
        return F.transform(F.when(c.tokens > limit * 1.5, cuts).otherwise(F.array(c.text)), lambda t: F.struct(counter(t).alias("tokens"), t.alias("text")))

    return _exploded(rows, key, F.flatten(F.transform("_c", parts)))


def pack_elements(elements: DataFrame, key: str, limit: int = 400, counter=T.word_tokens) -> DataFrame:
    """Layout elements (key, page, y, type, content), sorted by page and height, packed with blank lines between;
    a chunk carries its element types and pages as sorted sets."""
    order = F.struct(F.coalesce("page", F.lit(0)).alias("page"), "y", "pos", "type", "content")
    rows = elements.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("_e"))
    rows = rows.select(key, "_e", chunks(F.col("_e.content"), F.transform("_e.content", counter), limit, "\n\n").alias("_c"))

    def whole(c: Column) -> Column:
        part = F.slice("_e", (c.first + 1).cast("int"), c.n_items.cast("int"))
        found = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(part, lambda x: x[name]), lambda v: v.isNotNull())))
        return F.struct(c.tokens.alias("tokens"), c.text.alias("text"), found("type").alias("element_types"), found("page").alias("page_numbers"))

    rows = rows.select(key, F.posexplode(F.transform("_c", whole)).alias("chunk_index", "c"))
    return rows.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "c.tokens", "c.text", "c.element_types", F.when(F.size("c.page_numbers") == 0, F.array(F.lit(1))).otherwise(F.col("c.page_numbers")).alias("page_numbers"))


def pack_table_rows(tables: DataFrame, key: str, header: str, rows: str, limit: int = 512, counter=T.word_tokens) -> DataFrame:
    """Ranges of table rows whose Markdown, header included, stays within the budget; one row over it stands alone.
    (key, chunk_index, first, n_rows, text)"""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit("-"))), " | "), F.lit(" |"))
    # the header costs the same in every chunk: it lowers the limit
    head = counter(T.markdown_table(F.col(header), F.array().cast("array<array<string>>")))
    df = tables.select(key, header, rows, F.transform(rows, line).alias("_l"), (F.lit(limit) - head).alias("_limit"))
    df = df.select(key, header, rows, chunks(F.col("_l"), F.transform("_l", counter), F.col("_limit"), "\n").alias("_c"))
    part = lambda c: F.struct(c.first.alias("first"), c.n_items.alias("n_rows"), T.markdown_table(F.col(header), F.slice(rows, (c.first + 1).cast("int"), c.n_items.cast("int"))).alias("text"))
    df = df.select(key, F.posexplode(F.transform("_c", part)).alias("chunk_index", "c"))
    return df.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "c.first", "c.n_rows", "c.text")


def pack_table_columns(tables: DataFrame, key: str, header: str, limit: int = 512, counter=T.word_tokens) -> DataFrame:
    """Ranges of columns for tables whose header alone exceeds 60 % of the budget; every range repeats the first column."""
    first = counter(F.coalesce(F.element_at(header, 1), F.lit("-")))
    wide = tables.where(F.aggregate(header, F.lit(0).cast("long"), lambda s, c: s + counter(c) + 1) > limit * 0.6)
    wide = wide.select(key, header, F.slice(header, 2, 1 << 20).alias("_rest"), first.alias("_first"))
    wide = wide.select(key, header, "_rest", chunks(F.col("_rest"), F.transform("_rest", lambda c: counter(c) + F.col("_first") + 1), int(limit * 0.6)).alias("_c"))
    columns = lambda c: F.concat(F.slice(header, 1, 1), F.slice("_rest", (c.first + 1).cast("int"), c.n_items.cast("int")))
    return wide.select(key, F.posexplode(F.transform("_c", columns)).alias("chunk_index", "columns")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def fixed_groups(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Consecutive groups of ``size`` rows per key: column group_no."""
    return numbered(df, key, order, "_n").withColumn("group_no", F.floor(F.col("_n") / size).cast("long")).drop("_n")
