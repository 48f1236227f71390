"""Layered summaries: groups of chunks are summarised, then groups of summaries, until one is left or the rest fits the model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.tables import pack_rows
from quillspark.functions.text import estimated_tokens, shortened
from quillspark.operators.ordering import ranked, written

#: A summariser takes an array of texts, in order, and gives one text.
Summariser = Callable[[Column], Column]


#: A sentence ends after a full stop, question or exclamation mark before white space, after a wide mark, or with its line.
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？；])\s*|[\n\r]+")
_TOKEN = re.compile(r"\w+")


def key_sentences(texts: list[str | None] | None) -> str:
    """The best third of the sentences of all texts (at least one), in order, a line each.  A sentence is as good as its words are frequent
    in all texts together, on average over its distinct words; of equal ones the earlier is kept, and a repeated one counts once."""
    sentences = list(dict.fromkeys(p for t in texts or () if t for s in _END.split(t) if (p := s.strip())))
    counts = Counter(w for t in texts or () if t for w in _TOKEN.findall(t.lower()))
    score = []
    for s in sentences:
        words = set(_TOKEN.findall(s.lower()))
        score.append(sum(counts[w] for w in words) / len(words) if words else 0.0)
    best = sorted(range(len(sentences)), key=lambda i: (-score[i], i))[: -(-len(sentences) // 3)]
    return "\n".join(sentences[i] for i in sorted(best))


def _key_sentences(texts: pa.Array) -> pa.Array:
    return pa.array([key_sentences(t) for t in texts.to_pylist()], pa.string())


def frequent_sentences(texts: Column) -> Column:
    """Default summariser, deterministic and offline: ``key_sentences`` of the whole texts, a batch of rows at a time."""
    return F.arrow_udf(_key_sentences, "string")(texts)


def layered_summary(chunks: DataFrame, key: str, order: str, text: str, summarise: Summariser = frequent_sentences, group: int = 5, width: int = 4, budget: int = 4800) -> DataFrame:
    """(key, summary, layers).  One chunk is its own summary.  All keys go through a layer together, so there are as many
    passes as the longest document has layers, each a group-by on (key, group); a layer's rows are at most a fourth of the last.
    Places come from sorted ranges, counts from aggregates: no task holds a whole key before its last layer."""
    placed = ranked(chunks.select(F.struct(key).alias("_key"), F.col(order).alias("_order"), F.col(text).alias("text")), F.asc("_key"), F.asc("_order"))
    sizes = written(placed.groupBy("_key").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")), "summary-sizes")
    longest = sizes.agg(F.max("_n").alias("n")).first()["n"] or 0
    level = placed.join(sizes, "_key").select("_key", (F.col("_rank") - F.col("_first")).cast("int").alias("pos"), "text", F.lit(0).cast("long").alias("layers"))
    level, size, items = written(level, "summary-layer"), group, longest
    while items > 1:
        counted = level.join(level.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum(estimated_tokens(F.col("text"))).alias("_t")), "_key")
        open_ = (F.col("_n") > 1) & ((F.col("layers") == 0) | (F.col("_t") > budget))
        groups = counted.where(open_).groupBy("_key", F.floor(F.col("pos") / size).alias("g")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r"), F.max("layers").alias("layers"))
        made = groups.select("_key", F.col("g").cast("int").alias("pos"), summarise(F.transform("r", lambda x: x.text)).alias("text"), (F.col("layers") + 1).alias("layers"))
        level = written(made.unionByName(counted.where(F.coalesce(~open_, F.lit(True))).select("_key", "pos", "text", "layers")), "summary-layer")
        items, size = -(-items // size), width
    last = level.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r"), F.max("layers").alias("layers"))
    texts = F.transform("r", lambda x: x.text)
    return last.select(F.col(f"_key.{key}").alias(key), F.when(F.size("r") > 1, summarise(texts)).otherwise(F.element_at(texts, 1)).alias("summary"), F.when(F.size("r") > 1, F.col("layers") + 1).otherwise(F.col("layers")).alias("layers"))


def batch_summary(lines: DataFrame, key: str, order: str, text: str, summarise: Summariser = frequent_sentences, limit: int = 1600) -> DataFrame:
    """(key, summary, n_batches): lines batched within the token limit, each batch summarised, and the summaries batched again
    while they exceed the limit together; then one summary of all that are left.  n_batches counts the first round's.  A key whose
    tokens a round didn't lessen goes to the final summary as it is.  All keys go through a round together; a round streams a key's
    lines through a table function, so only its open batch is held."""
    weight = F.coalesce(estimated_tokens(F.col("text")), F.lit(0)).alias("w")

    def batched(rows: DataFrame) -> DataFrame:
        """(key, pos, text, n_batches, open) after a round over rows (key, pos, text, n_batches)."""
        weighed = rows.select("_key", "pos", "text", weight)
        made = pack_rows(weighed, "_key", ["pos"], "w", "text", limit, "\n").select("_key", F.col("chunk_index").alias("pos"), summarise(F.array("text")).alias("text"))
        made = written(made, "summary-batches")
        before = rows.select("_key", weight, "n_batches").groupBy("_key").agg(F.sum("w").alias("before"), F.first("n_batches").alias("n"))
        after = made.select("_key", weight).groupBy("_key").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("after"))
        open_ = ((F.col("k") > 1) & (F.col("after") > limit) & (F.col("after") < F.col("before"))).alias("open")
        state = before.join(after, "_key").select("_key", F.coalesce("n", "k").alias("n_batches"), open_)
        return written(made.join(state, "_key"), "summary-round")

    rows = lines.select(F.struct(key).alias("_key"), F.col(order).alias("pos"), F.col(text).alias("text"), F.lit(None).cast("long").alias("n_batches"))
    level = batched(rows)
    closed = [level.where("not open")]
    while not level.where("open").isEmpty():
        level = batched(level.where("open").drop("open"))
        closed.append(level.where("not open"))
    done = reduce(DataFrame.unionByName, closed).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"), F.first("n_batches").alias("n_batches"))
    texts = F.transform("p", lambda x: x.text)
    return done.select(F.col(f"_key.{key}").alias(key), F.when(F.size("p") > 1, summarise(texts)).otherwise(F.element_at(texts, 1)).alias("summary"), "n_batches")


def fused_prompt(scene_text: Column, transcript: Column, event: Column, limit: int = 1600) -> Column:
    """One prompt of scene text, transcript and event summary; over the token limit the first two are cut to 500 and 800 characters."""
    whole = F.concat_ws("\n\n", event, scene_text, transcript)
    return F.when(estimated_tokens(whole) > limit, F.concat_ws("\n\n", event, shortened(scene_text, 500), shortened(transcript, 800))).otherwise(whole)


def page_range(chunks: DataFrame, key: str) -> DataFrame:
    """(key, first_page, last_page, n_pages) over the page numbers of all chunks; null, null, 0 without any."""
    rows = chunks.select(key, F.explode_outer("page_numbers").alias("p"))
    return rows.groupBy(key).agg(F.min("p").alias("first_page"), F.max("p").alias("last_page"), F.countDistinct("p").alias("n_pages"))


def union_of(chunks: DataFrame, key: str, column: str) -> DataFrame:
    """(key, values): sorted distinct values of an array column."""
    return chunks.select(key, F.explode(column).alias("v")).groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("values"))
