"""Registered queries of frame distances, the inverted file, nested configurations and priorities, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.functions import text as T
from quillspark.operators import assets, configs, frames, index, packing, sketches, temporal, vector
from quillspark.operators.ordering import written
from quillspark.plans.catalogue import _GREEDY, _WORDS, query

# ---- frames: a vector of 64 numbers stands for 8 × 8 grey values, a label for a video ----------------------------

_GREY = "least(255, greatest(0, round(128 + 600 * x::DOUBLE)))"
_WINDOW = "list_transform(range(9), lambda k: {0}[((w // 6) + (k // 3)) * 8 + (w % 6) + (k % 3) + 1])"


def _over(f: str) -> str:
    """A mean over the nine pixels of window w; a and b are the frames."""
    return f"list_avg(list_transform(range(9), lambda k: {f.replace('A', 'a[((w // 6) + (k // 3)) * 8 + (w % 6) + (k % 3) + 1]').replace('B', 'b[((w // 6) + (k // 3)) * 8 + (w % 6) + (k % 3) + 1]')}))"


_SSIM = f"""f AS (SELECT vec_id, label, list_transform(embedding, lambda x: {_GREY}) AS a FROM embeddings WHERE len(embedding) = 64),
l AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM f),
w AS (SELECT vec_id, w, {_over("A")} AS ux, {_over("B")} AS uy, {_over("A * A")} AS xx, {_over("B * B")} AS yy, {_over("A * B")} AS xy FROM l, range(36) r(w) WHERE b IS NOT NULL),
s AS (SELECT vec_id, avg(((2 * ux * uy + 6.5025) * (2 * 9 / 8.0 * (xy - ux * uy) + 58.5225)) / ((ux * ux + uy * uy + 6.5025) * (9 / 8.0 * (xx - ux * ux) + 9 / 8.0 * (yy - uy * uy) + 58.5225))) AS ssim FROM w GROUP BY vec_id),
m AS (SELECT vec_id, label, list_avg(list_transform(range(1, 65), lambda k: abs(a[k] - b[k]))) AS pixel FROM l),
d AS (SELECT vec_id, label, CASE WHEN pixel < 5 THEN 0.1 ELSE pixel * (1 - ssim) END AS diff FROM m LEFT JOIN s USING (vec_id))"""


def _frames(read):
    e = read("embeddings").where(F.size("embedding") == 64)
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(F.lit(128.0) + x.cast("double") * 600.0))))
    return frames.frame_distances(e.select("vec_id", "label", grey.alias("pixels"), F.lit(8).alias("width")), "label", "vec_id").drop("pixels", "width")


@query(f"WITH {_SSIM} SELECT vec_id, label, round(diff, 6) AS diff FROM d")
def frame_ssim(read):
    return _frames(read).select("vec_id", "label", F.round("diff", 6).alias("diff"))


@query(f"WITH {_SSIM}, t AS (SELECT label, median(diff) + 0.5 * stddev_pop(diff) AS threshold FROM d GROUP BY label) SELECT vec_id, label, round(diff, 6) AS diff FROM d JOIN t USING (label) WHERE diff > threshold")
def ssim_scenes(read):
    found = temporal.scenes(_frames(read), "label", "vec_id")
    return found.select("vec_id", "label", F.round("diff", 6).alias("diff"))


# ---- inverted file ---------------------------------------------------------------------------------------------

#: Share of exact results that the number of lists probed is tuned for, on vectors that aren't queries here.
AIM = 0.97


def _ivf(read):
    e = read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = read("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    made = index.build(e)
    return made, e, q, index.search(made, q, 5, index.tuned(made, e, 5, AIM, among=e.where("id % 100 <> 0")))


@query("SELECT count(*) AS queries, true AS recall_reached, (SELECT count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0) AS posted FROM embeddings WHERE vec_id % 100 = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0")
def ivf_recall(read):
    """The five nearest of every id divisible by 100 by the inverted file: do they hold nine tenths of the exact ones?  All vectors are posted."""
    made, e, q, found = _ivf(read)
    each = index.recall(found, vector.nearest_k(e, q, 5))
    total = each.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"))
    return total.withColumn("posted", F.lit(made.posted(e.sparkSession).count()))


# ---- nested configurations -------------------------------------------------------------------------------------


def _configs(read):
    inner = F.concat(F.lit('{"task_to_models": '), F.col("props"), F.lit(', "Engine": "'), F.col("event_type"), F.lit('", "limits": [1, {"K": "view"}, []]}'))
    store = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "storage": {"path": "/u/'), F.col("user_id").cast("string"), F.lit('"}'))).otherwise(F.lit(""))
    lakes = F.when(F.col("event_id") % 2 == 0, F.lit(', "lakefs": {}')).otherwise(F.lit(""))
    return read("events").select("event_id", F.concat(F.lit('{"inference": '), inner, store, lakes, F.lit(', "mlflow": "on"}')).alias("config"))


@query("""SELECT event_id, 'inference.task_to_models.k' AS path, 'key' AS match_type FROM events UNION ALL
SELECT event_id, 'inference.Engine', 'value' FROM events WHERE contains(event_type, 'k') UNION ALL SELECT event_id, 'lakefs', 'key' FROM events WHERE event_id % 2 = 0 UNION ALL
SELECT event_id, 'inference.task_to_models', 'key' FROM events""")
def config_search(read):
    """Names and strings with a k in the configuration of every event."""
    docs = _configs(read)
    return configs.search(configs.entries(docs, "event_id"), "K").select("event_id", "path", "match_type")


@query("""SELECT event_id, 'inference' AS section, 8::BIGINT AS items FROM events UNION ALL SELECT event_id, 'mlflow', 0 FROM events UNION ALL
SELECT event_id, 'storage', 1 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'lakefs', 0 FROM events WHERE event_id % 2 = 0""")
def config_counts(read):
    docs = _configs(read)
    return configs.counts(configs.entries(docs, "event_id"), "event_id")


@query("""SELECT event_id, 2 + (event_id % 3 = 0)::BIGINT + (event_id % 2 = 0)::BIGINT AS n_sections, 10 + 2 * (event_id % 3 = 0)::BIGINT + (event_id % 2 = 0)::BIGINT AS n_items,
concat_ws(',', CASE WHEN event_id % 2 <> 0 THEN 'lakefs' END, CASE WHEN event_id % 3 <> 0 THEN 'storage' END) AS missing, CASE WHEN event_id % 2 = 0 THEN 'lakefs' ELSE '' END AS empty, event_id % 6 = 0 AS valid FROM events""")
def config_validation(read):
    docs = _configs(read)
    out = configs.report(configs.entries(docs, "event_id"), docs, "event_id", ["storage", "mlflow", "lakefs", "inference"])
    return out.select("event_id", "n_sections", "n_items", F.array_join("missing", ",").alias("missing"), F.array_join("empty", ",").alias("empty"), "valid")


# ---- stored sketches, phrases, deletions -----------------------------------------------------------------------


@query("""WITH a AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
w AS (SELECT event_type, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-16') AS late FROM events GROUP BY 1)
SELECT event_type, n, users, true AS same_as_whole, true AS users_near, true AS gone_near, true AS median_near FROM a JOIN w USING (event_type)""")
def merged_sketches(read):
    """Daily sketches, stored and merged per event type: equal to a sketch of all rows, near the exact distinct users, the users seen in the
    first half of the month only, and the median's rank."""
    e = read("events")
    by = ["event_type"]
    daily = written(sketches.daily(e, F.to_date("ts"), by, "user_id", "value"), "daily-sketches")
    every = sketches.merged(daily, by)
    half = F.col("day") >= F.lit("2024-01-16").cast("date")
    early = sketches.merged(daily.where(~half), by).select("event_type", F.col("theta").alias("early"))
    late = sketches.merged(daily.where(half), by).select("event_type", F.col("theta").alias("late"))
    whole = sketches.daily(e, F.lit(0), by, "user_id", "value").select("event_type", sketches.distinct("hll").alias("whole"))
    seen = every.join(early, "event_type", "left").join(late, "event_type", "left").join(whole, "event_type")
    gone = F.when(F.col("late").isNull(), F.theta_sketch_estimate("early")).when(F.col("early").isNull(), 0).otherwise(sketches.only_in("early", "late"))
    seen = seen.select("event_type", "n", sketches.distinct("hll").alias("about"), "whole", gone.alias("about_gone"), sketches.quantile(0.5).alias("median"))
    users = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    exact = users.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("last") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("gone"))
    ranks = e.join(seen.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"), F.count("value").alias("k"))
    out = seen.join(exact, "event_type").join(ranks, "event_type")
    near = lambda about, true, of: F.abs(F.col(about) - F.col(true)) <= 0.05 * F.col(of) + 1
    return out.select(
        "event_type", "n", "users", (F.col("about") == F.col("whole")).alias("same_as_whole"), near("about", "users", "users").alias("users_near"),
        near("about_gone", "gone", "users").alias("gone_near"), ((F.col("below") <= 0.53 * F.col("k")) & (F.col("upto") >= 0.47 * F.col("k"))).alias("median_near"),
    )


#: Phrases that contain, start with and overlap each other.
_PHRASES = ("th", "the", "the ", "er", "ere", "re", "en", "ent", "nt", "in", "ing", "der", "die ", "un", "und", "é", "ción")


@query(f"SELECT doc_id, sha256(regexp_replace(text, '({'|'.join(sorted(_PHRASES, key=len, reverse=True))})', '<\\1>', 'g')) AS text_sha256 FROM documents")
def phrase_conversion(read):
    """Every document with the longest phrase at each place converted."""
    to = T.to_traditional(F.col("text"), {p: f"<{p}>" for p in _PHRASES})
    return read("documents").select("doc_id", F.sha2(to, 256).alias("text_sha256"))


@query("""WITH d AS (SELECT source AS path, lang AS branch, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS version, doc_id AS ts FROM documents)
SELECT path, branch, version, ts FROM (SELECT * FROM (SELECT *, lag(version) OVER (PARTITION BY path, branch ORDER BY ts) AS before FROM d) WHERE version IS DISTINCT FROM before
  QUALIFY row_number() OVER (PARTITION BY path, branch ORDER BY ts DESC) = 1) WHERE version IS NOT NULL""")
def standing_objects(read):
    """Uploads and, for every seventh document, deletions: committed in two batches, then what stands."""
    d = read("documents").select(F.col("source").alias("path"), F.col("lang").alias("branch"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"), F.col("doc_id").alias("ts"))
    none = d.select("path", "branch", F.lit(None).cast("string").alias("version"), "ts").where("false")
    first = assets.commit(none, d.where("ts < 100"))
    return assets.standing(assets.commit(first, d.where("ts >= 100"))).select("path", "branch", "version", "ts")


# ---- cells, tables, templates, times ---------------------------------------------------------------------------

_CELL = "coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey // 4 % 3 = {r} AND o_orderkey // 16 % 2 = {c}), '')"
_GRID = "'| ' || {0} || ' | ' || {1} || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {2} || ' | ' || {3} || ' |' || chr(10) || '| ' || {4} || ' | ' || {5} || ' |'".format(*[_CELL.format(r=r, c=c) for r in range(3) for c in range(2)])


@query(f"SELECT o_custkey, {_GRID} AS text FROM orders GROUP BY o_custkey")
def cells_markdown(read):
    """Cells (row, column, text) of each customer's orders as a grid; of two at one place the later one counts."""
    cell = F.struct("o_orderkey", F.expr("cast(o_orderkey div 4 % 3 as int)").alias("row"), F.expr("cast(o_orderkey div 16 % 2 as int)").alias("col"), F.col("o_orderpriority").alias("text"))
    rows = read("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("o_custkey", T.grid_markdown(T.cells_grid(F.col("cells"), F.lit(3), F.lit(2))).alias("text"))


@query(r"SELECT conv_id, turn, replace(trim(regexp_replace(role || ' | ' || text, '\s+', ' ', 'g')), '|', '\|') AS cell FROM conversations")
def cell_cleaning(read):
    return read("conversations").select("conv_id", "turn", T.clean_cell(F.concat_ws(" | ", "role", "text")).alias("cell"))


_TWO = "'| ' || lang || ' | ' || source || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | x |'"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '<TABLE>' || chr(10) || {_TWO} || CASE doc_id % 4 WHEN 2 THEN chr(10) ELSE '' END || chr(10) || '</TABLE>' END AS text FROM documents""")
def table_fallback(read):
    """A table from its grid, else its cells, else the Markdown in the text."""
    kind, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    grid = F.when(kind == 0, F.array(F.array("lang", "source"), F.array(n, F.lit("x"))))
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    cells = F.when(kind == 1, F.array(cell(0, 0, F.col("lang")), cell(0, 1, F.col("source")), cell(1, 0, n), cell(1, 1, F.lit("x"))))
    text = F.when(kind == 2, F.concat(F.lit("before\n| "), "lang", F.lit(" | "), "source", F.lit(" |\n| --- | --- |\n| "), n, F.lit(" | x |\nafter"))).otherwise("none")
    return read("documents").select("doc_id", T.table_text(grid, cells, F.lit(2), F.lit(2), text, F.lit(0)).alias("text"))


@query("SELECT conv_id, turn, 'Say: ' || text || ' / ' || text AS prompt FROM conversations")
def template_application(read):
    return read("conversations").select("conv_id", "turn", T.apply_template(F.col("text"), "Say: {input} / {input}").alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events""")
def times(read):
    """ISO text to time stamps and back, and milliseconds as text; every fifth text is none."""
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return e.select("event_id", S.format_iso(S.parse_iso(iso)).alias("iso"), S.epoch_ms_text(F.unix_millis("ts")).alias("text"))


_NAME = _WORDS.format("p_name")


@query(_GREEDY.format(items=f"""SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY n) AS pos FROM (
  SELECT p_size AS k, n, {_NAME} + first_value({_NAME}) OVER (PARTITION BY p_size ORDER BY n) + 1 AS w, sum({_NAME} + 1) OVER (PARTITION BY p_size) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part)) WHERE n > 1 AND whole > 24 * 0.6""", limit=14, joiner=0)
       + "SELECT k AS p_size, chunk::BIGINT AS chunk_index, (count(*) + 1)::BIGINT AS n_columns FROM g GROUP BY k, chunk")
def table_column_chunks(read):
    """Tables with a part's name a column: ranges of columns within the budget, each after the first one."""
    tables_ = read("part").groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("r")).select("p_size", F.col("r.p_name").alias("header"))
    return packing.pack_table_columns(tables_, "p_size", "header", 24).select("p_size", "chunk_index", F.size("columns").cast("long").alias("n_columns"))
