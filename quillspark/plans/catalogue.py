"""Registered queries of the content-insight operators, each over whole supplied tables, with DuckDB SQL where SQL can say it.

The supplied tables stand in for the operators' own inputs: documents are files to chunk, embeddings are points, orders are
asset versions (customer = path, order = version, date = upload, status F/O/P), events are messages, steps and
intervals, conversations are transcripts, part and supplier are registries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.functions import tables
from quillspark.functions import text as T
from quillspark.operators import assets, cache, envelopes, packing, registry, summarize, temporal, vector

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: A fixed "now" for queries about expiry.
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None) -> Callable:
    """Decorator: register a query under its function's name, with its SQL."""

    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = lambda spark, sf: fn(lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- similarity search -----------------------------------------------------------------------------------------


def _points(read) -> DataFrame:
    """All embeddings, with the payload of the document of the same id where there is one."""
    docs = read("documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", F.concat("lang", F.lit("_"), "source").alias("filename"))
    e = read("embeddings").join(docs, "vec_id", "left")
    return e.select(F.col("vec_id").alias("id"), F.lit("document").alias("type"), F.when(F.col("label") % 2 == 0, "text").otherwise("summary").alias("embedding_type"), F.when(F.col("label") < 9, "active").otherwise("inactive").alias("status"), "filename", "source", F.col("lang").alias("speaker"), F.col("embedding").alias("vec"))


_POINTS = """points AS (
  SELECT e.vec_id AS id, 'document' AS type, CASE WHEN label % 2 = 0 THEN 'text' ELSE 'summary' END AS embedding_type,
         CASE WHEN label < 9 THEN 'active' ELSE 'inactive' END AS status, lang || '_' || source AS filename, source, lang AS speaker, embedding AS vec
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


_ALL_TOP = """WITH points AS (
  SELECT e.vec_id AS id, 'document' AS type, CASE WHEN label % 2 = 0 THEN 'text' ELSE 'summary' END AS embedding_type,
         CASE WHEN label < 9 THEN 'active' ELSE 'inactive' END AS status, lang || '_' || source AS filename, source, lang AS speaker, embedding AS vec
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
q AS (SELECT vec_id AS query, embedding AS qvec FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, id, filename, source, round(list_cosine_similarity(vec::DOUBLE[], qvec::DOUBLE[]), 9) AS score FROM points, q WHERE status = 'active' AND embedding_type = 'text' {})
SELECT query, id, filename, source, round(score, 6) AS score FROM s WHERE score IS NOT NULL AND NOT isnan(score)
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5"""


def _all_top(read, condition) -> DataFrame:
    q = read("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    found = vector.nearest_k(_points(read).where(condition), q, 5, keep=["filename", "source"])
    return found.select("query", "id", "filename", "source", F.round("score", 6).alias("score"))


@query(_ALL_TOP.format(""))
def topk_all(read):
    """Every vector of an id divisible by 100 against all active text points, with or without a document."""
    return _all_top(read, vector.metadata_filter("text"))


@query(_ALL_TOP.format("AND source = 'src1'"))
def filtered_topk_all(read):
    """Points of one source for every vector of an id divisible by 100."""
    return _all_top(read, vector.metadata_filter("text", source="src1"))


@query(_ALL_TOP.format("AND filename IN ('en_src1', 'en_src2', 'de_src3') AND speaker IN ('en', 'de') AND type = 'document'"))
def topk_in_list_all(read):
    """Points of some files and speakers for every vector of an id divisible by 100."""
    return _all_top(read, vector.metadata_filter("text", "document", ["en_src1", "en_src2", "de_src3"], speaker=["en", "de"]))


@query(f"WITH {_POINTS} SELECT source, count(*) AS n FROM points WHERE source IS NOT NULL AND source <> '' GROUP BY source")
def collection_stats(read):
    return vector.collection_stats(_points(read), "source")


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS n_distinct, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM documents ORDER BY s LIMIT 10)) AS sample")
def distinct_sample(read):
    return vector.distinct_sample(read("documents"), "source").select("n_distinct", F.array_join("sample", ",").alias("sample"))


@query("SELECT count(*) AS n_points, max(len(embedding))::BIGINT AS vector_size, 'cosine' AS metric FROM embeddings")
def collection_info(read):
    return vector.collection_info(read("embeddings"), "embedding")


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS key, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query, arg_max(key, score) AS key, round(max(score), 6) AS score FROM s GROUP BY query HAVING max(score) >= 0.3""")
def knn1_threshold(read):
    """Every vector of an id divisible by 100 against all others."""
    e = read("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    q = e.where("key % 100 = 0").select(F.col("key").alias("query"), F.col("vec").alias("qvec"))
    return vector.nearest(e, q, 0.3, skip_same=True).select("query", "key", F.round("score", 6).alias("score"))


@query("""WITH u AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS text, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS type FROM orders)
SELECT id, arg_max(text, seq) AS text, arg_max(type, seq) AS type FROM u WHERE type <> '' GROUP BY id""")
def vector_upsert(read):
    o = read("orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("type"))
    o = o.withColumns({"summary": F.lit(None).cast("string"), "embedding_type": F.lit("text"), "asset_path": F.col("id"), "version_id": F.col("seq").cast("string")})
    empty = o.where(F.lit(False)).drop("seq")
    return vector.upsert(empty, o).select(F.col("id").cast("long").alias("id"), "text", "type")


@query("SELECT o_orderstatus AS type, count(*) AS n_points FROM orders WHERE o_orderstatus <> '' GROUP BY 1")
def upsert_counts(read):
    return vector.upsert_counts(read("orders").select(F.col("o_orderstatus").alias("type")))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey = 7 AND o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status FROM orders")
def payload_update(read):
    o = read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("asset_path"), F.col("o_orderstatus").alias("version_id"), F.lit("active").alias("status"))
    return vector.set_payload(o, {"status": "archived"}, "7", "F").select("id", "status")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderpriority = '1-URGENT' AND k.o_custkey = o.o_custkey AND k.o_orderstatus = o.o_orderstatus)")
def filtered_delete(read):
    o = read("orders")
    return vector.delete_points(o, o.where("o_orderpriority = '1-URGENT'"), ["o_custkey", "o_orderstatus"]).select("o_orderkey")


@query("""SELECT coalesce(s.s_suppkey, c.c_custkey) AS id, coalesce(s.s_nationkey, c.c_nationkey) AS nation, coalesce(round(s.s_acctbal, 2), round(c.c_acctbal, 2)) AS balance
FROM customer c FULL OUTER JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def update_or_insert(read):
    old = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    new = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 2).alias("balance"))
    return vector.update_or_insert(old, new, ["id"])


# ---- caches ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256('search:' || text) AS key FROM documents")
def cache_key(read):
    return read("documents").select("doc_id", F.sha2(F.concat(F.lit("search:"), "text"), 256).alias("key"))


@query("SELECT user_id, count(*) AS hits, CAST(floor(3600 * (count(*) * 0.01 + 1) + 1e-9) AS BIGINT) AS ttl FROM events GROUP BY user_id")
def dynamic_ttl(read):
    rows = cache.count_hits(read("events"), "user_id")
    return rows.select("user_id", "hits", S.dynamic_ttl(F.lit(3600), F.col("hits")).alias("ttl"))


@query("SELECT user_id, count_if(event_type = 'view') AS hits, count_if(event_type <> 'view') AS misses, round(count_if(event_type = 'view') / greatest(count(*), 1), 9) AS hit_rate FROM events GROUP BY user_id")
def hit_rate(read):
    rows = cache.hit_statistics(read("events").withColumn("hit", F.col("event_type") == "view"), "user_id")
    return rows.withColumn("hit_rate", F.round("hit_rate", 9))


@query("""WITH c AS (SELECT user_id AS key, max(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30')
SELECT e.event_id, e.user_id AS key, CASE WHEN c.key IS NULL THEN 'computed' ELSE 'cached' END AS value FROM events e LEFT JOIN c ON c.key = e.user_id""")
def cache_single_flight(read):
    e = read("events").withColumnRenamed("user_id", "key")
    held = e.where("event_type = 'purchase'").groupBy("key").agg(F.max("ts").alias("expires_at")).withColumn("value", F.lit("cached"))
    out, _ = cache.read_through(held, e.select("event_id", "key"), F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00")), lambda missing: missing.select("key", F.lit("computed").alias("value")))
    return out.select("event_id", "key", "value")


@query("""WITH live AS (SELECT vec_id AS key, label AS scope, embedding AS vec FROM embeddings WHERE label <> 3),
q AS (SELECT vec_id AS query, vec_id + 7 AS key, label AS scope, embedding AS qvec FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, live.key AS hit, list_cosine_similarity(vec::DOUBLE[], qvec::DOUBLE[]) AS score FROM q JOIN live USING (scope) WHERE live.key <> query),
n AS (SELECT query, arg_max(hit, score) AS hit FROM s WHERE score >= 0.4 GROUP BY query)
SELECT q.query, coalesce(n.hit, x.key) AS value, CASE WHEN n.hit IS NOT NULL THEN 'similar' WHEN x.key IS NOT NULL THEN 'exact' ELSE 'miss' END AS how
FROM q LEFT JOIN n USING (query) LEFT JOIN live x ON x.key = q.key""")
def semantic_or_exact_cache(read):
    """Every vector of an id divisible by 100 against all live entries (label 3 has expired)."""
    e = read("embeddings").withColumnsRenamed({"vec_id": "key", "label": "scope", "embedding": "vec"})
    held = e.select("key", "scope", "vec", F.col("key").alias("value"), F.when(F.col("scope") == 3, -1).otherwise(1).alias("expires_at"))
    q = e.where("key % 100 = 0").select(F.col("key").alias("query"), (F.col("key") + 7).alias("key"), "scope", F.col("vec").alias("qvec"))
    return cache.semantic_or_exact(held, q, F.lit(0), 0.4, skip_same=True)


@query("SELECT event_type || ':' || user_id AS key, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def cache_invalidation(read):
    rows = read("events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"))
    return cache.invalidate(rows, "click").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# ---- text ------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, len(s)::BIGINT AS n, sha256(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\n\r]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def sentence_split(read):
    s = T.sentences(F.col("text"))
    return read("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<[^>]+>'))::BIGINT AS n_tags FROM pages")
def html_tag_tokens(read):
    return read("pages").select("page_id", F.size(F.filter(T.tag_tokens(F.col("html")), lambda t: t.rlike("^<[^>]+>$"))).cast("long").alias("n_tags"))


@query(r"""SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '\n\s*\n', chr(10), 'g'), chr(10)), lambda x: trim(x, E' \t\r\x0b\x0c')), lambda x: x <> ''), chr(10))) AS digest FROM pages""")
def blank_line_collapse(read):
    return read("pages").select("page_id", F.sha2(T.collapse_blank_lines(F.col("html")), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 2048)) AS digest FROM documents")
def clean_input(read):
    return read("documents").select("doc_id", F.sha2(T.clean_input(F.col("text")), 256).alias("digest"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(replace(trim(text), '[INST]', ''), '\s+', ' ', 'g')) AS clean FROM (SELECT conv_id, turn, '  [INST] ' || text || ' [INST] ' AS text FROM conversations)")
def clean_output(read):
    return read("conversations").select("conv_id", "turn", T.clean_output(F.concat(F.lit("  [INST] "), "text", F.lit(" [INST] "))).alias("clean"))


@query("""SELECT p_partkey, CASE WHEN length(t) > 12 THEN left(t, 12) || '...' ELSE t END AS name
FROM (SELECT p_partkey, replace(CASE WHEN starts_with(p_name, 'part') THEN trim(substr(p_name, 5)) ELSE p_name END, 'a', 'aa') AS t FROM part)""")
def output_filters(read):
    f = [{"type": "remove_prefix", "value": "part"}, {"type": "replace", "old": "a", "new": "aa"}]
    return read("part").select("p_partkey", T.output_filters(F.col("p_name"), f, 12).alias("name"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS text FROM (
  SELECT conv_id, turn, upper(left(trim(text), 1)) || substr(trim(text), 2) AS t FROM conversations)""")
def description_filters(read):
    f = [{"type": "remove_redundant"}, {"type": "capitalize_first"}, {"type": "length_limit", "max_length": 40}]
    return read("conversations").select("conv_id", "turn", T.description_filters(F.concat(F.lit("In this image "), "text"), f).alias("text"))


@query(r"""SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[一-鿿]')) * 1.5 + len(regexp_extract_all(text, '[a-zA-Z]+')) * 1.3
  + (length(text) - len(regexp_extract_all(text, '[一-鿿]')) - len(regexp_extract_all(text, '[a-zA-Z\s]'))) * 1.2) AS BIGINT) AS tokens FROM documents""")
def token_estimate(read):
    return read("documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


_GREEDY = """WITH RECURSIVE items AS ({items}),
g AS (
  SELECT k, pos, w, w AS total, 0 AS chunk FROM items WHERE pos = 1
  UNION ALL
  SELECT i.k, i.pos, i.w, CASE WHEN g.total + {joiner} + i.w <= {limit} THEN g.total + {joiner} + i.w ELSE i.w END,
         CASE WHEN g.total + {joiner} + i.w <= {limit} THEN g.chunk ELSE g.chunk + 1 END
  FROM g JOIN items i ON i.k = g.k AND i.pos = g.pos + 1)
"""


_PACK_ROWS = (_GREEDY.format(items="SELECT l_orderkey AS k, l_quantity::BIGINT AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem", limit=60, joiner=1)
       + "SELECT k AS l_orderkey, chunk::BIGINT AS chunk_index, count(*) AS n_items, (sum(w) + (count(*) - 1))::BIGINT AS tokens FROM g GROUP BY k, chunk")


@query(_PACK_ROWS)
def pack_rows(read):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("r"))
    rows = rows.select("l_orderkey", F.transform("r", lambda x: x.l_quantity.cast("long")).alias("w")).withColumn("items", F.transform("w", lambda x: x.cast("string")))
    return packing.packed(rows, ["l_orderkey"], "items", "w", 60, " ", 1).select("l_orderkey", "chunk_index", "n_items", "tokens")


@query(_PACK_ROWS)
def pack_rows_streamed(read):
    """The same as a stream of sorted rows, for keys of any number of rows."""
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").cast("long").alias("w"))
    out = tables.pack_rows(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "w", None, 60, " ", 1)
    return out.select("l_orderkey", "chunk_index", "n_items", "tokens")


@query(_GREEDY.format(items="SELECT conv_id AS k, length(text)::BIGINT AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations", limit=400, joiner=0)
       + "SELECT k AS conv_id, chunk::BIGINT AS chunk_index, count(*) AS n_items, sum(w)::BIGINT AS tokens FROM g GROUP BY k, chunk")
def pack_lines(read):
    rows = read("conversations").withColumn("w", F.length("text").cast("long"))
    return tables.pack_rows(rows, "conv_id", ["turn"], "w", "text", 400, "\n").select("conv_id", "chunk_index", "n_items", "tokens")


_WORDS = r"len(regexp_extract_all({}, '\w+|[^\w\s]'))"
_CHUNK_SENTENCES = rf"""WITH RECURSIVE items AS (
  SELECT k, item, {_WORDS.format('item')} AS w, row_number() OVER (PARTITION BY k ORDER BY i) AS pos
  FROM (SELECT doc_id AS k, trim(unnest(l), chr(32) || chr(9)) AS item, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[。！？；\n\r]') AS l FROM documents)) WHERE item <> ''),
g AS (
  SELECT k, pos, w, w AS total, 0 AS chunk FROM items WHERE pos = 1
  UNION ALL
  SELECT i.k, i.pos, i.w, CASE WHEN g.total + i.w <= 400 THEN g.total + i.w ELSE i.w END, CASE WHEN g.total + i.w <= 400 THEN g.chunk ELSE g.chunk + 1 END
  FROM g JOIN items i ON i.k = g.k AND i.pos = g.pos + 1),
whole AS (SELECT k, chunk, sum(g.w)::BIGINT AS tokens, string_agg(item, ' ' ORDER BY pos) AS text FROM g JOIN items USING (k, pos) GROUP BY k, chunk),
words AS (SELECT k, chunk, unnest(l) AS item, generate_subscripts(l, 1) AS pos FROM (SELECT k, chunk, regexp_split_to_array(text, '\s+') AS l FROM whole WHERE tokens > 400)),
v AS (SELECT k, chunk, item, pos, {_WORDS.format('item')} AS w FROM words),
h AS (
  SELECT k, chunk, pos, w, w AS total, 0 AS part FROM v WHERE pos = 1
  UNION ALL
  SELECT v.k, v.chunk, v.pos, v.w, CASE WHEN h.total + v.w <= 400 THEN h.total + v.w ELSE v.w END, CASE WHEN h.total + v.w <= 400 THEN h.part ELSE h.part + 1 END
  FROM h JOIN v ON v.k = h.k AND v.chunk = h.chunk AND v.pos = h.pos + 1),
cut AS (SELECT k, chunk, part, sum(h.w)::BIGINT AS tokens, string_agg(item, ' ' ORDER BY pos) AS text FROM h JOIN v USING (k, chunk, pos) GROUP BY k, chunk, part),
every AS (SELECT k, chunk, 0 AS part, tokens, text FROM whole WHERE tokens <= 400 UNION ALL SELECT * FROM cut)
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY chunk, part) - 1 AS chunk_index, tokens, text FROM every"""


@query(_CHUNK_SENTENCES)
def chunk_sentences(read):
    return packing.chunk_sentences(read("documents"), "doc_id", "text")


@query()
def chunk_html(read):
    return packing.chunk_html(read("pages"), "page_id", "html")


@query(_GREEDY.format(items=f"SELECT conv_id AS k, {_WORDS.format('text')}::BIGINT AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 4, turn) AS pos FROM conversations", limit=300, joiner=0)
       + """, e AS (SELECT conv_id AS k, turn // 4 AS page, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 4, turn) AS pos FROM conversations)
SELECT k AS conv_id, chunk::BIGINT AS chunk_index, sum(w)::BIGINT AS tokens, string_agg(DISTINCT role, ',' ORDER BY role) AS types, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages FROM g JOIN e USING (k, pos) GROUP BY k, chunk""")
def element_chunks(read):
    """Turns as layout elements: four to a page, by height."""
    rows = read("conversations").select("conv_id", F.floor(F.col("turn") / 4).cast("long").alias("page"), F.col("turn").alias("y"), F.col("turn").alias("pos"), F.col("role").alias("type"), F.col("text").alias("content"))
    out = packing.pack_elements(rows, "conv_id", 300)
    return out.select("conv_id", "chunk_index", "tokens", F.array_join("element_types", ",").alias("types"), F.array_join(F.array_sort(F.transform("page_numbers", lambda p: p.cast("string"))), ",").alias("pages"))


@query(_GREEDY.format(items=f"SELECT o_custkey AS k, {_WORDS.format("line")}::BIGINT AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM (SELECT *, '| ' || o_orderkey || ' | ' || o_orderpriority || ' |' AS line FROM orders)", limit=40 - 21, joiner=0)
       + """SELECT k AS o_custkey, chunk::BIGINT AS chunk_index, min(pos) - 1 AS first, count(*) AS n_rows FROM g GROUP BY k, chunk""")
def table_row_chunks(read):
    """A customer's orders as a table, cut into ranges of rows."""
    rows = read("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("c")))).alias("r"))
    tables = rows.select("o_custkey", F.array(F.lit("order"), F.lit("priority")).alias("head"), F.col("r.c").alias("rows"))
    return packing.pack_table_rows(tables, "o_custkey", "head", "rows", 40).select("o_custkey", "chunk_index", "first", "n_rows")


@query("SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 5)::BIGINT AS group_no FROM conversations")
def fixed_groups(read):
    return packing.fixed_groups(read("conversations"), "conv_id", ["turn"], 5).select("conv_id", "turn", "group_no")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations")
def chunk_index(read):
    return packing.numbered(read("conversations").select("conv_id", "turn"), "conv_id", ["turn"])


@query("""SELECT p_brand, '| name | size |' || chr(10) || '| ---- | ---- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand""")
def markdown_table(read):
    rows = read("part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.array("p_name", F.col("p_size").cast("string")).alias("c")))).alias("r"))
    return rows.select("p_brand", T.markdown_table(F.array(F.lit("name"), F.lit("size")), F.transform("r", lambda x: x.c)).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '-' ELSE o_orderstatus END AS status FROM orders")
def null_fill(read):
    return read("orders").select("o_orderkey", S.blank_to_dash(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))).alias("status"))


@query("SELECT doc_id, source || '_chunk_' || (doc_id % 7) AS name, printf('scene_frame_%04d.jpg', doc_id) AS frame FROM documents")
def identifiers(read):
    d = read("documents")
    return d.select("doc_id", T.chunk_name(F.concat("source", F.lit(".txt")), F.col("doc_id") % 7).alias("name"), T.scene_frame_name(F.col("doc_id")).alias("frame"))


@query("""SELECT p_partkey, CASE WHEN contains(n, 'bert') THEN 'bert' WHEN contains(n, 'llama') THEN 'llama' ELSE 'default' END AS family, CAST(p_size * 1e9 AS BIGINT) AS params
FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'bert' WHEN 1 THEN 'llama' ELSE 'other' END AS n FROM part)""")
def params_from_name(read):
    kind = F.when(F.col("p_partkey") % 3 == 0, "BERT").when(F.col("p_partkey") % 3 == 1, "Llama").otherwise("other")
    name = F.concat(kind, F.lit("-v2.1-"), F.col("p_size").cast("string"), F.lit("b-chat-7b"))
    return read("part").select("p_partkey", T.model_family(name).alias("family"), T.params_from_name(name).alias("params"))


# ---- intervals and ordered events ------------------------------------------------------------------------------


def _speech(read) -> tuple[DataFrame, DataFrame]:
    """Views as speech, purchases as speaker turns: intervals that start at the event and last by its value."""
    e = read("events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    speech = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("pos"), F.col("s").alias("s1"), (F.col("s") + 7200.0).alias("e1"))
    turns = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("turn_pos"), F.col("s").alias("s2"), (F.col("s") + 3600.0 + F.floor("value") * 60).alias("e2"), F.col("event_id").cast("string").alias("speaker"))
    return speech, turns


_SPEECH = """e AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM events),
speech AS (SELECT user_id, event_id AS pos, s AS s1, s + 7200.0 AS e1 FROM e WHERE event_type = 'view'),
turns AS (SELECT user_id, event_id AS turn_pos, s AS s2, s + 3600.0 + floor(value) * 60 AS e2, event_id::VARCHAR AS speaker FROM e WHERE event_type = 'purchase'),
pairs AS (SELECT user_id, pos, turn_pos, speaker, least(e1, e2) - greatest(s1, s2) AS overlap FROM speech JOIN turns USING (user_id) WHERE s1 < e2 AND s2 < e1)"""


@query(f"WITH {_SPEECH} SELECT user_id, pos, turn_pos, round(overlap, 3) AS overlap FROM pairs")
def overlap_join(read):
    out = temporal.overlap_join(*_speech(read), "user_id", bin_size=3600.0)
    return out.select("user_id", "pos", "turn_pos", F.round("overlap", 3).alias("overlap"))


@query(f"WITH {_SPEECH}, b AS (SELECT user_id, pos, speaker, row_number() OVER (PARTITION BY user_id, pos ORDER BY overlap DESC, turn_pos) AS n FROM pairs) SELECT s.user_id, s.pos, b.speaker FROM speech s LEFT JOIN b ON b.user_id = s.user_id AND b.pos = s.pos AND b.n = 1")
def argmax_overlap(read):
    return temporal.best_speaker(*_speech(read), "user_id", 3600.0).select("user_id", "pos", "speaker")


@query(f"WITH {_SPEECH}, l AS (SELECT DISTINCT user_id, pos, 'l' || (turn_pos % 3) AS label FROM pairs WHERE (turn_pos % 10) / 10.0 > 0.4) SELECT s.user_id, s.pos, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels FROM speech s LEFT JOIN l ON l.user_id = s.user_id AND l.pos = s.pos GROUP BY s.user_id, s.pos")
def label_union_over_threshold(read):
    speech, turns = _speech(read)
    c = F.array(F.struct(F.concat(F.lit("l"), (F.col("turn_pos") % 3).cast("string")).alias("label"), ((F.col("turn_pos") % 10) / 10.0).alias("probability")))
    out = temporal.overlapping_labels(speech, turns.withColumn("top_classes", c), "user_id", bin_size=3600.0)
    return out.select("user_id", "pos", F.array_join("labels", ",").alias("labels"))


_FRAMES = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events),
d AS (SELECT user_id, idx, CASE WHEN abs(value - lag(value) OVER w) < 5 THEN 0.1 ELSE abs(value - lag(value) OVER w) END AS diff FROM f WINDOW w AS (PARTITION BY user_id ORDER BY idx))"""


def _frames(read) -> DataFrame:
    f = packing.numbered(read("events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "idx")
    return temporal.lag_difference(f, "user_id", "idx", "value", 5.0)


@query(f"WITH {_FRAMES} SELECT user_id, idx, round(diff, 6) AS diff FROM d")
def lag_difference(read):
    return _frames(read).select("user_id", "idx", F.round("diff", 6).alias("diff"))


@query(f"WITH {_FRAMES}, t AS (SELECT user_id, median(diff) + 0.5 * stddev_pop(diff) AS threshold FROM d WHERE diff IS NOT NULL GROUP BY 1) SELECT user_id, idx, idx / 0.5 AS at, round(threshold, 6) AS threshold FROM d JOIN t USING (user_id) WHERE diff > threshold")
def scene_threshold(read):
    return temporal.scenes(_frames(read), "user_id", "idx").select("user_id", "idx", "at", F.round("threshold", 6).alias("threshold"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber // 2 AS segment, l_returnflag || l_linestatus AS label, avg(l_discount) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, segment ORDER BY p DESC, label) AS rank FROM m)
SELECT l_orderkey, segment::BIGINT AS segment, label, rank, round(p, 4) AS probability FROM r WHERE rank <= 5""")
def segment_top5(read):
    """Means are summed in the order of the file, whichever tasks read it."""
    place = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    rows = read("lineitem").withColumns(place).select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_discount").alias("probability"), *place)
    return temporal.segment_means(rows, "l_orderkey", "l_linenumber", 2, order=list(place))


@query("""SELECT user_id, i, CAST(floor(0 + (n / 8.0) / 2 + round_even((n / 8.0) * i, 0)) AS BIGINT) AS frame
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(0, 8) r(i)""")
def uniform_sampling(read):
    n = read("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.posexplode(temporal.uniform_samples(F.lit(0), F.col("n"), 8)).alias("i", "frame")).withColumn("i", F.col("i").cast("long"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS candidate FROM events")
def round_robin(read):
    return registry.round_robin(read("events"), 4, ["ts", "event_id"], "user_id").select("event_id", "candidate")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def step_changes(read):
    return temporal.step_changes(read("events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT conv_id, string_agg('- ' || turn || 's [' || role || ']: ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def transcript(read):
    return temporal.transcript(read("conversations"), "conv_id", "turn", F.col("turn").cast("string"), F.col("role"), F.col("text"))


@query("SELECT conv_id, string_agg('\"' || turn || '-' || (turn + 1) || 'sec\" \"' || role || '\": \"' || text || '\"', ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def final_transcript(read):
    rows = read("conversations").select("conv_id", "turn", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.col("role").alias("speaker"), "text")
    return temporal.final_transcript(rows, "conv_id", "turn")


@query("SELECT l.doc_id, coalesce(d.source, '') AS text FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang <> 'en'")
def left_lookup(read):
    texts = read("documents").where("lang <> 'en'").select(T.scene_frame_name(F.col("doc_id")).alias("file"), F.col("source").alias("text"))
    return temporal.attach_text(read("labels").select("doc_id"), texts, "doc_id").select("doc_id", "text")


# ---- messages --------------------------------------------------------------------------------------------------


def _messages(read) -> DataFrame:
    """Events as messages: every fifth lacks a key, others are late, for someone else or of an unknown action."""
    e = read("events")
    target = F.when(F.col("event_type") == "error", "other").otherwise("document_orchestrator")
    action = F.when(F.col("event_type") == "signup", "dance").otherwise("document_processing")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    head = F.when(F.col("event_id") % 5 == 0, "{").otherwise('{"message_id": "1", ')
    body = F.format_string('"correlation_id": "c", "timestamp": "%s", "source_service": "s", "target_service": "%s", "message_type": "REQUEST", "priority": null, "payload": {"request_id": "r", "action": "%s", "parameters": {"asset_path": "a", "version_id": "v", "primary_filename": "f", "status": null}}, "retry_count": 0, "ttl": 1296000}', stamp, target, action)
    return e.select("event_id", F.concat(head, body).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'INVALID_FORMAT' WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(date_trunc('second', ts)) > 1296000000000 THEN 'MESSAGE_EXPIRED'
  WHEN event_type = 'error' THEN 'WRONG_TARGET' WHEN event_type = 'signup' THEN 'UNKNOWN_ACTION' END AS error FROM events""")
def envelope_guard(read):
    now = F.to_timestamp(F.lit(NOW))
    return _messages(read).select("event_id", envelopes.error_code(F.col("value"), now, "document_orchestrator", ["document_processing"]).alias("error"))


@query("SELECT event_id, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(date_trunc('second', ts)) > 1296000000000 AS expired FROM events")
def ttl_expiry(read):
    v = F.col("value")
    e = envelopes.expired(F.get_json_object(v, "$.timestamp"), F.get_json_object(v, "$.ttl").cast("long"), F.to_timestamp(F.lit(NOW)))
    return _messages(read).select("event_id", e.alias("expired"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' ELSE 'unknown' END AS modality,
  CASE page_id % 6 WHEN 0 THEN 'document-processing-requests' WHEN 1 THEN 'image-processing-requests' WHEN 2 THEN 'video-processing-requests' WHEN 3 THEN 'audio-processing-requests' END AS topic FROM pages""")
def route_by_extension(read):
    pages = read("pages")
    names = S.pick(["a.b.PDF", "x.png", "v.mp4", "s.Mp3", "noext", "t.xyz"], F.col("page_id") % 6)
    out = envelopes.route(pages.select("page_id", names.alias("filename")), envelopes.topics(pages.sparkSession))
    return out.select("page_id", "modality", "topic")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'office' WHEN 2 THEN 'spreadsheet' END AS analyser, CASE doc_id % 4 WHEN 0 THEN 'ocr' ELSE 'default' END AS mode, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/csv' ELSE 'application/octet-stream' END AS mime FROM documents")
def analysis_route(read):
    name = S.pick(["a.pdf", "b.docx", "c.csv", "d.zzz"], F.col("doc_id") % 4)
    mime = F.when(F.col("doc_id") % 4 == 1, "text/html").otherwise("application/octet-stream")
    return read("documents").select("doc_id", envelopes.analyser(name).alias("analyser"), envelopes.processing_mode(name, F.lit("ocr")).alias("mode"), envelopes.mime_type(name, mime).alias("mime"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.z'), 'none') AS z FROM events")
def json_path(read):
    return read("events").select("event_id", S.json_path(F.col("props"), "$.k").cast("long").alias("k"), S.json_path(F.col("props"), "$.z", "none").alias("z"))


_RESULTS = "r AS (SELECT user_id || '-' || date_trunc('day', ts)::DATE AS correlation_id, event_type AS branch, ts, event_id, value, CASE WHEN value > 90 THEN 'failed' ELSE 'ok' END AS status FROM events)"


def _results(read) -> DataFrame:
    e = read("events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("correlation_id"), F.col("event_type").alias("branch"), F.struct("ts", "event_id").alias("ts"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status"), F.col("event_id").cast("string").alias("result"))


def _fan_in_sql(branches: tuple[str, ...]) -> str:
    firsts = ", ".join(f"arg_min(status, (ts, event_id)) FILTER (branch = '{b}') AS s{k}, arg_min(event_id, (ts, event_id)) FILTER (branch = '{b}') AS i{k}" for k, b in enumerate(branches))
    errors = ", ".join(f"CASE WHEN s{k} = 'failed' THEN '{b}: ' || i{k} END" for k, b in enumerate(branches))
    return f"WITH {_RESULTS}, f AS (SELECT correlation_id, {firsts} FROM r GROUP BY 1) SELECT correlation_id, concat_ws('; ', {errors}) AS errors FROM f WHERE " + " AND ".join(f"s{k} IS NOT NULL" for k in range(len(branches)))


@query(_fan_in_sql(("view", "click")))
def fanin_2(read):
    return envelopes.fan_in(_results(read), ("view", "click")).select("correlation_id", "errors")


@query(_fan_in_sql(("view", "click", "purchase")))
def fanin_3(read):
    return envelopes.fan_in(_results(read), ("view", "click", "purchase")).select("correlation_id", "errors")


@query("SELECT event_id, b AS branch FROM events, unnest(['classifier', 'diarization', 'recognizer']) t(b)")
def fan_out(read):
    return envelopes.fan_out(read("events"), "audio").select("event_id", "branch")


@query("""SELECT user_id, round(2678400 + epoch_us(TIMESTAMP '2024-01-01') / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS running_seconds FROM events GROUP BY user_id
HAVING count_if(event_type = 'purchase') < 8""")
def active_tasks(read):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = e.groupBy("user_id").agg(F.min("ts").alias("ts"))
    ends = e.where("event_type = 'purchase'").groupBy("user_id").count().where("count >= 8")
    out = envelopes.active_tasks(starts, ends, F.to_timestamp(F.lit(NOW)), "user_id")
    return out.select("user_id", F.round("running_seconds", 3).alias("running_seconds"))


@query("SELECT event_id, error, CASE WHEN retry < 3 THEN 'retry' ELSE 'dead' END AS fate, CASE WHEN retry < 3 THEN retry + 1 ELSE retry END AS retry_count FROM (SELECT event_id, 'E' || user_id AS error, event_id % 5 AS retry FROM events WHERE event_type = 'error')")
def dead_letters(read):
    rows = read("events").select(F.col("event_id").cast("string").alias("value"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("user_id").cast("string"))).alias("error"), (F.col("event_id") % 5).alias("retry_count"))
    again, dead = envelopes.dead_letters(rows)
    pick = lambda df, fate: df.select(F.col("value").cast("long").alias("event_id"), "error", F.lit(fate).alias("fate"), "retry_count")
    return pick(again, "retry").unionByName(pick(dead, "dead"))


@query("SELECT doc_id, 0 AS ord, 's' || lang AS text FROM documents UNION ALL SELECT doc_id, quality + 1, 'q' || quality FROM labels")
def summary_plus_chunks_union(read):
    s = read("documents").select("doc_id", F.concat(F.lit("s"), "lang").alias("text"))
    c = read("labels").select("doc_id", F.col("quality").alias("chunk_index"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("text"))
    return envelopes.summary_first(s, c, "doc_id").select("doc_id", "ord", "text")


@query("SELECT doc_id, unnest(['summary', 'text']) AS embedding_type, unnest([lang, source]) AS content FROM documents")
def two_row_expand(read):
    return envelopes.two_rows(read("documents"), "doc_id", "lang", "source")


# ---- assets ----------------------------------------------------------------------------------------------------


def _versions(read) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "active").otherwise("destroyed")
    return read("orders").select(F.col("o_custkey").alias("asset_path"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").cast("timestamp").alias("upload_date"), status.alias("status"))


_VERSIONS = "v AS (SELECT o_custkey AS asset_path, o_orderkey AS version_id, o_orderdate AS upload_date, CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'active' ELSE 'destroyed' END AS status FROM orders)"


@query(f"WITH {_VERSIONS} SELECT asset_path, version_id FROM v WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY asset_path ORDER BY upload_date DESC, version_id DESC) = 1")
def latest_active(read):
    return assets.latest_active(_versions(read), ["asset_path"]).select("asset_path", "version_id")


@query(f"WITH {_VERSIONS} SELECT asset_path, version_id, status FROM v QUALIFY row_number() OVER (PARTITION BY asset_path ORDER BY upload_date DESC, version_id DESC) = 1")
def head_version(read):
    return assets.head_versions(_versions(read), ["asset_path"]).select("asset_path", "version_id", "status")


@query(f"WITH {_VERSIONS} SELECT version_id, epoch_us(upload_date) AS upload_us FROM v WHERE asset_path = 7 AND status = 'active'")
def version_list(read):
    return assets.version_list(_versions(read), "asset_path", 7).select("version_id", F.unix_micros("upload_date").alias("upload_us"))


@query(f"WITH {_VERSIONS} SELECT asset_path, version_id, epoch_us(upload_date + INTERVAL 30 DAY) AS archive_us, epoch_us(upload_date + INTERVAL 75 DAY) AS destroy_us FROM v")
def retention_dates(read):
    out = assets.with_retention(_versions(read), None, 45)
    return out.select("asset_path", "version_id", F.unix_micros("archive_date").alias("archive_us"), F.unix_micros("destroy_date").alias("destroy_us"))


@query(f"WITH {_VERSIONS} SELECT version_id, CASE WHEN status = 'active' AND upload_date + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01' THEN 'archived' ELSE status END AS status FROM v")
def archive_due(read):
    out = assets.archive_due(assets.with_retention(_versions(read)), F.to_timestamp(F.lit("1997-01-01 00:00:00")))
    return out.select("version_id", "status")


@query(f"""WITH {_VERSIONS}, h AS (SELECT asset_path, version_id AS head FROM v QUALIFY row_number() OVER (PARTITION BY asset_path ORDER BY upload_date DESC, version_id DESC) = 1)
SELECT version_id, version_id = head AS drop_object FROM v JOIN h USING (asset_path) WHERE status = 'archived' AND upload_date + INTERVAL 60 DAY <= TIMESTAMP '1997-01-01'""")
def destroy_due(read):
    _, gone = assets.destroy_due(assets.with_retention(_versions(read)), F.to_timestamp(F.lit("1997-01-01 00:00:00")), ["asset_path"])
    return gone.select("version_id", "drop_object")


@query("SELECT o_custkey AS asset_path, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def upsert_latest(read):
    o = read("orders").select(F.col("o_custkey").alias("asset_path"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return vector.latest_by_key(o, ["asset_path"], F.desc("o_orderkey")).select("asset_path", "status")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def permission_check(read):
    users = read("customer").select("c_custkey", F.col("c_nationkey").alias("branch"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("admin"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("list"), F.lit("download"))).otherwise(F.array(F.lit("list"))).alias("permissions"))
    return assets.permitted(users, read("supplier").withColumnRenamed("s_nationkey", "branch"), "download").select("c_custkey", "s_suppkey")


@query("SELECT n_nationkey AS asset_path, r_name AS name, r.r_regionkey AS version FROM nation CROSS JOIN unnest([n_regionkey, 9]) t(x) LEFT JOIN region r ON r.r_regionkey = x")
def exploded_assoc(read):
    files = F.array(F.struct(F.col("n_regionkey").alias("name"), F.lit("v").alias("version")), F.struct(F.lit(9).alias("name"), F.lit("v").alias("version")))
    objects = read("region").select(F.col("r_regionkey").alias("name"), F.lit("v").alias("version"), "r_name", F.col("r_regionkey").alias("found"))
    out = assets.associated(read("nation").select(F.col("n_nationkey").alias("asset_path"), files.alias("associated_filenames")), objects)
    return out.select("asset_path", F.col("r_name").alias("name"), F.col("found").alias("version"))


@query("SELECT event_type AS operation, value > 50 AS success, count(*) AS n FROM events GROUP BY ALL")
def audit_stats(read):
    return assets.audit_stats(read("events").select(F.col("event_type").alias("operation"), (F.col("value") > 50).alias("success")))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def audit_purge(read):
    return assets.purge_audit(read("events"), F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("event_id")


@query("SELECT source AS path, lang AS branch, arg_max(sha256(text), doc_id) AS head FROM documents GROUP BY ALL")
def object_heads(read):
    d = read("documents").select(F.col("source").alias("path"), F.col("lang").alias("branch"), F.sha2("text", 256).alias("version"), F.col("doc_id").alias("ts"))
    return assets.head_versions(d, ["path", "branch"], "ts", "version").select("path", "branch", F.col("version").alias("head"))


# ---- registry --------------------------------------------------------------------------------------------------


def _models(read) -> DataFrame:
    tags = F.create_map(F.lit("inference_task"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.lit("model_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""))
    return read("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"), F.upper("p_type").alias("stage"), tags.alias("tags"), "p_partkey")


@query("""WITH l AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1)
SELECT lower(upper(p_type)) AS stage, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN p_brand END, 'unknown') AS task, count(*) AS n FROM l GROUP BY ALL""")
def stage_distribution(read):
    return registry.stage_distribution(_models(read))


@query("SELECT p_brand AS name, max(p_partkey) AS version FROM part GROUP BY 1")
def latest_model(read):
    return registry.latest_versions(_models(read)).select("name", F.col("version").cast("long").alias("version"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1') AND p_size % 3 <> 0 AND p_type = (SELECT min(p_type) FROM part)")
def registry_search(read):
    kind = read("part").agg(F.min("p_type")).first()[0]
    return registry.search(_models(read), "BRAND#1", {"inference_task": kind}).select("p_partkey")


@query("""WITH e AS (SELECT p_partkey, p_size * 1000000000::BIGINT AS params, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 2.0 END AS pb, p_partkey % 2 = 0 AS external FROM part),
w AS (SELECT *, greatest(64, floor(sqrt(params::DOUBLE) * 0.7)) AS hidden FROM e)
SELECT p_partkey, round((floor(params * pb) + floor(hidden * pb * 2560) + floor(hidden * pb * 4096) + 524288000) / 1073741824.0, 6) AS total_gb,
  round(CASE WHEN external THEN params * 5120.0 / 40e12 * 7.0 + 0.05 ELSE params * 5120.0 / 40e12 * 5.0 END, 6) AS latency_s FROM w""")
def resource_estimate(read):
    p = _estimates(read)
    return p.select("p_partkey", F.round("total_gb", 6).alias("total_gb"), F.round("latency_s", 6).alias("latency_s"))


def _estimates(read) -> DataFrame:
    p = read("part")
    external = F.col("p_partkey") % 2 == 0
    per = S.bytes_per_param(F.when(external, "Q4_0"), F.lit("fp16"))
    est = S.resource_estimate((F.col("p_size") * F.lit(1_000_000_000).cast("long")), F.when(external, "text-generation-ollama").otherwise("text-generation-hf"), per)
    return p.select("p_partkey", est.alias("e")).select("p_partkey", "e.*")


@query("""WITH e AS (SELECT p_partkey, p_size * 1000000000::BIGINT AS params, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 2.0 END AS pb, p_partkey % 2 = 0 AS external FROM part),
w AS (SELECT *, greatest(64, floor(sqrt(params::DOUBLE) * 0.7)) AS hidden FROM e),
t AS (SELECT p_partkey, (floor(params * pb) + floor(hidden * pb * 2560) + floor(hidden * pb * 4096) + 524288000) / 1073741824.0 AS gb,
  CASE WHEN external THEN params * 5120.0 / 40e12 * 7.0 + 0.05 ELSE params * 5120.0 / 40e12 * 5.0 END AS lat FROM w)
SELECT p_partkey, round(0.4 / (gb + 0.1) + 0.4 / (lat + 0.1) + 0.2 / lat, 6) AS score FROM t WHERE gb <= 22.8 AND lat <= 10 ORDER BY score DESC, p_partkey LIMIT 1""")
def select_best(read):
    out = registry.select_best(_estimates(read), 24.0, max_latency=10.0, order="p_partkey")
    return out.select("p_partkey", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE m AS (SELECT p_type AS task, p_partkey AS name, CASE WHEN p_size BETWEEN 1 AND 40 THEN p_size::BIGINT END AS p FROM part),
h AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p, name) AS k, count(*) OVER (PARTITION BY task, p) AS c FROM m WHERE p IS NOT NULL),
r AS (SELECT task, name, k, p AS got, [p] AS used, 1::BIGINT AS free FROM h WHERE k = 1 UNION ALL
  SELECT task, name, k, got, list_append(used, got), CASE WHEN c = 1 THEN free WHEN keeps THEN f ELSE f + 1 END FROM (
    SELECT *, CASE WHEN c = 1 OR keeps THEN p ELSE f END AS got FROM (
      SELECT h.task, h.name, h.k, h.c, h.p, r.used, r.free, NOT list_contains(r.used, h.p) AS keeps, list_filter(range(r.free, r.free + len(r.used) + 2), lambda x: NOT list_contains(r.used, x))[1] AS f
      FROM r JOIN h ON h.task = r.task AND h.k = r.k + 1))),
t AS (SELECT task, max(got) AS top FROM r GROUP BY task)
SELECT task, name, '1' AS version, got::INT AS new_priority FROM r UNION ALL
SELECT m.task, name, '1', (coalesce(top, 0) + row_number() OVER (PARTITION BY m.task ORDER BY name))::INT FROM m LEFT JOIN t ON t.task = m.task WHERE p IS NULL""")
def priority_shift(read):
    p = read("part").select(F.col("p_type").alias("task"), F.col("p_partkey").alias("name"), F.lit("1").alias("version"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("priority"))
    return registry.priorities(p)


@query("SELECT s_nationkey AS node, round(sum(coalesce(s_acctbal, 0)), 2) AS used FROM supplier GROUP BY 1")
def device_totals(read):
    return read("supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.round(F.sum(F.coalesce("s_acctbal", F.lit(0.0))), 2).alias("used"))


@query("SELECT round(sum(coalesce(s_acctbal, 0)), 2) AS total_gb, round(sum(s_suppkey % 16), 2)::DOUBLE AS used_gb, count(*) AS n FROM supplier")
def device_memory(read):
    return registry.device_totals(read("supplier").select(F.col("s_acctbal").alias("total_gb"), (F.col("s_suppkey") % 16).cast("double").alias("used_gb")))


@query("SELECT s_suppkey AS device FROM supplier ORDER BY s_acctbal >= 5000 DESC, s_acctbal DESC, s_suppkey LIMIT 1")
def select_device(read):
    d = read("supplier").select(F.col("s_suppkey").alias("device"), F.col("s_acctbal").alias("free_gb"), F.lit(0.0).alias("load"))
    return registry.select_device(d, 5000.0).select("device")


@query("SELECT p_type AS task, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS engines FROM part GROUP BY 1")
def supported_engines(read):
    out = registry.supported(read("part").select(F.col("p_type").alias("task"), F.col("p_brand").alias("engine")))
    return out.select("task", F.array_join("engines", ",").alias("engines"))


@query("SELECT count_if(o_orderstatus = 'F') AS n_ok, count(*) AS n FROM orders")
def batch_success(read):
    return registry.success_share(read("orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status")))


@query("""WITH f AS (SELECT source AS dataset, lang AS ext, n_chars AS length FROM documents), b AS (SELECT dataset, ext, count(*) AS n, sum(length) AS b FROM f GROUP BY ALL)
SELECT dataset, sum(n)::BIGINT AS n_files, round(sum(b) / 1048576.0, 2) AS size_mb, string_agg(ext || '=' || n, ',' ORDER BY ext) AS extensions FROM b GROUP BY 1""")
def dataset_inventory(read):
    f = read("documents").select(F.col("source").alias("dataset"), F.concat(F.lit("/d/x."), "lang").alias("path"), F.col("n_chars").alias("length"))
    ext = F.array_join(F.transform("extensions", lambda e: F.concat(e.ext, F.lit("="), e.n.cast("string"))), ",")
    return registry.dataset_inventory(f).select("dataset", "n_files", "size_mb", ext.alias("extensions"))


# ---- summaries -------------------------------------------------------------------------------------------------


@query()
def layered_summary(read):
    return summarize.layered_summary(read("conversations"), "conv_id", "turn", "text")


@query()
def batch_summary(read):
    return summarize.batch_summary(read("conversations"), "conv_id", "turn", "text", limit=120)


@query("""WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
l AS (SELECT source, n, 1 AS layers, ceil(n / 5.0)::BIGINT AS items, false AS done FROM c
  UNION ALL SELECT source, n, layers + 1, ceil(items / 4.0)::BIGINT, ceil(items / 4.0) * 512 <= 4800 FROM l WHERE items > 1 AND NOT done)
SELECT source, n, max(layers)::BIGINT AS layers FROM l GROUP BY ALL""")
def summary_layers(read):
    n = read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", S.summary_layers(F.col("n")).alias("layers"))


@query("SELECT user_id, min(k)::BIGINT AS first_page, max(k)::BIGINT AS last_page, count(DISTINCT k) AS n_pages FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def page_range(read):
    rows = read("events").select("user_id", F.array(F.get_json_object("props", "$.k").cast("long")).alias("page_numbers"))
    return summarize.page_range(rows, "user_id")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS values FROM documents GROUP BY 1")
def element_type_union(read):
    out = summarize.union_of(read("documents").select("source", F.array("lang").alias("t")), "source", "t")
    return out.select("source", F.array_join("values", ",").alias("values"))


# ---- engine coverage -------------------------------------------------------------------------------------------


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def cube(read):
    j = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand, p_type, sum(p_size)::BIGINT AS size FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup(read):
    return read("part").rollup("p_brand", "p_type").agg(F.sum("p_size").alias("size"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(read):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return read("lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], a, b).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi(read):
    return read("customer").join(read("orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(read):
    return read("customer").join(read("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT v.event_id, p.purchase FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN p ON p.user_id = v.user_id AND v.ts >= p.ts""")
def asof(read):
    e = read("events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return temporal.as_of(e.where("event_type = 'view'").select("user_id", "ts", "event_id"), bought, "user_id", "ts", "purchase").select("event_id", "purchase")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(read):
    return read("customer").select(F.col("c_nationkey").alias("nation")).intersect(read("supplier").select("s_nationkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_rows(read):
    return read("documents").select("doc_id").subtract(read("labels").select("doc_id"))


@query("""SELECT event_id, round(sum(value) OVER w, 6) AS running, rank() OVER (PARTITION BY user_id ORDER BY event_type)::BIGINT AS rank, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS quarter FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_frames(read):
    by = Window.partitionBy("user_id")
    o = by.orderBy("ts", "event_id")
    return read("events").select("event_id", F.round(F.sum("value").over(o.rowsBetween(-2, 0)), 6).alias("running"), F.rank().over(by.orderBy("event_type")).cast("long").alias("rank"), F.ntile(4).over(o).cast("long").alias("quarter"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(read):
    from quillspark.streaming.flow import tumbling_counts

    return tumbling_counts(read("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_counts(read):
    from quillspark.streaming.flow import session_counts as counts

    return counts(read("events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), "n")


# ---- further coverage ------------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg('- ' || turn || 's: ' || text, chr(10) ORDER BY turn) AS lines FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def scene_lines(read):
    return temporal.text_lines(read("conversations"), "conv_id", "turn", F.col("turn").cast("string"), F.col("text"))


@query("SELECT conv_id, count(*) AS n_segments, count(DISTINCT role) AS n_speakers, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY 1")
def speaker_roster(read):
    out = temporal.speaker_roster(read("conversations"), "conv_id", "role")
    return out.select("conv_id", "n_segments", "n_speakers", F.array_join("speakers", ",").alias("speakers"))


@query("SELECT doc_id, (SELECT round(max(o_totalprice), 2) FROM orders) AS event_summary FROM documents")
def scalar_attach(read):
    one = read("orders").agg(F.round(F.max("o_totalprice"), 2).alias("event_summary"))
    return temporal.attach_scalar(read("documents").select("doc_id"), one)


@query("SELECT o_orderkey AS version_id, CASE WHEN o_custkey = 7 THEN 'archived' ELSE o_orderstatus END AS status FROM orders")
def status_update(read):
    o = read("orders").select(F.col("o_custkey").alias("asset_path"), F.lit(1).alias("version_id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return assets.set_status(o, 7, 1, "archived").select(F.col("k").alias("version_id"), "status")


@query("SELECT o_orderkey FROM orders o ANTI JOIN (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 300000) k USING (o_custkey, o_orderstatus)")
def delete_versions(read):
    o = read("orders").withColumnsRenamed({"o_custkey": "asset_path", "o_orderstatus": "version_id"})
    return assets.delete_versions(o, o.where("o_totalprice > 300000")).select("o_orderkey")


@query("""WITH u AS (SELECT c_custkey AS id, 'user' || (c_custkey % 120) AS username, c_custkey % 3 = 0 AS odd, c_mktsegment = 'BUILDING' AS first FROM customer), old AS (SELECT DISTINCT username FROM u WHERE first)
SELECT id, username, CASE WHEN known THEN 'duplicate user' WHEN odd THEN 'unknown permission' WHEN row_number() OVER (PARTITION BY username, known OR odd ORDER BY id) > 1 THEN 'duplicate user' ELSE 'created' END AS outcome FROM (SELECT *, username IN (SELECT username FROM old) AS known FROM u WHERE NOT first)""")
def user_creation(read):
    c = read("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("user"), (F.col("c_custkey") % 120).cast("string")).alias("username"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("fly"))).otherwise(F.array(F.lit("list"))).alias("permissions"), (F.col("c_mktsegment") == "BUILDING").alias("first"))
    old = c.where("first").dropDuplicates(["username"])
    after, bad = assets.create_users(old, c.where("not first"))
    return after.where("not first").select("id", "username", F.lit("created").alias("outcome")).unionByName(bad.select("id", "username", F.col("error").alias("outcome")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'download' WHEN c_custkey % 4 = 1 THEN 'list' ELSE 'list' END AS permissions FROM customer")
def permission_change(read):
    c = read("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("username"), F.array(F.lit("list")).alias("permissions"))
    changes = c.where("c_custkey % 4 < 2").select("username", F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("download"))).otherwise(F.array(F.lit("admin"))).alias("permissions"))
    return assets.change_permissions(c, changes).select("c_custkey", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT source AS path, string_agg(b, ',' ORDER BY b) AS branches FROM (SELECT source, lang || '=' || max(doc_id) AS b FROM documents GROUP BY source, lang) WHERE starts_with(source, 'src1') GROUP BY 1")
def branch_listing(read):
    d = read("documents").select(F.col("source").alias("path"), F.col("lang").alias("branch"), F.sha2("text", 256).alias("version"), F.col("doc_id").alias("ts"))
    out = assets.branches(d, "src1")
    return out.select("path", F.array_join(F.array_sort(F.transform("branches", lambda b: F.concat(b.branch, F.lit("="), b.ts.cast("string")))), ",").alias("branches"))


@query("""WITH d AS (SELECT source AS path, lang AS branch, sha256(text) AS version, doc_id AS ts, n_chars FROM documents), old AS (SELECT path, branch, version, ts FROM d WHERE n_chars < 2000),
h AS (SELECT path, branch, arg_max(version, (ts, version)) AS head FROM old GROUP BY ALL)
SELECT path, branch, version, ts FROM old UNION ALL
SELECT path, branch, version, ts FROM (SELECT d.path, d.branch, d.version, d.ts, head, row_number() OVER w AS k, lag(version) OVER w AS before FROM d LEFT JOIN h USING (path, branch) WHERE n_chars >= 2000 WINDOW w AS (PARTITION BY d.path, d.branch ORDER BY d.ts, d.version))
WHERE version IS DISTINCT FROM CASE WHEN k = 1 THEN head ELSE before END""")
def object_commit(read):
    d = read("documents").select(F.col("source").alias("path"), F.col("lang").alias("branch"), F.col("text").alias("content"), F.col("doc_id").alias("ts"), "n_chars")
    old = d.where("n_chars < 2000").select("path", "branch", F.sha2("content", 256).alias("version"), "ts")
    return assets.commit(old, d.where("n_chars >= 2000"))


@query("SELECT doc_id AS ts FROM documents WHERE NOT (starts_with(source || '/' || lang, 'src1') AND NOT contains(source || '/' || lang, 'en'))")
def associated_cleanup(read):
    d = read("documents").select(F.concat("source", F.lit("/"), "lang").alias("path"), F.col("doc_id").alias("ts"))
    return assets.drop_associated(d, "src1", "en").select("ts")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def artifact_download(read):
    d = read("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit("c1").alias("commit_id"))
    have = read("labels").select(F.col("doc_id").cast("string").alias("path"), F.lit("c1").alias("commit_id"))
    return assets.missing_artifacts(d, have).select("doc_id")


@query("SELECT p_brand AS name, max(p_partkey) + row_number() OVER (PARTITION BY p_brand ORDER BY s) AS version FROM part, unnest([1, 2]) t(s) GROUP BY p_brand, s")
def version_registration(read):
    old = _models(read).select("name", "version")
    new = old.select("name").distinct().withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return registry.register_version(old.withColumn("fresh", F.lit(0)), new.withColumn("fresh", F.lit(1))).where("fresh = 1").select("name", F.col("version").cast("long").alias("version"))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' AND p_partkey = (SELECT max(p_partkey) FROM part WHERE p_brand = 'Brand#11') THEN 'production'
  WHEN p_brand = 'Brand#11' AND p_size > 25 THEN 'archived' WHEN p_size > 25 THEN 'production' ELSE 'none' END AS stage FROM part""")
def stage_transition(read):
    v = read("part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"), F.when(F.col("p_size") > 25, "production").otherwise("none").alias("stage"))
    top = v.where("name = 'Brand#11'").agg(F.max("p_partkey").alias("k")).first()["k"]
    return registry.transition(v, "Brand#11", str(top), "production").select("p_partkey", "stage")


@query("SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size + 1 ELSE p_size END::INT AS new_priority FROM part")
def priority_insert(read):
    rows, _ = registry.insert_priority(read("part").select("p_partkey", F.col("p_size").alias("new_priority")), 10)
    return rows


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unknown task' WHEN p_size % 4 = 1 THEN 'engine not supported' WHEN p_size % 4 = 2 THEN 'missing: inputs' END AS error FROM part")
def task_compatibility(read):
    from quillspark.functions.models import task_table

    p = read("part")
    k = F.col("p_size") % 4
    data = F.when(k == 2, F.create_map(F.lit("x"), F.lit("1"))).otherwise(F.create_map(F.lit("inputs"), F.lit("1")))
    r = p.select("p_partkey", F.when(k == 0, "fly").otherwise("text-generation").alias("task"), F.when(k == 1, "other").otherwise("ollama").alias("engine"), data.alias("data"))
    return registry.compatible(r, task_table(p.sparkSession)).select("p_partkey", "error")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size / 1000.0 WHEN 2 THEN p_size / 1e6 ELSE 1.0 END AS billions FROM part")
def parameter_sizes(read):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    size = F.when(k == 0, F.concat(n, F.lit("B"))).when(k == 1, F.concat(n, F.lit(" M"))).when(k == 2, F.concat(n, F.lit("K"))).otherwise(F.lit("?"))
    return read("part").select("p_partkey", T.params_in_billions(size).alias("billions"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END::DOUBLE AS per, round(CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END * p_size * 1e9 / 1073741824, 6) AS gb, CASE p_partkey % 3 WHEN 0 THEN 'int8' WHEN 1 THEN 'int8' ELSE 'fp16' END AS precision FROM part""")
def quantisation(read):
    level = S.pick(["Q4_K_M", "q8_0", "odd"], F.col("p_partkey") % 3)
    e = S.explain_quantisation(level, F.col("p_size") * 1e9)
    return read("part").select("p_partkey", e.bytes_per_param.alias("per"), F.round(e.weight_gb, 6).alias("gb"), S.precision_of(level).alias("precision"))


@query("SELECT p_partkey, printf('%.4f', p_retailprice) AS price, p_size::VARCHAR AS size, CASE WHEN p_size > 10 THEN 2 ELSE 1 END + 1 AS n FROM part")
def estimate_tags(read):
    tags = S.estimate_tags({"price": (F.col("p_retailprice"), "double"), "size": (F.col("p_size"), "int"), "big": (F.when(F.col("p_size") > 10, "x"), "text")})
    return read("part").select("p_partkey", tags.alias("t")).select("p_partkey", F.element_at("t", "est_price").alias("price"), F.element_at("t", "est_size").alias("size"), F.size("t").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image' WHEN doc_id % 3 = 1 THEN 'text' ELSE 'multimodal' END AS kind FROM documents")
def dataset_types(read):
    k = F.col("doc_id") % 3
    keys = F.when(k == 0, F.array(F.lit("text"), F.lit("img"))).when(k == 1, F.array(F.lit("sentence"))).otherwise(F.array(F.lit("other")))
    return read("documents").select("doc_id", S.dataset_type(keys).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang <> 'de' THEN lang ELSE source END AS content FROM documents")
def embedding_content(read):
    kind = F.when(F.col("doc_id") % 2 == 0, "summary").otherwise("text")
    return read("documents").select("doc_id", S.content_to_embed(kind, F.when(F.col("lang") != "de", F.col("lang")).otherwise(""), F.col("source")).alias("content"))


@query(r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE trim(regexp_replace(url, '[\\/]+', '/', 'g'), '/') END AS path FROM pages")
def path_sanitise(read):
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/../x"))).otherwise(F.col("url"))
    return read("pages").select("page_id", S.sanitise_path(url).alias("path"))


@query("SELECT page_id, 'a_b_é' || page_id || '.txt' AS name FROM pages")
def name_sanitise(read):
    return read("pages").select("page_id", S.sanitise_name(F.concat(F.lit("dir%2Fa%20b+é"), F.col("page_id").cast("string"), F.lit(".txt"))).alias("name"))


@query("""SELECT conv_id, array_to_string(list_slice(list(role || ':' || n ORDER BY n DESC, role), 1, 2), ',') AS top FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY 1""")
def top_labels(read):
    rows = read("conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("conv_id").agg(F.collect_list(F.struct("role", "n")).alias("l"))
    top = S.top_labels(F.col("l.role"), F.col("l.n"), 2)
    return rows.select("conv_id", F.array_join(F.transform(top, lambda x: F.concat(x.label, F.lit(":"), x.probability.cast("long").cast("string"))), ",").alias("top"))


@query("""SELECT conv_id, concat_ws(' | ', CASE WHEN count(*) FILTER (turn < 2) > 0 THEN 'upper: ' || string_agg(role, ' ' ORDER BY turn) FILTER (turn < 2) END,
  CASE WHEN count(*) FILTER (turn BETWEEN 2 AND 6) > 0 THEN 'middle: ' || string_agg(role, ' ' ORDER BY turn) FILTER (turn BETWEEN 2 AND 6) END,
  CASE WHEN count(*) FILTER (turn > 6) > 0 THEN 'lower: ' || string_agg(role, ' ' ORDER BY turn) FILTER (turn > 6) END) AS text FROM conversations GROUP BY 1""")
def region_text(read):
    items = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("text"), F.col("turn").cast("double").alias("center_y"), F.lit(0.9).alias("score"))))
    return read("conversations").groupBy("conv_id").agg(items.alias("i")).select("conv_id", T.region_text(F.col("i"), F.lit(8.0)).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN right(t, 1) IN ('.', '!', '?') THEN t ELSE t || '.' END AS text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def clean_description(read):
    return read("conversations").select("conv_id", "turn", T.clean_description(F.concat(F.lit("<image>"), "text")).alias("text"))


@query("""SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def grid_markdown(read):
    rows = read("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("c")))).alias("r"))
    return rows.select("r_regionkey", T.grid_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("r", lambda x: x.c))).alias("text"))


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def result_harvest(read):
    rows = read("conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("summary"), "text", F.lit("text").alias("embedding_type"))
    return envelopes.harvest(rows, "conv_id", "document").select("conv_id", "text")


@query("""WITH a AS (SELECT user_id AS key, count(*) AS hits FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT DISTINCT user_id AS key FROM events)
SELECT key, CASE WHEN hits > 0 THEN epoch_us(TIMESTAMP '2024-02-01') // 1000000 + CAST(floor(3600 * (hits * 0.01 + 1) + 1e-9) AS BIGINT) ELSE epoch_us(TIMESTAMP '2024-02-01') // 1000000 + 60 END AS expires FROM c LEFT JOIN a USING (key)""")
def life_extension(read):
    e = read("events").withColumnRenamed("user_id", "key")
    now = F.to_timestamp(F.lit(NOW))
    held = e.select("key").distinct().withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(60)))
    return cache.extend_life(held, e.where("event_type = 'view'"), now).select("key", (F.unix_micros("expires_at") / 1_000_000).cast("long").alias("expires"))


@query("SELECT user_id AS key, count(*) AS hits FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1")
def live_counters(read):
    e = read("events").withColumnRenamed("user_id", "key")
    return cache.live_counters(cache.count_hits(e), e.where("event_type = 'error'").select("key", F.lit(1).alias("expires_at")), F.lit(0))


@query("SELECT user_id AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def cache_put(read):
    e = read("events").withColumnRenamed("user_id", "key")
    now = F.to_timestamp(F.lit(NOW))
    old = vector.latest_by_key(e.where("ts < timestamp_ntz'2024-01-20'"), ["key"], F.desc("ts"), F.desc("event_id")).select("key", "value", now.alias("expires_at"))
    new = vector.latest_by_key(e.where("ts >= timestamp_ntz'2024-01-20'"), ["key"], F.desc("ts"), F.desc("event_id")).select("key", "value")
    return cache.put_many(old, new, now).select("key", "value")


@query("SELECT event_id AS id, event_type AS speaker FROM events")
def payload_normalisation(read):
    e = read("events")
    standard = F.struct(F.lit(0.0).alias("start"), F.col("value").alias("end"), F.col("event_type").alias("speaker"), F.lit("t").alias("text"))
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, standard).alias("payload"), F.lit(0.0).alias("start"), F.col("value").alias("end"), F.col("event_type").alias("speaker"), F.lit("t").alias("text"))
    return envelopes.standard_rows(rows).select("id", "payload.speaker")


@query("SELECT event_id, message_type, event_type AS target, 'MEDIUM' AS priority, user_id::VARCHAR AS correlation, 3600 AS ttl FROM (SELECT *, 'REQUEST' AS message_type FROM events)")
def message_envelope(read):
    m = S.envelope(F.lit("s"), F.col("event_type"), F.lit("REQUEST"), F.struct("value"), F.lit(None).cast("string"), F.col("user_id").cast("string"), F.lit(None).cast("int"), F.to_timestamp(F.lit(NOW)))
    return read("events").select("event_id", m.alias("m")).select("event_id", "m.message_type", F.col("m.target_service").alias("target"), "m.priority", F.col("m.correlation_id").alias("correlation"), "m.ttl")


@query("SELECT s_suppkey AS device, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 END, 0.0) AS load FROM supplier")
def device_monitor(read):
    r = read("supplier").select(F.col("s_suppkey").alias("device"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("a_load"), F.when(F.col("s_suppkey") % 2 == 0, 1.0).alias("b_load"), F.lit(0.0).alias("c_load"))
    return registry.device_readings(r, ["a", "b", "c"], "load").select("device", "load")


@query()
def text_embedding(read):
    from quillspark.functions.models import embed

    return read("conversations").select("conv_id", "turn", F.transform(embed(F.col("text"), dim=64), lambda x: F.round(x.cast("double"), 6)).alias("vec"))


# ---- streams ---------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    from quillspark.streaming import flow

    table = spark.read.parquet(f"{sf}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[:1] and table.inputFiles()[0].endswith("/events.parquet"):  # one file: its folder is watched
        return flow.event_time(reader.option("pathGlobFilter", "events.parquet").parquet(sf))
    return flow.event_time(reader.parquet(f"{sf}/events.parquet"))


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream that carries each of them twice; each comes out once."""
    from quillspark.streaming import flow

    twice = _event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return flow.run_to_files(flow.distinct_messages(twice, "event_id").select("event_id", "user_id", "event_type"), "stream-dedup")


def stream_fanin(spark: SparkSession, sf: str) -> DataFrame:
    """The fan-in of views and clicks per user and day as a stateful stream."""
    from quillspark.streaming import flow

    e = _event_stream(spark, sf)
    day = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    rows = e.select(day.alias("correlation_id"), F.col("event_type").alias("branch"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status"), F.col("event_id").cast("string").alias("result"), "ts", "event_id")
    out = flow.run_to_files(flow.fan_in(rows, ("view", "click"), order="event_id"), "stream-fanin").where("outcome <> 'timeout'")
    return out.select(F.col("key").alias("correlation_id"), "errors")


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as CSV files, with their line breaks and quotes, and read again as text."""
    from quillspark.sources import readers
    from quillspark.streaming import flow

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    folder = f"{flow.shared_folder(spark)}/csv-scan-{uuid.uuid4().hex}"
    docs.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.csv_table(spark, folder).select("doc_id", "lang", "source", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


def sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """A query given as SQL text with parameters, over the supplied tables."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return spark.sql(
        """SELECT n_name AS nation, o_orderstatus AS status, count(*) AS orders, count(DISTINCT o_custkey) AS customers
           FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
           WHERE o_orderstatus <> :without GROUP BY n_name, o_orderstatus""",
        args={"without": "P"}, orders=read("orders"), customer=read("customer"), nation=read("nation"),
    )


_QUERIES |= {"csv_scan": csv_scan, "sql_text": sql_text}
_SQL |= {
    "csv_scan": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, length(nullif(text, ''))::INTEGER AS chars, sha256(nullif(text, '')) AS text_sha256 FROM documents",
    "sql_text": "SELECT n_name AS nation, o_orderstatus AS status, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_name, o_orderstatus",
}


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS users_near, min(value) AS low, true AS median_near, max(value) AS high FROM events GROUP BY event_type")
def approximate_counts(read):
    """Distinct users by sketch and the median by sketch: are they within a tenth of the count, within a hundredth of the ranks?"""
    e = read("events").select("event_type", "user_id", "value")
    about = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", 0.5, 1000).alias("median"))
    exact = e.join(about, "event_type").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"),
        F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"), F.first("about").alias("about"),
    )
    near = (F.col("below") <= F.col("n") * 0.51) & (F.col("upto") >= F.col("n") * 0.49)
    return exact.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.1).alias("users_near"), "low", near.alias("median_near"), "high")


#: Which events stand for which message of a task; the user is the task.
_MESSAGES_OF = {
    "document": {"request": "event_type = 'signup'", "analysis": "event_type = 'view'", "summary": "event_type = 'click'", "save": "event_type = 'purchase'"},
    "audio": {
        "request": "event_type = 'signup'", "asr": "event_type = 'view'", "diarization": "event_type = 'click'", "classification": "event_type = 'error'",
        "summary": "event_type = 'purchase' AND value < 20", "save": "event_type = 'purchase' AND value >= 20",
    },
    "video": {"request": "event_type = 'signup'", "video": "event_type = 'view'", "audio": "event_type = 'click'", "summary": "event_type = 'error'", "save": "event_type = 'purchase'"},
    "image": {"request": "event_type = 'signup'", "description": "event_type = 'view'", "ocr": "event_type = 'click'", "merge": "event_type = 'error'", "save": "event_type = 'purchase'"},
}


def _message_kind(modality: str) -> str:
    return "CASE " + " ".join(f"WHEN {where} THEN '{kind}'" for kind, where in _MESSAGES_OF[modality].items()) + " END"


def _steps_query(modality: str) -> Callable[[SparkSession, str], DataFrame]:
    def steps(spark: SparkSession, sf: str) -> DataFrame:
        from quillspark.streaming import flow

        rows = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("correlation_id"), F.expr(_message_kind(modality)).alias("event"), F.when(F.col("value") > 90, "failed").otherwise("ok").alias("status"), "ts", "event_id")
        out = flow.run_to_files(flow.step_machine(rows, modality, order="event_id"), f"stream-steps-{modality}")
        return out.select(F.col("key").alias("correlation_id"), "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("since"))

    return steps


def _steps_sql(modality: str) -> str:
    """Each step as a query of its own: the first answer of every branch after the step began, and the last of them ends it."""
    from quillspark.streaming import flow

    steps, parallel = flow.STEPS[modality], flow.PARALLEL.get(modality, {})
    parts = [
        f"e AS (SELECT CAST(user_id AS VARCHAR) AS id, struct_pack(t := ts, n := event_id) AS moment, {_message_kind(modality)} AS kind, coalesce(value > 90, false) AS bad FROM events)",
        f"s0 AS (SELECT id, min(moment) AS moment, false AS bad, '{steps[0]}' AS step FROM e WHERE kind = 'request' GROUP BY id)",
    ]
    for k, step in enumerate(steps[:-1]):
        branches = parallel.get(step, (step,))
        among = ", ".join(f"'{b}'" for b in branches)
        parts.append(f"f{k} AS (SELECT e.id, kind, min(e.moment) AS moment, arg_min(e.bad, e.moment) AS bad FROM e JOIN s{k} s ON e.id = s.id AND e.moment > s.moment AND NOT s.bad WHERE kind IN ({among}) GROUP BY e.id, kind)")
        parts.append(f"s{k + 1} AS (SELECT id, max(moment) AS moment, bool_or(bad) AS bad, CASE WHEN bool_or(bad) THEN 'error:{step}' ELSE '{steps[k + 1]}' END AS step FROM f{k} GROUP BY id HAVING count(*) = {len(branches)})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT id AS correlation_id, step, strftime(moment.t, '%Y-%m-%d %H:%M:%S') AS since FROM s{k}" for k in range(len(steps)))


_QUERIES |= {"stream_dedup": stream_dedup, "stream_fanin": stream_fanin} | {f"stream_steps_{m}": _steps_query(m) for m in _MESSAGES_OF}
_SQL |= {f"stream_steps_{m}": _steps_sql(m) for m in _MESSAGES_OF}
_SQL |= {"stream_dedup": "SELECT event_id, user_id, event_type FROM events", "stream_fanin": _SQL["fanin_2"]}

from quillspark.plans import insight, stateful  # noqa: E402, F401  (they register their queries here)
