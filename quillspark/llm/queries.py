"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, importance, langid, merkle, ngram_join, packing, pieces, pii, quality, sharding, substring

#: Bytes of text a shard may hold.
SHARD_BYTES = 512 << 10


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, redact=False).drop("clean_text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_scores(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.duplicate_groups(docs).withColumnRenamed("id", "doc_id")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(_read(spark, sf_dir, "pages"), docs)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, k=4, percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, texts=False).drop("kept_text", "spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, SHARD_BYTES).withColumnRenamed("key", "doc_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(docs, tokenizer_file("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(docs, text=F.replace("text", F.lit("\n"), F.lit(""))))
    rows = merkle.manifest(docs, other=tampered)
    return merkle.verify(rows.withColumn("found", F.coalesce("other", "leaf")), "found").withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _read(spark, sf_dir, "benchmark").select("text"), percent=10, longest=1, least_words=20).drop("n_words")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), ids=False).drop("ids")


def queries() -> dict:
    every = (
        op1_pii, op2_quality, op3_exact_dedup, op4_packing, op5_language_id, op6_ngram_jaccard_join,
        op7_substring_dedup, op8_sharding, op9_embedding_near_dedup, op10_sentencepiece,
        op11_merkle_manifest, op12_importance_resampling, op13_bpe,
    )
    return {f.__name__: f for f in every}


_OP3 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM n
"""


_REACH = """
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
nodes AS (SELECT doc_id AS id FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{_REACH}
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN comp ON comp.id = s.doc_id
"""

_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (gram) WHERE first_doc < g.doc_id) GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM j
"""

_OP9 = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON n.a = comp.id
"""


#: CRC-32 by table, as DuckDB has no such function: ``t`` holds the 256 entries, ``b`` the bytes of a text.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


def _hashed(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in columns) + ")"


_CLIMB = "SELECT tree, level + 1 AS level, pos // 3 AS pos, (n + 2) // 3 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 3, n"
_BESIDE = """SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
  FROM {0} a JOIN {0} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL"""

_OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('.' || source, '') AS tree, {_hashed("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
        CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_hashed("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS other FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM l UNION ALL {_CLIMB.format("up")}),
subroots AS (SELECT tree AS name, digest AS subroot FROM up WHERE n = 1),
top AS (SELECT '' AS tree, 0 AS level, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n, subroot AS digest FROM subroots UNION ALL {_CLIMB.format("top")}),
s AS ({_BESIDE.format("up")}),
t AS ({_BESIDE.format("top")}),
f AS (SELECT doc_id, tree, 0 AS level, pos, coalesce(other, leaf) AS digest, '' AS proof FROM l
      UNION ALL SELECT doc_id, f.tree, f.level + 1, f.pos // 3, sha256(lft || digest || rgt), proof || lft || rgt FROM f JOIN s USING (tree, level, pos)),
groups AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM subroots),
g AS (SELECT doc_id, 0 AS level, g.pos, arg_max(f.digest, f.level) AS digest, arg_max(f.proof, f.level) AS proof FROM f JOIN groups g ON g.name = f.tree GROUP BY doc_id, g.pos
      UNION ALL SELECT doc_id, g.level + 1, g.pos // 3, sha256(lft || digest || rgt), proof || lft || rgt FROM g JOIN t USING (level, pos)),
z AS (SELECT doc_id, arg_max(digest, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM g GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subroots ON name = tree JOIN z USING (doc_id), (SELECT digest AS root FROM top WHERE n = 1)
"""


_OP12 = rf"""
WITH {_CRC_TABLE},
f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
u AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM f) GROUP BY ALL),
v AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM g) GROUP BY w),
every AS (SELECT w FROM u UNION SELECT w FROM v),
b AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM every, crc),
s AS (SELECT bucket, sum(n) AS s FROM u JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM v JOIN b USING (w) GROUP BY bucket),
k AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000)) / ((s::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), k),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM u JOIN b USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM f LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN able USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The fitted, trained or hashed queries (1, 2, 4, 5, 8, 10, 13) have none; tests/llm compares them with plain versions."""
    return {"op3_exact_dedup": _OP3, "op6_ngram_jaccard_join": _OP6, "op7_substring_dedup": _OP7, "op9_embedding_near_dedup": _OP9, "op11_merkle_manifest": _OP11, "op12_importance_resampling": _OP12}
