"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, repair_conversations
from .decontaminate import scan_contamination
from .divergence import source_divergence
from .embedding_dedup import embedding_links
from .line_dedup import remove_fuzzy_lines
from .mixing import mix_copies, word_count
from .packing import pack_tokens
from .quality import score_quality
from .sharding import shard_by_bytes
from .simhash import simhash_classes
from .substring import remove_repeats
from .suffix_array import remove_repeated_bytes
from .url_filter import UrlRule, apply_url_rules, rules_table


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_shard_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard_by_bytes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors at cosine 0.95."""
    return embedding_links(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    classes = simhash_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_ri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("w"))
    plan = mix_copies(docs, size=F.col("w"))
    return plan.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op6_pack_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed rows of 2048."""
    return pack_tokens(_read(spark, sf_dir, "documents"))


def op7_lines_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line or nearly."""
    return remove_fuzzy_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


#: Rules of the URL query: fixed values.
URL_RULES = [
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
]


def op8_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return apply_url_rules(pages, rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op9_substring_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier run of 20."""
    return remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_decontaminate_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hit."""
    found = scan_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_suffix_pfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 200 that stand elsewhere too."""
    found = remove_repeated_bytes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_conversation_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return repair_conversations(damaged(_read(spark, sf_dir, "conversations")), copies=F.col("copies"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of every source's words from its language and the other sources."""
    return source_divergence(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, folder of tables)."""
    listed = [op1_shard_kk, op2_embedding_hnsw, op3_simhash_gray, op4_quality_ri, op5_mix_pivotal, op6_pack_bfd, op7_lines_minhash, op8_url_bloom, op9_substring_seeds, op10_decontaminate_ac, op11_suffix_pfp, op12_conversation_dp, op13_divergence, pipeline]
    return {f.__name__: f for f in listed}


_OP2 = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id
"""

_OP8 = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE n = 1
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS gram FROM d, unnest(generate_series(1, len(w) - 19)) AS t(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM later, unnest(generate_series(0, 19)) AS t(o)),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(generate_series(1, len(w))) AS t(i)),
kept AS (
  SELECT doc_id, count(g2.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g2.i IS NULL), '') AS kept
  FROM words LEFT JOIN (SELECT doc_id AS gd, i FROM gone) g2 ON gd = doc_id AND g2.i = words.i GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""".replace("ORDER BY i) FILTER", "ORDER BY words.i) FILTER")

_OP10 = r"""
WITH low AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(p) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(p)),
hits AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM g JOIN win ON win.n = g.n AND win.gram = g.gram),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + o AS i FROM hits, unnest(generate_series(0, n - 1)) AS t(o)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT r, p, md5(substr(x, 2 * p - 1, 400)) AS gram FROM d, unnest(generate_series(1, CAST(length(x) // 2 - 199 AS BIGINT))) AS t(p)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
edge AS (SELECT r, p, CASE WHEN lag(p) OVER w >= p - 200 THEN 0 ELSE 1 END AS new FROM again WINDOW w AS (PARTITION BY r ORDER BY p)),
run AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM edge) GROUP BY r, k),
part AS (SELECT r, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY a) AS before FROM run),
kept AS (SELECT d.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, CAST(2 * before - 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(x), CAST(2 * max(b) - 1 AS BIGINT)) AS left_ FROM part JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT d.lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v, (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = d.lang) AS n FROM (SELECT DISTINCT lang FROM d) d),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, v.v, v.n AS ln, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) m USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (g.ln + 5 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; the others are tested against brute force."""
    return {"op2_embedding_hnsw": _OP2, "op8_url_bloom": _OP8, "op9_substring_seeds": _OP9, "op10_decontaminate_ac": _OP10, "op11_suffix_pfp": _OP11, "op13_divergence": _OP13}
