"""SQL of the catalogue's queries for another engine (DuckDB), written from the operators' definitions."""

from __future__ import annotations

from ..functions.text import NEGATIVE_CONTRACTIONS, STOP_WORDS, _quoted, stem_sql
from ..operators.consolidate import ANTONYMS, INFLECTIONS, REVISION_MARKERS
from ..sources.fixtures import with_views
from .catalogue import _WINDOWS, PLANTED_TEXTS, PLANTED_TURNS, QUESTIONS

_FOLD = "replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def _tokens(x: str) -> str:
    raw = f"regexp_extract_all({_FOLD.format(x=x)}, '[\\p{{L}}\\p{{N}}_'']+')"
    return f"list_filter(list_transform({raw}, lambda w: trim(regexp_replace(w, '''s$|''$|^''', '', 'g'), '''')), lambda w: w <> '')"


def _kept(x: str) -> str:
    folded = f"list_transform({_tokens(x)}, lambda w: CASE WHEN w IN ({_quoted(NEGATIVE_CONTRACTIONS)}) THEN 'not' ELSE w END)"
    return f"list_filter({folded}, lambda w: w NOT IN ({_quoted(STOP_WORDS)}))"


_SHA = "sha256(replace(lower(regexp_replace(trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+', ' ', 'g')), 'ß', 'ss'))"
_STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _bm25(chunks: str, fetch: int) -> str:
    """CTEs from ``chunks`` (memory_id, text): lexical(qid, memory_id, score, rank)."""
    return f"""
words AS (SELECT memory_id, {_kept("text")} AS w FROM ({chunks})),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM words),
tokens AS (SELECT memory_id, len(w) AS length, unnest(w) AS word FROM words),
vocabulary AS (SELECT word, {stem_sql("word")} AS term FROM (SELECT DISTINCT word FROM tokens)),
qwords AS (SELECT item_id AS qid, unnest({_kept("text")}) AS word FROM benchmark),
qterms AS (SELECT DISTINCT qid, {stem_sql("word")} AS term FROM qwords),
tf AS (SELECT memory_id, length, term, count(*) AS tf FROM tokens JOIN vocabulary USING (word) WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT qid, memory_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))) AS s
  FROM tf JOIN df USING (term) JOIN qterms USING (term), stats GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT qid, memory_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, memory_id) AS rank FROM parts) WHERE rank <= {fetch})"""


def _vector(queries: str, k: int, memories: str = "SELECT memory_id, embedding FROM chunks_vec") -> str:
    """CTE vector(qid, memory_id, score, rank)."""
    return f"""
vector AS (SELECT * FROM (SELECT qid, memory_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM (
  SELECT q.qid, m.memory_id, round(list_cosine_similarity(q.embedding, m.embedding), 6) AS score FROM ({queries}) q, ({memories}) m)) WHERE rank <= {k})"""


_FIFTY = "SELECT memory_id AS qid, embedding FROM chunks_vec WHERE memory_id % 50 = 0"
_LIVE = "SELECT id AS memory_id, content AS text FROM memories_text WHERE status = 'active'"
_ASKED = "SELECT item_id AS qid, c.embedding FROM benchmark JOIN chunks_vec c ON c.memory_id = item_id"
_LIVE_VEC = "SELECT c.memory_id, c.embedding FROM chunks_vec c JOIN memories_text m ON m.id = c.memory_id WHERE m.status = 'active'"
_BOTH = with_views("memories_text", "chunks_vec") + "," + _bm25(_LIVE, 60) + "," + _vector(_ASKED, 60, _LIVE_VEC)

_REACH = """
reach AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT r.root, s.nxt, r.depth + 1 FROM reach r JOIN steps s ON s.cur = r.node WHERE r.depth < {depth})"""
_SUPERSEDES = "steps AS (SELECT DISTINCT target_id AS cur, source_id AS nxt FROM edges WHERE type = 'supersedes')"


def _pairs(low: float, high: float, met: str = "a.vec_id % 50 = 0") -> str:
    return f"""pairs AS (SELECT new_id, old_id, sim FROM (SELECT a.vec_id AS new_id, b.vec_id AS old_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {met}) WHERE sim >= {low} AND sim < {high}),
joined AS (SELECT p.*, n.content AS nc, n.occurred_at AS nt, n.tags AS ntags, o.content AS oc, o.occurred_at AS ot, o.tags AS otags, o.status AS ostatus
  FROM pairs p JOIN memories_text n ON n.id = new_id JOIN memories_text o ON o.id = old_id)"""


_NEG = r"regexp_matches({x}, '(?i)\b(not|no|none|never|neither|nor|nobody|nothing|nowhere|cannot)\b|n''t\b')"
_OPPOSED = " OR ".join(
    f"(NOT ({a('nc')} AND {b('nc')}) AND NOT ({a('oc')} AND {b('oc')}) AND (({a('nc')} AND {b('oc')}) OR ({b('nc')} AND {a('oc')})))"
    for yes, no in ANTONYMS
    for a, b in [((lambda x, t=yes: rf"regexp_matches({x}, '(?i)\b{t}{INFLECTIONS}\b')"), (lambda x, t=no: rf"regexp_matches({x}, '(?i)\b{t}{INFLECTIONS}\b')"))]
)
_POLARITY = f"({_NEG.format(x='nc')} <> {_NEG.format(x='oc')} OR {_OPPOSED})"


def _apart(pattern: str, x: str, y: str) -> str:
    m, n = f"regexp_extract_all({x}, '{pattern}', 1)", f"regexp_extract_all({y}, '{pattern}', 1)"
    return f"(len({m}) > 0 AND len({n}) > 0 AND NOT list_has_any({m}, {n}))"


_FIGURES = (
    "("
    + _apart(r"\b(\d[\d,]*(\.\d+)?)\b", "nc", "oc")
    + " OR "
    + _apart(r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", "lower(nc)", "lower(oc)")
    + ")"
)
_MARKED = " OR ".join(f"contains(lower(nc), '{m}')" for m in REVISION_MARKERS)

SQL: dict[str, str] = {}

SQL["filter_memories"] = with_views("memories_text") + f"""
SELECT id, space_id, status, kind, source, {_STAMP.format(x="occurred_at")} AS occurred_at FROM memories_text
WHERE status IN ('active', 'stale') AND kind = 'episodic' AND list_contains(tags, 'quality') AND quality = 1
  AND occurred_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-12-31'"""

SQL["typed_metadata"] = with_views("memories_text") + """
SELECT id, coalesce(quality = 1 AND space_id = 'en' AND length(content) > 1000, false) AS is_all, false AS is_text, false AS is_number, coalesce(quality = 1, false) AS is_said,
  false AS is_boolean, quality IS NULL AND coalesce(length(content) <= 1000, false) AS is_absent FROM memories_text"""

_USAGE = """SELECT {by}, count(*) AS memories, sum(octet_length(encode(content)))::BIGINT AS bytes, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-15') AS recent
FROM memories_text WHERE status <> 'archived' GROUP BY ALL"""
SQL["tenant_usage"] = with_views("memories_text") + _USAGE.format(by="org_id, space_id")
SQL["quota_flags"] = with_views("memories_text") + f"""
SELECT source, memories >= 50 AS over_memories, bytes + 1000 > 100000 AS over_bytes, recent >= 30 AS over_recent FROM ({_USAGE.format(by="source")})"""

SQL["keyset_page"] = with_views("memories_text") + """
SELECT id, space_id, source, (SELECT count(*) FROM memories_text WHERE status = 'active') AS total FROM memories_text WHERE status = 'active' AND id > 100 ORDER BY id LIMIT 25"""

_HASHED = f"SELECT *, {_SHA.format(x='content')} AS sha FROM memories_text WHERE status <> 'archived'"
SQL["exact_dedupe"] = with_views("memories_text") + f"""
SELECT id, sha AS content_sha256, min(id) OVER w AS first_id, id <> min(id) OVER w AS duplicate FROM ({_HASHED}) WINDOW w AS (PARTITION BY space_id, sha)"""
SQL["merge_duplicates"] = with_views("memories_text") + f""", h AS ({_HASHED}),
t AS (SELECT space_id, sha, id, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM h),
u AS (SELECT space_id, sha, tag, min((id, i)) AS spot FROM t GROUP BY ALL),
v AS (SELECT space_id, sha, string_agg(tag, ',' ORDER BY spot, tag) AS tags FROM u GROUP BY ALL)
SELECT m.space_id, m.sha AS content_sha256, m.id, {_STAMP.format(x="m.occurred_at")} AS occurred_at, m.source, m.version, v.tags FROM (
  SELECT space_id, sha, min(id) AS id, max(occurred_at) AS occurred_at, max_by(source, id) AS source, count(*) AS version FROM h GROUP BY ALL) m JOIN v USING (space_id, sha)"""

SQL["token_counts"] = f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens("text")} AS t FROM documents)"""
SQL["analyzed_terms"] = f"""
WITH w AS (SELECT doc_id, unnest({_kept("text")}) AS word FROM documents), v AS (SELECT word, {stem_sql("word")} AS term FROM (SELECT DISTINCT word FROM w))
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w JOIN v USING (word) GROUP BY term"""
SQL["token_estimates"] = f"SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, {_SHA.format(x='text')} AS sha FROM documents"

SQL["bm25_topk"] = with_views("memories_text") + "," + _bm25("SELECT id AS memory_id, content AS text FROM memories_text", 10) + "\nSELECT qid, memory_id, score, rank FROM lexical"
SQL["vector_index_topk"] = with_views("memories_text", "chunks_vec") + "," + _vector(_FIFTY, 10, _LIVE_VEC) + "\nSELECT qid, memory_id, score, rank FROM vector"
SQL["bm25_added_batch"] = SQL["bm25_topk"]
SQL["bm25_filtered_topk"] = with_views("memories_text") + "," + _bm25("SELECT id AS memory_id, content AS text FROM memories_text WHERE status = 'active' AND kind = 'episodic' AND space_id = 'en'", 10) + "\nSELECT qid, memory_id, score, rank FROM lexical"
SQL["vector_topk"] = with_views("chunks_vec") + "," + _vector("SELECT 0 AS qid, embedding FROM chunks_vec WHERE memory_id = 0", 60) + "\nSELECT memory_id, score, rank FROM vector"
SQL["vector_topk_batch"] = with_views("chunks_vec") + "," + _vector(_FIFTY, 10) + "\nSELECT qid, memory_id, score, rank FROM vector"
SQL["best_chunk_per_memory"] = """
SELECT l_orderkey AS memory_id, max(l_extendedprice) AS score, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS ordinal FROM lineitem GROUP BY l_orderkey"""

SQL["hybrid_topk"] = _BOTH + """, fused AS (
  SELECT qid, memory_id, round(sum(part), 9) AS score FROM (
    SELECT qid, memory_id, 1.15::DOUBLE / (60 + rank) AS part FROM vector UNION ALL SELECT qid, memory_id, 1.0::DOUBLE / (60 + rank) FROM lexical) GROUP BY ALL)
SELECT qid, memory_id, score, rank, source FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM fused) JOIN memories_text ON id = memory_id WHERE rank <= 10"""
SQL["weighted_fusion"] = _BOTH + """, normed AS (
  SELECT arm, qid, memory_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v
  FROM (SELECT 'v' AS arm, * FROM vector UNION ALL SELECT 'l', * FROM lexical) WINDOW w AS (PARTITION BY arm, qid)),
fused AS (SELECT qid, memory_id, round(sum(v) / 2, 6) AS score FROM normed GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM fused) WHERE rank <= 20"""
SQL["heuristic_rerank"] = _BOTH + f""", pool AS (SELECT l.qid, l.memory_id, l.score AS prior, w.w FROM lexical l JOIN words w USING (memory_id) WHERE l.rank <= 32),
sized AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM pool),
pt AS (SELECT qid, memory_id, n, term, count(*) AS c FROM (SELECT qid, memory_id, n, unnest(w) AS word FROM sized) JOIN vocabulary USING (word) JOIN qterms USING (qid, term) GROUP BY ALL),
pdf AS (SELECT qid, term, count(*) AS df FROM pt GROUP BY ALL),
base AS (SELECT qid, memory_id, sum(ln(1 + (n + 1)::DOUBLE / (df + 1)) * c / (c + 1.2)) AS b, count(*) AS hit FROM pt JOIN pdf USING (qid, term) GROUP BY ALL),
phrase AS (SELECT qid, string_agg({stem_sql("word")}, ' ' ORDER BY i) AS p FROM (SELECT item_id AS qid, unnest({_kept("text")}) AS word, unnest(range(len({_kept("text")}))) AS i FROM benchmark) GROUP BY qid),
body AS (SELECT qid, memory_id, string_agg(term, ' ' ORDER BY i) AS t FROM (SELECT qid, memory_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM pool) JOIN vocabulary USING (word) GROUP BY ALL),
size AS (SELECT qid, count(*) AS terms FROM qterms GROUP BY qid),
new AS (SELECT s.qid, s.memory_id, s.prior, round(coalesce(b, 0) * (0.5 + 0.5 * coalesce(hit, 0) / terms) * CASE WHEN contains(t, p) THEN 1.35 ELSE 1.0 END + 0.15 * s.prior, 6) AS score
  FROM sized s JOIN size USING (qid) JOIN phrase USING (qid) LEFT JOIN base USING (qid, memory_id) LEFT JOIN body USING (qid, memory_id))
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM new"""

_AGE = "greatest(epoch_us(TIMESTAMP '2001-08-02') - epoch_us(occurred_at), 0) / 86400000000.0"
SQL["recency_decay"] = with_views("memories_order") + f""", f AS (
  SELECT space_id AS qid, id AS memory_id, round(CASE WHEN {_AGE} > 36500 THEN 0.25 ELSE 0.25 + 0.75 * pow(0.5, {_AGE} / 180.0) END, 6) AS score FROM memories_order)
SELECT qid, memory_id, score AS recency, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM f"""
SQL["access_boost"] = "SELECT user_id, count(*) AS n, round(1 + 0.1 * least(ln(1 + count(*)) / ln(21), 1), 6) AS factor FROM events GROUP BY user_id"
_W = ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in _WINDOWS)
SQL["temporal_boost"] = with_views("memories_order") + f"""
SELECT id, label, CASE WHEN out <= 0 THEN 1.25::DOUBLE WHEN out <= 14 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM (
  SELECT id, label, greatest(s - occurred_at::DATE, occurred_at::DATE - e) AS out FROM memories_order, (VALUES {_W}) w(label, s, e))"""
_SCORED = "scored AS (SELECT space_id AS qid, id AS memory_id, n_chars::DOUBLE AS score, m.source, kind FROM memories_text m JOIN documents ON doc_id = id)"
SQL["source_cap"] = with_views("memories_text") + f""", {_SCORED}
SELECT qid, memory_id, source FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, memory_id) AS n FROM scored) WHERE n <= 3"""
SQL["kind_allocation"] = with_views("memories_text") + f""", {_SCORED},
a AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, memory_id) > CASE kind WHEN 'episodic' THEN 6 ELSE 4 END AS spare FROM scored),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spare, score DESC, memory_id) AS n FROM a)
SELECT qid, memory_id, kind, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM b WHERE n <= 10"""
SQL["evidence_budget"] = with_views("chunks_vec") + "," + _vector(_FIFTY, 20) + """
SELECT qid, memory_id, rank FROM (SELECT *, bool_and(score >= 0.8 * top) OVER (PARTITION BY qid ORDER BY rank) AS ok FROM (
  SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top FROM vector)) WHERE ok OR rank <= 2"""
SQL["confidence_grade"] = with_views("chunks_vec") + "," + _vector(_FIFTY, 10) + """,
r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM vector WHERE memory_id <> qid),
g AS (SELECT qid, max(score) FILTER (rank = 1) AS t, max(score) FILTER (rank = 2) AS s, count(*) AS n FROM r GROUP BY qid),
h AS (SELECT qid, t, n, t - coalesce(s, 0) AS m FROM g)
SELECT qid, CASE WHEN t < 0.3 OR (n > 1 AND m < 0.12 * t) THEN 'low' WHEN t >= 0.55 THEN 'high' ELSE 'medium' END AS level, t AS top_score, round(m, 6) AS margin, n AS n_results,
  CASE WHEN t < 0.3 THEN 'weak' WHEN n > 1 AND m < 0.12 * t THEN 'flat' ELSE 'ok' END AS reason FROM h"""

SQL["conflict_pairs"] = with_views("memories_order", "edges") + """
SELECT DISTINCT a.space_id AS qid, least(source_id, target_id) AS left_id, greatest(source_id, target_id) AS right_id
FROM edges JOIN memories_order a ON a.id = source_id JOIN memories_order b ON b.id = target_id AND a.space_id = b.space_id WHERE type = 'contradicts'"""
SQL["suppress_superseded"] = with_views("memories_order", "edges", recursive=True) + f""", {_SUPERSEDES}, {_REACH.format(depth=20)}
SELECT space_id AS qid, id AS memory_id FROM memories_order m WHERE status <> 'superseded' AND NOT EXISTS (
  SELECT 1 FROM reach r JOIN memories_order o ON o.id = r.node WHERE r.root = m.id AND r.node <> m.id AND o.space_id = m.space_id)"""
SQL["lineage_head"] = with_views("edges", recursive=True) + """,
steps AS (SELECT target_id AS cur, source_id AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY created_at, source_id) AS n FROM edges WHERE type = 'supersedes') WHERE n = 1),
walk AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT root, nxt, depth + 1 FROM walk JOIN steps ON cur = node WHERE depth < 20)
SELECT root, arg_max(node, depth) AS head, max(depth) AS depth FROM walk GROUP BY root"""
SQL["reachable_superseders"] = with_views("edges", recursive=True) + f""", {_SUPERSEDES}, {_REACH.format(depth=20)}
SELECT root, node, min(depth) AS depth FROM reach WHERE node <> root GROUP BY ALL"""
SQL["bridge_on_delete"] = with_views("memories_order", "edges") + """, s AS (SELECT * FROM edges WHERE type = 'supersedes'),
made AS (SELECT a.source_id, b.target_id, max(least(a.confidence, b.confidence)) AS c FROM s a JOIN s b ON a.target_id = b.source_id JOIN memories_order m ON m.id = a.target_id AND m.tag = '1-URGENT'
  WHERE a.source_id <> b.target_id GROUP BY ALL)
SELECT source_id, target_id, round(c, 6) AS confidence FROM made WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = made.source_id AND s.target_id = made.target_id)"""
SQL["stale_propagation"] = with_views("memories_order", "edges", recursive=True) + """,
steps AS (SELECT DISTINCT target_id AS cur, source_id AS nxt FROM edges WHERE type = 'derived_from'),
hit AS (SELECT id AS root, id AS node, 0 AS depth FROM memories_order WHERE status = 'superseded' UNION SELECT root, nxt, depth + 1 FROM hit JOIN steps ON cur = node WHERE depth < 20)
SELECT id FROM memories_order WHERE status = 'active' AND id IN (SELECT node FROM hit WHERE node <> root)"""
SQL["dependency_closure"] = with_views("edges", recursive=True) + f""",
steps AS (SELECT DISTINCT source_id AS cur, target_id AS nxt FROM edges WHERE type IN ('depends_on', 'derived_from')), {_REACH.format(depth=2)}
SELECT root, node, min(depth) AS depth FROM reach WHERE node <> root GROUP BY ALL"""
SQL["limited_closure"] = with_views("edges", recursive=True) + f""",
steps AS (SELECT DISTINCT source_id AS cur, target_id AS nxt FROM edges WHERE type IN ('depends_on', 'derived_from')), {_REACH.format(depth=5)},
whole AS (SELECT root, node, min(depth) AS depth FROM reach WHERE node <> root GROUP BY ALL)
SELECT root, node, depth, count(*) OVER (PARTITION BY root) > 3 AS truncated FROM whole QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, node) <= 3"""
SQL["graph_profile"] = with_views("memories_order", "edges") + """
SELECT 'status' AS measure, status AS key, count(*) AS n FROM memories_order GROUP BY ALL
UNION ALL SELECT 'edge', type, count(*) FROM edges WHERE type <> 'contradicts' OR source_id < target_id GROUP BY ALL
UNION ALL SELECT 'isolated', 'all', count(*) FROM memories_order WHERE id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)"""
SQL["node_degrees"] = with_views("edges") + """, once AS (SELECT * FROM edges WHERE type <> 'contradicts' OR source_id < target_id)
SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM once UNION ALL SELECT target_id FROM once) GROUP BY id"""

SQL["as_of_snapshot"] = with_views("versions") + f"""
SELECT memory_id, version, content, {_STAMP.format(x="valid_from")} AS valid_from, {_STAMP.format(x="valid_to")} AS valid_to FROM versions
WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY version DESC) = 1"""
SQL["as_of_join"] = with_views("versions") + """
SELECT e.event_id AS qid, v.memory_id, max(v.version) AS version FROM events e JOIN versions v ON v.memory_id = e.user_id AND v.valid_from <= e.ts - INTERVAL 1 HOUR
  AND (v.valid_to IS NULL OR e.ts - INTERVAL 1 HOUR < v.valid_to) GROUP BY ALL"""
SQL["scd2_history"] = with_views("versions") + f""",
w AS (SELECT memory_id, (version + 1) // 2 AS version, arg_max(content, version) AS content, min(valid_from) AS valid_from FROM versions GROUP BY memory_id, (version + 1) // 2)
SELECT memory_id, version::INTEGER AS version, content, {_STAMP.format(x="valid_from")} AS valid_from, {_STAMP.format(x="lead(valid_from) OVER (PARTITION BY memory_id ORDER BY version)")} AS valid_to FROM w"""
_WRITES = """, m AS (SELECT space_id, id, status, md5(content) AS content FROM memories_text WHERE id % 7 <> 0),
w AS (
  SELECT space_id, id, 1 AS version, status, content, 1 AS d FROM m UNION ALL SELECT space_id, id, 2, 'stale', 'second', 2 FROM m WHERE id % 3 = 0
  UNION ALL SELECT space_id, id, 2, 'active', 'third', 3 FROM m WHERE id % 6 = 0 UNION ALL SELECT space_id, id, 3, status, 'fifth', 5 FROM m WHERE id % 10 = 0
)"""
SQL["logged_history"] = with_views("memories_text") + _WRITES + f""",
one AS (SELECT space_id, id, version, max_by(status, d) AS status, max_by(content, d) AS content, min(d) AS a, max(d) AS z FROM w GROUP BY ALL),
ends AS (SELECT *, CASE WHEN id % 5 = 0 AND z < 4 THEN 4 END AS cut, lead(a) OVER (PARTITION BY space_id, id ORDER BY version) AS b FROM one),
t AS (SELECT *, CASE WHEN b IS NULL OR cut < b THEN cut ELSE b END AS e FROM ends)
SELECT space_id, id, version, status, content, {_STAMP.format(x="TIMESTAMP '2024-12-31' + a * INTERVAL 1 DAY")} AS valid_from, {_STAMP.format(x="TIMESTAMP '2024-12-31' + e * INTERVAL 1 DAY")} AS valid_to FROM t"""
SQL["logged_snapshots"] = with_views("memories_text") + _WRITES + """
SELECT 0 AS snapshot, space_id, id, version, content FROM w WHERE id % 5 <> 0 OR d = 5 QUALIFY row_number() OVER (PARTITION BY space_id, id ORDER BY d DESC) = 1
UNION ALL SELECT 2, space_id, id, version, content FROM (SELECT space_id, id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN id % 3 = 0 THEN 'second' ELSE md5(content) END AS content FROM memories_text)"""
SQL["erase_report"] = with_views("memories_order", "edges", "versions") + """, gone AS (SELECT id FROM memories_order WHERE tag = '1-URGENT'), s AS (SELECT * FROM edges WHERE type = 'supersedes'),
made AS (SELECT DISTINCT a.source_id, b.target_id FROM s a JOIN s b ON a.target_id = b.source_id WHERE a.target_id IN (FROM gone) AND a.source_id <> b.target_id)
SELECT (SELECT count(*) FROM gone) AS memories, (SELECT count(*) FROM versions WHERE memory_id IN (FROM gone)) AS versions,
  (SELECT count(*) FROM edges WHERE source_id IN (FROM gone) OR target_id IN (FROM gone)) AS edges,
  (SELECT count(*) FROM made WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = made.source_id AND s.target_id = made.target_id)) AS bridged"""

SQL["near_duplicate_pairs"] = with_views("memories_text") + f""", {_pairs(0.25, 2)}
SELECT new_id, old_id, round(sim, 6) AS sim FROM pairs QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) = 1"""
#: Every memory is a new one here; which old ones the rule takes is asked before the cosines too.
_REPLACEABLE = "b.vec_id IN (SELECT id FROM memories_text WHERE status = 'active' AND length(content) <= 500)"
SQL["supersession_proposals"] = with_views("memories_text") + f""", {_pairs(0.1, 0.97, _REPLACEABLE)}
SELECT new_id, old_id, round(sim, 6) AS sim, round(least(0.99, 0.35 + 0.45 * (sim - 0.1) / (0.97 - 0.1)::DOUBLE + CASE WHEN {_MARKED} THEN 0.15 ELSE 0 END
  + CASE WHEN {_NEG.format(x="nc")} THEN 0.05 ELSE 0 END + CASE WHEN list_has_any(ntags, otags) THEN 0.05 ELSE 0 END), 6) AS confidence
FROM joined WHERE ostatus = 'active' AND length(oc) <= 500 AND ot < nt"""
SQL["contradiction_proposals"] = with_views("memories_text") + f""", {_pairs(0.1, 0.97)},
m AS (SELECT *, {_POLARITY} AS polarity, {_FIGURES} AS figures, least(0.45 + 0.2 * (sim - 0.1) / (0.97 - 0.1)::DOUBLE, 0.95) AS v FROM joined WHERE ostatus = 'active')
SELECT new_id AS left_id, old_id AS right_id, round(sim, 6) AS sim, polarity, figures, round(CASE WHEN polarity AND figures THEN least(v + 0.2, 0.95) ELSE v END, 6) AS confidence
FROM m WHERE polarity OR figures"""
SQL["unexplained_pairs"] = with_views("memories_text") + f""", {_pairs(0.1, 0.97)}
SELECT new_id, old_id, round(sim, 6) AS sim FROM joined WHERE ostatus = 'active' AND NOT ({_POLARITY} OR {_FIGURES})"""
_CONTENT = "regexp_extract_all(" + _FOLD.format(x="content") + ", '[a-z0-9]+')"
SQL["jaccard_dedupe"] = with_views("memories_text", recursive=True) + f""",
raw AS (SELECT space_id AS qid, id AS seq, CAST(occurred_at AS DATE) AS d, list_distinct({_CONTENT}) AS w FROM memories_text),
few AS (SELECT *, list_filter(w, lambda x: x NOT IN ({_quoted(STOP_WORDS)})) AS f FROM raw),
told AS (SELECT qid, seq, d, CASE WHEN len(f) > 0 THEN f ELSE w END AS w FROM few),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, d ORDER BY seq) AS i FROM told WHERE len(w) > 0),
walk AS (
  SELECT qid, d, seq, i, [w] AS kept, true AS stays FROM f WHERE i = 1
  UNION ALL
  SELECT qid, d, seq, i, CASE WHEN alike THEN kept ELSE list_append(kept, w) END, NOT alike FROM (
    SELECT f.*, walk.kept, len(list_filter(walk.kept, lambda k: len(list_intersect(k, f.w))::DOUBLE / (len(k) + len(f.w) - len(list_intersect(k, f.w))) >= 0.6)) > 0 AS alike
    FROM walk JOIN f ON f.qid IS NOT DISTINCT FROM walk.qid AND f.d IS NOT DISTINCT FROM walk.d AND f.i = walk.i + 1)
)
SELECT qid, seq FROM walk WHERE stays UNION ALL SELECT qid, seq FROM told WHERE len(w) = 0"""
SQL["association_edges"] = with_views("memories_text") + f""", {_pairs(0.1, 0.97)}
SELECT new_id AS left_id, old_id AS right_id, round(sim, 6) AS sim, 1 AS weight, round(least(1.0, 0.65 + 0.2 * sim), 6) AS confidence FROM joined
WHERE ostatus = 'active' AND list_has_any(ntags, otags) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) <= 4"""

_TURN = " ".join(f"WHEN {i} THEN {t}::DOUBLE" for i, t in enumerate(PLANTED_TURNS))
_BEFORE, _AFTER = (" ".join(f"WHEN {i} THEN '{t[k]}'" for i, t in enumerate(PLANTED_TEXTS)) for k in (0, 1))


def _planted(low: float, high: float | None) -> str:
    """CTEs pairs and joined of the planted memories with all others, in [low, high)."""
    n, k = len(PLANTED_TURNS), len(PLANTED_TEXTS)
    return f"""turned AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE vec_id % {n} {_TURN} END AS t FROM embeddings),
pv AS (SELECT vec_id + 1000000 AS id, list_transform(range(1, len(e) + 1), lambda i: e[i] + t * e[len(e) + 1 - i]) AS e FROM turned),
pm AS (SELECT id + 1000000 AS id, (CASE id % {k} {_BEFORE} END) || content || (CASE id % {k} {_AFTER} END) AS content, occurred_at + INTERVAL 1 DAY AS occurred_at, tags FROM memories_text),
pairs AS (SELECT new_id, old_id, sim FROM (SELECT p.id AS new_id, t.vec_id AS old_id, round(list_cosine_similarity(p.e, t.e), 9) AS sim FROM pv p, turned t) WHERE sim >= {low}{f" AND sim < {high}" if high else ""}),
joined AS (SELECT p.*, n.content AS nc, n.occurred_at AS nt, n.tags AS ntags, o.content AS oc, o.occurred_at AS ot, o.tags AS otags, o.status AS ostatus
  FROM pairs p JOIN pm n ON n.id = new_id JOIN memories_text o ON o.id = old_id)"""


_DIGITS = r"list_sort(list_distinct(regexp_extract_all({x}, '\b\w*\d[\w.-]*\b')))"
SQL["planted_near_duplicates"] = with_views("memories_text") + f""", {_planted(0.97, None)}
SELECT new_id, old_id, round(sim, 6) AS sim FROM joined WHERE {_DIGITS.format(x="nc")} = {_DIGITS.format(x="oc")} QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) = 1"""
SQL["planted_supersessions"] = with_views("memories_text") + f""", {_planted(0.72, 0.97)}
SELECT new_id, old_id, round(sim, 6) AS sim, round(least(0.99, 0.35 + 0.45 * (sim - 0.72) / (0.97 - 0.72)::DOUBLE + CASE WHEN {_MARKED} THEN 0.15 ELSE 0 END
  + CASE WHEN {_NEG.format(x="nc")} THEN 0.05 ELSE 0 END + CASE WHEN list_has_any(ntags, otags) THEN 0.05 ELSE 0 END), 6) AS confidence
FROM joined WHERE ostatus = 'active' AND length(oc) <= 500 AND ot < nt"""
SQL["planted_contradictions"] = with_views("memories_text") + f""", {_planted(0.82, 0.97)},
m AS (SELECT *, {_POLARITY} AS polarity, {_FIGURES} AS figures, least(0.45 + 0.2 * (sim - 0.82) / (0.97 - 0.82)::DOUBLE, 0.95) AS v FROM joined WHERE ostatus = 'active')
SELECT new_id AS left_id, old_id AS right_id, round(sim, 6) AS sim, polarity, figures, round(CASE WHEN polarity AND figures THEN least(v + 0.2, 0.95) ELSE v END, 6) AS confidence
FROM m WHERE polarity OR figures"""
SQL["planted_unexplained"] = with_views("memories_text") + f""", {_planted(0.82, 0.97)}
SELECT new_id, old_id, round(sim, 6) AS sim FROM joined WHERE ostatus = 'active' AND NOT ({_POLARITY} OR {_FIGURES})"""
SQL["planted_associations"] = with_views("memories_text") + f""", {_planted(0.45, 0.97)}
SELECT new_id AS left_id, old_id AS right_id, round(sim, 6) AS sim, 1 AS weight, round(least(1.0, 0.65 + 0.2 * sim), 6) AS confidence FROM joined
WHERE ostatus = 'active' AND sim >= 0.6 AND list_has_any(ntags, otags) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY sim DESC, old_id) <= 4"""

_WALK = """{n}_steps AS (SELECT {a} AS cur, {b} AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY created_at, {b}) AS n FROM edges WHERE type = 'supersedes') WHERE n = 1),
{n}_walk AS (SELECT o_orderkey AS root, o_orderkey AS node, []::BIGINT[] AS path, 0 AS depth FROM orders
  UNION ALL SELECT root, nxt, list_append(path, nxt), depth + 1 FROM {n}_walk JOIN {n}_steps ON cur = node WHERE depth < 20),
{n} AS (SELECT root, arg_max(path, depth) AS path FROM {n}_walk GROUP BY root)"""
SQL["whole_lineage"] = with_views("edges", recursive=True) + ", " + _WALK.format(n="up", a="target_id", b="source_id") + ", " + _WALK.format(n="down", a="source_id", b="target_id") + """
SELECT up.root, array_to_string(down.path, ',') AS ancestors, array_to_string(up.path, ',') AS successors, len(up.path) = 0 AS is_current, coalesce(up.path[-1], up.root) AS head FROM up JOIN down USING (root)"""
SQL["upserted_memories"] = with_views("memories_text") + """, i AS (SELECT id * 2 AS id, 'stale' AS status, (id % 4)::INTEGER AS version FROM memories_text WHERE id % 3 = 0)
SELECT id, CASE WHEN i.version >= 2 OR m.id IS NULL THEN i.status ELSE m.status END AS status, CASE WHEN i.version >= 2 OR m.id IS NULL THEN i.version ELSE 2 END AS version
FROM memories_text m FULL JOIN i USING (id)"""
SQL["benchmark_quotes"] = """
SELECT item_id, doc_id FROM (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark) JOIN (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) ON q <> '' AND contains(t, q)"""

SQL["turn_neighbours"] = """
SELECT conv_id AS session_id, turn, len(coalesce(b, [])) AS n_before, len(coalesce(a, [])) AS n_after, sha256(coalesce(array_to_string(b, chr(10)), '')) AS before_sha, sha256(coalesce(array_to_string(a, chr(10)), '')) AS after_sha
FROM (SELECT conv_id, turn, list(text) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, list(text) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
SQL["classify_questions"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k, _, _, _) in enumerate(QUESTIONS)) + ") t(qid, kind)"
SQL["question_windows"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {repr(a) if a else 'NULL'}, {repr(b) if b else 'NULL'})" for i, (_, _, _, a, b) in enumerate(QUESTIONS)) + ") t(qid, start_day, end_day)"
SQL["derive_reduce"] = """
WITH r AS (SELECT user_id AS qid, event_id AS seq, ts::DATE AS d, event_type AS fact FROM events),
g AS (SELECT qid, count(*) AS n, min(d) AS low, max(d) AS high, count(DISTINCT d) AS days, arg_min(fact || ' (' || d || ')', (d, seq)) AS first, string_agg(fact, '; ' ORDER BY seq) AS listed FROM r GROUP BY qid)
SELECT qid, CASE qid % 4 WHEN 0 THEN CASE WHEN n >= 2 THEN n::VARCHAR END WHEN 1 THEN first WHEN 2 THEN CASE WHEN days >= 2 THEN ((high - low) // 7)::VARCHAR || ' weeks' END ELSE listed END AS answer, n FROM g"""
_COLLAPSED = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
SQL["ground_quotes"] = f"""
WITH q AS (SELECT doc_id, substr(text, 10, 60) AS quote FROM documents), r AS (SELECT doc_id AS source_id, doc_id AS quoted_id, quote FROM q UNION ALL SELECT doc_id + 1, doc_id, quote FROM q)
SELECT source_id, quoted_id FROM r JOIN documents s ON s.doc_id = source_id WHERE quote <> '' AND contains({_COLLAPSED.format(x="s.text")}, {_COLLAPSED.format(x="quote")})"""
SQL["retrieval_metrics"] = with_views("chunks_vec") + "," + _vector(_FIFTY, 11) + """,
f AS (SELECT qid, memory_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM vector WHERE memory_id <> qid),
t AS (SELECT f.qid, f.r, a.label = b.label AS good FROM f JOIN embeddings a ON a.vec_id = f.qid JOIN embeddings b ON b.vec_id = f.memory_id WHERE f.r <= 10),
g AS (SELECT q.vec_id AS qid, count(*) AS n FROM embeddings q JOIN embeddings o ON o.label = q.label AND o.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT qid, round(count(*) FILTER (good) / any_value(n)::DOUBLE, 6) AS recall, CASE WHEN bool_or(good) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(1.0::DOUBLE / min(r) FILTER (good), 0), 6) AS mrr,
  round(coalesce(sum(1 / log2(r + 1)) FILTER (good), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(any_value(n), 10) + 1) x(i)), 6) AS ndcg,
  CASE WHEN count(*) FILTER (good) = any_value(n) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS full_recall
FROM t JOIN g USING (qid) GROUP BY qid"""
_Z = 1.959963984540054
SQL["wilson_by_category"] = with_views("memories_text") + f""", c AS (SELECT space_id, sum(quality)::BIGINT AS good, count(*) AS n, sum(quality)::DOUBLE / count(*) AS p FROM memories_text WHERE quality IS NOT NULL GROUP BY space_id),
i AS (SELECT *, (p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) AS mid, {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n) AS half FROM c)
SELECT space_id, good, n, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM i"""
SQL["retrieval_by_label"] = f"""
WITH m AS ({SQL["retrieval_metrics"]}), c AS (
  SELECT label AS category, count(*) AS n, sum(full_recall) AS good, avg(full_recall) AS f, avg(hit) AS h, avg(mrr) AS r, sum(full_recall) / count(*) AS p FROM m JOIN embeddings ON vec_id = qid GROUP BY label),
i AS (SELECT *, (p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) AS mid, {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n) AS half FROM c)
SELECT category, n, round(f, 4) AS full_recall, round(greatest(0, mid - half), 4) AS full_low, round(least(1, mid + half), 4) AS full_high, round(h, 4) AS hit, round(r, 4) AS mrr FROM i"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL expresses."""
    return dict(SQL)
