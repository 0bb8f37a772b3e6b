"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from corvane.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tok(x: str) -> str:
    """Tokens: whole runs of letters and digits of any script that are ASCII throughout."""
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-zA-Z0-9_]+'))"


def _ascii(x: str) -> str:
    return f"coalesce(length(regexp_replace({x}, '[\\x00-\\x7F]+', '', 'g')) / nullif(length({x}), 0), 0.0)"


_TEXT = f"""
m AS (
  SELECT doc_id, text, {_tok('text')} AS toks, {_ascii('text')} AS nonascii,
         list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS sents
  FROM documents),
x AS (
  SELECT doc_id, text, len(toks) AS n, nonascii,
         coalesce(len(list_filter(toks, lambda t: list_contains({_STOP}, t))) / nullif(len(toks), 0), 0.0) AS stop,
         CASE WHEN len(sents) = 0 THEN len(toks)::DOUBLE ELSE list_sum(list_transform(sents, lambda q: len({_tok('q')}))) / len(sents) END AS sent
  FROM m)
"""

_QUALITY = f"""{_TEXT},
sc AS (
  SELECT *, 0.40 * CASE WHEN sent < 3 THEN 0.10 WHEN sent < 8 THEN 0.50 + (sent - 3) * 0.08::DOUBLE WHEN sent <= 25 THEN 1.0 WHEN sent <= 50 THEN 1.0 - (sent - 25) * 0.020::DOUBLE ELSE 0.30 END::DOUBLE
         + 0.30 * greatest(0.0, 1.0 - nonascii * 6.0)::DOUBLE
         + 0.30 * CASE WHEN stop < 0.10 THEN 0.40 WHEN stop < 0.20 THEN 0.70 WHEN stop <= 0.55 THEN 1.0 WHEN stop <= 0.75 THEN 1.0 - (stop - 0.55) * 2.0 ELSE 0.20 END::DOUBLE AS raw
  FROM x),
quality AS (
  SELECT doc_id AS chunk_id,
         CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, round(raw, 4))) END::DOUBLE AS quality_score,
         CASE WHEN n = 0 THEN 0.0 ELSE round(sent, 2) END::DOUBLE AS mean_sent_len,
         CASE WHEN NOT regexp_matches(text, '\\S') THEN 1.0 WHEN n = 0 THEN nonascii ELSE round(nonascii, 4) END::DOUBLE AS nonascii_ratio,
         CASE WHEN n = 0 THEN 0.0 ELSE round(stop, 4) END::DOUBLE AS stopword_ratio
  FROM sc)
"""

_SCORES = f"""
dt AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
qt AS (SELECT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark),
terms AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM df),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
hit AS (SELECT query_id, doc_id, qtf, tf, dl, idf FROM tf JOIN terms USING (term) JOIN stats USING (term)),
found AS (
  SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(toks)) FROM dt)))) AS score, sum(qtf * tf)::DOUBLE AS dot
  FROM hit GROUP BY ALL),
allp AS (
  SELECT q.query_id, d.doc_id, coalesce(f.score, 0.0) AS score, coalesce(f.dot, 0.0) AS dot, f.doc_id IS NOT NULL AS held
  FROM (SELECT DISTINCT query_id FROM terms) q CROSS JOIN documents d LEFT JOIN found f USING (query_id, doc_id)),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM allp),
dots AS (SELECT query_id, doc_id, dot, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, doc_id) AS rank FROM allp WHERE held)
"""


def _fuse(k: int = 60, n: int = 10, name: str = "fused") -> str:
    return f"""
{name} AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, no, first, doc_id) AS rank FROM (
      SELECT query_id, doc_id, sum(1.0::DOUBLE / ({k} + rank)) AS score, min(no) AS no, arg_min(rank, no) AS first FROM (
        SELECT query_id, doc_id, rank, 0 AS no FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank, 1 FROM dots WHERE rank <= 100)
      GROUP BY query_id, doc_id)) WHERE rank <= {n})
"""


_QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id, 1 AS label FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _metrics(ranked: str, qrels: str, keys: str, doc: str = "doc_id") -> str:
    """A query over the CTEs ``ranked`` (keys, doc, rank) and ``qrels``."""
    on = keys.split(", ")[-1]
    return f"""
pos AS (
  SELECT r.*, row_number() OVER (PARTITION BY {keys} ORDER BY rank, {doc}) AS pos, coalesce(l.label, 0) AS label
  FROM {ranked} r LEFT JOIN {qrels} l USING ({on}, {doc})),
got AS (
  SELECT {keys}, sum(CASE WHEN pos <= 10 THEN label / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN pos <= 10 THEN (pow(2, label) - 1) / log2(pos + 1) ELSE 0 END) AS dcg_exp,
         min(CASE WHEN label > 0 THEN pos END) AS first,
         {', '.join(f'sum(CASE WHEN pos <= {n} AND label > 0 THEN 1 ELSE 0 END) / least({n}, count(*)) AS prec_at_{n}' for n in (3, 5, 10))}
  FROM pos GROUP BY {keys}),
ideal AS (
  SELECT {on}, sum(label / log2(pos + 1)) AS idcg, sum((pow(2, label) - 1) / log2(pos + 1)) AS idcg_exp
  FROM (SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY label DESC) AS pos FROM {qrels}) WHERE pos <= 10 GROUP BY {on}),
metric AS (
  SELECT {keys}, coalesce(dcg / nullif(idcg, 0), 0.0) AS ndcg, coalesce(dcg_exp / nullif(idcg_exp, 0), 0.0) AS ndcg_exp, coalesce(1.0 / first, 0.0)::DOUBLE AS mrr,
         prec_at_3, prec_at_5, prec_at_10
  FROM got LEFT JOIN ideal USING ({on}))
"""


_BENCH = f"""{_SCORES}, {_QRELS},
ranked AS (SELECT 'A' AS config, query_id, doc_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'C', query_id, doc_id, rank FROM dots WHERE rank <= 10),
{_metrics('ranked', 'qrels', 'config, query_id')},
bench AS (SELECT config, query_id, ndcg AS ndcg_at_10, mrr, prec_at_3, prec_at_5, prec_at_10, CASE WHEN config = 'C' THEN 0.002 ELSE 0.0 END::DOUBLE AS cost_usd FROM metric),
agg AS (
  SELECT config, avg(ndcg_at_10) AS ndcg_at_10, avg(mrr) AS mrr, avg(prec_at_3) AS prec_at_3, avg(prec_at_5) AS prec_at_5, avg(prec_at_10) AS prec_at_10,
         sum(cost_usd) AS cost_usd, count(*) AS num_queries FROM bench GROUP BY config)
"""

_RANKS = f"""{_SCORES}, {_fuse(60, 100, 'pooled')},
pool AS (SELECT p.query_id, p.doc_id, p.rank AS rank_a, allp.dot FROM pooled p JOIN allp USING (query_id, doc_id)),
ranks AS (SELECT query_id, doc_id, rank_a, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, doc_id) AS rank_c FROM pool),
rho AS (SELECT query_id, corr(rank_a, rank_c) AS rho FROM ranks GROUP BY query_id),
size AS (SELECT query_id, count(*) AS k FROM ranks GROUP BY query_id),
depth AS (SELECT query_id, k, unnest(range(1, k + 1)) AS d FROM size),
metat AS (SELECT query_id, greatest(rank_a, rank_c) AS d, count(*) AS met FROM ranks GROUP BY ALL),
run AS (SELECT query_id, k, d, sum(coalesce(met, 0)) OVER (PARTITION BY query_id ORDER BY d) AS x FROM depth LEFT JOIN metat USING (query_id, d)),
rb AS (
  SELECT query_id, max(CASE WHEN d = k THEN x / k * pow(0.9, d) END) + sum(x / d * pow(0.9, d)) * ((1 - 0.9::DOUBLE) / 0.9::DOUBLE) AS rbo FROM run GROUP BY query_id)
"""

_EVENTS = """
ev AS (
  SELECT event_id, ts, ts::DATE AS day, user_id::VARCHAR AS user_id, event_type AS stage, value AS duration_ms, json_extract_string(props, '$.k') AS query_id,
         CASE WHEN event_type = 'click' THEN 'up' WHEN event_type = 'error' THEN 'down' END AS reaction FROM events),
fb AS (SELECT * FROM ev WHERE reaction IS NOT NULL),
daily AS (SELECT stage AS metric, day, round(avg(duration_ms), 6) AS score FROM ev GROUP BY ALL)
"""

_TURNS = """
part AS (
  SELECT conv_id, turn, role AS heading, text, '[' || role || ']' || chr(10) || text AS part FROM conversations),
off AS (
  SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM part)
"""

_STREAK = """
lagged AS (SELECT *, lag(score) OVER (PARTITION BY metric ORDER BY day) AS before FROM daily),
falls AS (SELECT *, coalesce(score < before, false) AS falls FROM lagged),
stop AS (SELECT metric, max(CASE WHEN NOT falls THEN day END) AS stop, arg_max(score, day) AS latest, max(day) AS last_day FROM falls GROUP BY metric),
streak AS (SELECT metric, count(*) FILTER (WHERE day > stop) AS streak, any_value(latest) AS latest, any_value(last_day) AS last_day FROM falls JOIN stop USING (metric) GROUP BY metric)
"""

_VECTORS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
cen AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v WHERE label < 5) GROUP BY i)),
proj AS (SELECT vec_id, label, list_inner_product(e, c) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(c, c)), 0) AS x FROM v, cen),
cos AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) AS score, q.label AS ql, v.label AS vl
  FROM v q, v WHERE q.vec_id % 100 = 0),
dense AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cos) WHERE rank <= 10),
vq AS (SELECT query_id, vec_id, CASE WHEN query_id = vec_id THEN 2 ELSE 1 END AS label FROM cos WHERE ql = vl)
"""


_PAIRS = f"""{_QRELS},
pairs AS (SELECT q.query_id, q.doc_id, b.doc_id IS NOT NULL AS hit, d.text FROM qrels q JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) b ON q.query_id = b.query_id AND q.doc_id = b.doc_id)
"""
_PARTS = "[len(list_filter(toks, lambda t: (len(t) + ascii(t)) % 16 = j))::DOUBLE for j in range(16)]"
_HASHED = f"""
dv AS (SELECT doc_id, {_PARTS} AS e FROM dt WHERE toks IS NOT NULL),
qv AS (SELECT item_id AS query_id, {_PARTS} AS e FROM (SELECT item_id, {_tok('text')} AS toks FROM benchmark)),
pairs AS (
  SELECT query_id, doc_id, list_inner_product(q.e, d.e) / greatest(sqrt(list_inner_product(q.e, q.e)), 1e-8) / greatest(sqrt(list_inner_product(d.e, d.e)), 1e-8) AS cos FROM qv q, dv d)
"""


def _psi(rows: str) -> str:
    """CTEs that end in ``psi`` over a CTE ``rows`` of (side 0 or 1, x)."""
    cuts = ", ".join(str(i / 10) for i in range(11))
    return f"""
edges AS (SELECT list_sort(list_distinct(quantile_cont(x, [{cuts}]))) AS e FROM {rows} WHERE side = 0),
inn AS (SELECT CASE WHEN len(e) < 2 THEN [] ELSE list_slice(e, 2, len(e) - 1) END AS i FROM edges),
bucketed AS (SELECT side, len(list_filter(i, lambda q: q <= x)) AS b FROM {rows}, inn),
share AS (
  SELECT b, (SELECT count(*) FROM bucketed z WHERE z.b = y.b AND side = 0) / (SELECT count(*) FROM {rows} WHERE side = 0) + 1e-4::DOUBLE AS pb,
         (SELECT count(*) FROM bucketed z WHERE z.b = y.b AND side = 1) / (SELECT count(*) FROM {rows} WHERE side = 1) + 1e-4::DOUBLE AS pc
  FROM (SELECT unnest(range(0, len(i) + 1)) AS b FROM inn) y),
psi AS (
  SELECT sum((pc - pb) * ln(pc / pb)) AS psi, (SELECT count(*) FROM {rows} WHERE side = 0) AS baseline_size, (SELECT count(*) FROM {rows} WHERE side = 1) AS current_size FROM share)
"""


_SEVERITY = "CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.10 THEN 'moderate' ELSE 'none' END"
_META = "meta AS (SELECT doc_id, source || '/' || lang AS title, lang AS gpu_family, source AS doc_type FROM documents)"
_JUDGED = "jd AS (SELECT doc_id, source AS query_id, quality = 1 AS supported FROM labels JOIN documents USING (doc_id))"
_RER = """
rr AS (
  SELECT query_id, doc_id, pooled.rank AS prior, len(list_filter(list_distinct(qtoks), lambda t: list_contains(toks, t))) / nullif(len(list_distinct(qtoks)), 0) AS score
  FROM pooled JOIN dt USING (doc_id) JOIN (SELECT item_id AS query_id, {q} AS qtoks FROM benchmark) USING (query_id)),
rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, prior) AS rank FROM rr)
""".replace("{q}", _tok("text"))


def _freq(name: str, source: str) -> str:
    return f"{name}t AS (SELECT unnest({_tok('text')}) AS term FROM {source}), {name} AS (SELECT term, count(*) AS n, count(*) / (SELECT count(*) FROM {name}t) AS freq FROM {name}t GROUP BY term)"


def _terms(source: str) -> str:
    return f"SELECT DISTINCT unnest({_tok('text')}) AS term FROM {source}"


def all_sql() -> dict[str, str]:
    user, other = "(SELECT text FROM conversations WHERE role = 'user')", "(SELECT text FROM conversations WHERE role = 'assistant')"
    both_psi = f"{_VECTORS}, sides AS (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS side, x FROM proj), {_psi('sides')}"
    shift = "sh AS (SELECT coalesce(b.term, c.term) AS term, coalesce(b.freq, 0.0) AS base_freq, coalesce(c.freq, 0.0) AS cur_freq FROM b FULL JOIN c ON b.term = c.term)"
    r6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
    means = ("ndcg_at_10", "mrr", "prec_at_3", "prec_at_5", "prec_at_10")
    return {
        "text_tokens_stats": f"WITH {_TEXT} SELECT doc_id, n::BIGINT AS n_tokens, round(nonascii, 6) AS nonascii_ratio, round(stop, 6) AS stopword_ratio FROM x",
        "text_mean_sentence_len": f"WITH {_TEXT} SELECT doc_id, round(sent, 6) AS mean_sent_len FROM x",
        "chunk_quality": f"WITH {_QUALITY} SELECT *, quality_score < 0.40 AS flagged FROM quality",
        "content_ids": """
            WITH k AS (SELECT page_id, html, substr(sha256(url), 1, 16) AS doc_key FROM pages)
            SELECT page_id, doc_key, sha256(html) AS content_sha256, substr(sha256(doc_key || ':' || page_id || ':' || substr(html, 1, 64)), 1, 24) AS chunk_key FROM k""",
        "snippet": r"""
            WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents)
            SELECT doc_id, CASE WHEN length(t) > 150 THEN substr(t, 1, 150) || '...' ELSE t END AS snippet, substr(t, 1, 100) AS short FROM f""",
        "passage_labels": "SELECT conv_id, turn, role AS label, length(text)::BIGINT AS n_chars FROM conversations",
        "request_stages": """
            WITH p AS (SELECT coalesce(nullif(string_split(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/')[1], ''), 'root') AS stage FROM pages)
            SELECT stage, count(*) AS n FROM p GROUP BY stage""",
        "search_tab_context": """
            WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
            SELECT conv_id, sha256(string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS context_sha256 FROM r WHERE n <= 3 GROUP BY conv_id""",
        "doc_assembly_offsets": f"WITH {_TURNS} SELECT conv_id, turn, char_offset, length(part)::BIGINT AS part_chars FROM off",
        "doc_assembly_text": f"""WITH {_TURNS}, t AS (SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS x FROM off GROUP BY conv_id)
            SELECT conv_id, sha256(x) AS sha256, length(x)::BIGINT AS n_chars FROM t""",
        "nearest_heading": f"""WITH {_TURNS},
            h AS (SELECT conv_id, char_offset, regexp_extract(text, '(\\S+)', 1) AS heading FROM off WHERE heading = 'user' AND regexp_extract(text, '(\\S+)', 1) <> ''),
            p AS (SELECT conv_id, turn, char_offset + length(part) // 2 AS pos FROM off)
            SELECT conv_id, turn, pos::BIGINT AS pos, (SELECT arg_max(h.heading, h.char_offset) FROM h WHERE h.conv_id = p.conv_id AND h.char_offset <= p.pos) AS heading FROM p""",
        "upsert_docs": """
            WITH o AS (SELECT doc_id, quality::BIGINT AS content FROM labels),
                 n AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN length(text)::BIGINT END AS content FROM documents)
            SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.content, o.content) AS content,
                   CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
        "insert_if_absent": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "hash_drift": """
            WITH h AS (SELECT doc_id, sha256(text) AS old_hash, sha256(trim(replace(text, chr(10), ' '), ' ')) AS new_hash FROM documents)
            SELECT * FROM h WHERE old_hash <> new_hash""",
        "feedback_fk_repair": f"""WITH {_EVENTS}
            SELECT event_id, CASE WHEN query_id IN (SELECT item_id::VARCHAR FROM benchmark) THEN query_id END AS query_id, 'web' AS source,
                   coalesce(nullif(user_id, '0'), 'anonymous') AS user_id, reaction FROM fb""",
        "coverage": """
            WITH c AS (SELECT count(*) AS t, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS i FROM documents)
            SELECT t AS total_manifest, i AS total_indexed, round(100.0::DOUBLE * i / t, 2) AS coverage_pct FROM c""",
        "coverage_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "stratified_sample": """
            WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
            rest AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)),
            held AS (SELECT count(*) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM f)),
            want AS (SELECT source, round_even(greatest(200 - (SELECT h FROM held), 0) * count(*)::DOUBLE / (SELECT count(*) FROM rest), 0)::BIGINT AS want FROM rest GROUP BY source),
            drawn AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS nth FROM rest)
            SELECT doc_id, source FROM drawn JOIN want USING (source) WHERE nth <= want
            UNION ALL SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM f)""",
        "bm25_term_stats": f"WITH {_SCORES} SELECT term, df, round(idf, 6) AS idf FROM stats",
        "bm25_topk": f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
        "sparse_dot_topk": f"WITH {_SCORES} SELECT query_id, doc_id, dot AS score, rank FROM dots WHERE rank <= 10",
        "dense_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense",
        "collection_stats": "SELECT count(*) AS points, max(len(embedding))::BIGINT AS dimension FROM embeddings",
        "rrf_fused_topk": f"WITH {_SCORES}, {_fuse()} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused",
        "rrf_k_variants": f"""WITH {_SCORES}, {_fuse(10, 5, 'f10')}, {_fuse(60, 5, 'f60')}
            SELECT 10::BIGINT AS k, query_id, doc_id, rank FROM f10 UNION ALL SELECT 60, query_id, doc_id, rank FROM f60""",
        "method_comparison": f"""WITH {_SCORES}, {_fuse(60, 3)}
            SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm WHERE rank <= 3 UNION ALL SELECT 'dot', query_id, doc_id, rank FROM dots WHERE rank <= 3
            UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fused""",
        "method_overlap": f"""WITH {_SCORES} SELECT b.query_id, count(d.doc_id) AS overlap FROM (SELECT * FROM bm WHERE rank <= 5) b
            LEFT JOIN (SELECT * FROM dots WHERE rank <= 5) d ON b.query_id = d.query_id AND b.doc_id = d.doc_id GROUP BY b.query_id""",
        "top1_pairs": f"WITH {_SCORES}, {_fuse(60, 1)} SELECT query_id, doc_id FROM fused",
        "rerank_scored": f"WITH {_SCORES}, {_fuse(60, 100, 'pooled')}, {_RER} SELECT query_id, doc_id, round(score, 6) AS score, rank, 'live_fast' AS tier FROM rer WHERE rank <= 5",
        "rerank_fallback": f"WITH {_SCORES}, {_fuse(60, 5)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused",
        "rerank_rank1": f"""WITH {_SCORES}, {_fuse(60, 100, 'pooled')}, {_RER} SELECT b.query_id, b.doc_id AS before_id, r.doc_id AS after_id, b.doc_id <> r.doc_id AS moved
            FROM pooled b JOIN rer r USING (query_id) WHERE b.rank = 1 AND r.rank = 1""",
        "dense_metrics": f"WITH {_VECTORS}, {_metrics('dense', 'vq', 'query_id', 'vec_id')} SELECT query_id, {r6('ndcg', 'ndcg_exp', 'mrr', 'prec_at_3', 'prec_at_5', 'prec_at_10')} FROM metric",
        "benchmark_rows": f"WITH {_BENCH} SELECT config, query_id, {r6(*means)}, cost_usd FROM bench",
        "benchmark_aggregate": f"WITH {_BENCH} SELECT config, {r6(*means, 'cost_usd')}, num_queries FROM agg",
        "ndcg_gate": f"WITH {_BENCH} SELECT bool_and(ndcg_at_10 >= 0.30) AS passed, coalesce(string_agg(config, ',' ORDER BY config) FILTER (WHERE ndcg_at_10 < 0.30), '') AS failed FROM agg",
        "ndcg_quartiles": f"""WITH {_BENCH} SELECT config, round(quantile_cont(ndcg_at_10, 0.25), 6) AS p25, round(quantile_cont(ndcg_at_10, 0.5), 6) AS p50,
            round(quantile_cont(ndcg_at_10, 0.75), 6) AS p75, round(avg(ndcg_at_10), 6) AS mean FROM bench GROUP BY config""",
        "model_winner": f"WITH {_BENCH} SELECT config AS winner FROM agg ORDER BY round(ndcg_at_10, 9) DESC, config LIMIT 1",
        "spearman_full": f"WITH {_RANKS} SELECT query_id, round(rho, 6) AS rho FROM rho",
        "spearman_head": f"""WITH {_RANKS},
            h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank_a) AS a, row_number() OVER (PARTITION BY query_id ORDER BY rank_c) AS c
                  FROM ranks WHERE rank_a <= 10 OR rank_c <= 10)
            SELECT query_id, round(corr(a, c), 6) AS rho FROM h GROUP BY query_id""",
        "overlap_at_n": f"""WITH {_RANKS} SELECT query_id, count(*) FILTER (WHERE rank_a <= 10 AND rank_c <= 10) AS overlap_at_10,
            count(*) FILTER (WHERE rank_a <= 5 AND rank_c <= 5) AS overlap_at_5, count(*) FILTER (WHERE rank_a = 1 AND rank_c = 1) = 1 AS top1_match FROM ranks GROUP BY query_id""",
        "rbo": f"WITH {_RANKS} SELECT query_id, round(rbo, 6) AS rbo FROM rb",
        "agreement_by_case": f"""WITH {_RANKS} SELECT (length(b.text) // 100)::BIGINT AS case_no, round(avg(rho), 6) AS rho, round(avg(rbo), 6) AS rbo
            FROM rho JOIN rb USING (query_id) JOIN benchmark b ON b.item_id = rho.query_id GROUP BY 1""",
        "agreement_summary": f"WITH {_RANKS} SELECT round(avg(rbo), 6) AS mean, round(quantile_cont(rbo, 0.5), 6) AS median, round(min(rbo), 6) AS least, round(max(rbo), 6) AS greatest FROM rb",
        "agreement_gap": f"""WITH {_RANKS} SELECT count(*) FILTER (WHERE rbo > rho) AS n_above, count(*) AS n, round(avg(rbo - rho), 6) AS mean_gap
            FROM rho JOIN rb USING (query_id) WHERE rho IS NOT NULL AND NOT isnan(rho)""",
        "splade_dot_topk": f"""WITH {_SCORES},
            s AS (SELECT query_id, doc_id, sum(ln(1 + qtf) * ln(1 + tf)) AS score FROM tf JOIN terms USING (term) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
        "prefixed_queries": "SELECT item_id AS query_id, sha256('query: ' || text) AS query_sha256, sha256('passage: ' || text) AS passage_sha256 FROM benchmark",
        "retrieve_without_dense": f"WITH {_SCORES} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank FROM bm WHERE rank <= 10",
        "first_queries": "SELECT 'bq' || lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, 2, '0') AS name, item_id AS query_id, text AS query FROM benchmark ORDER BY item_id LIMIT 10",
        "pool_labels": f"""WITH {_SCORES}, {_fuse()} SELECT query_id, doc_id, contains(d.text, b.text)::INT AS label
            FROM fused JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id""",
        "biencoder_mean": f"WITH {_VECTORS}, {_metrics('dense', 'vq', 'query_id', 'vec_id')} SELECT round(avg(ndcg_exp), 6) AS mean_ndcg, count(*) AS num_queries FROM metric",
        "eda_mean_by_config": f"WITH {_BENCH} SELECT config, round(ndcg_at_10, 6) AS mean_ndcg, round(mrr, 6) AS mean_mrr FROM agg",
        "latest_citation_run": f"WITH {_EVENTS} SELECT CASE WHEN stage = 'view' THEN duration_ms END AS metric FROM ev ORDER BY ev.ts DESC, event_id DESC LIMIT 1",
        "drift_windows": f"""WITH {_EVENTS}, n AS (SELECT TIMESTAMP '2024-01-31' AS t)
            SELECT 'baseline' AS "window", count(*) AS n, round(avg(duration_ms), 6) AS mean FROM ev, n WHERE ts >= t - INTERVAL 30 DAY AND ts < t - INTERVAL 23 DAY
            UNION ALL SELECT 'current', count(*), round(avg(duration_ms), 6) FROM ev, n WHERE ts >= t - INTERVAL 2 DAY AND ts < t""",
        "feedback_trailing_week": f"""WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE reaction = 'up') AS up, count(*) FILTER (WHERE reaction = 'down') AS down,
            round(count(*) FILTER (WHERE reaction = 'down') / count(*), 4) AS down_rate, count(*) >= 5 AND count(*) FILTER (WHERE reaction = 'down') / count(*) >= 0.30 AS alert
            FROM fb WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""",
        "regression_run": f"""WITH {_EVENTS.replace("daily AS", "eachday AS")},
            today AS (SELECT * FROM ev WHERE day = DATE '2024-01-30'),
            asked AS (SELECT DISTINCT query_id FROM today WHERE query_id IS NOT NULL ORDER BY query_id LIMIT 20),
            daily AS (SELECT * FROM eachday WHERE day < DATE '2024-01-30'
                      UNION ALL SELECT stage, day, avg(duration_ms) FROM today JOIN asked USING (query_id) GROUP BY ALL), {_STREAK}
            SELECT metric, streak, round(latest, 6) AS latest, last_day::VARCHAR AS day, streak >= 3 AS regressing FROM streak""",
        "vector_positions": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vec_id FROM documents",
        "download_report": """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'ok' ELSE 'download_failed' END AS status FROM documents""",
        "vector_upsert": """
            WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vec_id FROM documents WHERE lang = 'en'),
            n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + (SELECT count(*) FROM o) AS vec_id FROM documents WHERE lang <> 'en')
            SELECT doc_id, vec_id, length(source)::BIGINT AS payload FROM (SELECT * FROM o UNION ALL SELECT * FROM n) JOIN documents USING (doc_id)""",
        "upsert_quality": f"""WITH {_QUALITY}, o AS (SELECT DISTINCT doc_id AS chunk_id FROM labels)
            SELECT coalesce(q.chunk_id, o.chunk_id) AS chunk_id, coalesce(quality_score, 0.0) AS quality_score, coalesce(quality_score < 0.40, true) AS flagged,
                   CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN q.chunk_id IS NULL THEN 'keep' ELSE 'update' END AS action
            FROM quality q FULL JOIN o ON q.chunk_id = o.chunk_id""",
        "hybrid_dense_topk": f"""WITH {_SCORES}, {_HASHED},
            near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, doc_id) AS rank FROM pairs),
            lists AS (SELECT query_id, doc_id, rank, 0 AS no FROM bm WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank, 1 FROM near WHERE rank <= 100),
            f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(no) AS no, arg_min(rank, no) AS first FROM lists GROUP BY ALL)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, no, first, doc_id) AS rank FROM f) WHERE rank <= 10""",
        "splade_pooled": f"""WITH t AS (SELECT doc_id, unnest(toks[1:256]) AS t FROM (SELECT doc_id, {_tok('text')} AS toks FROM documents)),
            g AS (SELECT doc_id, t AS term, len(t) / 2 - 2 AS logit FROM t WHERE len(t) > 1 UNION ALL SELECT doc_id, t[1:3], len(t) - 6 FROM t WHERE len(t) > 1)
            SELECT doc_id, term, round(ln(1 + max(logit)), 6) AS weight FROM g WHERE logit > 0 GROUP BY ALL""",
        "judged_pairs": f"WITH {_SCORES}, {_PAIRS} SELECT query_id, doc_id, hit AS supported, CASE WHEN hit THEN 'holds it' ELSE 'cited chunk_id not found in retrieved passages' END AS rationale FROM pairs",
        "judge_runs": f"""WITH {_SCORES}, {_PAIRS}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT hit) AS lost, count(*) FILTER (WHERE hit AND length(text) % 3 = 0) AS failed FROM pairs)
            SELECT unnest([1, 2, 3])::INT AS run, unnest([n, failed, 0]) AS open, unnest([n - lost - failed, failed, 0]) AS judged, unnest([lost, 0, 0]) AS unretrieved, unnest([failed, 0, 0]) AS failed FROM c""",
        "step_latency": """WITH t AS (SELECT lang, coalesce(length(text), 0) / 100 AS ms, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
            b AS (SELECT lang, max(n) AS n, avg(ms) AS mean, max(CASE WHEN i = ceil(1 + 0.95 * (n - 1) - 1e-9) THEN CASE WHEN ms <= 0.001 THEN 0 ELSE ceil(ln(ms / 0.001) / ln(1.02)) END END) AS bk FROM t GROUP BY lang)
            SELECT lang, n, round(mean, 6) AS mean_ms, round(CASE WHEN bk = 0 THEN 0 ELSE 0.001 * pow(1.02, bk - 0.5) END, 6) AS p95_ms FROM b""",
        "late_interaction_topk": f"""WITH dt AS (SELECT doc_id, unnest(toks[1:256]) AS t FROM (SELECT doc_id, {_tok('text')} AS toks FROM documents)),
            qt AS (SELECT item_id AS query_id, unnest(toks[1:256]) AS t FROM (SELECT item_id, {_tok('text')} AS toks FROM benchmark)),
            raw AS (SELECT t, list_transform([1, 3, 5, 7], lambda i: ('0x' || substr(md5(t), i, 2))::INT - 127.5::DOUBLE) AS e FROM (SELECT t FROM dt UNION SELECT t FROM qt)),
            vec AS (SELECT t, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM raw),
            q AS (SELECT query_id, t, count(*) AS n FROM qt GROUP BY ALL),
            sims AS (SELECT a.t AS qt, b.t AS dt, list_inner_product(a.e, b.e) AS s FROM vec a, vec b WHERE a.t IN (SELECT t FROM q)),
            best AS (SELECT s.qt, d.doc_id, max(s.s) AS s FROM (SELECT DISTINCT doc_id, t FROM dt) d JOIN sims s ON s.dt = d.t GROUP BY ALL),
            f AS (SELECT query_id, doc_id, sum(n * s) AS score FROM q JOIN best ON qt = t GROUP BY ALL)
            SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
        "streak_closed": f"WITH {_EVENTS}, {_STREAK} SELECT metric, streak, latest, last_day::VARCHAR AS day, streak >= 3 AS regressing FROM streak",
        "stage_counts": f"""WITH {_QUALITY} , d AS (SELECT text, CASE WHEN quality_score < 0.4 THEN 1 ELSE 0 END AS flagged FROM documents JOIN quality ON doc_id = chunk_id)
            SELECT 'scan' AS stage, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents UNION ALL SELECT 'quality', count(*), sum(length(text))::BIGINT FROM documents
            UNION ALL SELECT 'flagged', count(*), coalesce(sum(length(text)), 0)::BIGINT FROM d WHERE flagged = 1""",
        "eda_views": f"""WITH {_BENCH} SELECT config, round(max(ndcg_at_10), 6) AS ndcg_at_10, 0::BIGINT AS timed,
            (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE quality = 1) AS supported, 1::INT AS failed FROM bench GROUP BY config""",
        "orchestrated_run": f"""WITH {_SCORES}, {_fuse(60, 100, 'pooled')}, {_RER} SELECT r.query_id, count(*) FILTER (WHERE contains(d.text, b.text)) AS supported, count(*) AS total
            FROM rer r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank <= 5 GROUP BY r.query_id""",
        "contexts_round_trip": f"""WITH {_SCORES}, {_fuse(60, 3)} SELECT query_id, doc_id, round(score, 6) AS score, rank, sha256(text) AS text_sha256 FROM fused JOIN documents USING (doc_id)""",
        "bounded_topk": f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
        "bounded_blocks": "SELECT true AS some_read, true AS some_skipped",
        "live_index_topk": f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
        "vector_index_exact": f"WITH {_VECTORS} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dense",
        "vector_index_recall": f"WITH {_VECTORS} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS reached FROM dense",
        "snapshot_writes": f"""WITH {_EVENTS}, c AS (SELECT count(*) FILTER (WHERE day < DATE '2024-01-16') AS a, count(*) FILTER (WHERE day >= DATE '2024-01-16') AS b FROM daily)
            SELECT unnest(['early', 'early again', 'broken', 'late', 'there']) AS write, unnest([a, a, 0, b, a + b]) AS written FROM c""",
        "snapshot_rows": f"WITH {_EVENTS} SELECT metric, day::VARCHAR AS day, score FROM daily",
        "bm25_from_index": f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
        "method_comparison_snippets": f"""WITH {_SCORES}, {_fuse(60, 3)},
            m AS (SELECT 'bm25' AS method, query_id, doc_id, rank FROM bm WHERE rank <= 3 UNION ALL SELECT 'dot', query_id, doc_id, rank FROM dots WHERE rank <= 3
                  UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fused)
            SELECT method, query_id, doc_id, rank, substr(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), 1, 80) AS snippet FROM m JOIN documents USING (doc_id)""",
        "request_log": """
            WITH p AS (SELECT page_id, html, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS endpoint FROM pages)
            SELECT page_id, endpoint, coalesce(nullif(string_split(trim(endpoint, '/'), '/')[1], ''), 'root') AS stage, CASE WHEN length(html) > 0 THEN 200 ELSE 500 END AS status_code FROM p""",
        "footer_query_ids": "SELECT conv_id, turn, CASE WHEN role <> 'system' THEN 'c' || conv_id END AS query_id FROM conversations",
        "tracked_reactions": f"WITH {_EVENTS} SELECT reaction, count(*) AS n FROM fb GROUP BY reaction",
        "recovered_citations": """
            SELECT doc_id, contains(text, chr(10))::BIGINT AS n, CASE WHEN contains(text, chr(10)) THEN source END AS claim, CASE WHEN contains(text, chr(10)) THEN doc_id::VARCHAR END AS chunk_id
            FROM documents""",
        "evaluate_node": f"""WITH {_SCORES}, {_QRELS} SELECT round(coalesce(avg((b.doc_id IS NOT NULL)::INT), 0), 6) AS citation_accuracy
            FROM qrels q LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) b ON q.query_id = b.query_id AND q.doc_id = b.doc_id""",
        "labels_round_trip": f"WITH {_QRELS} SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS chunk_id, 1::INT AS label FROM qrels",
        "history_append": f"WITH {_EVENTS} SELECT metric, day::VARCHAR AS day, score FROM daily",
        "count_by_family": "SELECT coalesce(nullif(lang, ''), 'Unknown') AS family, count(*) AS n FROM documents GROUP BY lang",
        "below_threshold": f"WITH {_QUALITY} SELECT chunk_id, quality_score FROM quality WHERE quality_score < 0.6",
        "avg_quality_per_doc": f"""WITH {_QUALITY}, {_META} SELECT title, ((2 * sum(round(quality_score * 10000)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS avg_quality, count(*) AS chunks
            FROM meta JOIN quality ON meta.doc_id = quality.chunk_id GROUP BY title""",
        "chunk_count_like": f"WITH {_META} SELECT title, count(*) AS chunks FROM meta WHERE title ILIKE '%SRC1%' GROUP BY title",
        "list_docs": f"WITH {_META} SELECT * FROM meta",
        "avg_price_per_nation": """
            SELECT n_name, ((2 * sum(round(l_extendedprice * 10000)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS avg_price, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
        "eda_canned": f"""WITH {_EVENTS}, {_JUDGED}, m AS (SELECT day, max(score) AS m FROM daily GROUP BY day)
            SELECT round((SELECT avg(supported::INT) FROM jd), 6) AS citation_accuracy, (SELECT day::VARCHAR FROM m ORDER BY m DESC, day DESC LIMIT 1) AS worst_day""",
        "latest_run_per_config": f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ev)
            SELECT user_id, ts::VARCHAR AS ts, duration_ms FROM r WHERE n = 1""",
        "latest_complete": f"WITH {_EVENTS} SELECT ts::VARCHAR AS ts, duration_ms, duration_ms AS second FROM ev WHERE stage <> 'view' AND duration_ms IS NOT NULL ORDER BY ev.ts DESC, event_id DESC LIMIT 1",
        "stage_latency": f"WITH {_EVENTS} SELECT stage, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM ev GROUP BY stage",
        "daily_error_rate": f"""WITH {_EVENTS} SELECT day::VARCHAR AS day, count(*) AS requests, count(*) FILTER (WHERE stage = 'error') AS errors,
            round(count(*) FILTER (WHERE stage = 'error') / count(*), 4) AS error_rate FROM ev GROUP BY day""",
        "relevance_pct": f"""WITH {_SCORES}, t AS (SELECT *, min(dot) OVER w AS low, max(dot) OVER w AS high FROM dots WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id))
            SELECT query_id, doc_id, coalesce(floor(20 + (dot - low) / nullif(high - low, 0) * 80 + 0.5), 100)::BIGINT AS percent FROM t""",
        "centroid_projection": f"WITH {_VECTORS} SELECT vec_id, round(x, 6) AS x FROM proj",
        "psi_embeddings": f"WITH {both_psi} SELECT round(psi, 6) AS psi, baseline_size, current_size, {_SEVERITY} AS severity, psi >= 0.10 AS drifted FROM psi",
        "psi_values": f"""WITH {_EVENTS}, sides AS (SELECT CASE WHEN day < DATE '2024-01-16' THEN 0 ELSE 1 END AS side, duration_ms AS x FROM ev), {_psi('sides')}
            SELECT round(psi, 6) AS psi, baseline_size, current_size, {_SEVERITY} AS severity FROM psi""",
        "term_freq": f"WITH {_freq('b', 'documents')} SELECT term, n, round(freq * 1000, 6) AS freq FROM b",
        "term_shift": f"""WITH {_freq('b', "(SELECT text FROM documents WHERE lang = 'en')")}, {_freq('c', "(SELECT text FROM documents WHERE lang <> 'en')")}, {shift}
            SELECT term, round(base_freq, 6) AS base_freq, round(cur_freq, 6) AS cur_freq, round(cur_freq - base_freq, 6) AS delta FROM sh
            WHERE abs(cur_freq - base_freq) >= 0.005 ORDER BY round(abs(cur_freq - base_freq), 12) DESC, term LIMIT 20""",
        "new_terms": f"({_terms(other)}) EXCEPT ({_terms(user)})",
        "dropped_terms": f"({_terms(user)}) EXCEPT ({_terms(other)})",
        "decline_streak": f"WITH {_EVENTS}, {_STREAK} SELECT metric, streak, latest, last_day::VARCHAR AS day, streak >= 3 AS regressing FROM streak",
        "regression_alert": f"""WITH {_EVENTS}, {_STREAK}
            SELECT coalesce(bool_or(streak >= 1), false) AS is_regressing,
                   CASE WHEN bool_or(streak >= 1) THEN 'Quality regression detected on ' || max(last_day)::VARCHAR || ': '
                     || string_agg(metric || ': ' || streak || ' consecutive days declining (latest=' || printf('%.4f', latest) || ')', '; ' ORDER BY metric) FILTER (WHERE streak >= 1) END AS alert
            FROM streak""",
        "feedback_summary": f"""WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE reaction = 'up') AS up, count(*) FILTER (WHERE reaction = 'down') AS down,
            round(count(*) FILTER (WHERE reaction = 'down') / count(*), 4) AS down_rate, count(*) >= 5 AND count(*) FILTER (WHERE reaction = 'down') / count(*) >= 0.30 AS alert FROM fb""",
        "worst_queries": f"WITH {_EVENTS} SELECT query_id, count(*) AS down_count FROM fb WHERE reaction = 'down' AND query_id IS NOT NULL AND query_id <> '' GROUP BY query_id ORDER BY 2 DESC, 1 LIMIT 5",
        "feedback_weekly": f"""WITH {_EVENTS}, w AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM fb)
            SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS week_start, count(*) AS total, count(*) FILTER (WHERE reaction = 'up') AS up, count(*) FILTER (WHERE reaction = 'down') AS down,
                   round(count(*) FILTER (WHERE reaction = 'down') / count(*), 4) AS down_rate, count(*) >= 5 AND count(*) FILTER (WHERE reaction = 'down') / count(*) >= 0.30 AS alert
            FROM w GROUP BY s""",
        "drift_alert": f"""WITH {_EVENTS}, {_STREAK}, {both_psi}, {_freq('b', user)}, {_freq('c', other)}, {shift},
            z AS (SELECT (SELECT psi >= 0.10 FROM psi) AS drifted, (SELECT count(*) FROM sh WHERE abs(cur_freq - base_freq) >= 0.02) AS shifted_terms,
                         (SELECT coalesce(bool_or(streak >= 3), false) FROM streak) AS is_regressing)
            SELECT *, drifted OR shifted_terms > 0 OR is_regressing AS alert FROM z""",
        "citation_accuracy": f"WITH {_JUDGED} SELECT round(coalesce(avg(supported::INT), 0), 6) AS citation_accuracy FROM jd",
        "citation_by_group": f"WITH {_JUDGED} SELECT query_id, count(*) FILTER (WHERE supported) AS supported, count(*) AS total, round(count(*) FILTER (WHERE supported) / count(*), 6) AS accuracy FROM jd GROUP BY query_id",
        "citation_fanout_unretrieved": f"""WITH {_SCORES}, {_QRELS} SELECT q.query_id, q.doc_id AS chunk_id, CASE WHEN b.doc_id IS NULL THEN 'unsupported' ELSE 'to be judged' END AS verdict,
            CASE WHEN b.doc_id IS NULL THEN 'cited chunk_id not found in retrieved passages' ELSE '' END AS rationale
            FROM qrels q LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) b ON q.query_id = b.query_id AND q.doc_id = b.doc_id""",
        "ragas_dataset": f"""WITH {_SCORES}, {_fuse(60, 3)}
            SELECT query_id, count(*) AS n, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS contexts_sha256, '' AS answer, '' AS ground_truth
            FROM fused JOIN documents USING (doc_id) GROUP BY query_id""",
        "answer_card": f"""WITH {_SCORES}, {_fuse(60, 3)}
            SELECT query_id, '*Top citations:*' || chr(10) || string_agg('*' || rank || '.* claim ' || rank || chr(10) || '   `' || doc_id || '`', chr(10) ORDER BY rank) || chr(10) || 'query_id: `' || query_id || '`' AS card
            FROM fused GROUP BY query_id""",
    }
