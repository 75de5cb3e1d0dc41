"""All queries of the engine's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.operators import dedup, graph, lifecycle, retrieval, telemetry, text
from memengine.plans.base import QUERIES, query
from memengine.plans.recall import COMPOSITE as _COMPOSITE, QUERY_VECTOR, QV as _QV, SCORED as _SCORED, scored_memories as _scored
from memengine.sources.tables import AS_OF, MEMORIES_SQL, USAGE_SQL, VECTORS_SQL, active, api_usage, for_tenant, memories, scan, vectors

_QUERIES = QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


#: No two of the given vectors are alike by the memory model's own thresholds (0.78 and above), so the pair queries use this one.
SIMILAR = 0.4
_SIM = f"round(coalesce(list_cosine_similarity(embedding, {_QV}), 0), 6)"


@query(f"WITH {VECTORS_SQL} SELECT id, agent_id, {_SIM} AS similarity FROM vectors ORDER BY list_cosine_similarity(embedding, {_QV}) DESC, id LIMIT 20")
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(vectors(spark, sf_dir), QUERY_VECTOR, 20).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {VECTORS_SQL} SELECT id, agent_id, round(s, 6) AS similarity, r AS rank FROM (SELECT *, list_cosine_similarity(embedding, {_QV}) AS s, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY list_cosine_similarity(embedding, {_QV}) DESC, id) AS INTEGER) AS r FROM vectors) WHERE r <= 10")
def vector_topk_per_agent(spark, sf_dir):
    scored = retrieval.scored(vectors(spark, sf_dir), QUERY_VECTOR)
    return retrieval.topk_by(scored, ["agent_id"], [F.desc("similarity"), F.col("id")], 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_SCORED}, a AS (SELECT id, similarity FROM scored WHERE similarity IS NOT NULL ORDER BY similarity DESC, id LIMIT 100), b AS (SELECT id FROM scored WHERE importance > 0.8 AND id NOT IN (SELECT id FROM a) ORDER BY importance DESC, id LIMIT 50),
c AS (SELECT id FROM scored WHERE contains(lower(context), 'the') AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY importance DESC, id LIMIT 50)
SELECT id, round(similarity, 6) AS similarity, 'vector' AS strategy FROM a UNION ALL SELECT id, 0.5, 'importance' FROM b UNION ALL SELECT id, 0.35, 'keyword' FROM c""")
def hybrid_candidates(spark, sf_dir):
    hits = retrieval.hybrid_candidates(_scored(spark, sf_dir), F.contains(F.lower("context"), F.lit("the")), 100)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SCORED}, {_COMPOSITE} SELECT id, agent_id, memory_type, round(composite, 6) AS composite FROM composed ORDER BY composed.composite DESC, id LIMIT 50")
def composite_recall(spark, sf_dir):
    out = retrieval.composite_score(_scored(spark, sf_dir), AS_OF).orderBy(F.desc("composite"), "id").limit(50)
    return out.select("id", "agent_id", "memory_type", F.round("composite", 6).alias("composite"))


def _packed(scored):
    """The 200 best of each agent, packed."""
    best = retrieval.topk_by(retrieval.tiered(retrieval.composite_score(scored, AS_OF)), ["agent_id"], [F.desc("composite"), F.col("id")], 200)
    return retrieval.pack(best, "agent_id", 500)


def flagship(spark, sf_dir):
    return composite_recall(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SCORED}, {_COMPOSITE}, tiers AS (SELECT id, agent_id, composite, CASE WHEN composite > 0.7 THEN context ELSE headline END AS shown FROM composed WHERE composite > 0.4),
ranked AS (SELECT *, greatest(1, length(shown) // 4) AS t, row_number() OVER (PARTITION BY agent_id ORDER BY composite DESC, id) AS r FROM tiers QUALIFY r <= 200),
p AS (SELECT agent_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT agent_id FROM tiers) UNION ALL
 SELECT p.agent_id, x.r, CASE WHEN used + t <= 500 THEN used + t ELSE used END, CASE WHEN used + t <= 500 THEN list_append(ids, CAST(x.id AS VARCHAR)) ELSE ids END FROM p JOIN ranked x ON x.agent_id = p.agent_id AND x.r = p.r + 1),
z AS (SELECT agent_id, arg_max(used, r) AS used_tokens, arg_max(ids, r) AS ids FROM p GROUP BY agent_id)
SELECT agent_id, used_tokens, CAST(len(ids) AS INTEGER) AS n_packed, array_to_string(ids, ',') AS packed FROM z""")
def tier_pack(spark, sf_dir):
    return _packed(_scored(spark, sf_dir))


_BATCH = [(1, "the"), (2, "idiot"), (3, "tion"), (4, "keit")]


@query(f"""WITH {MEMORIES_SQL}, q AS (SELECT * FROM (VALUES (1, 'the'), (2, 'idiot'), (3, 'tion'), (4, 'keit')) t(query_id, q))
SELECT query_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, created_at DESC, id) AS r FROM memories JOIN q ON contains(lower(headline), lower(q)) OR contains(lower(context), lower(q)) WHERE superseded_at IS NULL) WHERE r <= 20""")
def batch_search(spark, sf_dir):
    asked = spark.createDataFrame(_BATCH, "query_id int, q string")
    return retrieval.substring_search(active(memories(spark, sf_dir)), asked).select("query_id", "id", "rank")


@query("""WITH r AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT id, len(ws) AS dl, len(list_filter(ws, lambda w: w = 'the')) AS a, len(list_filter(ws, lambda w: w = 'with')) AS b FROM r),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM t),
x AS (SELECT id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM t, s)
SELECT id, round(score, 6) AS score FROM x WHERE score > 0""")
def keyword_bm25(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, ["the", "with"]).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTORS_SQL} SELECT x.agent_id, x.id AS a, y.id AS b, CASE WHEN s >= 0.92 THEN 'duplicate' WHEN s >= 0.85 THEN 'review' ELSE 'related' END AS label, round(s, 6) AS similarity FROM (SELECT x, y, list_cosine_similarity(x.embedding, y.embedding) AS s FROM vectors x JOIN vectors y ON x.agent_id = y.agent_id AND x.id < y.id) WHERE s >= 0.4")
def near_duplicate_pairs(spark, sf_dir):
    return dedup.labelled(dedup.similar_pairs(vectors(spark, sf_dir), SIMILAR)).select("agent_id", "a", "b", "label", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {VECTORS_SQL}, n AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.embedding, y.embedding) AS s FROM vectors x JOIN vectors y ON x.agent_id = y.agent_id AND x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM n) SELECT a, b, round(s, 6) AS similarity FROM r WHERE r <= 20 AND s >= 0.4 AND a < b")
def knn_edges(spark, sf_dir):
    return dedup.knn_edges(vectors(spark, sf_dir), 20, SIMILAR).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {VECTORS_SQL}, n AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.embedding, y.embedding) AS s FROM vectors x JOIN vectors y ON x.agent_id = y.agent_id AND x.id <> y.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM n), e AS (SELECT a, b FROM r WHERE r <= 20 AND s >= 0.4 AND a < b), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS id, a AS component FROM u UNION SELECT u.b, c.component FROM c JOIN u ON u.a = c.id AND c.component < u.b) SELECT id, min(component) AS component FROM c GROUP BY id""")
def clusters(spark, sf_dir):
    edges = dedup.knn_edges(vectors(spark, sf_dir), 20, SIMILAR)
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(f"WITH {VECTORS_SQL}, r AS (SELECT agent_id AS cluster, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding) AS x FROM vectors) SELECT cluster, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(x), 6) AS mean FROM r GROUP BY ALL")
def centroids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dedup.centroids(v.drop("agent_id"), v.select("id", F.col("agent_id").alias("cluster"))).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {VECTORS_SQL}, {MEMORIES_SQL}, p AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.agent_id = y.agent_id AND x.id < y.id WHERE list_cosine_similarity(x.embedding, y.embedding) >= 0.4)
SELECT CASE WHEN f THEN a ELSE b END AS winner, CASE WHEN f THEN b ELSE a END AS loser, greatest(xi, yi) AS importance, round(least(0.99, (xc + yc) / 2 + 0.1), 6)::DOUBLE AS confidence,
 md5(CASE WHEN wh <> lh AND li >= 0.6 THEN wh || ' (also: ' || lh || ')' ELSE wh END) AS headline_md5, md5(CASE WHEN wt = '' THEN lt WHEN lt = '' OR wt = lt THEN wt ELSE wt || chr(10) || '---' || chr(10) || lt END) AS context_md5
FROM (SELECT a, b, x.confidence >= y.confidence AS f, x.importance AS xi, y.importance AS yi, x.confidence AS xc, y.confidence AS yc, CASE WHEN f THEN y.importance ELSE x.importance END AS li,
 coalesce(CASE WHEN f THEN x.headline ELSE y.headline END, '') AS wh, coalesce(CASE WHEN f THEN y.headline ELSE x.headline END, '') AS lh, coalesce(CASE WHEN f THEN x.context ELSE y.context END, '') AS wt, coalesce(CASE WHEN f THEN y.context ELSE x.context END, '') AS lt
 FROM p JOIN memories x ON x.id = a JOIN memories y ON y.id = b)""")
def merged_pairs(spark, sf_dir):
    return dedup.merged(dedup.similar_pairs(vectors(spark, sf_dir), SIMILAR).select("a", "b"), memories(spark, sf_dir)).withColumns({"confidence": F.round("confidence", 6), "headline_md5": F.md5(F.col("headline").cast("binary")), "context_md5": F.md5(F.col("context").cast("binary"))}).drop("headline", "context")


@query(f"""WITH {MEMORIES_SQL} SELECT agent_id, count(*) AS total, count(*) FILTER (WHERE superseded_at IS NULL) AS active, count(*) FILTER (WHERE superseded_at IS NOT NULL) AS superseded, count(*) FILTER (WHERE superseded_at IS NULL AND importance > 0.8) AS important,
count(*) FILTER (WHERE redaction_state = 'redacted') AS redacted, round(avg(importance) FILTER (WHERE superseded_at IS NULL), 6) AS avg_importance, count(DISTINCT memory_type) FILTER (WHERE superseded_at IS NULL) AS types, max(created_at) AS newest FROM memories GROUP BY agent_id""")
def memory_stats(spark, sf_dir):
    return telemetry.memory_stats(memories(spark, sf_dir))


@query(f"WITH {MEMORIES_SQL} SELECT id, agent_id FROM memories WHERE tenant_id = 'en' AND superseded_at IS NULL AND coalesce(redaction_state, 'active') NOT IN ('redacted', 'pending_resynthesis') AND (is_pinned IS NOT TRUE) AND memory_type <> 'raw_turn'")
def tenant_view(spark, sf_dir):
    m = for_tenant(active(memories(spark, sf_dir)), "en")
    kept = ~F.coalesce("redaction_state", F.lit("active")).isin("redacted", "pending_resynthesis")
    return m.where(kept & ~F.col("is_pinned").eqNullSafe(True) & (F.col("memory_type") != "raw_turn")).select("id", "agent_id")


@query(f"WITH {USAGE_SQL} SELECT tenant_id, endpoint, count(*) AS calls, count(*) FILTER (WHERE status_code >= 500) AS errors, round(avg(response_time_ms), 6) AS avg_ms, round(max(response_time_ms), 6) AS max_ms FROM api_usage GROUP BY ALL")
def usage_by_endpoint(spark, sf_dir):
    return telemetry.usage_by_endpoint(api_usage(spark, sf_dir))


@query(f"""WITH {USAGE_SQL}, v AS (SELECT endpoint, count(*) AS n, list_sort(list(response_time_ms)) AS x, avg(response_time_ms) AS m, count(*) FILTER (WHERE status_code >= 500) AS e FROM api_usage GROUP BY endpoint)
SELECT endpoint, n AS calls, x[1] AS least, x[n] AS most, round(m, 6) AS mean, round(e / n, 6) AS error_rate, round((x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2, 6) AS p50, x[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95, x[least(CAST(floor(n * 0.99) AS BIGINT), n - 1) + 1] AS p99 FROM v""")
def latency_percentiles(spark, sf_dir):
    return telemetry.percentiles(api_usage(spark, sf_dir))


@query(f"WITH {USAGE_SQL} SELECT tenant_id, endpoint, count(*) AS calls, CAST(grouping(tenant_id, endpoint) AS INTEGER) AS level FROM api_usage GROUP BY ROLLUP (tenant_id, endpoint)")
def usage_rollup(spark, sf_dir):
    return telemetry.rollup(api_usage(spark, sf_dir))


_Z = """x AS (SELECT event_id, endpoint, response_time_ms AS v, count(*) OVER w AS n, avg(response_time_ms) OVER w AS m, stddev_samp(response_time_ms) OVER w AS sd FROM (SELECT *, epoch_us(created_at) AS s FROM api_usage)
WINDOW w AS (PARTITION BY endpoint ORDER BY s RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)), z AS (SELECT *, (v - m) / sd AS z FROM x WHERE n >= 5 AND sd > 0)"""


@query(f"WITH {USAGE_SQL}, {_Z} SELECT event_id, round(z, 4) AS z FROM z")
def rolling_zscores(spark, sf_dir):
    return telemetry.rolling_zscores(api_usage(spark, sf_dir)).select("event_id", F.round("z", 4).alias("z"))


@query(f"WITH {USAGE_SQL} SELECT event_id, n AS in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY tenant_id ORDER BY s RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM api_usage)) WHERE n > 1")
def rate_limited(spark, sf_dir):
    return telemetry.rate_limited(api_usage(spark, sf_dir), 600, 1)


_TRACE = """t AS (SELECT *, 'Traceback' || chr(10) || '  File "app' || endpoint || '.py", line ' || CAST(event_id AS VARCHAR) || ', in call' || chr(10) || '    work()' || chr(10) || 'ValueError: ' || props AS traceback FROM api_usage WHERE status_code >= 500),
h AS (SELECT *, substr(sha256('ValueError:' || endpoint || ':' || regexp_replace(array_to_string(list_transform(list_filter(string_split(traceback, chr(10)), lambda l: contains(l, 'File') OR contains(l, 'Error') OR contains(l, 'Exception')), lambda l: string_split(l, ', line ')[1]), ''), '[0-9]', '', 'g')), 1, 16) AS hash FROM t)"""


@query(f"WITH {USAGE_SQL}, {_TRACE}, s AS (SELECT hash, tenant_id, min(created_at) AS f FROM h GROUP BY ALL), o AS (SELECT hash, string_agg(CAST(tenant_id AS VARCHAR), ',' ORDER BY f, tenant_id) AS tenants FROM s GROUP BY hash) SELECT hash, count(*) AS occurrences, min(created_at) AS first_seen, max(created_at) AS last_seen, any_value(tenants) AS tenants FROM h JOIN o USING (hash) GROUP BY hash")
def error_groups(spark, sf_dir):
    return telemetry.error_groups(_traced(spark, sf_dir)).withColumn("tenants", F.array_join(F.transform("tenants", lambda t: t.cast("string")), ","))


def _traced(spark, sf_dir):
    """Errors with a traceback: each from a line of its own."""
    trace = F.concat(F.lit('Traceback\n  File "app'), "endpoint", F.lit('.py", line '), F.col("event_id").cast("string"), F.lit(", in call\n    work()\nValueError: "), "props")
    return api_usage(spark, sf_dir).where("status_code >= 500").withColumns({"error_type": F.lit("ValueError"), "traceback": trace})


@query(f"WITH {USAGE_SQL} SELECT time_bucket(INTERVAL 1 DAY, created_at) AS start, endpoint, count(*) AS calls FROM api_usage GROUP BY ALL")
def daily_calls(spark, sf_dir):
    return telemetry.tumbling(api_usage(spark, sf_dir))


@query(f"""WITH {USAGE_SQL}, x AS (SELECT user_id, event_id, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM api_usage), y AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 86400 THEN 1 ELSE 0 END AS k FROM x),
z AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM y) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS calls, max(s) - min(s) AS seconds FROM z GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    return telemetry.sessions(api_usage(spark, sf_dir))


@query(f"WITH {USAGE_SQL} SELECT event_id, tenant_id, endpoint FROM api_usage WHERE (created_at, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 500) ORDER BY created_at DESC, event_id DESC LIMIT 100")
def keyset_page(spark, sf_dir):
    return telemetry.keyset_page(api_usage(spark, sf_dir), "2024-01-20 00:00:00", 500, 100).select("event_id", "tenant_id", "endpoint")


@query(f"""WITH {USAGE_SQL}, l AS (SELECT * FROM api_usage WHERE endpoint = '/purchase'), r AS (SELECT * FROM api_usage WHERE endpoint = '/view'),
m AS (SELECT l.event_id AS left_id, max(struct_pack(t := r.created_at, id := r.event_id)) AS b FROM l JOIN r ON l.user_id = r.user_id AND r.created_at <= l.created_at AND r.created_at >= l.created_at - INTERVAL 1 DAY GROUP BY 1)
SELECT l.event_id AS left_id, m.b.id AS right_id FROM l LEFT JOIN m ON m.left_id = l.event_id""")
def asof_feedback(spark, sf_dir):
    u = api_usage(spark, sf_dir)
    return telemetry.asof(u.where("endpoint = '/purchase'"), u.where("endpoint = '/view'"), "user_id", 86400)


@query("""WITH i AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS id FROM lineitem), p AS (SELECT a.id, b.id AS other, count(*) AS shared FROM i a JOIN i b USING (entity) WHERE a.id <> b.id GROUP BY ALL)
SELECT id, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) AS r FROM p) WHERE r <= 10""")
def entity_cooccurrence(spark, sf_dir):
    return graph.co_occurrence(scan(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("id")).distinct(), 10)


@query(f"""WITH {MEMORIES_SQL} SELECT id, round(greatest(0.01, relevance_score - CASE memory_type WHEN 'preference' THEN 0.001 WHEN 'correction' THEN 0.001 WHEN 'relationship' THEN 0.002 WHEN 'decision' THEN 0.005 WHEN 'fact' THEN 0.02 WHEN 'task' THEN 0.03 ELSE 0.01 END
 * CASE temporal_type WHEN 'permanent' THEN 0.0 WHEN 'event' THEN 1.5 ELSE 1.0 END), 6)::DOUBLE AS relevance FROM memories WHERE superseded_at IS NULL AND relevance_score > 0.01 AND memory_type <> 'identity'""")
def decay(spark, sf_dir):
    return lifecycle.decayed(active(memories(spark, sf_dir))).withColumn("relevance", F.round("relevance", 6))


@query("SELECT o_custkey, o_orderstatus, count(*) AS mentions, CAST(round(least(1.0, 0.5 + 0.1 * (count(*) - 1)), 6) AS DOUBLE) AS strength FROM orders GROUP BY ALL")
def upserted_strength(spark, sf_dir):
    return lifecycle.upserted_strength(scan(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"]).withColumn("strength", F.round("strength", 6))


@query("""WITH RECURSIVE f AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, event_type = 'click' AS used FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS r, 0.5::DOUBLE AS v FROM f UNION ALL SELECT s.id, f.r, CASE WHEN used THEN least(1.0, v + 0.05) ELSE greatest(0.05, v - 0.02) END FROM s JOIN f ON f.id = s.id AND f.r = s.r + 1)
SELECT id, round(arg_max(v, r), 6) AS importance, max(r) AS n FROM s GROUP BY id""")
def feedback_importance(spark, sf_dir):
    recalls = scan(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    return lifecycle.feedback_importance(recalls.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("used")))


@query("SELECT user_id AS id, event_id AS seq, CAST(row_number() OVER w AS INTEGER) AS version, lead(event_id) OVER w IS NULL AS is_latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def memory_versions(spark, sf_dir):
    return lifecycle.versions(scan(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq")))


_STATES = {"click": "active", "view": "modified", "error": "redacted", "purchase": "pending_resynthesis", "signup": "active"}


@query("""WITH x AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'modified' WHEN 'error' THEN 'redacted' WHEN 'purchase' THEN 'pending_resynthesis' ELSE 'active' END AS state FROM events),
y AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY id ORDER BY seq), 'active') AS was FROM x)
SELECT id, seq, was, state FROM y WHERE was <> state AND (was || '>' || state) NOT IN ('active>modified', 'active>redacted', 'modified>active', 'modified>redacted', 'pending_resynthesis>active', 'pending_resynthesis>redacted', 'pending_resynthesis>modified')""")
def illegal_moves(spark, sf_dir):
    state = F.lit("active")
    for kind, s in _STATES.items():
        state = F.when(F.col("event_type") == kind, s).otherwise(state)
    return lifecycle.illegal_moves(scan(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), state.alias("state")))


_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem)"


def _edge_rows(spark, sf_dir):
    """Parts and, below zero, suppliers that lineitem brings together, as often as it does."""
    return scan(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))


def _all_edges(spark, sf_dir):
    return _edge_rows(spark, sf_dir).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS hop UNION SELECT u.dst, hop + 1 FROM h JOIN u ON u.src = h.id WHERE hop < 3) SELECT id, min(hop) AS hop FROM h GROUP BY id""")
def graph_hops_all(spark, sf_dir):
    return graph.hops(_edge_rows(spark, sf_dir), spark.range(7, 8).select("id"), 3)


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h AS (SELECT CAST(7 AS BIGINT) AS id, 0 AS hop UNION SELECT u.dst, hop + 1 FROM h JOIN u ON u.src = h.id WHERE hop < 1), n AS (SELECT id, min(hop) AS hop FROM h GROUP BY id)
SELECT src, dst, min(hop) + 1 AS hop FROM (SELECT e.*, hop FROM e JOIN n ON n.id = src UNION ALL SELECT e.*, hop FROM e JOIN n ON n.id = dst) GROUP BY src, dst""")
def graph_subgraph_all(spark, sf_dir):
    return graph.subgraph(_edge_rows(spark, sf_dir), spark.range(7, 8).select("id"), 2)


@query("""WITH c AS (SELECT source AS cluster, lang AS agent, rtrim(regexp_replace(lower(trim(unnest(string_split(regexp_replace(trim(text), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))), ' ' || chr(9) || chr(10) || chr(13))), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '.!?,;:') AS claim FROM documents),
v AS (SELECT cluster, claim, count(DISTINCT agent) AS votes FROM c WHERE claim <> '' GROUP BY ALL),
n AS (SELECT source AS cluster, count(DISTINCT lang) AS agents FROM documents GROUP BY 1) SELECT cluster, claim, votes, votes >= (agents + 1) // 2 AS retained FROM v JOIN n USING (cluster)""")
def claim_votes_all(spark, sf_dir):
    return text.claim_votes(scan(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("agent"), "text"))


@query("""WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS src FROM lineitem GROUP BY 1), u AS (SELECT id, len(src) AS n, unnest(src) AS source FROM s), r AS (SELECT id, n, count(*) AS lost FROM u WHERE source IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7') GROUP BY id, n)
SELECT id, CASE WHEN lost >= n THEN 'redacted' ELSE 'pending_resynthesis' END AS state, lost FROM r""")
def redaction_by_brand(spark, sf_dir):
    s = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("source_ids"))
    return lifecycle.redaction_cascade(s, scan(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("id")))


@query("SELECT conv_id, turn, text AS user_text, reply FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def turn_pairs(spark, sf_dir):
    return text.turn_pairs(scan(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, count(*) OVER w AS n_before, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS context_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def sliding_context(spark, sf_dir):
    return text.sliding_context(scan(spark, sf_dir, "conversations"))


@query()
def text_chunks(spark, sf_dir):
    return text.chunks(scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT conv_id FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY 1) WHERE u > 0 AND s = 0")
def orphan_threads(spark, sf_dir):
    c = scan(spark, sf_dir, "conversations")
    return c.where("role = 'user'").select("conv_id").distinct().join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti")


@query("SELECT n_name, r_name, count(c_custkey) AS tenants, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def tenant_counts(spark, sf_dir):
    n = scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(scan(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return n.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("tenants"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))


from memengine.plans import consolidation, details, fulltext, knowledge, reports, searches, streams, untrusted, writes  # noqa: E402, F401  (they register their queries)
