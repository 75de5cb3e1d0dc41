"""Queries of the write path: folds of logs, cascades, quotas, retention, history, merges' aftermath."""

from __future__ import annotations

from pyspark.sql import functions as F

from memengine.operators import dedup, lifecycle, writes
from memengine.plans.base import query
from memengine.sources.tables import AS_OF, MEMORIES_SQL, VECTORS_SQL, active, memories, scan, vectors

_PAIRS = "p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.embedding, y.embedding) AS s FROM vectors x JOIN vectors y ON x.agent_id = y.agent_id AND x.id < y.id WHERE s >= 0.4)"


def _pairs(spark, sf_dir):
    return dedup.similar_pairs(vectors(spark, sf_dir), 0.4)


@query(f"""WITH {VECTORS_SQL}, {MEMORIES_SQL}, {_PAIRS}, d AS (SELECT a AS id, b AS other, least(1.0, s * 2) AS s FROM p UNION ALL SELECT b, a, least(1.0, s * 2) FROM p),
r AS (SELECT d.*, x.memory_type AS t, y.memory_type AS u, row_number() OVER (PARTITION BY d.id ORDER BY s DESC, other) AS r FROM d JOIN memories x ON x.id = d.id JOIN memories y ON y.id = other QUALIFY r <= 3)
SELECT id, arg_min(other, r) AS duplicate_of, round(arg_min(s, r), 6) AS similarity FROM r WHERE s >= 0.92 OR (s >= 0.85 AND t = u) GROUP BY id""")
def duplicate_check(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("similarity", F.least(F.lit(1.0), F.col("similarity") * 2))
    both = p.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").union(p.select("b", "a", "similarity"))
    return writes.duplicate_check(both, memories(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query("SELECT user_id AS id, count(*) + 1 AS reinforcement_count, round(least(1.0, 0.5 + 0.1 * count(*)), 6)::DOUBLE AS relevance_score, max(ts) AS last_accessed FROM events WHERE event_type = 'click' GROUP BY 1")
def reinforce(spark, sf_dir):
    hits = scan(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))
    return writes.reinforced(hits).withColumn("relevance_score", F.round("relevance_score", 6))


@query("""WITH e AS (SELECT l_orderkey AS src, 10000000 + l_suppkey AS dst, max(l_discount) * 10 AS strength FROM lineitem GROUP BY 1, 2), b AS (SELECT src AS id, dst AS neighbour, strength FROM e UNION ALL SELECT dst, src, strength FROM e),
n AS (SELECT id, neighbour, max(strength) AS strength FROM b WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL)
SELECT id, neighbour, strength FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, neighbour) AS r FROM n) WHERE r <= 10 AND strength >= 0.4""")
def correction_cascade(spark, sf_dir):
    edges = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") + 10000000).alias("dst"), (F.col("l_discount") * 10).alias("strength"))
    return writes.cascade(edges, scan(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("SELECT DISTINCT l_suppkey AS agent, l_partkey AS entity, l_orderkey AS id FROM lineitem")
def entity_index(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("agent"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("id")).distinct()


@query("SELECT l_partkey AS a, l_suppkey AS b, count(*) AS mentions, round(0.5 + 0.1 * (count(*) - 1), 6)::DOUBLE AS strength, max(l_discount) AS strongest FROM lineitem GROUP BY 1, 2")
def edge_upsert(spark, sf_dir):
    """Edges grow by 0.1 without a cap; the other rule keeps the greatest strength offered."""
    e = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("mentions"), F.max("l_discount").alias("strongest"))
    return e.select("a", "b", "mentions", F.round(0.5 + 0.1 * (F.col("mentions") - 1), 6).alias("strength"), "strongest")


@query("""SELECT user_id AS entity, arg_max(k, ts_id) AS kind, any_value(n) AS mention_count, any_value(m) AS last_seen FROM (SELECT user_id, nullif(event_type, 'error') AS k, struct_pack(t := ts, i := nullif(event_type, 'error')) AS ts_id, count(*) OVER (PARTITION BY user_id) AS n, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE k IS NOT NULL GROUP BY user_id""")
def entity_nodes(spark, sf_dir):
    e = scan(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.nullif("event_type", F.lit("error")).alias("kind"), F.col("ts").alias("at"))
    return writes.entity_nodes(e)


@query("""WITH e AS (SELECT doc_id AS id, lower(text) AS t, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS entity FROM documents), l AS (SELECT *, lower(entity) AS n FROM e)
SELECT id, entity, CASE WHEN contains(t, n || ' is a person') OR contains(t, n || ' said') OR contains(t, n || ' prefers') THEN 'person' WHEN contains(n, 'inc') OR contains(n, 'corp') OR contains(n, 'llc') OR contains(n, 'ltd') OR contains(n, 'company') OR contains(n, 'academy') OR contains(n, 'university') THEN 'organization'
 WHEN contains(n, 'project') OR contains(n, 'phase') OR contains(n, 'module') THEN 'project' WHEN contains(t, 'in ' || n) OR contains(t, 'at ' || n) OR contains(t, 'from ' || n) THEN 'location' ELSE 'unknown' END AS kind FROM l""")
def entity_kinds(spark, sf_dir):
    """Each capitalised word of a text as an entity, and its type."""
    e = scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("entity"))
    return e.select("id", "entity", writes.entity_kind(F.col("entity"), F.col("text")).alias("kind"))


@query("""WITH o AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS e FROM lineitem GROUP BY 1), i AS (SELECT id, e, unnest(generate_series(1, len(e))) AS i FROM o), j AS (SELECT id, e, i, unnest(generate_series(i + 1, len(e))) AS j FROM i) SELECT id, e[i] AS a, e[j] AS b FROM j""")
def relation_pairs(spark, sf_dir):
    o = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("entities"))
    return writes.relation_pairs(o)


@query(f"WITH {MEMORIES_SQL} SELECT id, TIMESTAMP '{AS_OF}' AS superseded_at FROM memories WHERE superseded_at IS NULL AND created_at + INTERVAL 12 DAY < TIMESTAMP '{AS_OF}'")
def expired(spark, sf_dir):
    return writes.expired(memories(spark, sf_dir).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 12 DAYS")), AS_OF)


@query(f"""WITH {MEMORIES_SQL}, f AS (SELECT user_id AS id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS u, count(*) FILTER (WHERE event_type = 'view') AS i, count(*) FILTER (WHERE event_type = 'error') AS c FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY 1),
x AS (SELECT id, coalesce(nullif(importance, 0), 0.5) AS now, CASE WHEN c >= 2 THEN 'queue' WHEN u >= 3 AND i = 0 THEN 'raise' WHEN i >= 3 AND u = 0 THEN 'lower' END AS change FROM f JOIN memories USING (id) WHERE n >= 3 AND memory_type <> 'identity' AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR)
SELECT id, change, round(now + CASE change WHEN 'raise' THEN least(0.05, 1.0 - now) WHEN 'lower' THEN greatest(-0.05, 0.1 - now) ELSE 0 END, 3)::DOUBLE AS importance FROM x WHERE change IS NOT NULL""")
def importance_changes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "used").when(F.col("event_type") == "view", "ignored").when(F.col("event_type") == "error", "contradicted")
    feedback = scan(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-23 00:00:00'").select(F.col("user_id").alias("id"), kind.alias("kind"))
    return writes.importance_changes(feedback, memories(spark, sf_dir), AS_OF)


@query("SELECT lang || '/' || source AS topic, count(*) AS n, CASE WHEN count(*) - 1 >= 5 THEN 'deep' WHEN count(*) - 1 >= 2 THEN 'moderate' ELSE 'shallow' END AS depth FROM documents GROUP BY 1")
def topic_coverage(spark, sf_dir):
    return writes.topic_depth(scan(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("topic")).where("topic <> ''"))


@query("""WITH v AS (SELECT user_id AS id, row_number() OVER w AS version, value, value - lag(value) OVER w AS d, lag(value) OVER w AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT id, CAST(version AS INTEGER) AS version, 'value' AS field, o AS old, value AS new FROM v WHERE abs(d) > 0.01""")
def version_changes(spark, sf_dir):
    log = scan(spark, sf_dir, "events")
    v = lifecycle.versions(log.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"))).join(log.select(F.col("event_id").alias("seq"), "value"), "seq")
    return writes.field_changes(v, ["value"])


@query(f"WITH {VECTORS_SQL}, {_PAIRS} SELECT a, b FROM p")
def pair_store(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("a", "b")
    return writes.pair_store(p.union(p.select("b", "a")))


_MERGES = "m AS (SELECT l_suppkey AS loser, min(l_partkey) AS winner FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@query(f"WITH {_MERGES}, e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), r AS (SELECT coalesce(x.winner, src) AS src, coalesce(y.winner, dst) AS dst FROM e LEFT JOIN m x ON x.loser = src LEFT JOIN m y ON y.loser = dst) SELECT DISTINCT src, dst FROM r WHERE src <> dst")
def edge_redirect(spark, sf_dir):
    li = scan(spark, sf_dir, "lineitem")
    merged = li.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("loser")).agg(F.min("l_partkey").alias("winner"))
    return writes.redirected(li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct(), merged)


@query(f"""WITH {VECTORS_SQL}, {_PAIRS}, g AS (SELECT count(*) AS n, round(quantile_cont(s, 0.9), 6) AS p90 FROM p) SELECT n, p90, CASE WHEN n < 12 OR p90 < 0.85 THEN 'NO-GO' WHEN p90 < 0.9 THEN 'CAUTION' ELSE 'GO' END AS gate, CASE WHEN n < 12 OR p90 < 0.85 THEN 0 WHEN p90 < 0.9 THEN 5 ELSE 10 END AS most FROM g""")
def queue_gate(spark, sf_dir):
    return writes.queue_gate(_pairs(spark, sf_dir).withColumnRenamed("similarity", "confidence")).withColumn("p90", F.round("p90", 6))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') AND l_suppkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')")
def delete_cascade(spark, sf_dir):
    gone = scan(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"))
    return writes.without_deleted(scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), gone, "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending_review' WHEN 'error' THEN 'invalidated' WHEN 'purchase' THEN 'resynthesized' WHEN 'signup' THEN 'pending_resynthesis' ELSE 'valid' END AS state FROM events),
y AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY id ORDER BY seq), 'valid') AS was FROM x)
SELECT id, seq, was, state FROM y WHERE was <> state AND (was || '>' || state) NOT IN ('valid>pending_review', 'valid>invalidated', 'valid>resynthesized', 'valid>pending_resynthesis', 'pending_review>valid', 'pending_review>invalidated', 'pending_review>resynthesized', 'pending_resynthesis>resynthesized', 'invalidated>resynthesized')""")
def illegal_synthesis_moves(spark, sf_dir):
    state = lifecycle.choose(F.col("event_type"), {"view": "pending_review", "error": "invalidated", "purchase": "resynthesized", "signup": "pending_resynthesis"}, "valid")
    log = scan(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), state.alias("state"))
    return lifecycle.illegal_moves(log, lifecycle.SYNTHESIS_MOVES, "valid")


@query("""WITH u AS (SELECT c_custkey AS tenant_id, c_mktsegment AS plan, count(o_orderkey) AS used, 3::BIGINT AS asked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT plan, tenant_id, used, asked, quota FROM u JOIN (VALUES ('BUILDING', 10::BIGINT), ('MACHINERY', 15::BIGINT), ('HOUSEHOLD', NULL)) t(plan, quota) USING (plan) WHERE used + asked > quota""")
def quota_check(spark, sf_dir):
    use = scan(spark, sf_dir, "customer").join(scan(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("tenant_id"), F.col("c_mktsegment").alias("plan")).agg(F.count("o_orderkey").alias("used")).withColumn("asked", F.lit(3).cast("long"))
    return writes.over_quota(use, spark.createDataFrame([("BUILDING", 10), ("MACHINERY", 15), ("HOUSEHOLD", None)], "plan string, quota long"))


@query("SELECT event_id, 'auth_' || event_type AS event_type FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, 'gdpr_' || event_type FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'error') AND date_diff('day', CAST(ts AS DATE), DATE '2024-04-12') <= 90")
def retention(spark, sf_dir):
    prefix = F.when(F.col("event_type") == "signup", "auth_").when(F.col("event_type") == "error", "gdpr_").otherwise("")
    logs = scan(spark, sf_dir, "events").select("event_id", F.concat(prefix, "event_type").alias("event_type"), F.col("ts").alias("created_at"))
    return writes.retained(logs, "2024-04-12 00:00:00").select("event_id", "event_type")


@query(f"""WITH {MEMORIES_SQL}, c AS (SELECT id, memory_type, confidence + CASE WHEN is_pinned THEN 0.2 ELSE 0.0 END AS c, access_count > 7 AS shared, access_count AS n FROM memories),
d AS (SELECT *, CASE memory_type WHEN 'identity' THEN greatest(c, 0.85) WHEN 'decision' THEN greatest(c, 0.7) ELSE c END AS d FROM c), e AS (SELECT *, greatest(0.1, least(0.95, d + CASE WHEN shared THEN 0.1 ELSE 0.0 END)) AS e FROM d)
SELECT id, round(e, 6)::DOUBLE AS confidence, round(CASE WHEN n >= 10 THEN e ELSE least(0.95, e + 0.05 * (1 - n / 10)) END, 6)::DOUBLE AS boosted FROM e""")
def confidence(spark, sf_dir):
    c = writes.initial_confidence(F.col("confidence"), F.col("memory_type"), F.col("is_pinned"), F.col("access_count") > 7)
    m = memories(spark, sf_dir).withColumn("c", c)
    return m.select("id", F.round("c", 6).alias("confidence"), F.round(writes.boosted(F.col("c"), F.col("access_count")), 6).alias("boosted"))


@query("""SELECT l_orderkey AS src, l_suppkey AS dst, l_shipmode_ AS kind, least(1.0, l_tax * 20) AS strength FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'knows' ELSE 'other' END AS l_shipmode_ FROM lineitem) WHERE l_orderkey <> l_suppkey AND l_shipmode_ IN ('uses', 'knows') AND l_tax * 20 >= 0.3
 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey IN (SELECT o_orderkey FROM orders)""")
def valid_relations(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "uses").when(F.col("l_returnflag") == "N", "knows").otherwise("other")
    r = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), kind.alias("kind"), (F.col("l_tax") * 20).alias("strength"))
    return writes.valid_relations(r, scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["uses", "knows"])


@query(f"WITH {MEMORIES_SQL} SELECT agent_id, greatest(count(*) - 120, 0) AS rejected, least(count(*), 120) AS accepted FROM memories WHERE superseded_at IS NULL GROUP BY agent_id")
def memory_limit(spark, sf_dir):
    """Rows that an agent's limit of active memories lets in, and those it rejects."""
    n = active(memories(spark, sf_dir)).groupBy("agent_id").agg(F.count("*").alias("n"))
    return n.select("agent_id", F.greatest(F.col("n") - 120, F.lit(0)).alias("rejected"), F.least(F.col("n"), F.lit(120)).alias("accepted"))


@query(f"WITH {MEMORIES_SQL} SELECT id, 'org' AS scope, headline FROM memories WHERE superseded_at IS NULL AND importance >= 0.9")
def org_promote(spark, sf_dir):
    return active(memories(spark, sf_dir)).where("importance >= 0.9").select("id", F.lit("org").alias("scope"), "headline")
