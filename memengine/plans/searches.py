"""Queries of search, filters, joins, sets, pages and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memengine.functions.scalars import estimated_tokens
from memengine.operators import retrieval, search, threads
from memengine.plans.recall import COMPOSITE as _COMPOSITE, COMPOSITE_PLAIN as _COMPOSITE_PLAIN, SCORED as _SCORED, scored_memories
from memengine.plans.base import query
from memengine.sources.tables import AS_OF, MEMORIES_SQL, VECTORS_SQL, active, memories, scan, vectors

_STOP = ", ".join(f"'{w}'" for w in search.CLASSIFY_STOP)
_ASKED = "q AS (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user')"


def _asked(spark, sf_dir):
    return scan(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"))


@query(f"""WITH {_ASKED}, w AS (SELECT *, lower(trim(q)) AS low, list_filter(regexp_split_to_array(lower(trim(q)), '\\s+'), lambda x: x <> '') AS ws FROM q), k AS (SELECT *, list_filter(ws, lambda x: x NOT IN ({_STOP}) AND length(x) > 2) AS keys, regexp_matches(q, '{search.PROPER}') AS proper,
regexp_matches(low, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches(low, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') OR regexp_matches(low, '({search.MONTHS})\\s+\\d{{4}}') OR regexp_matches(low, '\\d{{1,2}}\\s+({search.MONTHS})') AS dated, len(ws) <= 5 OR contains(low, '"') AS exact FROM w)
SELECT conv_id, turn, CAST(len(keys) AS INTEGER) AS n_keywords, proper, dated, exact, CAST(proper AS INT) + CAST(dated AS INT) + CAST(exact AS INT) + CAST(len(keys) > 0 AS INT) >= 2 OR proper OR dated AS dominant, least(1.0::DOUBLE, round(CAST(proper AS INT) * 0.4 + CAST(dated AS INT) * 0.3 + CAST(exact AS INT) * 0.2 + CAST(len(keys) >= 2 AS INT) * 0.1, 6)::DOUBLE) AS confidence FROM k""")
def query_classes(spark, sf_dir):
    out = search.classified(_asked(spark, sf_dir))
    return out.select("conv_id", "turn", F.size("keywords").alias("n_keywords"), "proper", "dated", "exact", "dominant", "confidence")


_KEYS = ", ".join(f"'{w}'" for w in search.KEYWORD_STOP)


@query(f"WITH {_ASKED} SELECT conv_id, turn, regexp_replace(replace(trim(q), '-', ' '), '\\s+', ' ', 'g') AS clean, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(q), '{search.GAP}+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND x NOT IN ({_KEYS})), 1, 5), ' OR ') AS keywords FROM q")
def query_keywords(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", search.sanitised(F.col("q")).alias("clean"), F.array_join(search.keywords(F.col("q")), " OR ").alias("keywords"))


_LEX = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in search.CRITERIA["urgency"][1])
_RISK = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in search.CRITERIA["risk"][1])


@query(f"""WITH c AS (SELECT doc_id AS id, text, (doc_id * 37) % 100 / 100.0 AS importance, (doc_id * 53) % 100 / 100.0 AS composite FROM documents), s AS (SELECT id, composite, round(least(1.0, 0.3 + 0.15 * ({_LEX})), 3)::DOUBLE AS urgency, round(least(1.0, 0.2 + 0.15 * ({_RISK})), 3)::DOUBLE AS risk, importance::DOUBLE AS custom FROM c WHERE text IS NOT NULL)
SELECT id, urgency, risk, round(0.7 * composite + 0.3 * (urgency * 2 + risk + custom * 0.5) / 3.5, 6)::DOUBLE AS final FROM s""")
def criteria_rerank(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", ((F.col("doc_id") * 37) % 100 / 100.0).alias("importance"), ((F.col("doc_id") * 53) % 100 / 100.0).alias("composite"), F.lit(0.8).alias("confidence"))
    out = search.reranked(d, {"urgency": 2.0, "risk": 1.0, "my own": 0.5})
    one = lambda n: search.criterion(n, F.col("text"), F.col("confidence"), F.col("importance")).alias(n)
    return out.select("id", one("urgency"), one("risk"), F.round("final", 6).alias("final"))


@query("""WITH t AS (SELECT lang || ' ' || source AS topic, CASE WHEN count(*) > 5 THEN 'deep' ELSE 'shallow' END AS depth FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1), a AS (SELECT * FROM (VALUES ('en'), ('de src'), ('klingon'), ('the topic of es src3 here')) v(topic)),
m AS (SELECT a.topic, lower(t.topic) AS k, depth, row_number() OVER (PARTITION BY a.topic ORDER BY lower(t.topic)) AS r FROM a JOIN t ON contains(lower(t.topic), lower(a.topic)) OR contains(lower(a.topic), lower(t.topic)) QUALIFY r <= 3)
SELECT a.topic, count(k) AS known_topics, CASE WHEN count(k) = 0 THEN 'unknown' WHEN bool_and(depth = 'shallow') THEN 'shallow' ELSE 'known' END AS state FROM a LEFT JOIN m USING (topic) GROUP BY a.topic""")
def knowledge_gaps(spark, sf_dir):
    t = scan(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy(F.concat_ws(" ", "lang", "source").alias("topic")).agg(F.when(F.count("*") > 5, "deep").otherwise("shallow").alias("depth"))
    return search.gaps(spark.createDataFrame([("en",), ("de src",), ("klingon",), ("the topic of es src3 here",)], "topic string"), t)


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def requested_events(spark, sf_dir):
    return search.requested(scan(spark, sf_dir, "events"), types=["click", "error"], since="2024-01-10 00:00:00", until="2024-01-20 00:00:00").select("event_id")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'public' WHEN 2 THEN 'ops' END AS role_tag FROM memories) WHERE (role_tag IS NULL OR role_tag IN ('ops', 'public')) AND (agent_id = 'src3' OR memory_type = 'synthesis')")
def visible_to_role(spark, sf_dir):
    tag = F.when(F.col("id") % 4 == 0, "finance").when(F.col("id") % 4 == 1, "public").when(F.col("id") % 4 == 2, "ops")
    return search.requested(memories(spark, sf_dir).withColumn("role_tag", tag), role="ops", agent="src3").select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id, agent_id FROM memories WHERE created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND agent_id LIKE 'src1%' AND agent_id NOT LIKE 'src_0'")
def age_window(spark, sf_dir):
    hours = lambda n: F.expr(f"timestamp_ntz '{AS_OF}' - INTERVAL {n} HOURS")
    m = memories(spark, sf_dir)
    return m.where((F.col("created_at") <= hours(48)) & (F.col("created_at") >= hours(720)) & F.col("agent_id").like("src1%") & ~F.col("agent_id").like("src_0")).select("id", "agent_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_path_filter(spark, sf_dir):
    return scan(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS sources FROM lineitem GROUP BY 1) SELECT id FROM s WHERE list_contains(sources, 77)")
def array_membership(spark, sf_dir):
    s = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("sources"))
    return s.where(F.array_contains("sources", F.lit(77).cast("long"))).select("id")


@query(f"WITH {MEMORIES_SQL}, {VECTORS_SQL} SELECT m.id, coalesce(nullif(importance, 0), 0.5)::DOUBLE AS weight, coalesce(len(embedding), 0)::INTEGER AS dimensions FROM memories m LEFT JOIN vectors v USING (id)")
def defaults_on_read(spark, sf_dir):
    """Null and zero weights become the default; a missing vector has no dimensions."""
    m = memories(spark, sf_dir).join(vectors(spark, sf_dir).select("id", "embedding"), "id", "left")
    return m.select("id", F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)).alias("weight"), F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("dimensions"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def rows_by_ids(spark, sf_dir):
    ids = scan(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(ids, "l_orderkey", "left_semi")


@query("""WITH o AS (SELECT l_orderkey AS thread, min(l_linenumber) * 100 AS "from", max(l_linenumber) * 100 + l_orderkey % 90 AS "to" FROM lineitem GROUP BY l_orderkey), a AS (SELECT o_orderkey AS thread, o_custkey % 700 AS asked_from, o_custkey % 700 + 40 AS asked_to FROM orders) SELECT thread, asked_from, min("from") AS first FROM a JOIN o USING (thread) WHERE asked_from <= "to" AND "from" <= asked_to GROUP BY ALL""")
def overlapping_ranges(spark, sf_dir):
    o = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("thread")).agg((F.min("l_linenumber") * 100).alias("from"), (F.max("l_linenumber") * 100).alias("m")).withColumn("to", F.col("m") + F.col("thread") % 90).drop("m")
    a = scan(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thread"), (F.col("o_custkey") % 700).alias("asked_from"), (F.col("o_custkey") % 700 + 40).alias("asked_to"))
    return threads.overlapping(o, a)


@query("""SELECT c_custkey, count(o_orderkey) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY c_custkey""")
def left_with_range(spark, sf_dir):
    o = scan(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01 00:00:00'").select("o_custkey", "o_orderkey")
    return scan(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("recent"))


@query("SELECT o_orderkey FROM orders o WHERE coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'), 0) <> 2")
def count_is_not_two(spark, sf_dir):
    """A correlated count as a left join."""
    n = scan(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return scan(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").where(F.coalesce("n", F.lit(0)) != 2).select("o_orderkey")


@query("SELECT n_nationkey, role FROM nation CROSS JOIN (VALUES ('admin'), ('member'), ('viewer')) t(role)")
def tenant_roles(spark, sf_dir):
    roles = spark.createDataFrame([("admin",), ("member",), ("viewer",)], "role string")
    return scan(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(roles))


@query("""WITH s AS (SELECT l_orderkey AS id, l_partkey AS parent FROM lineitem), p AS (SELECT p_partkey, p_name FROM part WHERE p_size > 40) SELECT id, count(*) AS n, string_agg(p_name, '; ' ORDER BY p_partkey) AS evidence FROM (SELECT DISTINCT id, parent FROM s) JOIN p ON parent = p_partkey GROUP BY id""")
def evidence(spark, sf_dir):
    """Parents' headlines attached to what derives from them."""
    s = scan(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey")).distinct()
    p = scan(spark, sf_dir, "part").where("p_size > 40").select("p_partkey", "p_name")
    order = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    return s.join(p, "p_partkey").groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda x: x["p_name"]), "; ").alias("evidence"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE sha256(s_name) = sha256((SELECT min(s_name) FROM supplier)) LIMIT 1")
def key_lookup(spark, sf_dir):
    """A key's owner by the key's hash."""
    s = scan(spark, sf_dir, "supplier")
    key = s.agg(F.sha2(F.min("s_name").cast("binary"), 256).alias("h"))
    found = s.withColumn("h", F.sha2(F.col("s_name").cast("binary"), 256)).join(F.broadcast(key), "h", "left_semi")
    found = found.join(scan(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(scan(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return found.select("s_suppkey", "n_name", "r_name").limit(1)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id OFFSET 40 LIMIT 20")
def offset_page(spark, sf_dir):
    return scan(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").offset(40).limit(20).select("event_id")


@query("""WITH x AS (SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 500) ORDER BY ts DESC, event_id DESC LIMIT 101), r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER () AS n FROM x)
SELECT event_id, n > 100 AS has_more, base64(encode(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || CAST(event_id AS VARCHAR))) AS cursor FROM r WHERE r <= 100""")
def keyset_cursor(spark, sf_dir):
    """A page, whether there is more (one row more is asked for), and each row's cursor."""
    from memengine.operators.telemetry import keyset_page

    x = keyset_page(scan(spark, sf_dir, "events").withColumnRenamed("ts", "created_at"), "2024-01-20 00:00:00", 500, 101)
    x = x.withColumns({"r": F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("event_id"))), "n": F.count("*").over(Window.partitionBy(F.lit(1)))})  # 101 rows
    cursor = F.base64(F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("|"), F.col("event_id").cast("string")).cast("binary"))
    return x.where("r <= 100").select("event_id", (F.col("n") > 100).alias("has_more"), cursor.alias("cursor"))


@query(f"""WITH {MEMORIES_SQL} SELECT agent_id, string_agg(headline, '; ' ORDER BY created_at DESC, id DESC) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS r FROM memories WHERE headline IS NOT NULL) WHERE r <= 3 GROUP BY agent_id""")
def recent_headlines(spark, sf_dir):
    m = retrieval.topk_by(memories(spark, sf_dir).where("headline IS NOT NULL"), ["agent_id"], [F.desc("created_at"), F.desc("id")], 3)
    return m.groupBy("agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda x: x["headline"]), "; ").alias("newest"))


@query("SELECT doc_id FROM documents ORDER BY CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END DESC NULLS FIRST, doc_id LIMIT 30")
def nulls_first(spark, sf_dir):
    """Descending with nulls first, as the memory store orders."""
    d = scan(spark, sf_dir, "documents").withColumn("size", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")))
    return d.orderBy(F.desc_nulls_first("size"), "doc_id").limit(30).select("doc_id")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT ALL SELECT s_nationkey + 100 FROM supplier)")
def id_sets(spark, sf_dir):
    c, s = scan(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), scan(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).union(c.select(F.col("k") + 100).exceptAll(s.select(F.col("k") + 100)))


@query("WITH a AS (SELECT user_id AS id, event_id, 1 AS side FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 2 FROM events WHERE event_type = 'view') SELECT id, arg_min(event_id, side * 1000000000 + event_id) AS first_wins, arg_max(event_id, side * 1000000000 + event_id) AS last_wins FROM a GROUP BY id")
def keyed_union(spark, sf_dir):
    """A union by key, in which the first or the last row of a key wins."""
    e = scan(spark, sf_dir, "events")
    side = lambda kind, n: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), "event_id", F.lit(n).alias("side"))
    both, order = side("click", 1).union(side("view", 2)), F.struct("side", "event_id")
    return both.groupBy("id").agg(F.min_by("event_id", order).alias("first_wins"), F.max_by("event_id", order).alias("last_wins"))


@query("WITH a AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey)) AS x, list_sort(list(DISTINCT l_suppkey)) AS y FROM lineitem GROUP BY 1) SELECT id, CAST(len(list_intersect(x, y)) AS INTEGER) AS both, CAST(len(list_filter(x, lambda e: NOT list_contains(y, e))) AS INTEGER) AS only_first, list_has_any(x, y) AS meet FROM a")
def set_operations(spark, sf_dir):
    a = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("x"), F.collect_set("l_suppkey").alias("y"))
    return a.select("id", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_except("x", "y")).alias("only_first"), F.arrays_overlap("x", "y").alias("meet"))


@query("""WITH t AS (SELECT user_id, event_id, CAST(floor(value + 0.5) AS BIGINT) + 1 AS tokens FROM events), r AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM t) SELECT user_id, count(*) AS n, CAST(max(used) AS BIGINT) AS used FROM r WHERE used <= 500 GROUP BY user_id""")
def budget_prefix(spark, sf_dir):
    """The longest prefix, newest first, whose tokens fit."""
    t = scan(spark, sf_dir, "events").select("user_id", "event_id", (F.floor(F.col("value") + 0.5) + 1).alias("tokens"))
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("used", F.sum("tokens").over(w)).where("used <= 500").groupBy("user_id").agg(F.count("*").alias("n"), F.max("used").alias("used"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY p) AS seen FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen_order(spark, sf_dir):
    """Each value once, in the order in which it was first seen."""
    p = scan(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("p"))
    return p.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "event_type"))), lambda x: x["event_type"]), ",").alias("seen"))


@query(f"""WITH {_SCORED}, {_COMPOSITE}, t AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY composed.composite DESC, id) AS r FROM composed WHERE composed.composite > 0.4) SELECT agent_id, round(max(composite), 6)::DOUBLE AS best, max(composite) >= 0.6 AS own FROM t GROUP BY agent_id
UNION ALL SELECT DISTINCT agent_id, NULL::DOUBLE, false FROM composed WHERE agent_id NOT IN (SELECT agent_id FROM t) OR agent_id IS NULL""")
def recall_fallback(spark, sf_dir):
    """Agents whose best own answer reaches 0.6, and those that ask all others; an agent without a shown memory asks them too."""
    ranked = retrieval.composite_score(scored_memories(spark, sf_dir), AS_OF)
    return retrieval.fallback(ranked).withColumn("best", F.round("best", 6))


@query(f"""WITH {_SCORED}, {_COMPOSITE_PLAIN}, own AS (SELECT agent_id, max(composite) AS best FROM composed GROUP BY agent_id), low AS (SELECT agent_id AS asking FROM own WHERE best < 0.6), x AS (SELECT id, agent_id AS source_agent, plain, CASE WHEN plain > 0.7 THEN 'L1' ELSE 'L0' END AS tier, '[From ' || agent_id || '] ' || CASE WHEN plain > 0.7 THEN context ELSE headline END AS shown FROM plain WHERE plain > 0.4 AND agent_id IS NOT NULL)
SELECT id, source_agent, tier, round(plain, 6)::DOUBLE AS composite, md5(shown) AS shown_md5, greatest(1, length(shown) // 4) AS tokens FROM x ORDER BY x.plain DESC, id LIMIT 50""")
def cross_agent_ranks(spark, sf_dir):
    """The 50 best over all agents: scored without the types' factors, each with its agent's name before the text shown."""
    ranked = retrieval.cross_agent(retrieval.composite_score(scored_memories(spark, sf_dir), AS_OF, typed=False))
    best = ranked.orderBy(F.desc("composite"), "id").limit(50)
    return best.select("id", "source_agent", "tier", F.round("composite", 6).alias("composite"), F.md5(F.col("shown").cast("binary")).alias("shown_md5"), estimated_tokens(F.col("shown")).cast("long").alias("tokens"))


@query("""WITH c AS (SELECT n_nationkey AS agent, CASE WHEN n_nationkey % 3 = 0 THEN 1000 * n_nationkey END AS context_budget, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey / 50.0 END AS semantic_weight, CASE WHEN n_nationkey % 5 = 1 THEN 0.2 END AS recency_weight, CASE WHEN n_nationkey % 6 = 2 THEN 0.0 END AS importance_weight, n_nationkey / 100.0 AS access_weight, CASE WHEN n_nationkey % 7 < 3 THEN n_nationkey % 7 END AS half_life FROM nation WHERE n_regionkey <> 2)
SELECT n_nationkey AS agent, CAST(coalesce(nullif(context_budget, 0), 4000) AS INTEGER) AS context_budget, coalesce(nullif(semantic_weight, 0), 0.4)::DOUBLE AS semantic_weight, coalesce(nullif(recency_weight, 0), 0.35)::DOUBLE AS recency_weight, coalesce(nullif(importance_weight, 0), 0.15)::DOUBLE AS importance_weight, coalesce(nullif(access_weight, 0), 0.1)::DOUBLE AS access_weight, CAST(coalesce(nullif(half_life, 0), 3) AS INTEGER) AS recency_half_life_days
FROM nation LEFT JOIN c ON agent = n_nationkey""")
def agent_config(spark, sf_dir):
    """Configured values by agent; missing rows, nulls and zeros fall back to the defaults, field by field."""
    key = F.col("n_nationkey")
    own = scan(spark, sf_dir, "nation").where("n_regionkey <> 2").select(
        key.alias("agent"), F.when(key % 3 == 0, 1000 * key).alias("context_budget"), F.when(key % 4 == 0, key / 50).alias("semantic_weight"), F.when(key % 5 == 1, 0.2).alias("recency_weight"),
        F.when(key % 6 == 2, 0.0).alias("importance_weight"), (key / 100).alias("access_weight"), F.when(key % 7 < 3, key % 7).alias("recency_half_life_days"),
    )
    return retrieval.configured(scan(spark, sf_dir, "nation").select(key.alias("agent")), own, "agent")


_HANDOFFS = "h AS (SELECT source AS agent_id, arg_max(left(text, 200), doc_id) AS summary FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1)"


@query(f"""WITH {MEMORIES_SQL}, {_HANDOFFS}, r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id) AS r FROM memories WHERE superseded_at IS NULL AND memory_type = 'correction' AND agent_id IS NOT NULL),
c AS (SELECT agent_id, '### Active Corrections' || chr(10) || string_agg('- ⚠️ ' || coalesce(headline, '') || ': ' || coalesce(context, ''), chr(10) ORDER BY r) AS block FROM r WHERE r <= 5 GROUP BY agent_id),
a AS (SELECT DISTINCT source AS agent_id, CASE WHEN source LIKE '%1' THEN '{{"name": "' || source || '"}}' END AS identity, CASE WHEN source LIKE '%2' THEN '{{"likes": "brevity"}}' END AS user_profile FROM documents WHERE source IS NOT NULL),
b AS (SELECT a.agent_id, concat_ws(chr(10) || chr(10), '### Agent Identity' || chr(10) || identity, '### User Profile' || chr(10) || user_profile, '### Last Session Summary' || chr(10) || summary, block) AS block FROM a LEFT JOIN h USING (agent_id) LEFT JOIN c USING (agent_id))
SELECT agent_id, md5(block) AS block_md5, greatest(1, length(block) // 4) AS tokens, greatest(0, 4000 - greatest(1, length(block) // 4)) AS remaining FROM b""")
def always_included(spark, sf_dir):
    """Each agent's identity, profile, last handoff and five latest active corrections, and what they leave of its budget."""
    d = scan(spark, sf_dir, "documents").where("source IS NOT NULL")
    agents = d.select(F.col("source").alias("agent_id")).distinct().select(
        "agent_id", F.when(F.col("agent_id").endswith("1"), F.concat(F.lit('{"name": "'), "agent_id", F.lit('"}'))).alias("identity"), F.when(F.col("agent_id").endswith("2"), '{"likes": "brevity"}').alias("user_profile"),
    )
    handoffs = d.where("text IS NOT NULL").select(F.col("source").alias("agent_id"), F.col("doc_id").alias("created_at"), F.substring("text", 1, 200).alias("summary"))
    out = retrieval.always_block(agents, handoffs, active(memories(spark, sf_dir)), 4000)
    return out.select("agent_id", F.md5(F.col("block").cast("binary")).alias("block_md5"), "tokens", "remaining")
