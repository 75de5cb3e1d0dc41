"""Queries of dashboards, reports, alerts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memengine.operators import telemetry, threads
from memengine.plans.base import query
from memengine.sources.tables import MEMORIES_SQL, USAGE_SQL, active, api_usage, memories, scan

_NOW = "2024-01-30 00:00:00"


def _since(days):
    return F.col("created_at") >= F.expr(f"timestamp_ntz '{_NOW}' - INTERVAL {days} DAYS")


@query(f"""WITH {USAGE_SQL} SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 1 DAY) AS day, count(*) FILTER (WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 30 DAY) AS month,
count(DISTINCT user_id) FILTER (WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS active_users, round(100.0 * count(*) FILTER (WHERE status_code >= 500) / count(*), 6)::DOUBLE AS error_percent FROM api_usage""")
def usage_windows(spark, sf_dir):
    """Counters over several windows in one scan."""
    return api_usage(spark, sf_dir).agg(
        F.count_if(_since(1)).alias("day"), F.count_if(_since(7)).alias("week"), F.count_if(_since(30)).alias("month"), F.count_distinct(F.when(_since(7), F.col("user_id"))).alias("active_users"), F.round(100 * F.count_if(F.col("status_code") >= 500) / F.count("*"), 6).alias("error_percent"),
    )


@query(f"WITH {USAGE_SQL} SELECT endpoint, count(*) AS calls FROM api_usage WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY GROUP BY endpoint ORDER BY calls DESC, endpoint LIMIT 3")
def popular_endpoints(spark, sf_dir):
    return api_usage(spark, sf_dir).where(_since(7)).groupBy("endpoint").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "endpoint").limit(3)


@query(f"WITH {MEMORIES_SQL} SELECT agent_id, count(*) AS n, max(greatest(created_at, coalesce(superseded_at, created_at))) AS last_active FROM memories GROUP BY agent_id")
def agents_list(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n"), F.max(F.greatest("created_at", F.coalesce("superseded_at", "created_at"))).alias("last_active"))


@query(f"WITH {MEMORIES_SQL} SELECT agent_id FROM memories GROUP BY agent_id ORDER BY count(*) DESC, agent_id LIMIT 1")
def busiest_agent(spark, sf_dir):
    n = memories(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "agent_id").limit(1).select("agent_id")


@query(f"WITH {MEMORIES_SQL} SELECT tenant_id, count(DISTINCT agent_id) AS agents FROM memories WHERE superseded_at IS NULL GROUP BY tenant_id HAVING count(DISTINCT agent_id) >= 2")
def tenants_with_agents(spark, sf_dir):
    return active(memories(spark, sf_dir)).groupBy("tenant_id").agg(F.count_distinct("agent_id").alias("agents")).where("agents >= 2")


@query(f"WITH {USAGE_SQL} SELECT endpoint, count(*) AS n, round(count(*) / greatest((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 6e7, 1), 9) AS per_minute FROM api_usage WHERE status_code >= 500 GROUP BY endpoint")
def error_rate(spark, sf_dir):
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    out = api_usage(spark, sf_dir).where("status_code >= 500").groupBy("endpoint").agg(F.count("*").alias("n"), ((F.max(micros) - F.min(micros)) / 6e7).alias("span"))
    return out.select("endpoint", "n", F.round(F.col("n") / F.greatest("span", F.lit(1.0)), 9).alias("per_minute"))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS day, event_type AS category, CASE WHEN value > 50 THEN 'block' ELSE 'warn' END AS action FROM events) SELECT day, category, action, count(*) AS n, CAST(grouping(day, category, action) AS INTEGER) AS level FROM e GROUP BY GROUPING SETS ((day, category, action), (category), (action), ())""")
def detection_metrics(spark, sf_dir):
    """Daily counts by category and action and their roll-ups in one pass."""
    e = scan(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("category"), F.when(F.col("value") > 50, "block").otherwise("warn").alias("action"))
    d, c, a = F.col("day"), F.col("category"), F.col("action")
    return e.groupingSets([[d, c, a], [c], [a], []], d, c, a).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(f"""WITH {USAGE_SQL}, x AS (SELECT event_id, endpoint, response_time_ms AS v, count(*) OVER w AS n, avg(response_time_ms) OVER w AS m, stddev_samp(response_time_ms) OVER w AS sd FROM (SELECT *, epoch_us(created_at) AS s FROM api_usage) WINDOW w AS (PARTITION BY endpoint ORDER BY s RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, (v - m) / sd AS z FROM x WHERE n >= 5 AND sd > 0), a AS (SELECT CASE WHEN z > 0 THEN 'usage_spike' ELSE 'usage_drop' END AS type, CASE WHEN abs(z) > 5.0 THEN 'critical' WHEN abs(z) > 3.0 THEN 'high' ELSE 'medium' END AS severity, event_id FROM z WHERE abs(z) > 2.0)
SELECT replace(type, 'usage', 'error_rate') AS type, severity, count(*) AS n, max(event_id) AS last_event FROM a GROUP BY ALL""")
def anomaly_summary(spark, sf_dir):
    found = telemetry.anomalies(telemetry.rolling_zscores(api_usage(spark, sf_dir)), "error_rate")
    return found.groupBy("type", "severity").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""WITH s AS (SELECT '/' || lang || '/' || source || '/' || CAST(doc_id % 5 AS VARCHAR) AS scope, doc_id % 100 / 100.0 AS importance FROM documents), k AS (SELECT array_to_string(list_slice(list_filter(string_split(scope, '/'), lambda x: x <> ''), 1, 2), '/') AS k, importance FROM s)
SELECT CASE WHEN k = '' OR k IS NULL THEN 'general' ELSE k END AS cluster, count(*) AS n, round(avg(importance), 6)::DOUBLE AS importance FROM k GROUP BY 1 HAVING count(*) >= 3""")
def scope_clusters(spark, sf_dir):
    d = scan(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 5).cast("string")).alias("scope"), (F.col("doc_id") % 100 / 100.0).alias("importance"))
    key = F.array_join(F.slice(F.filter(F.split("scope", "/"), lambda x: x != ""), 1, 2), "/")
    out = d.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit("general")).alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("importance"))
    return out.where("n >= 3")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS pending FROM events GROUP BY user_id")
def contributor_counters(spark, sf_dir):
    kind = F.col("event_type")
    return scan(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("accepted"), F.count_if(kind == "error").alias("rejected"), F.count_if(~kind.isin("purchase", "error")).alias("pending"))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS sources, max(ts) AS last_call FROM events GROUP BY user_id")
def api_usage_view(spark, sf_dir):
    return scan(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") != "error").alias("succeeded"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct(F.get_json_object("props", "$.k")).alias("sources"), F.max("ts").alias("last_call"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 ORDER BY ts DESC, event_id LIMIT 50")
def failed_calls(spark, sf_dir):
    """Security view: failures with a field of their JSON, newest first."""
    k = F.get_json_object("props", "$.k").cast("long")
    return scan(spark, sf_dir, "events").where((F.col("event_type") == "error") & (k >= 90)).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", k.alias("k"))


@query("SELECT count(*) AS failures, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15 00:00:00' AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 10")
def auth_failures(spark, sf_dir):
    e = scan(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.expr("timestamp_ntz '2024-01-15 00:00:00'")) & (F.get_json_object("props", "$.k").cast("long") < 10))
    return e.agg(F.count("*").alias("failures"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {MEMORIES_SQL} SELECT memory_type, count(*) AS n, count(*) FILTER (WHERE superseded_at IS NULL) AS active, round(avg(importance), 6) AS importance FROM memories GROUP BY memory_type")
def type_histogram(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("memory_type").agg(F.count("*").alias("n"), F.count_if(F.col("superseded_at").isNull()).alias("active"), F.round(F.avg("importance"), 6).alias("importance"))


@query(f"""WITH {MEMORIES_SQL}, s AS (SELECT (SELECT count(*) FROM memories) AS total, (SELECT count(*) FROM memories WHERE superseded_at IS NOT NULL) AS merged, (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS recalls, (SELECT count(*) FROM events WHERE event_type = 'error') AS contradictions, (SELECT count(*) FROM events WHERE event_type = 'click') AS used, (SELECT count(*) FROM events WHERE event_type = 'view') AS ignored)
SELECT total, merged, recalls, contradictions, used, ignored, CAST(trunc(used / greatest(used + ignored, 1) * 40 + least(merged / greatest(0.01 * total, 1), 1) * 20 + least(recalls / 100, 1) * 20 + (1 - least(contradictions / 10, 1)) * 20) AS INTEGER) AS score FROM s""")
def weekly_report(spark, sf_dir):
    """Scalars of several tables in one row, and the quality score."""
    m = memories(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("superseded_at").isNotNull()).alias("merged"))
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    e = scan(spark, sf_dir, "events").agg(kind("click", "view").alias("recalls"), kind("error").alias("contradictions"), kind("click").alias("used"), kind("view").alias("ignored"))
    return m.crossJoin(e).withColumn("score", telemetry.quality_score())  # one row each


@query(f"WITH {MEMORIES_SQL} SELECT agent_id, count(*) FILTER (WHERE access_count > 0) AS recalled, CAST(sum(least(reinforcement_count, access_count)) AS BIGINT) AS used, round(avg(CASE WHEN access_count > 0 THEN least(reinforcement_count, access_count) / access_count END), 3)::DOUBLE AS hit_rate FROM memories WHERE superseded_at IS NULL GROUP BY agent_id")
def recall_hit_rate(spark, sf_dir):
    """Of active memories: recalls that were used, in all and as a mean rate of those recalled at all."""
    used = F.least("reinforcement_count", "access_count")
    m = active(memories(spark, sf_dir)).select("agent_id", F.col("access_count").alias("recall_count"), used.alias("used_count"))
    return telemetry.recall_stats(m).withColumn("hit_rate", F.round("hit_rate", 3))


@query(f"""WITH {MEMORIES_SQL} SELECT a.agent_id, a.memory_type, id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, memory_type ORDER BY created_at DESC, id) AS r FROM memories) a WHERE r = 1""")
def latest_per_group(spark, sf_dir):
    w = Window.partitionBy("agent_id", "memory_type").orderBy(F.desc("created_at"), "id")
    return memories(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").select("agent_id", "memory_type", "id")


@query("""WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS kind, o_totalprice AS confidence FROM orders) SELECT status, count(*) FILTER (WHERE kind = '1-URGENT') AS urgent, count(*) FILTER (WHERE kind = '5-LOW') AS low, round(avg(confidence) FILTER (WHERE kind = '1-URGENT'), 2) AS avg_urgent FROM o GROUP BY status""")
def queue_report(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return scan(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(urgent).alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.round(F.avg(F.when(urgent, F.col("o_totalprice"))), 2).alias("avg_urgent"))


@query(f"""WITH {USAGE_SQL}, m AS (SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS hour, endpoint, count(*) AS calls, count(*) FILTER (WHERE status_code >= 500) AS errors, count(*) FILTER (WHERE response_time_ms > 90) AS slow FROM api_usage GROUP BY ALL)
SELECT hour, endpoint, CASE WHEN errors > 3 THEN 'errors' ELSE 'slow' END AS rule FROM m WHERE errors > 3 OR (calls > 1 AND slow > 1 AND slow / calls > 0.2)""")
def alert_rules(spark, sf_dir):
    w = F.window(F.col("created_at").cast("timestamp"), "1 hour")
    m = api_usage(spark, sf_dir).groupBy(w.alias("w"), "endpoint").agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.count_if(F.col("response_time_ms") > 90).alias("slow"))
    hit = (F.col("errors") > 3) | ((F.col("calls") > 1) & (F.col("slow") > 1) & (F.col("slow") / F.col("calls") > 0.2))
    return m.where(hit).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "endpoint", F.when(F.col("errors") > 3, "errors").otherwise("slow").alias("rule"))



@query("""WITH RECURSIVE f AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS r FROM events WHERE event_type = 'error'),
s AS (SELECT key, r, t AS last, true AS sent, t FROM f WHERE r = 1 UNION ALL SELECT f.key, f.r, CASE WHEN f.t - last >= 86400 THEN f.t ELSE last END, f.t - last >= 86400, f.t FROM s JOIN f ON f.key = s.key AND f.r = s.r + 1) SELECT key, t AS at_seconds FROM s WHERE sent""")
def alert_cooldown(spark, sf_dir):
    return threads.cooled(scan(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), 86400)


@query("""WITH RECURSIVE f AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS r FROM events),
s AS (SELECT key, r, t AS start FROM f WHERE r = 1 UNION ALL SELECT f.key, f.r, CASE WHEN f.t - start >= 86400 THEN f.t ELSE start END FROM s JOIN f ON f.key = s.key AND f.r = s.r + 1) SELECT key, start, count(*) AS n, greatest(count(*) - 3, 0) AS refused FROM s GROUP BY key, start""")
def first_hit_windows(spark, sf_dir):
    return threads.first_hit_windows(scan(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), 86400, 3)


@query(f"WITH {USAGE_SQL} SELECT endpoint, count(*) AS kept, round(avg(response_time_ms), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY event_id DESC) AS r FROM api_usage) WHERE r <= 1000 GROUP BY endpoint")
def last_thousand(spark, sf_dir):
    """Metrics of the last 1000 calls of each endpoint."""
    return threads.last_n(api_usage(spark, sf_dir), "endpoint", "event_id", 1000).groupBy("endpoint").agg(F.count("*").alias("kept"), F.round(F.avg("response_time_ms"), 6).alias("mean"))
