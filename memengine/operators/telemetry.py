"""Usage, health, percentiles, anomalies, cooldowns and limits over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def memory_stats(memories: DataFrame) -> DataFrame:
    """Filtered counts and averages for each agent, in one pass."""
    live = F.col("superseded_at").isNull()
    return memories.groupBy("agent_id").agg(
        F.count("*").alias("total"),
        F.count_if(live).alias("active"),
        F.count_if(~live).alias("superseded"),
        F.count_if(live & (F.col("importance") > 0.8)).alias("important"),
        F.count_if(F.col("redaction_state") == "redacted").alias("redacted"),
        F.round(F.avg(F.when(live, F.col("importance"))), 6).alias("avg_importance"),
        F.count_distinct(F.when(live, F.col("memory_type"))).alias("types"),
        F.max("created_at").alias("newest"),
    )


def usage_by_endpoint(usage: DataFrame) -> DataFrame:
    return usage.groupBy("tenant_id", "endpoint").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 500).alias("errors"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms"), F.round(F.max("response_time_ms"), 6).alias("max_ms")
    )


def percentiles(usage: DataFrame, value: str = "response_time_ms", ranks: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Calls, extremes, mean, error rate, median and nearest-rank percentiles of each endpoint.

    Equal values are counted first; a running count over an endpoint's distinct values finds each rank."""
    counts = usage.groupBy("endpoint", F.col(value).alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col("status_code") >= 500).alias("e"))
    own = Window.partitionBy("endpoint")
    cum = counts.withColumns({"upto": F.sum("c").over(own.orderBy("v")), "n": F.sum("c").over(own)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    n = F.col("n")
    found = [at(F.least(F.floor(n * F.lit(r)), n - 1)).alias(f"p{round(r * 100)}") for r in ranks]
    median = F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 6).alias("p50")
    calls = F.sum("c").alias("calls")
    return cum.groupBy("endpoint").agg(calls, F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.round(F.sum("e") / F.sum("c"), 6).alias("error_rate"), median, *found)


def rollup(usage: DataFrame) -> DataFrame:
    """Calls by tenant and endpoint with subtotals (grouping sets)."""
    return usage.rollup("tenant_id", "endpoint").agg(F.count("*").alias("calls"), F.grouping_id().cast("int").alias("level"))


def rolling_zscores(usage: DataFrame, window_seconds: int = 3600, least: int = 5) -> DataFrame:
    """(event_id, endpoint, value, mean, sd, z): each call's deviation from the endpoint's calls of the window that ends with it (sample deviation).

    A call is dealt to its own stretch of time and, as context, to the next one; so a stretch, not an endpoint's history, is one group.  A stretch is as long as
    the window, so a window is the start of its call's stretch and the end of the one before: two running aggregates, put together without taking anything away."""
    width = window_seconds * 1_000_000
    x = usage.withColumn("s", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("own", F.floor(F.col("s") / width))
    x = x.select("event_id", "endpoint", F.col("response_time_ms").alias("value"), "s", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("stretch"))
    # a call of the stretch before stands where the last window that holds it ends
    mine = F.col("stretch") == F.col("own")
    x = x.withColumns({"end": F.when(mine, F.col("s")).otherwise(F.col("s") + (width - 1)), "now": F.when(mine, F.col("value")), "was": F.when(~mine, F.col("value"))})
    upto = Window.partitionBy("endpoint", "stretch").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for c, w in (("now", upto.orderBy("end")), ("was", upto.orderBy(F.desc("end")))):
        x = x.withColumns({f"{c}_{n}": f(c).over(w) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))})
    m, n, mean, other = F.col("now_n"), F.col("was_n"), F.col("now_mean"), F.coalesce("was_mean", "now_mean")
    squares = m * F.col("now_var") + F.coalesce(n * F.col("was_var"), F.lit(0.0)) + (mean - other) * (mean - other) * m * n / (m + n)
    x = x.where(mine).withColumns({"n": m + n, "mean": (m * mean + n * other) / (m + n), "sd": F.sqrt(squares / F.greatest(m + n - 1, F.lit(1)))})
    varies = F.greatest("now_max", "was_max") > F.least("now_min", "was_min")  # rounding alone must not make a deviation
    return x.where((F.col("n") >= least) & varies & (F.col("sd") > 0)).select("event_id", "endpoint", "value", "mean", "sd", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


#: Deviations from which each kind of metric is an anomaly, and multiples of them by severity.
SENSITIVITY = {"error_rate": 2.0, "latency": 2.5, "usage": 3.0}
SEVERE = (("critical", 2.5), ("high", 1.5))


def anomalies(scores: DataFrame, category: str = "latency") -> DataFrame:
    """(event_id, endpoint, type, severity, z) of those beyond the category's sensitivity."""
    limit, size = SENSITIVITY[category], F.abs("z")
    severity = F.lit("medium")
    for name, times in reversed(SEVERE):
        severity = F.when(size > limit * times, name).otherwise(severity)
    kind = F.when(F.col("z") > 0, f"{category}_spike").otherwise(f"{category}_drop")
    return scores.where(size > limit).select("event_id", "endpoint", kind.alias("type"), severity.alias("severity"), "z")


def rate_limited(usage: DataFrame, window_seconds: int = 60, limit: int = 2) -> DataFrame:
    """(event_id, in_window): calls with more than `limit` calls of the tenant in the window that ends with them."""
    w = Window.partitionBy("tenant_id").orderBy("s").rangeBetween(-(window_seconds - 1), 0)
    return usage.withColumn("s", F.unix_seconds(F.col("created_at").cast("timestamp"))).withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > limit).select("event_id", "in_window")


def fingerprint(error_type: Column, traceback: Column, endpoint: Column) -> Column:
    """16 hex digits for errors alike: type, endpoint and the telling lines of the traceback without line numbers and digits."""
    telling = F.filter(F.split(traceback, "\n"), lambda line: line.contains("File") | line.contains("Error") | line.contains("Exception"))
    lines = F.transform(telling, lambda line: F.substring_index(line, ", line ", 1))
    return F.substring(F.sha2(F.concat(error_type, F.lit(":"), endpoint, F.lit(":"), F.regexp_replace(F.array_join(lines, ""), "[0-9]", "")).cast("binary"), 256), 1, 16)


def error_groups(errors: DataFrame) -> DataFrame:
    """Errors by fingerprint: first and last seen, count, and the tenants in the order in which they met it."""
    own = errors.withColumn("hash", fingerprint(F.col("error_type"), F.col("traceback"), F.col("endpoint")))
    by_tenant = own.groupBy("hash", "tenant_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    order = F.array_sort(F.collect_list(F.struct("first", "tenant_id")))
    return by_tenant.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.transform(order, lambda x: x["tenant_id"]).alias("tenants"))


def tumbling(usage: DataFrame, width: str = "1 day") -> DataFrame:
    """Calls in each window of fixed width; the same expression runs on a stream (see memengine.streaming)."""
    w = F.window(F.col("created_at").cast("timestamp"), width)
    return usage.groupBy(w.alias("w"), "endpoint").agg(F.count("*").alias("calls")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "endpoint", "calls")


def sessions(usage: DataFrame, gap_seconds: int = 86400) -> DataFrame:
    """(user_id, session, calls): runs of calls less than the gap apart."""
    own = Window.partitionBy("user_id").orderBy("s", "event_id")
    x = usage.withColumn("s", F.unix_seconds(F.col("created_at").cast("timestamp")))
    x = x.withColumn("new", F.coalesce((F.col("s") - F.lag("s").over(own) >= gap_seconds).cast("int"), F.lit(0)))
    x = x.withColumn("session", F.sum("new").over(own))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("calls"), (F.max("s") - F.min("s")).alias("seconds"))


def keyset_page(df: DataFrame, after_time: str, after_id: int, size: int) -> DataFrame:
    """The next page, newest first, behind (time, id): the cursor reaches the scan as a filter, and only a page is sorted."""
    t, i = F.expr(f"timestamp_ntz '{after_time}'"), F.lit(after_id)
    behind = (F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("event_id") < i))
    return df.where(behind).orderBy(F.desc("created_at"), F.desc("event_id")).limit(size)


def asof(left: DataFrame, right: DataFrame, by: str, tolerance_seconds: int) -> DataFrame:
    """(left_id, right_id): for each left row the latest right row of the same key at or before it, within the tolerance.

    Both sides go through one window ordered by time, so there is no range join and nothing larger than a key's rows."""
    l = left.select(by, F.col("event_id").alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.lit(1).alias("side"))
    r = right.select(by, F.lit(None).cast("long").alias("left_id"), F.col("event_id").alias("right_id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.lit(0).alias("side"))
    w = Window.partitionBy(by).orderBy("t", "side", "right_id")
    last = F.last(F.when(F.col("side") == 0, F.struct("t", "right_id")), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("m", last).where("side = 1")
    near = F.col("t") - F.col("m.t") <= tolerance_seconds * 1_000_000
    return out.select("left_id", F.when(near, F.col("m.right_id")).alias("right_id"))


def quality_score() -> Column:
    """From 0 to 100, truncated: used recalls 40, merges 20, recalls 20, lack of contradictions 20; over used, ignored, merged, total, recalls, contradictions."""
    part = lambda c: F.least(c, F.lit(1.0))
    usage = F.col("used") / F.greatest(F.col("used") + F.col("ignored"), F.lit(1))
    merges = part(F.col("merged") / F.greatest(0.01 * F.col("total"), F.lit(1.0)))
    return (usage * 40 + merges * 20 + part(F.col("recalls") / 100) * 20 + (1 - part(F.col("contradictions") / 10)) * 20).cast("int")


def recall_stats(active: DataFrame) -> DataFrame:
    """(agent_id, recalled, used, hit_rate) of active memories (agent_id, recall_count, used_count)."""
    rate = F.when(F.col("recall_count") > 0, F.col("used_count") / F.col("recall_count"))
    return active.groupBy("agent_id").agg(F.count_if(F.col("recall_count") > 0).alias("recalled"), F.sum("used_count").alias("used"), F.avg(rate).alias("hit_rate"))
