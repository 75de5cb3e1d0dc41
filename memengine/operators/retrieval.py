"""Retrieval: candidates, composite ranking, tiers, budget packing, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.functions.scalars import age_days, dot, estimated_tokens, recency, unit

#: Fixed values of the memory model.
WEIGHTS = {"similarity": 0.4, "recency": 0.35, "importance": 0.15, "access": 0.1}
TYPE_MULTIPLIERS = {"identity": 1.15, "correction": 1.25, "preference": 1.15, "synthesis": 1.15}


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, agent_id, similarity) of every row that has a vector: a projection, nothing moves."""
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    return vectors.where(F.col("embedding").isNotNull()).select("id", "agent_id", F.coalesce(dot(unit(F.col("embedding")), q), F.lit(0.0)).alias("similarity"))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k most similar rows: each task keeps its own k best, so one small merge is all that moves."""
    return scored(vectors, query).orderBy(F.desc("similarity"), "id").limit(k)


def topk_by(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes within tasks before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hybrid_candidates(scored: DataFrame, keyword: Column, k_vector: int = 200, k_other: int = 50) -> DataFrame:
    """Vector hits, then important memories and keyword hits that aren't hits yet; each with its strategy.

    scored has id, similarity (null without a vector), importance.  A row takes the first strategy that has it.  One pass: each row enters the lists that it
    may be in, tasks keep the first rows of each list, as many as are enough after the other strategies take theirs, and the choice is made among those few hundred."""
    entry = lambda name, key, may: F.when(may, F.struct(F.lit(name).alias("list"), F.col(key).cast("double").alias("key")))
    lists = F.array_compact(F.array(entry("vector", "similarity", F.col("similarity").isNotNull()), entry("importance", "importance", F.col("importance") > 0.8), entry("keyword", "importance", F.col("hit"))))
    rows = scored.select("id", "similarity", "importance", F.coalesce(keyword, F.lit(False)).alias("hit")).select("id", "similarity", F.explode(lists).alias("e")).select("id", "similarity", "e.list", "e.key")
    top = topk_by(rows, ["list"], [F.desc("key"), F.col("id")], k_vector + 2 * k_other)
    place = lambda name: F.min(F.when(F.col("list") == name, F.col("rank")))
    few = top.groupBy("id").agg(F.max("similarity").alias("similarity"), place("vector").alias("v"), place("importance").alias("i"), place("keyword").alias("k"))
    few = few.withColumn("strategy", F.when(F.col("v") <= k_vector, "vector"))
    for name, column in (("importance", "i"), ("keyword", "k")):
        open_ = F.col("strategy").isNull() & F.col(column).isNotNull()
        so_far = F.sum(open_.cast("int")).over(Window.orderBy(F.asc_nulls_last(column)).rowsBetween(Window.unboundedPreceding, 0))  # of a few hundred rows
        few = few.withColumn("strategy", F.when(open_ & (so_far <= k_other), name).otherwise(F.col("strategy")))
    similarity = F.when(F.col("strategy") == "importance", 0.5).when(F.col("strategy") == "keyword", 0.35).otherwise(F.col("similarity"))
    return few.where("strategy IS NOT NULL").select("id", similarity.alias("similarity"), "strategy")


def composite_score(df: DataFrame, as_of: str, half_life_days: float = 3.0, typed: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """df (similarity, created_at, importance, reinforcement_count, access_count, memory_type) with composite."""
    w = weights or WEIGHTS
    age = age_days(F.col("created_at"), as_of)
    importance = F.least(F.lit(1.0), F.col("importance") * (1 + 0.1 * F.least(F.col("reinforcement_count"), F.lit(5))))
    access = F.least(F.col("access_count") / 10.0, F.lit(1.0))
    score = w["similarity"] * F.coalesce("similarity", F.lit(0.0)) + w["recency"] * recency(age, half_life_days) + w["importance"] * importance + w["access"] * access
    factor = F.lit(1.0)
    if typed:
        for kind, m in TYPE_MULTIPLIERS.items():
            factor = F.when(F.col("memory_type") == kind, m).otherwise(factor)
        factor = F.when((F.col("memory_type") == "decision") & (age < 7), 1.2).otherwise(factor)
    return df.withColumn("composite", score * factor)


def tiered(df: DataFrame) -> DataFrame:
    """Rows above 0.7 with their context, above 0.4 with their headline; the rest go."""
    tier = F.when(F.col("composite") > 0.7, "L1").when(F.col("composite") > 0.4, "L0")
    return df.withColumn("tier", tier).where("tier IS NOT NULL").withColumn("shown", F.when(F.col("tier") == "L1", F.col("context")).otherwise(F.col("headline")))


def pack(df: DataFrame, group: str, budget: int) -> DataFrame:
    """Greedy packing by composite: a row that doesn't fit is skipped, later ones may still fit.

    Each group's rows are the few ranked candidates of one recall (top-k before this), folded in one array."""
    budget = min(max(budget, 500), 16000)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("composite")).alias("o"), F.col("id"), estimated_tokens(F.col("shown")).alias("tokens"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate(ranked, start, lambda a, x: F.when(a["used"] + x["tokens"] <= budget, F.struct((a["used"] + x["tokens"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a))
    return df.groupBy(group).agg(fold.alias("f")).select(group, F.col("f.used").alias("used_tokens"), F.size("f.ids").alias("n_packed"), F.array_join(F.transform("f.ids", lambda x: x.cast("string")), ",").alias("packed"))


def substring_search(df: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """For each (query_id, q): memories whose headline or context holds q, by importance, the newest first. queries is a request: a few rows."""
    hit = F.contains(F.lower("headline"), F.lower("q")) | F.contains(F.lower("context"), F.lower("q"))
    met = df.join(F.broadcast(queries), hit)
    return topk_by(met, ["query_id"], [F.desc("importance"), F.desc("created_at"), F.col("id")], limit)


def _is(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def bm25(df: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows (id, text) that hold a term; lengths and document frequencies are one aggregate row."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "")
    rows = df.select("id", words.alias("ws")).select("id", F.size("ws").alias("dl"), *[F.size(F.filter("ws", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.crossJoin(F.broadcast(totals)).select("id", score.alias("score")).where("score > 0")


#: Fixed values of the memory model: what holds where an agent's configuration says nothing.
CONFIG = {"context_budget": 4000, "semantic_weight": 0.4, "recency_weight": 0.35, "importance_weight": 0.15, "access_weight": 0.1, "recency_half_life_days": 3}


def configured(agents: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """agents (key) with the six values of CONFIG; a missing row, a null and a zero in config mean the default."""
    values = [F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(v)).cast("int" if isinstance(v, int) else "double").alias(c) for c, v in CONFIG.items()]
    return agents.join(config, key, "left").select(key, *values)


def always_block(agents: DataFrame, handoffs: DataFrame, memories: DataFrame, budget: int, corrections: int = 5) -> DataFrame:
    """(agent_id, block, tokens, remaining): what an agent's recall always has, and what it leaves of the budget.

    agents has agent_id, identity and user_profile (JSON texts or null), handoffs agent_id, created_at and summary, of which the last counts, and
    memories are active ones; the latest corrections are shown with headline and context."""
    last = handoffs.groupBy("agent_id").agg(F.max_by("summary", "created_at").alias("summary"))
    shown = F.concat(F.lit("- ⚠️ "), F.coalesce("headline", F.lit("")), F.lit(": "), F.coalesce("context", F.lit("")))
    top = topk_by(memories.where("memory_type = 'correction'"), ["agent_id"], [F.desc("created_at"), F.col("id")], corrections)
    lines = top.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("line")))).alias("lines"))  # a handful each
    part = lambda title, c: F.concat(F.lit(f"### {title}\n"), c)
    block = F.concat_ws("\n\n", part("Agent Identity", F.col("identity")), part("User Profile", F.col("user_profile")), part("Last Session Summary", F.col("summary")), part("Active Corrections", F.array_join(F.col("lines.line"), "\n")))
    out = agents.join(last, "agent_id", "left").join(lines, "agent_id", "left").select("agent_id", block.alias("block"))
    tokens = estimated_tokens(F.col("block")).cast("long")
    return out.select("agent_id", "block", tokens.alias("tokens"), F.greatest(F.lit(0), budget - tokens).alias("remaining"))


def cross_agent(ranked: DataFrame) -> DataFrame:
    """ranked (agent_id, composite, ...) of several agents with tier and shown, which names the agent that the memory is from."""
    out = tiered(ranked.where("agent_id IS NOT NULL"))
    return out.withColumnRenamed("agent_id", "source_agent").withColumn("shown", F.concat(F.lit("[From "), "source_agent", F.lit("] "), "shown"))


def fallback(ranked: DataFrame, least: float = 0.6) -> DataFrame:
    """(agent_id, best, own): whether an agent's best shown memory is good enough, or all agents are asked."""
    best = F.max(F.when(F.col("composite") > 0.4, F.col("composite")))
    return ranked.groupBy("agent_id").agg(best.alias("best")).select("agent_id", "best", F.coalesce(F.col("best") >= least, F.lit(False)).alias("own"))
