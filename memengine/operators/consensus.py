"""Consensus of agents and checks of syntheses: merges by majority, disagreement, selection, citations, cluster ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.functions.scalars import estimated_tokens
from memengine.operators.text import claim_votes, claims


def chosen_agents(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, agents, eligible): the first agents by name; a cluster of one agent isn't eligible."""
    out = candidates.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set("agent")), 1, most).alias("agents"))
    return out.withColumn("eligible", F.size("agents") >= 2)


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """(cluster, agent, retained, tokens, r): by retained claims, then length, then name; one text for each agent of a cluster."""
    votes = claim_votes(candidates).where("retained").select("cluster", "claim")
    own = candidates.select("cluster", "agent", F.explode(claims(F.col("text"))).alias("claim")).distinct().join(votes, ["cluster", "claim"])
    kept = own.groupBy("cluster", "agent").agg(F.count("*").alias("retained"))
    sizes = candidates.groupBy("cluster", "agent").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"))
    out = sizes.join(kept, ["cluster", "agent"], "left").withColumn("retained", F.coalesce("retained", F.lit(0)))
    return out.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("retained"), F.desc("tokens"), "agent")))


def disagreement(candidates: DataFrame) -> DataFrame:
    """(cluster, claim, supporters, dissenters) of the claims that no majority states."""
    own = candidates.select("cluster", "agent", F.explode(claims(F.col("text"))).alias("claim")).groupBy("cluster", "claim").agg(F.array_sort(F.collect_set("agent")).alias("supporters"))
    every = candidates.groupBy("cluster").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    out = own.join(every, "cluster").where(F.size("supporters") < F.ceil(F.size("agents") / 2))
    return out.select("cluster", "claim", "supporters", F.array_except("agents", "supporters").alias("dissenters"))


def cited(text: Column, listed: Column) -> Column:
    """Ids that a synthesis cites, in the text as [src:id] or in its list; each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\[src:([0-9a-f-]+)\]"), F.lit(1)), F.coalesce(listed, F.array().cast("array<string>"))))


def citation_check(syntheses: DataFrame) -> DataFrame:
    """syntheses (text, listed, sources) with cited, unknown ids, valid, and confidence: cited over sources."""
    out = syntheses.withColumn("cited", cited(F.col("text"), F.col("listed"))).withColumn("unknown", F.array_except("cited", "sources"))
    out = out.withColumn("valid", (F.size("cited") > 0) & (F.size("unknown") == 0))
    return out.withColumn("confidence", F.when(F.size("sources") > 0, F.size(F.array_intersect("cited", "sources")) / F.size("sources")).otherwise(0.0))


def cluster_id(ids: Column) -> Column:
    """16 hex digits of the sorted ids' hash."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256), 1, 16)


def resynthesis_sources(syntheses: DataFrame, redacted: DataFrame) -> DataFrame:
    """(id, left, degenerate): the sources that stay when redacted ones go; none left is degenerate."""
    rows = syntheses.select("id", F.explode("source_ids").alias("source"))
    left = rows.join(redacted.select(F.col("id").alias("source")), "source", "left_anti").groupBy("id").agg(F.count("*").alias("left"))
    return syntheses.select("id").join(left, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left"), F.col("left").isNull().alias("degenerate"))
