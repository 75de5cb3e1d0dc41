"""Writes as folds: decay, upserts, feedback, versions, states, redaction cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the memory model: daily decay by type, and factors by temporal type.
DECAY = {"preference": 0.001, "correction": 0.001, "relationship": 0.002, "decision": 0.005, "fact": 0.02, "task": 0.03}
OTHER_DECAY, LEAST_RELEVANCE = 0.01, 0.01
TEMPORAL = {"permanent": 0.0, "event": 1.5}
#: State machines: allowed moves of sources and of syntheses.
MOVES = (("active", "modified"), ("active", "redacted"), ("modified", "active"), ("modified", "redacted"), ("pending_resynthesis", "active"), ("pending_resynthesis", "redacted"), ("pending_resynthesis", "modified"))
SYNTHESIS_MOVES = (
    ("valid", "pending_review"), ("valid", "invalidated"), ("valid", "resynthesized"), ("valid", "pending_resynthesis"), ("pending_review", "valid"), ("pending_review", "invalidated"), ("pending_review", "resynthesized"),
    ("pending_resynthesis", "resynthesized"), ("invalidated", "resynthesized"),
)


def choose(c: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for key, value in values.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def decayed(memories: DataFrame) -> DataFrame:
    """(id, relevance): a day's decay by type and temporal type, not below the least; identities and rows at the least are left out."""
    step = choose(F.col("memory_type"), DECAY, OTHER_DECAY) * choose(F.col("temporal_type"), TEMPORAL, 1.0)
    rows = memories.where((F.col("relevance_score") > LEAST_RELEVANCE) & (F.col("memory_type") != "identity"))
    return rows.select("id", F.greatest(F.lit(LEAST_RELEVANCE), F.col("relevance_score") - step).alias("relevance"))


def upserted_strength(mentions: DataFrame, keys: list[str], first: float = 0.5, step: float = 0.1) -> DataFrame:
    """Relation strength after each mention's upsert: capped closed form of the fold, so it pre-aggregates."""
    return mentions.groupBy(*keys).agg(F.count("*").alias("mentions")).withColumn("strength", F.least(F.lit(1.0), first + step * (F.col("mentions") - 1)))


def feedback_importance(feedback: DataFrame) -> DataFrame:
    """(id, importance, n): recalls in order: used +0.05 up to 1, ignored -0.02 down to 0.05.

    The bounds depend on the order, so an id's recalls are folded by one task."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "used")))
    fold = F.aggregate(steps, F.lit(0.5), lambda s, x: F.when(x["used"], F.least(F.lit(1.0), s + 0.05)).otherwise(F.greatest(F.lit(0.05), s - 0.02)))
    return feedback.groupBy("id").agg(F.round(fold, 6).alias("importance"), F.count("*").alias("n"))


def versions(changes: DataFrame) -> DataFrame:
    """(id, seq, version, is_latest) by order of change."""
    w = Window.partitionBy("id").orderBy("seq")
    return changes.select("id", "seq", F.row_number().over(w).alias("version"), F.lead("seq").over(w).isNull().alias("is_latest"))


def illegal_moves(log: DataFrame, moves: tuple = MOVES, first: str = "active") -> DataFrame:
    """(id, seq, was, state) where a state follows another that doesn't lead to it; before the first stands `first`."""
    w = Window.partitionBy("id").orderBy("seq")
    x = log.withColumn("was", F.coalesce(F.lag("state").over(w), F.lit(first)))
    allowed = F.lit(False)
    for a, b in moves:
        allowed = allowed | ((F.col("was") == a) & (F.col("state") == b))
    return x.where(~allowed & (F.col("was") != F.col("state"))).select("id", "seq", "was", "state")


def redaction_cascade(syntheses: DataFrame, redacted: DataFrame) -> DataFrame:
    """(id, state, lost): syntheses by how many of their sources are redacted: all, some; others are left out."""
    rows = syntheses.select("id", F.explode("source_ids").alias("source"), F.size("source_ids").alias("n")).join(redacted.select(F.col("id").alias("source")).distinct(), "source")
    return rows.groupBy("id", "n").agg(F.count_distinct("source").alias("lost")).select("id", F.when(F.col("lost") >= F.col("n"), "redacted").otherwise("pending_resynthesis").alias("state"), "lost")
