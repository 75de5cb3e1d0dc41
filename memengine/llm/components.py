"""Connected components of an edge table, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import written

JUMPS = 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): for each vertex of an edge the smallest vertex that it reaches.

    Each round sends every vertex to the smallest of its neighbours and itself,
    follows those pointers a few steps, and keeps the edges between different
    targets; a chain shrinks at least fourfold a round.  Every round is a
    written table.  No vertex gathers its neighbours: the minimum is
    pre-aggregated by the tasks.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = None
    while not now.isEmpty():
        jump = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("vertex"), F.least("u", "v").alias("target"))
        for _ in range(JUMPS):
            jump = written(jump, "jumps")
            step = jump.select(F.col("vertex").alias("target"), F.col("target").alias("next"))
            jump = jump.join(step, "target").select("vertex", F.col("next").alias("target"))
        jump = written(jump, "jumps")
        if found is None:
            found = jump.select("vertex", F.col("target").alias("component"))
        else:
            step = jump.select(F.col("vertex").alias("component"), F.col("target").alias("next"))
            found = found.join(step, "component", "left").select("vertex", F.coalesce("next", "component").alias("component"))
        found = written(found, "components")
        u, v = jump.select(F.col("vertex").alias("u"), F.col("target").alias("x")), jump.select(F.col("vertex").alias("v"), F.col("target").alias("y"))
        now = written(now.join(u, "u").join(v, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")) if found is None else found
