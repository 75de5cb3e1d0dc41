"""Memories scored for one query: the view that the recall queries share, and its SQL."""

from __future__ import annotations

from memengine.operators import retrieval
from memengine.sources.tables import AS_OF, MEMORIES_SQL, VECTORS_SQL, active, memories, vectors

QUERY_VECTOR = [((i * 37) % 64) / 64.0 - 0.5 for i in range(64)]
QV = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"


def scored_memories(spark, sf_dir):
    """Memories with the similarity of the vector of the same number; a row without one has none."""
    return active(memories(spark, sf_dir)).join(retrieval.scored(vectors(spark, sf_dir), QUERY_VECTOR).select("id", "similarity"), "id", "left")


SCORED = f"{MEMORIES_SQL}, {VECTORS_SQL}, scored AS (SELECT m.*, list_cosine_similarity(v.embedding, {QV}) AS similarity FROM memories m LEFT JOIN vectors v USING (id) WHERE superseded_at IS NULL)"
_AGE = f"(epoch(TIMESTAMP '{AS_OF}') / 86400.0 - epoch(created_at) / 86400.0)"
COMPOSITE = f"""composed AS (SELECT *, (0.4 * coalesce(similarity, 0) + 0.35 * (exp(-0.693 * {_AGE} / 3.0) * CASE WHEN {_AGE} < 1 THEN 2.5 ELSE 1 END) + 0.15 * least(1.0, importance * (1 + 0.1 * least(reinforcement_count, 5))) + 0.1 * least(access_count / 10.0, 1.0))
 * CASE WHEN memory_type = 'decision' AND {_AGE} < 7 THEN 1.2 WHEN memory_type = 'identity' THEN 1.15 WHEN memory_type = 'correction' THEN 1.25 WHEN memory_type = 'preference' THEN 1.15 ELSE 1 END AS composite FROM scored)"""
#: The same without the types' factors.
COMPOSITE_PLAIN = f"{COMPOSITE}, plain AS (SELECT *, 0.4 * coalesce(similarity, 0) + 0.35 * (exp(-0.693 * {_AGE} / 3.0) * CASE WHEN {_AGE} < 1 THEN 2.5 ELSE 1 END) + 0.15 * least(1.0, importance * (1 + 0.1 * least(reinforcement_count, 5))) + 0.1 * least(access_count / 10.0, 1.0) AS plain FROM scored)"
