"""Queries of batches, diagnostics, exports, seeds and activation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memengine.operators import consolidation, retrieval
from memengine.plans.base import query
from memengine.plans.consolidation import _QUEUE, _queue
from memengine.plans.recall import QUERY_VECTOR
from memengine.sources.tables import MEMORIES_SQL, USAGE_SQL, VECTORS_SQL, active, api_usage, memories, scan, vectors

_LABEL = "CASE WHEN pair_id % 5 = 0 THEN 'duplicate ' WHEN pair_id % 5 = 1 THEN 'UPDATE' WHEN pair_id % 5 = 2 THEN 'maybe' END"


@query(f"""WITH {_QUEUE}, t AS (SELECT *, upper(trim({_LABEL})) AS label FROM queue WHERE status = 'pending' ORDER BY confidence DESC, pair_id LIMIT 200), m AS (SELECT doc_id AS id FROM documents),
s AS (SELECT pair_id, a, b, label, CASE WHEN a NOT IN (SELECT id FROM m) OR b NOT IN (SELECT id FROM m) THEN 'rejected' WHEN label IS NULL THEN 'pending' ELSE 'classified' END AS status FROM t)
SELECT pair_id, a, b, status, CASE WHEN status = 'classified' THEN CASE WHEN label IN ('DUPLICATE', 'UPDATE', 'CONTRADICTION', 'DISTINCT') THEN label ELSE 'DISTINCT' END END AS kind FROM s""")
def classified_batch(spark, sf_dir):
    q = _queue(spark, sf_dir).withColumn("similarity", F.col("confidence"))
    p = F.col("pair_id")
    labels = q.select("pair_id", F.when(p % 5 == 0, "duplicate ").when(p % 5 == 1, "UPDATE").when(p % 5 == 2, "maybe").alias("label")).where("label IS NOT NULL")
    return consolidation.classification_batch(q, memories(spark, sf_dir), labels, 200)


@query(f"WITH {MEMORIES_SQL}, {_QUEUE}, l AS (SELECT * FROM queue WHERE kind = 'DUPLICATE' AND confidence < 0.85 ORDER BY confidence, pair_id LIMIT 10) SELECT pair_id, l.confidence, x.headline AS headline_a, y.headline AS headline_b FROM l JOIN memories x ON x.id = a JOIN memories y ON y.id = b")
def unsure_duplicates(spark, sf_dir):
    return consolidation.unsure_duplicates(_queue(spark, sf_dir), memories(spark, sf_dir))


@query(f"WITH {MEMORIES_SQL} SELECT agent_id, id, memory_type, created_at, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY created_at, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY agent_id) AS total FROM memories WHERE superseded_at IS NULL")
def exported_memories(spark, sf_dir):
    """Each agent's active memories in the order of an export, with their total."""
    w = Window.partitionBy("agent_id")
    m = active(memories(spark, sf_dir))
    return m.select("agent_id", "id", "memory_type", "created_at", F.row_number().over(w.orderBy("created_at", "id")).alias("place"), F.count("*").over(w).alias("total"))


_SEEDS = "f AS (SELECT lang AS tenant_id, doc_id AS seq, trim(left(text, 40), ' ') AS text FROM documents WHERE trim(left(text, 40), ' ') <> ''), h AS (SELECT l.lang AS tenant_id, count(*) AS n FROM documents l WHERE n_chars < 500 GROUP BY 1), s AS (SELECT tenant_id, count(*) + coalesce(any_value(n), 0) <= 300 AS fits, count(*) AS c FROM f LEFT JOIN h USING (tenant_id) GROUP BY tenant_id)"


@query(f"WITH {_SEEDS} SELECT tenant_id, seq, md5(text) AS text_md5, 0.9::DOUBLE AS confidence FROM f JOIN s USING (tenant_id) WHERE fits")
def seeded_memories(spark, sf_dir):
    """Beginnings of documents as facts; a language holds 300 memories, its short documents being there already."""
    return _seeded(spark, sf_dir)[0].select("tenant_id", "seq", F.md5(F.col("full_content").cast("binary")).alias("text_md5"), "confidence")


@query(f"WITH {_SEEDS} SELECT tenant_id, c AS rejected FROM s WHERE NOT fits")
def rejected_seeds(spark, sf_dir):
    return _seeded(spark, sf_dir)[1]


def _seeded(spark, sf_dir):
    d = scan(spark, sf_dir, "documents")
    facts = d.select(F.col("lang").alias("tenant_id"), F.col("source").alias("agent_id"), F.col("doc_id").alias("seq"), F.substring("text", 1, 40).alias("text"))
    return consolidation.seeded(facts, d.where("n_chars < 500").groupBy(F.col("lang").alias("tenant_id")).agg(F.count("*").alias("n")), 300)


@query(f"WITH {USAGE_SQL} SELECT tenant_id, min(created_at) FILTER (WHERE endpoint = '/click') AS first_recall, count(*) FILTER (WHERE endpoint = '/purchase') = 0 AS never_stored, max(n) >= 10 AS activated FROM (SELECT *, count(*) FILTER (WHERE endpoint = '/click') OVER (PARTITION BY tenant_id, CAST(created_at AS DATE)) AS n FROM api_usage) GROUP BY tenant_id")
def activation(spark, sf_dir):
    """Each tenant's first recall, whether it ever stored, and whether it reached ten recalls on a day."""
    u = api_usage(spark, sf_dir)
    days = u.groupBy("tenant_id", F.to_date("created_at").alias("day")).agg(F.count_if(F.col("endpoint") == "/click").alias("n"), F.min(F.when(F.col("endpoint") == "/click", F.col("created_at"))).alias("first"), F.count_if(F.col("endpoint") == "/purchase").alias("stored"))
    return days.groupBy("tenant_id").agg(F.min("first").alias("first_recall"), (F.sum("stored") == 0).alias("never_stored"), (F.max("n") >= 10).alias("activated"))


_QV = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"


@query(f"WITH {MEMORIES_SQL}, {VECTORS_SQL} SELECT m.id, round(list_cosine_similarity(v.embedding, {_QV}), 6) AS similarity FROM vectors v JOIN memories m USING (id) WHERE m.importance > 0.7 AND m.memory_type <> 'raw_turn' ORDER BY list_cosine_similarity(v.embedding, {_QV}) DESC, m.id LIMIT 15")
def org_recall(spark, sf_dir):
    """The nearest of an organisation's memories: important ones stand for those promoted."""
    shared = memories(spark, sf_dir).where("importance > 0.7 AND memory_type <> 'raw_turn'").select("id")
    best = retrieval.vector_topk(vectors(spark, sf_dir).join(shared, "id", "left_semi"), QUERY_VECTOR, 15)
    return best.select("id", F.round("similarity", 6).alias("similarity"))
