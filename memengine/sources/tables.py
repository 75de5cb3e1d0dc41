"""Table scans with explicit tenant context, and the memory-shaped views of the driver's tables.

The adapters are deterministic projections; the operators take any DataFrame of
the same shape.  `as_of` is always a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
MEMORY_TYPES = ("fact", "decision", "preference", "task", "correction", "identity", "raw_turn")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_tenant(df: DataFrame, tenant: str | int, column: str = "tenant_id") -> DataFrame:
    """Row-level isolation: every scan of tenant data goes through this filter, which reaches the Parquet reader."""
    return df.where(F.col(column) == F.lit(tenant))


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("superseded_at").isNull())


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: one row a document."""
    docs = scan(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in MEMORY_TYPES]), (F.col("doc_id") % 7 + 1).cast("int"))
    created = F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - make_dt_interval(cast(doc_id % 60 AS int), cast(doc_id % 24 AS int))")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("agent_id"),
        F.substring("text", 1, 80).alias("headline"),
        F.col("text").alias("context"),
        F.col("text").alias("full_content"),
        kind.alias("memory_type"),
        ((F.col("doc_id") * 37) % 100 / 100.0).alias("importance"),
        (F.col("doc_id") % 15).alias("access_count"),
        (F.col("doc_id") % 6 + 1).alias("reinforcement_count"),
        created.alias("created_at"),
        F.when(F.col("doc_id") % 11 == 0, created).alias("superseded_at"),
        F.when(F.col("doc_id") % 17 == 0, "redacted").alias("redaction_state"),
        (F.col("doc_id") % 13 == 0).alias("is_pinned"),
        ((F.col("doc_id") * 53) % 100 / 100.0).alias("relevance_score"),
        ((F.col("doc_id") * 29) % 100 / 100.0).alias("confidence"),
        F.element_at(F.array(F.lit("state"), F.lit("event"), F.lit("permanent")), (F.col("doc_id") % 3 + 1).cast("int")).alias("temporal_type"),
    )


#: The same view for DuckDB.
MEMORIES_SQL = f"""memories AS (SELECT doc_id AS id, lang AS tenant_id, source AS agent_id, substr(text, 1, 80) AS headline, text AS context,
 text AS full_content, (['fact','decision','preference','task','correction','identity','raw_turn'])[doc_id % 7 + 1] AS memory_type,
 ((doc_id * 37) % 100) / 100.0::DOUBLE AS importance, doc_id % 15 AS access_count, doc_id % 6 + 1 AS reinforcement_count,
 TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 60 AS INTEGER)) - to_hours(doc_id % 24) AS created_at,
 CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 60 AS INTEGER)) - to_hours(doc_id % 24) END AS superseded_at,
 CASE WHEN doc_id % 17 = 0 THEN 'redacted' END AS redaction_state, doc_id % 13 = 0 AS is_pinned, ((doc_id * 53) % 100) / 100.0::DOUBLE AS relevance_score, ((doc_id * 29) % 100) / 100.0::DOUBLE AS confidence, (['state','event','permanent'])[doc_id % 3 + 1] AS temporal_type FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("agent_id"), F.col("embedding").cast("array<double>").alias("embedding"))


VECTORS_SQL = "vectors AS (SELECT vec_id AS id, label AS agent_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as API calls: tenant, endpoint, latency, status."""
    return scan(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 20).alias("tenant_id"), "user_id", F.concat(F.lit("/"), "event_type").alias("endpoint"), F.col("ts").alias("created_at"),
        F.col("value").alias("response_time_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), "props",
    )


USAGE_SQL = "api_usage AS (SELECT event_id, user_id % 20 AS tenant_id, user_id, '/' || event_type AS endpoint, ts AS created_at, value AS response_time_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, props FROM events)"
