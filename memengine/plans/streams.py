"""Queries of streams and readers: the tables' conversations are written as log and export files and come back through them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memengine.operators.graph import shared_folder
from memengine.plans.base import query
from memengine.sources.tables import scan
from memengine.streaming import sessions

_TURNS = "t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, text, lag(role) OVER w AS was, lag(text) OVER w AS human FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_KEPT = "k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS before FROM t WHERE role = 'assistant' AND was = 'user' AND NOT (length(human) < 15 AND length(text) < 30) AND NOT contains(human, 'HEARTBEAT') AND NOT contains(text, 'NO_REPLY'))"


def _streamed(spark, sf_dir):
    """The exchanges of all conversations, through log files, the stream and its sink."""
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    c = scan(spark, sf_dir, "conversations").where("text IS NOT NULL")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60)
    logs = c.select(F.lit("message").alias("type"), F.col("conv_id").cast("string").alias("session"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("turn_id"), "role", "text", ts.alias("ts"))
    logs.write.json(f"{folder}/logs")
    sessions.follow(spark, f"{folder}/logs", f"{folder}/sink", f"{folder}/progress", once=True).awaitTermination()
    return sessions.stored(spark, f"{folder}/sink")


@query(f"WITH {_TURNS}, {_KEPT} SELECT session, CAST(turn AS BIGINT) AS turn, CAST(least(4, before) AS INTEGER) AS n_before, md5(human || chr(10) || text) AS exchange_md5 FROM k")
def streamed_exchanges(spark, sf_dir):
    return _streamed(spark, sf_dir).select("session", F.col("turn_id").cast("long").alias("turn"), "n_before", F.md5(F.concat_ws("\n", "human", "reply").cast("binary")).alias("exchange_md5"))


@query(f"WITH {_TURNS}, {_KEPT}, l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS r FROM k QUALIFY r <= 4) SELECT session, md5(string_agg('Human: ' || human || chr(10) || 'Agent: ' || text, chr(10) ORDER BY turn)) AS context_md5, count(*) AS exchanges FROM l GROUP BY session")
def session_contexts(spark, sf_dir):
    return sessions.contexts(_streamed(spark, sf_dir)).select("session", F.md5(F.col("context").cast("binary")).alias("context_md5"), "exchanges")
