"""Hand-written examples of the memory model's rules: a query and its SQL share an author, these don't."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memengine.operators import retrieval, search, secrets, telemetry, threads, writes

NOW = "2024-01-31 00:00:00"


def memory(spark, **values):
    row = {"id": 1, "agent_id": "a", "similarity": 0.5, "created_at": "2024-01-28 00:00:00", "importance": 0.5, "reinforcement_count": 2, "access_count": 5, "memory_type": "fact", "headline": "head", "context": "context"} | values
    return spark.createDataFrame([row]).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_composite_weighs_similarity_above_recency(spark):
    (row,) = retrieval.composite_score(memory(spark), NOW).collect()
    assert row["composite"] == pytest.approx(0.4 * 0.5 + 0.35 * 2.718281828 ** (-0.693) + 0.15 * 0.5 * 1.2 + 0.1 * 0.5)
    (typed,) = retrieval.composite_score(memory(spark, memory_type="correction"), NOW).collect()
    (plain,) = retrieval.composite_score(memory(spark, memory_type="correction"), NOW, typed=False).collect()
    assert typed["composite"] == pytest.approx(1.25 * plain["composite"])


def test_resume_skips_what_does_not_fit(spark):
    def taken(rows, budget=80, most=4):
        df = spark.createDataFrame([(1, s, t, p) for s, t, p in rows], "thread int, seq int, tokens int, preserved boolean")
        return sorted(r["seq"] for r in threads.resumed(df, budget, most).collect())

    assert taken([(1, 50, False), (2, 100, False), (3, 10, False)]) == [1, 3]
    assert taken([(i, 90, True) for i in range(6)]) == [0, 1, 2, 3]
    assert taken([(1, 30, False), (2, 70, True), (3, 10, False), (4, 1, False)]) == [2, 3]


def test_prior_thread_is_the_latest_other_one(spark):
    df = spark.createDataFrame([("o", "a", 1), ("o", "b", 3), ("o", "c", 2), ("p", "d", 9), (None, "e", 1)], "owner string, thread string, last_seen int")
    assert {r["thread"]: r["prior"] for r in threads.prior_thread(df).collect()} == {"a": "b", "b": "c", "c": "b", "d": None, "e": None}


def test_turns_worth_keeping(spark):
    rows = [("short", "short"), ("HEARTBEAT of the agent, all well", "fine"), ("what is the plan for today", "NO_REPLY"), ("[system] is a word of mine here", "a reply of some length, surely"), ("hi", "a reply that has at least thirty characters")]
    got = threads.worth_keeping(spark.createDataFrame(rows, "human string, reply string")).collect()
    assert [r["human"] for r in got] == ["[system] is a word of mine here", "hi"]


def test_entity_kinds(spark):
    rows = [("Ada", "so Ada said yes", "person"), ("Acme Inc", "we met", "organization"), ("Phase Two", "later", "project"), ("Paris", "a trip from Paris to Rome", "location"), ("Rome", "a trip from Paris to Rome", "unknown"), ("Bo", None, "unknown")]
    df = spark.createDataFrame(rows, "entity string, text string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", writes.entity_kind(F.col("entity"), F.col("text"))).collect())


def test_importance_moves_by_a_step(spark):
    feedback = [(1, "used")] * 3 + [(2, "ignored")] * 3 + [(3, "contradicted")] * 2 + [(3, "used")] + [(4, "used")] * 3 + [(5, "used")] * 3 + [(6, "used")] * 2 + [(7, "used")] * 3 + [(7, "ignored")]
    old, new = "2024-01-01 00:00:00", "2024-01-30 00:00:00"
    rows = [(1, 0.98, "fact", old), (2, 0.12, "fact", old), (3, 0.4, "fact", old), (4, 0.5, "identity", old), (5, 0.5, "fact", new), (6, 0.5, "fact", old), (7, 0.5, "fact", old)]
    m = spark.createDataFrame(rows, "id int, importance double, memory_type string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = writes.importance_changes(spark.createDataFrame(feedback, "id int, kind string"), m, NOW).collect()
    assert sorted(map(tuple, got)) == [(1, "raise", 1.0), (2, "lower", 0.1), (3, "queue", 0.4)]


def test_previews():
    assert [secrets.preview(s) for s in ("abcd", "12345678", "abcdefghijkl", "abcdefghijklmnopqrst")] == ["ab***", "12***", "abcd...kl", "abcdef...qrst"]


def test_criteria_names_have_synonyms(spark):
    df = spark.createDataFrame([("a great win",)], "text string")
    score = lambda n: df.select(search.criterion(n, F.col("text"), F.lit(0.1), F.lit(0.2))).first()[0]
    assert score("Joy") == score("positivity") == 0.5 and score("negativity") == score("RISK") == 0.2 and score("unheard of") == 0.2


def test_configuration_by_field(spark):
    agents = spark.createDataFrame([("a",), ("b",)], "agent string")
    own = spark.createDataFrame([("a", 0, 0.5, None, 0.0, 0.3, 7)], "agent string, context_budget int, semantic_weight double, recency_weight double, importance_weight double, access_weight double, recency_half_life_days int")
    got = {r["agent"]: tuple(r)[1:] for r in retrieval.configured(agents, own, "agent").collect()}
    assert got == {"a": (4000, 0.5, 0.35, 0.15, 0.3, 7), "b": (4000, 0.4, 0.35, 0.15, 0.1, 3)}


def test_always_block(spark):
    agents = spark.createDataFrame([("a", '{"name": "A"}', None), ("b", None, None)], "agent_id string, identity string, user_profile string")
    handoffs = spark.createDataFrame([("a", 1, "first"), ("a", 2, "last")], "agent_id string, created_at int, summary string")
    rows = [(i, "a", "correction", f"h{i}", f"c{i}", i) for i in range(7)]
    m = spark.createDataFrame(rows, "id int, agent_id string, memory_type string, headline string, context string, created_at int")
    got = {r["agent_id"]: r for r in retrieval.always_block(agents, handoffs, m, 100).collect()}
    want = '### Agent Identity\n{"name": "A"}\n\n### Last Session Summary\nlast\n\n### Active Corrections\n' + "\n".join(f"- ⚠️ h{i}: c{i}" for i in (6, 5, 4, 3, 2))
    assert got["a"]["block"] == want and got["a"]["tokens"] == len(want) // 4 and got["a"]["remaining"] == 100 - len(want) // 4
    assert got["b"]["block"] == "" and got["b"]["tokens"] == 1


def test_cross_agent_and_fallback(spark):
    ranked = spark.createDataFrame([(1, "a", 0.75, "h", "c"), (2, "b", 0.5, "h", "c"), (3, "c", 0.3, "h", "c")], "id int, agent_id string, composite double, headline string, context string")
    got = {r["id"]: (r["tier"], r["shown"]) for r in retrieval.cross_agent(ranked).collect()}
    assert got == {1: ("L1", "[From a] c"), 2: ("L0", "[From b] h")}
    assert {tuple(r) for r in retrieval.fallback(ranked).collect()} == {("a", 0.75, True), ("b", 0.5, False), ("c", None, False)}


def test_quality_score_and_recall_stats(spark):
    row = spark.createDataFrame([(3, 1, 1, 1000, 50, 2)], "used int, ignored int, merged int, total int, recalls int, contradictions int")
    assert row.select(telemetry.quality_score()).first()[0] == int(0.75 * 40 + 0.1 * 20 + 0.5 * 20 + 0.8 * 20)
    m = spark.createDataFrame([("a", 4, 2), ("a", 0, 0), ("a", 2, 2)], "agent_id string, recall_count int, used_count int")
    assert tuple(telemetry.recall_stats(m).first()) == ("a", 2, 4, 0.75)


def test_project_filter(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, project_id string")
    assert [r["id"] for r in search.requested(df, project="p").collect()] == [1] and search.requested(df).count() == 3
