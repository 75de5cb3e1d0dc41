"""Validators, extraction replies, folds and subscriptions by hand-written examples."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from memengine.operators import folds, validation

GOOD = {
    "level": 1, "thread_id": "12345678-1234-1234-1234-123456789abc", "project_id": None, "checkpoint_sequence": 1, "checkpoint_type": "mid_thread", "turn_range": [1, 5], "turn_count": 5, "time_span_seconds": 0,
    "parent_memory_ids": ["12345678123412341234123456789abc"], "child_memory_ids": [], "parent_checkpoint_id": None, "source": "agent", "thread_title": None, "more": {"x": 1},
}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"level": 2}, ["level must be one of [1]"]),
        ({"level": "1"}, ["level must be an integer"]),
        ({"thread_id": "nope"}, ["thread_id must be a valid UUID"]),
        ({"thread_id": 7}, ["thread_id must be a string"]),
        ({"project_id": "x"}, ["project_id must be a valid UUID"]),
        ({"checkpoint_type": "other"}, ["checkpoint_type must be one of ['mid_thread', 'end_of_thread', 'auto_resume_meta', 'tail_recovery']"]),
        ({"checkpoint_sequence": 0}, ["checkpoint_sequence must be >= 1"]),
        ({"checkpoint_sequence": 1.5}, ["checkpoint_sequence must be an integer"]),
        ({"turn_range": [1]}, ["turn_range must have 2 items"]),
        ({"turn_range": [1, "2"]}, ["turn_range has an item that isn't valid"]),
        ({"turn_range": [3, 2]}, ["turn_range must be in order"]),
        ({"turn_count": 0}, ["turn_count must be >= 1"]),
        ({"time_span_seconds": -1}, ["time_span_seconds must be >= 0"]),
        ({"parent_memory_ids": ["x"]}, ["parent_memory_ids has an item that isn't valid"]),
        ({"parent_memory_ids": "x"}, ["parent_memory_ids must be an array"]),
        ({"child_memory_ids": None}, ["child_memory_ids must be an array"]),
        ({"parent_checkpoint_id": "{12345678-1234-1234-1234-123456789abc}"}, []),
        ({"source": "me"}, ["source must be one of ['server_job', 'agent', 'extension']"]),
        ({"thread_title": 5}, ["thread_title must be a string"]),
    ],
)
def test_checkpoint_rules(spark, change, want):
    row = spark.createDataFrame([(json.dumps(GOOD | change),)], "json string")
    assert validation.validated(row, validation.CHECKPOINT).first()["errors"] == want


def test_missing_fields_and_no_objects(spark):
    rows = spark.createDataFrame([(json.dumps({k: v for k, v in GOOD.items() if k not in ("source", "level")}),), ("[1]",), ("no json",), (None,)], "json string")
    got = [r["errors"] for r in validation.validated(rows, validation.CHECKPOINT).collect()]
    assert got == [["missing required field: level", "missing required field: source"]] + [["must be an object"]] * 3


def test_custom_schema(spark):
    schema = {"required": ["name"], "properties": {"name": {"type": "string"}, "score": {"type": "number", "minimum": 0, "maximum": 10}, "on": {"type": "boolean"}, "tags": {"type": "array"}, "size": {"enum": ["s", "m", 3]}, "it's": {"type": "string"}}}
    cases = [
        ({"name": "x", "score": 3.5, "on": True, "tags": [], "size": "m", "other": {}}, []), ({"score": 11, "name": 1}, ["name must be a string", "score must be <= 10"]), ({"name": "x", "score": "3"}, ["score must be a number"]),
        ({"name": "x", "score": -0.5, "on": 1}, ["score must be >= 0", "on must be a boolean"]), ({"name": "x", "size": "l"}, ["size must be one of ['s', 'm', 3]"]), ({"name": "x", "size": 3, "score": True}, []), ({"name": None}, ["name must be a string"]),
    ]
    schema["properties"].pop("it's")
    for value, want in cases:
        assert validation.validated(spark.createDataFrame([(json.dumps(value),)], "json string"), schema).first()["errors"] == want, value


def test_extraction_replies(spark):
    good = {"headline": " h ", "memory_type": "odd", "importance": 7, "confidence": "0.9", "entities": ["A"]}
    rows = [
        (1, json.dumps([good, {"headline": "g", "temporal_type": "permanent"}, 5, {"headline": "  "}, {"headline": "u", "confidence": 0.2}, {"headline": 3}, {"headline": "n", "importance": "much"}])),
        (2, "```json\n" + json.dumps({"memories": [{"headline": "e", "temporal_type": "ephemeral", "context": "c"}]}) + "\n```"), (3, json.dumps({"headline": "alone", "confidence": -3, "ttl_hours": 4})), (4, "not json"), (5, None), (6, "[]"),
        (7, json.dumps({"extracted_memories": [{"headline": "t", "temporal_type": "ephemeral", "ttl_hours": 3, "scope": "/x"}]})),
    ]
    table = spark.createDataFrame([(i, "a", t, "2024-01-01 00:00:00") for i, t in rows], "id long, agent_id string, text string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    fine, rejects = validation.normalised(table)
    got = {r["headline"]: r for r in fine.collect()}
    assert set(got) == {"h", "g", "e", "t"}
    assert (got["h"]["memory_type"], got["h"]["importance"], got["h"]["confidence"], got["h"]["context"], got["h"]["entities"], got["h"]["ttl_hours"]) == ("fact", 1.0, 0.9, "h", ["A"], None)
    assert (got["g"]["memory_type"], got["g"]["confidence"], got["g"]["importance"], got["g"]["scope"]) == ("identity", 0.8, 0.5, "/")
    assert (got["e"]["context"], got["e"]["full_content"], got["e"]["ttl_hours"]) == ("c", "c", 12) and (got["t"]["ttl_hours"], got["t"]["scope"]) == (3, "/x")
    assert len({r["id"] for r in got.values()}) == 4 and all(len(r["id"]) == 16 for r in got.values())
    assert {tuple(r) for r in rejects.collect()} == {(1, "not_an_object", 1), (1, "no_headline", 1), (1, "unsure", 1), (1, "bad_value", 2), (3, "unsure", 1), (4, "not_json", 1), (5, "not_json", 1)}


def test_folded(spark):
    rows = [("a", 1, None, 0.5, "d"), ("a", 2, None, None, "e"), ("a", 3, True, None, None), ("a", 4, None, 0.7, None), ("b", 1, None, 0.1, None), ("b", 2, True, 0.9, None), ("c", 1, None, None, None)]
    log = spark.createDataFrame(rows, "name string, seq int, deleted boolean, weight double, note string")
    got = {r["name"]: tuple(r)[1:] for r in folds.folded(log, ["name"], "seq", ["weight", "note"]).collect()}
    assert got == {"a": (0.7, "e", 1, 4, 4, True), "b": (0.1, None, 1, 2, 2, False), "c": (None, None, 1, 1, 1, True)}
    ended = {r["name"]: tuple(r)[1:] for r in folds.folded(log, ["name"], "seq", ["weight", "note"], revives=False).collect()}
    assert ended["a"] == (0.5, "e", 1, 3, 3, False)


def test_deliveries_and_failures(spark):
    subs = spark.createDataFrame([(1, "t", "u1", ["x", "y", "x"], True, 0), (2, "t", "u2", ["x"], False, 0), (3, "t", "u3", ["x"], True, 10), (4, "s", "u4", ["x"], True, None), (5, "t", "u5", [], True, 0)], "subscription_id int, tenant_id string, url string, events array<string>, active boolean, failures int")
    events = spark.createDataFrame([(1, "t", "x"), (2, "t", "z"), (3, "s", "x"), (4, "t", "y"), (5, None, "x")], "event_id int, tenant_id string, event string")
    assert {tuple(r) for r in folds.deliveries(events, subs).collect()} == {(1, 1, "u1"), (1, 4, "u1"), (4, 3, "u4")}
    rows = [(1, 1, 10, False), (1, 2, 20, True), (1, 3, 30, False), (1, 4, 40, None), (2, 1, 10, False), (3, 1, 10, True)]
    got = folds.failures(spark.createDataFrame(rows, "subscription_id int, seq int, at int, fine boolean")).collect()
    assert {tuple(r) for r in got} == {(1, 2, 20), (2, 1, None), (3, 0, 10)}


@pytest.mark.parametrize("most", [2, 4096])
def test_an_event_meets_lists_of_subscribers(spark, monkeypatch, most):
    """However many subscribe, an event meets one row for each LIST of them; null ids, nameless and repeated ones are delivered to as they stand."""
    monkeypatch.setattr(folds, "LIST", most)
    rows = [(i, "t", None if i == 3 else f"u{i}", ["x"], True, 0) for i in (1, 2, 3, 4, 4)] + [(None, "t", "u", ["x", "y"], True, 0)]
    subs = spark.createDataFrame(rows, "subscription_id int, tenant_id string, url string, events array<string>, active boolean, failures int")
    assert folds.subscriber_lists(subs).count() == (3 if most == 2 else 1) + 1
    events = spark.createDataFrame([(7, "t", "x"), (8, "t", "y"), (None, "t", "x")], "event_id int, tenant_id string, event string")
    want = [(i, e, u) for i, _, u, named, _, _ in rows for e, name in ((7, "x"), (8, "y"), (None, "x")) if name in named]
    assert sorted(map(tuple, folds.deliveries(events, subs).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, folds.deliveries(events, subs.drop("url")).collect()), key=repr) == sorted([x[:2] for x in want], key=repr)


def test_checkpoints_to_resume(spark):
    rows = [("o", "a", 1, "end_of_thread", 5), ("o", "a", 2, "mid_thread", 5), ("o", "b", 1, "mid_thread", 5), ("o", "b", 2, "auto_resume_meta", 5), ("o", "c", 1, "tail_recovery", 5)]
    got = folds.checkpoints_to_resume(spark.createDataFrame(rows, "owner string, thread string, seq int, kind string, tokens int"), spark.createDataFrame([("o", "b")], "owner string, thread string"))
    assert {(r["thread"], r["seq"], r["preserved"]) for r in got.collect()} == {("a", 1, True), ("b", 1, True), ("c", 1, True)}


def test_text_is_parsed_once(spark):
    """However many rules there are, the optimised plan parses a row's text once."""
    rows = spark.createDataFrame([('{"level": 1}',), ("no",), (None,)], "json string")
    out = validation.validated(rows, validation.CHECKPOINT)
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 1
    assert [len(r["errors"]) for r in out.collect()] == [9, 1, 1]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_deliveries_of_a_name_follow_each_other(spark, monkeypatch, sent):
    """However events come, those of one tenant and name follow each other, with the same subscribers again and again."""
    monkeypatch.setattr(folds, "SENT", sent)
    events = spark.createDataFrame([(i, i % 3, "xy"[i % 2]) for i in range(600)], "event_id int, tenant_id int, event string").coalesce(1)
    subs = spark.createDataFrame([(k, k % 3, ["x", "y"], True, 0) for k in range(9)], "subscription_id int, tenant_id int, events array<string>, active boolean, failures int")
    got = [(r["event_id"], r["subscription_id"]) for r in folds.deliveries(events, subs).collect()]
    assert sorted(got) == [(i, k) for i in range(600) for k in range(9) if i % 3 == k % 3]
    keys = [i % 6 for i, _ in got]
    assert sum(a != b for a, b in zip(keys, keys[1:], strict=False)) == 5
