"""Full-text search against a plain form; stems and queries by hand-written examples."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memengine.functions.stems import STOP, stem
from memengine.operators import dedup, fulltext


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generalization", "general"), ("happily", "happili"), ("consistency", "consist"), ("knitting", "knit"), ("adjustment", "adjust"), ("running", "run"), ("flies", "fli"), ("say", "say"), ("cry", "cri"), ("dying", "die"), ("news", "news"), ("technology", "technolog"), ("hopefulness", "hope"), ("communism", "communism"), ("controlling", "control"), ("quickly", "quick"), ("succeeds", "succeed"), ("über", "über"), ("x1", "x1"), ("be", "be")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_parsed():
    def short(q):
        return [(p["alternative"], p["part"], p["excluded"], p["term"], p["place"]) for p in fulltext.parsed(q)]

    assert short("running cats") == [(0, 0, False, "run", 0), (0, 1, False, "cat", 0)]
    assert short('"state of the art" OR -dogs') == [(0, 0, False, "state", 0), (0, 0, False, "art", 3), (1, 1, True, "dog", 0)]
    assert short(None) == short("the of") == short('""') == []


DOCS = ["The cat sat on the mat. Cats sit on mats!", "A dog and a cat", "state of the art", "art of the state", "stately arts, state art", None, "", "dogs dogs dogs cat", "nothing here", "über cat 東京", "cat " + "filler " * 150 + "dog"]
QUERIES = ["cat", "cats dogs", "cat -dog", '"state of the art"', '"state art"', "mat OR dog", 'cat "sat on" OR nothing', "unheard", "-cat", "", None, "the", "cat cat", "東京 OR über", '-"state of the art" state', "dog cat mat OR state art"]


def plain(docs, queries, most=50):
    index = {}
    for i, text in docs:
        places: dict[str, list[int]] = {}
        for at, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1):
            if w not in STOP:
                places.setdefault(stem(w), []).append(min(at, 16383))
        index[i] = {t: p[:255] for t, p in places.items()}
    out = []
    for q, text in queries:
        parts = fulltext.parsed(text)
        terms = sorted({p["term"] for p in parts})
        any_ = len({p["alternative"] for p in parts}) > 1
        found = []
        for i, own in index.items():
            good = False
            for a in {p["alternative"] for p in parts}:
                mine = [p for p in parts if p["alternative"] == a]
                held = {}
                for k in {p["part"] for p in mine}:
                    spots = [{x - p["place"] for x in own.get(p["term"], [])} for p in mine if p["part"] == k]
                    held[k] = bool(set.intersection(*spots))
                good |= any(not p["excluded"] for p in mine) and all(held[p["part"]] != p["excluded"] for p in mine)
            if not good:
                continue
            if any_ or len(terms) == 1:
                rank = sum(sum(0.1 / j**2 for j in range(1, len(own.get(t, [])) + 1)) / 1.64493406685 for t in terms) / len(terms)
            else:
                rest, pairs = 1.0, 0
                for x, t in enumerate(terms):
                    for u in terms[:x]:
                        for p in own.get(t, []):
                            for o in own.get(u, []):
                                if p != o:
                                    d = abs(p - o)
                                    rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
                                    pairs += 1
                rank = 1 - rest if pairs else 1e-20
            found.append((-round(rank, 9), i))
        out += [(q, i, -r, n) for n, (r, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["id"], round(r["rank"], 9), r["place"]) for r in df.collect())


def test_search_equals_plain_form(spark):
    docs, queries = list(enumerate(DOCS)), list(enumerate(QUERIES))
    table = spark.createDataFrame(docs, "id long, text string").repartition(3)
    got = fulltext.search(fulltext.postings(table), spark.createDataFrame(queries, "query_id long, q string"), table.select("id", F.lit(0.5).alias("importance")))
    assert rows(got) == plain(docs, queries)


def test_random_queries(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    words = [f"word{c}" for c in "abcdefghij"] + ["the", "running", "runs"]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    docs = [(i, text(int(rng.integers(0, 14)))) for i in range(120)]
    queries = []
    for i in range(40):
        a, b, c, d = (words[j] for j in rng.integers(0, len(words), 4))
        queries.append((i, [f"{a} {b}", f'"{a} {b}"', f"{a} OR {b} {c}", f"{a} -{b}", f'"{a} {b} {c}" OR {d}', f'{a} -"{b} {c}"'][i % 6]))
    table = spark.createDataFrame(docs, "id long, text string")
    got = fulltext.search(fulltext.postings(table), spark.createDataFrame(queries, "query_id long, q string"), table.select("id", F.lit(0.5).alias("importance")), most=7)
    assert rows(got) == plain(docs, queries, most=7)


def test_search_within_an_agent(spark):
    table = spark.createDataFrame([(1, "cat", "a"), (2, "cat", "b"), (3, "cat", None)], "id long, text string, agent_id string")
    asked = spark.createDataFrame([(1, "cat", "a"), (2, "cats", None), (3, "cat", "z")], "query_id long, q string, agent_id string")
    got = fulltext.search(fulltext.postings(table), asked, table.select("id", "agent_id", F.lit(0.5).alias("importance")))
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_equals_plain_form(spark, block):
    rng = np.random.Generator(np.random.PCG64(9))
    v, q = rng.normal(size=(60, 5)), rng.normal(size=(11, 5))
    v[7] = v[9]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [0.0] * 5), (98, None)], "id long, embedding array<double>").repartition(4)
    got = dedup.nearest(vectors, spark.createDataFrame([(1000 + i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>"), 4, block)
    near = (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    want = {(1000 + i, j, r) for i in range(11) for r, j in enumerate(sorted(range(60), key=lambda j: (-round(near[i, j], 12), j))[:4], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_routes_by_row(spark):
    kinds = spark.createDataFrame([(1, True, 0.7), (2, True, 0.6), (3, False, 0.9), (4, True, 0.9)], "query_id int, dominant boolean, confidence double")
    keyword = spark.createDataFrame([(i, 10 + i, 0.15 if i == 4 else 0.2, 1) for i in (1, 2, 3, 4)], "query_id int, id int, rank double, place int")
    vector = spark.createDataFrame([(i, 20 + i, 0.9, 1) for i in (1, 2, 3, 4)], "query_id int, id int, similarity double, rank int")
    got = {(r["query_id"], r["route"], r["id"]) for r in fulltext.routed(kinds, keyword, vector).collect()}
    assert got == {(1, "keyword", 11), (2, "vector", 22), (3, "vector", 23), (4, "vector", 24)}


def test_index_and_sums_are_not_shuffled_by_word(spark, monkeypatch):
    """Postings are made where texts are read, also of empty and missing ones and of more places than count; alternatives of one word, in several blocks, equal the plain form."""
    monkeypatch.setattr(fulltext, "BLOCK_QUERIES", 2)
    docs = [(i, t) for i, t in enumerate([*DOCS, "cats cat " * 200])]
    table = spark.createDataFrame(docs, "id long, text string").repartition(2)
    index = fulltext.postings(table)
    assert "Exchange" not in index.select("term", "id")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    held = {(r["term"], r["id"]): r["places"] for r in index.collect()}
    assert held["cat", 11] == list(range(1, 256)) and ("the", 0) not in held and held["cat", 0] == [2, 7]
    queries = list(enumerate(["cat OR dog", "mat OR dogs OR unheard", "dog OR dog", "cat", "art OR -cat", "sat", '"cat" OR "state art"']))
    got = fulltext.search(index, spark.createDataFrame(queries, "query_id long, q string"), table.select("id", F.lit(0.5).alias("importance")))
    assert rows(got) == plain(docs, queries)


@pytest.mark.parametrize("scoped", [False, True])
def test_texts_meet_queries_in_blocks(spark, monkeypatch, scoped):
    """Texts given as such are read once and answer in blocks and classes, queries in shares; floors from the first texts leave the answers as they are, and few others are given."""
    for name, value in (("BLOCK_QUERIES", 30), ("BLOCK_PLACES", 90), ("FIRST", 20), ("STEMS", 5)):
        monkeypatch.setattr(fulltext, name, value)
    rng = np.random.Generator(np.random.PCG64(11))
    words = [f"word{c}" for c in "abcdefgh"] + ["the", "running"]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    docs = [(i, text(int(rng.choice([0, 3, 9, 40])))) for i in range(150)]
    queries = []
    for i in range(48):
        a, b, c, d = (words[j] for j in rng.integers(0, len(words), 4))
        queries.append((i, [f"{a} {b}", f'"{a} {b}"', f"{a} OR {b} OR {c}", f"{a} -{b}", f'"{a} {b} {c}" OR {d}', f"{a} {b} {c} {d}"][i % 6]))
    table = spark.createDataFrame([(i, t, 0.5, "ab"[i % 2]) for i, t in docs], "id long, text string, importance double, agent_id string").repartition(3)
    asked = spark.createDataFrame([(*q, [None, "a", "z"][q[0] % 3]) for q in queries], "query_id long, q string, agent_id string")
    given = []
    answers = fulltext._answers

    def counted(*parts):
        given.append(spark.sparkContext.accumulator(0))
        run, seen = answers(*parts), given[-1]

        def ran(batches):
            for batch in run(batches):
                seen.add(batch.num_rows)
                yield batch

        return ran

    monkeypatch.setattr(fulltext, "_answers", counted)
    got = rows(fulltext.search(table, asked if scoped else asked.drop("agent_id"), most=5))
    if scoped:
        want = sorted(x for i, q in queries for x in plain([(d, t) for d, t in docs if i % 3 == 0 or (i % 3 == 1 and d % 2 == 0)], [(i, q)], most=5))
    else:
        want = plain(docs, queries, most=5)
        assert sum(a.value for a in given) < 0.6 * len(plain(docs, queries, most=1000)) and len(given) > 4
    assert got == want
