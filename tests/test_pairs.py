"""Similarity joins: the exact one and the hashed one against plain forms, with measured recall and work."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memengine.operators import dedup


def table(spark, rows):
    return spark.createDataFrame([(a, i, None if v is None else [float(x) for x in v]) for a, i, v in rows], "agent_id string, id long, embedding array<double>").repartition(3)


def plain(rows, threshold):
    out = set()
    held = [(a, i, np.array(v) / np.linalg.norm(v)) for a, i, v in rows if a is not None and v is not None and len(v) and np.linalg.norm(v) > 0]
    for n, (a, i, u) in enumerate(held):
        out |= {(a, min(i, j), max(i, j)) for b, j, v in held[n + 1 :] if a == b and i != j and len(u) == len(v) and u @ v >= threshold}
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_exact_pairs(spark, monkeypatch, block):
    """Also with agents of many blocks, vectors of other sizes, empty, zero and missing ones."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [("ab"[i % 2], i, rng.normal(size=6)) for i in range(60)] + [("a", 100, np.ones(3)), ("b", 101, np.ones(3)), ("b", 102, 2 * np.ones(3)), ("a", 103, []), ("a", 104, np.zeros(6)), ("a", 105, None), (None, 106, np.ones(3))]
    got = dedup.similar_pairs(table(spark, rows), 0.5).collect()
    assert {(r["agent_id"], r["a"], r["b"]) for r in got} == plain(rows, 0.5) and len(got) == len(plain(rows, 0.5))


@pytest.mark.parametrize("block", [1024, 16])
def test_hashed_pairs_recall_and_work(spark, monkeypatch, block):
    """64 dimensions at 0.78: nine in ten pairs at the very threshold are found, and under a tenth of all pairs are compared."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(300, 64))
    side -= (side * base[:300]).sum(axis=1)[:, None] * base[:300]
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.785 * base[:300] + np.sqrt(1 - 0.785**2) * side
    rows = [("a", i, v) for i, v in enumerate(np.concatenate([base, near]))]
    vectors = table(spark, rows)
    got = [(r["agent_id"], r["a"], r["b"]) for r in dedup.hashed_pairs(vectors, 0.78).collect()]
    want = plain(rows, 0.78)
    assert len(got) == len(set(got)) and set(got) <= want and len(want) >= 300
    assert len(got) >= 0.9 * len(want)
    if block == 1024:
        bits, tables = dedup.tables_for(0.78, 0.95, len(rows))
        sizes = dedup.hashed(vectors, bits, tables).groupBy("agent_id", "dims", "table", "bucket").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
        assert sizes < 0.1 * len(rows) * (len(rows) - 1) / 2


@pytest.mark.parametrize("agents", ["all", "own", "other"])
def test_nearest_by_agent(spark, agents):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [("abc"[i % 3], i, rng.normal(size=4)) for i in range(40)] + [(None, 50, rng.normal(size=4)), ("a", 51, rng.normal(size=2)), ("a", 52, rng.normal(size=2))]
    vectors = table(spark, rows)
    got = {(r["query_id"], r["id"], r["rank"]) for r in dedup.nearest(vectors, vectors.where("id < 12 OR id = 51").withColumnRenamed("id", "query_id"), 3, 5, agents).collect()}
    want = set()
    for a, i, v in rows:
        if i < 12 or i == 51:
            near = [(-(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for b, j, w in rows if j != i and len(w) == len(v) and (agents == "all" or (agents == "own") == (a == b))]
            want |= {(i, j, r) for r, (_, j) in enumerate(sorted(near)[:3], 1)}
    assert got == want


def test_second_scan_compares_nothing(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.normal(size=(5, 8))
    rows = [("a", i, base[i % 5] + 0.05 * rng.normal(size=8)) for i in range(20)] + [("b", 30, base[0])]
    vectors = table(spark, rows)
    none = vectors.select("id").limit(0)
    queued = spark.createDataFrame([], "a long, b long")
    first = dedup.unscanned_neighbours(vectors, none, queued).collect()
    assert first and {r["agent_id"] for r in first} == {"a"} and all(r["a"] < r["b"] and r["similarity"] > 0.82 for r in first)
    again = dedup.unscanned_neighbours(vectors, none, spark.createDataFrame([(r["b"], r["a"]) for r in first], "a long, b long"))
    assert again.collect() == []
    unchanged = dedup.unscanned_neighbours(vectors, vectors.select("id"), queued)
    assert unchanged.collect() == []
    later = dedup.unscanned_neighbours(vectors, vectors.where("id <> 19").select("id"), queued).collect()
    assert later and all(19 in (r["a"], r["b"]) for r in later)


@pytest.mark.parametrize("agents", ["all", "own", "other"])
def test_nearest_holds_two_blocks(spark, monkeypatch, agents):
    """No task gets more than a pair of blocks, equal vectors tie by id in whatever tile they stand, and the driver collects no query."""
    monkeypatch.setattr(dedup, "TILE", 64)
    rng = np.random.Generator(np.random.PCG64(5))
    base = rng.normal(size=(30, 16))
    rows = [("ab"[i % 2], i, base[i // 2 % 30]) for i in range(120)]
    vectors = table(spark, rows)
    sizes = spark.sparkContext.accumulator(0)
    best = dedup._best

    def counted(q, v, k, how):
        sizes.add(max(0, q.num_rows - 40) + max(0, v.num_rows - 40))
        return best(q, v, k, how)

    monkeypatch.setattr(dedup, "_best", counted)
    monkeypatch.setattr(type(vectors), "toPandas", None)
    got = {(r["query_id"], r["id"], r["rank"]) for r in dedup.nearest(vectors, vectors.withColumnRenamed("id", "query_id"), 3, 16, agents).collect()}
    want = set()
    for a, i, v in rows:
        near = [(-round(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), 12), j) for b, j, w in rows if j != i and (agents == "all" or (agents == "own") == (a == b))]
        want |= {(i, j, r) for r, (_, j) in enumerate(sorted(near)[:3], 1)}
    assert got == want
    assert sizes.value == 0


@pytest.mark.parametrize("block", [1024, 9])
def test_first_pairs_of_an_agent(spark, monkeypatch, block):
    """Where only the first pairs are wanted, copies make no others, and the first are the same."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    rng = np.random.Generator(np.random.PCG64(8))
    base = rng.normal(size=(6, 8))
    rows = [("ab"[i % 2], i, base[i % 3] + 0.02 * rng.normal(size=8) * (i % 4 == 0)) for i in range(90)]
    full = dedup.hashed_pairs(table(spark, rows), 0.85).withColumn("similarity", F.round("similarity", 6)).where("similarity >= 0.95").collect()
    few = dedup.hashed_pairs(table(spark, rows), 0.85, least=0.95, best=(5, 6)).collect()
    first = lambda found: {g: sorted((-r["similarity"], r["a"], r["b"]) for r in found if r["agent_id"] == g)[:5] for g in "ab"}
    assert first(few) == first(full)
    assert len(few) < len(full)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_are_those_of_the_pairs(spark, monkeypatch, block):
    """Counts and classes of copies, near copies and chains are those of all the pairs that hashed_pairs gives, and blocks give no more rows than they have."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    rng = np.random.Generator(np.random.PCG64(9))
    base = rng.normal(size=(12, 8))
    rows = [("ab"[i % 2], i, base[i % 12] + rng.normal(size=8) * (i % 4) * 0.12) for i in range(150)] + [("a", 200, []), ("a", 201, np.zeros(8)), ("b", 202, None), (None, 203, np.ones(8)), ("a", 204, np.ones(3)), ("a", 205, np.ones(3))]
    vectors = table(spark, rows)
    pairs = {(r["a"], r["b"]): r["similarity"] for r in dedup.hashed_pairs(vectors, 0.85).collect()}
    links, alike, label = {i: 0 for _, i, _ in rows}, {i: 0 for _, i, _ in rows}, {i: i for _, i, _ in rows}
    for (a, b), s in pairs.items():
        for x in (a, b):
            links[x] += 1
            alike[x] += s >= 0.92
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = dedup.hashed_links(vectors, 0.85).collect()
    assert len(got) == len(rows) and 1 < len(set(label.values())) < 60 and len(pairs) > 500
    assert {r["id"]: (r["class_id"], r["links"], r["duplicates"]) for r in got} == {i: (label[i], links[i], alike[i]) for i in links}
    sets = vectors.where("size(embedding) = 8 AND agent_id IS NOT NULL").withColumn("weight", F.lit(1).cast("long"))
    keys = ["agent_id", "dims", "table", "bucket"]
    assert dedup._within(dedup.hashed(sets, 2, 1), keys, -1.0, duplicate=0.92).where("links > 0").count() <= 152 * (1 if block == 1024 else 22)


def test_near_copies_has_a_row_of_each_document(spark):
    from memengine.plans import registry
    from tests.conftest import SF

    got = registry.queries()["near_copies"](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"))
    assert got.select("id").exceptAll(ids).isEmpty() and ids.exceptAll(got.select("id")).isEmpty()


def crowd():
    rng = np.random.Generator(np.random.PCG64(12))
    base = rng.normal(size=(12, 8))
    rows = [("ab"[i % 2], i, base[i % 12] + rng.normal(size=8) * (i % 4) * 0.12) for i in range(150)]
    return rows + [("a", 200, []), ("a", 201, np.zeros(8)), ("b", 202, None), (None, 203, np.ones(8)), ("a", 204, np.ones(3)), ("a", 205, np.ones(3)), ("c", 206, np.ones(3))]


@pytest.mark.parametrize("rows", [1 << 15, 11])
def test_exact_links(spark, monkeypatch, rows):
    """Counts and classes are those of all pairs, none missed, in one part or many; a part gives no more rows than it has."""
    monkeypatch.setattr(dedup, "GRID_ROWS", rows)
    monkeypatch.setattr(dedup, "TILE", 64)
    vectors = table(spark, crowd())
    want, alike = plain(crowd(), 0.85), plain(crowd(), 0.92)
    count = lambda pairs, i: sum(i in p[1:] for p in pairs)
    label = {i: i for _, i, _ in crowd()}
    for _ in label:
        for _, a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    got = dedup.links(vectors, 0.85).collect()
    assert len(got) == len(label) and len(want) > 500
    assert {r["id"]: (r["class_id"], r["links"], r["duplicates"]) for r in got} == {i: (label[i], count(want, i), count(alike, i)) for i in label}


@pytest.mark.parametrize("rows", [1 << 15, 11])
def test_exact_first_pairs(spark, monkeypatch, rows):
    """An agent's first pairs are those of all pairs, and copies give no more than asked for from each two parts."""
    monkeypatch.setattr(dedup, "GRID_ROWS", rows)
    monkeypatch.setattr(dedup, "TILE", 64)
    vectors = table(spark, crowd())
    every = [(r["agent_id"], -round(r["similarity"], 6), r["a"], r["b"]) for r in dedup.similar_pairs(vectors, 0.9).collect()]
    found = [(r["agent_id"], -r["similarity"], r["a"], r["b"]) for r in dedup.first_pairs(vectors, 0.9, 5).collect()]
    for agent in "ab":
        assert sorted(x for x in found if x[0] == agent)[:5] == sorted(x for x in every if x[0] == agent)[:5]
    assert len(found) < len(every) and len(found) == len(set(found)) and (rows == 11 or len(found) == 11)


def test_text_vectors_stay_where_texts_are(spark):
    """Sums of the words' signs as plain Python has them from the hashes; texts without words have none; nothing is shuffled."""
    from memengine.plans.consolidation import DIMENSIONS, text_vectors
    from tests.conftest import SF

    got = text_vectors(spark, SF)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).select("doc_id", F.xxhash64("w").alias("h")).collect()
    want: dict[int, list[float]] = {}
    for r in words:
        want.setdefault(r["doc_id"], [0.0] * DIMENSIONS)[r["h"] % DIMENSIONS] += 1 if (r["h"] >> 20) % 2 == 0 else -1
    assert {r["id"]: r["embedding"] for r in got.collect()} == want
