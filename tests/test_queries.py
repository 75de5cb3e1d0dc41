"""Every query of the engine's own operators against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from memengine.plans import registry
from tests.conftest import SF


#: Rounding and ties show on more rows only; the slowest queries of the larger size are left to the smaller one.
LARGER = "/root/testdata/sf0.01"
SLOW = {"entity_cooccurrence", "graph_subgraph_all", "shortest_paths", "clusters", "resumed_checkpoints"}


@pytest.fixture(scope="module", params=[SF, LARGER])
def tables(request):
    con = duckdb.connect()
    for path in Path(request.param).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con, request.param


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, tables, name):
    con, folder = tables
    if folder == LARGER and name in SLOW:
        pytest.skip("compared on the smaller size")
    df = registry.queries()[name](spark, folder)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).collect()


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["id", "agent_id", "memory_type", "composite"]


def test_graph_has_all_edges(spark, duck):
    assert registry._all_edges(spark, SF).count() == duck.execute("SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)").fetchone()[0]


def test_claims_of_one_vote_stay(spark):
    assert registry.queries()["claim_votes_all"](spark, SF).where("votes = 1").count()


def test_search_reads_whole_texts(spark):
    """Each string of the batch is found, and some matches lie behind the first 400 characters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = registry.queries()["batch_search"](spark, SF).join(spark.createDataFrame(registry._BATCH, "query_id int, q string"), "query_id").join(docs, docs["doc_id"] == F.col("id")).collect()
    assert {r["query_id"] for r in found} == {1, 2, 3, 4}
    assert any(r["q"] not in r["text"][:400].lower() for r in found)
