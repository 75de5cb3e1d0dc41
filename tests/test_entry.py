"""The entry module works with and without the training-data operators."""

from __future__ import annotations

import importlib
import sys

import __spark_entry__
from memengine.plans import registry


def test_core_only(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("memengine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "memengine.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(registry.queries())
        assert set(bare.oracle_sql()) == set(registry.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
