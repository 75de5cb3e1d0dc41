"""Ranked lexical search against a plain form and its SQL."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from memengine.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, (i is not None, i or 0), i))
        found.sort()
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "stone river"), (2, "STONE, stone; stone!"), (3, None), (4, ""), (5, " \t--"), (6, "東京 qué über"), (7, "nowhere found"), (8, "the a of stone river Blue qué"), (8, "light x1 small"), (None, "word 0 fin"), (9, "don't WARC/1.1 hello")]


@pytest.mark.parametrize(("entries", "places", "block", "k"), [(1 << 19, 1 << 16, 4 << 20, 10), (7, 1 << 16, 4 << 20, 10), (1 << 19, 3, 40, 3), (30, 2, 4 << 20, 1)])
def test_equals_plain_form(spark, docs, rows, monkeypatch, entries, places, block, k):
    """Also with short sorts, few places and many blocks of items: nulls, ties, repeated rows and ids among them."""
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "PLACES", places)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(i, t, 1.5, "x") for i, t in ITEMS], "item_id int, text string, score double, id string")
    got = lexical.search(docs, items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, ITEMS, k)


def test_random_texts(spark):
    rng = np.random.Generator(np.random.PCG64(11))
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[int(i)] for i in np.minimum(rng.zipf(1.4, n) - 1, 59))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in rng.permutation(400)]
    items = [(i, text(8)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.search(empty, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    with pytest.raises(TypeError):
        lexical.search(spark.createDataFrame([("a", "b")], "doc_id string, text string"), items)


def test_radix_order():
    rng = np.random.Generator(np.random.PCG64(2))
    for top in (1, 1 << 16, 1 << 20, 1 << 40, 1 << 63):
        keys = rng.integers(0, top, 5000, dtype=np.uint64)
        assert lexical.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert len(lexical.radix_order(np.zeros(0, dtype=np.uint64))) == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(lexical.SQL).fetchall()
    assert want and sorted(map(tuple, lexical.op13_lexical(spark, sf).collect())) == sorted(want)
