"""A small table with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import numpy as np
import pytest

WORDS = "the a of stone river Blue qué über 東京 don't light x1 small, End. walk tree ever path cold sun".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, block long, n long, key string, body string, score double"


def prose(seed: int, n: int) -> str:
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n).tolist())


def texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 60), prose(2, 80)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "TWO words"), (7, base), (8, base), (9, base.upper()), (10, " ".join(near)),
        (11, other), (12, other + "  " + prose(3, 20)), (13, prose(4, 30_000)), (14, "stone stone " * 40), (15, "a b c d e"), (16, base), (16, base), (17, other[: len(other) // 2]), (None, base), (None, None),
        (18, prose(5, 13)), (19, prose(6, 12)), (20, base + " " + other), (-5, " nbsp word 0\x1c1 \x85 <|endoftext|> fin"), (21, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (22, "12345 !!"), (23, "x" * 5000),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    full = [(i, t, "en" if (i or 0) % 2 else None, "hot", len(t or ""), 7, 0, 1, "k", "b", 0.5) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
