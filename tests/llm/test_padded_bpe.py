"""Byte-level BPE in padded matrices against the library of the rank file, and its pieces against plain forms."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from memengine.llm import padded_bpe
from memengine.llm.padded_bpe import PairTable, Ranks


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        own = Ranks(f.read(), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def hard(seed: int) -> list[str]:
    rng = np.random.Generator(np.random.PCG64(seed))
    some = ["", "a", " ", "x" * 5000, "ab" * 700, " " * 300 + "z", "aaab" * 100, "é" * 200, "\x1c a\x85b\x1f", "<|endoftext|>", "東京" * 100, "ÃÂ" * 200, "=" * 333, "don't we'll", "\r\n \t x  ", "👩‍👩‍👧" * 30]
    for letters, n in (("ab ", 3000), ("=-", 900), ("abcdefghijklmnopqrstuvwxyz", 20_000), ("the of and", 400), ("0123456789 ", 500)):
        some += ["".join(rng.choice(list(letters), n)) for _ in range(3)]
    some += ["".join(chr(c) for c in rng.integers(1, 0x2FFF, 300)) for _ in range(5)]
    return some


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_library(both, seed):
    own, library = both
    texts = hard(seed)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(ids, dtype="<i4")
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert own.decode(ids).tobytes() == text.encode()


def test_long_and_short_rows_agree(both):
    """A pre-token's ids don't depend on which of the two ways merges it."""
    own, _ = both
    rng = np.random.Generator(np.random.PCG64(5))
    for letters in ("ab", "xyz=", "ÃÂa"):
        for n in (2, 3, 17, 60):
            sym = own.byte[np.frombuffer("".join(rng.choice(list(letters), n)).encode(), dtype=np.uint8)]
            ((_, matrix),) = own._matrix(sym[None, :])
            assert own._long(sym).tolist() == matrix[0][matrix[0] >= 0].tolist()


def test_merges_that_make_smaller_ranks():
    """Ranks in an unusual order: a merge may make a pair of smaller rank, on either side, while the same pair stands elsewhere."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abab", b"aab", b"cab", b"abc", b"ab", b"ababab", b"abcab", b"aa"]
    body = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    own = Ranks(body, r"\S+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.Generator(np.random.PCG64(3))
    texts = ["".join(rng.choice(list("abc"), n)) for n in [5, 9, 20, 40, 200, 300, 500] * 8]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<i4").tolist() == library.encode_ordinary(text)


def test_pair_table():
    rng = np.random.Generator(np.random.PCG64(1))
    pairs = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    rank = np.arange(len(pairs), dtype=np.int32)
    table, want = PairTable(pairs[:, 0], pairs[:, 1], rank), {tuple(p): r for p, r in zip(pairs.tolist(), rank.tolist(), strict=True)}
    asked = rng.integers(-1, 320, (40, 50, 2))
    got = table(asked[..., 0], asked[..., 1])
    assert got.tolist() == [[want.get(tuple(p), int(padded_bpe.NONE)) for p in row] for row in asked.tolist()]


def test_forgets_and_slices(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(padded_bpe, "KEPT", 5)
    texts = hard(3)
    got = [i for a in range(0, len(texts), 4) for i in own.encode(texts[a : a + 4])]
    assert [np.frombuffer(i, dtype="<i4").tolist() for i in got] == [library.encode_ordinary(t) for t in texts]


def by_text(df):
    return sorted(((r["doc_id"], r["text"], r["ids"], bytes(r["decoded"])) for r in df.collect()), key=repr)


def test_table(docs, rows, empty, monkeypatch):
    """All columns pass through, nulls are empty, repeated rows stay; ids and texts go round."""
    monkeypatch.setattr(padded_bpe, "BATCH_IDS", 64)
    own = Ranks(*padded_bpe._defaults(None, None))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = padded_bpe.decode(padded_bpe.encode(docs))
    assert by_text(got) == by_text(padded_bpe.round_trip(docs))
    assert set(got.columns) == {*docs.columns, "n_tokens", "ids", "decoded"}
    found = sorted(((r["doc_id"], r["text"], r["lang"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in got.collect()), key=repr)
    want = [(i, t, "en" if (i or 0) % 2 else None, len(ids := library.encode_ordinary(t or "")), ids, (t or "").encode()) for i, t in rows]
    assert found == sorted(want, key=repr)
    assert padded_bpe.decode(padded_bpe.encode(empty)).collect() == []


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", "y")], "doc_id long, text string, n_tokens int, ids string, decoded string")
    (row,) = padded_bpe.decode(padded_bpe.encode(df)).collect()
    assert row["n_tokens"] == 2 and row["ids"] == [64, 275] and bytes(row["decoded"]) == b"a b"
    gone = df.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert bytes(padded_bpe.decode(gone).collect()[0]["decoded"]) == b""


def test_query(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    own = Ranks(*padded_bpe._defaults(None, None))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, padded_bpe.op12_padded_bpe(spark, sf).collect())) == sorted(want)
