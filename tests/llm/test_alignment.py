"""Cross-tokenizer alignment against a plain form that uses the tokenizers' own libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memengine.llm import alignment
from memengine.llm.bpe import byte_letters, read
from memengine.llm.common import forget, only

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(libraries, rows):
    a, b = libraries
    back = {c: i for i, c in byte_letters().items()}
    docs = []
    for i, text in rows:
        ids_a, ids_b, groups, found = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                x = y = end_a = end_b = 0
                own_a, own_b = [], []
                while x < len(ids_a) or y < len(ids_b):
                    if end_a <= end_b:
                        own_a.append(ids_a[x])
                        end_a += len(bytes_a[x])
                        x += 1
                    else:
                        own_b.append(ids_b[y])
                        end_b += len(bytes_b[y])
                        y += 1
                    if end_a == end_b:
                        found.append((own_a[-1], own_b[-1]))
                        groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                        own_a, own_b = [], []
            else:
                ids_a, ids_b = [], []
        docs.append((i, ids_a, ids_b, groups, found))
    counts = Counter(p for *_, found in docs for p in found)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted(((i, len(x), len(y), len(g), len(f), sum(counts[p] == most[p[1]] for p in f), sum(counts[p] for p in f), digest(g)) for i, x, y, g, f in docs), key=repr)


HARD = [" a", "a ", "  ", "a  b   c", "\n a\n  b", "▁ low line", "<s> </s> <unk> <0x41>", "ﬁ ① \x00 x", "é é", " x y", "a" * 200, "=" * 70 + " x", "日本語のテキスト、です。", "👩‍👩‍👧 ok", "tab\tsep", "don't we'll I'd", "   lead and trail   "]


def test_equals_plain_form(spark, docs, rows, empty, libraries):
    got = alignment.align(docs)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain(libraries, rows)
    assert alignment.align(empty).collect() == []


@pytest.mark.parametrize("common", [1 << 17, 1, 40])
def test_hard_texts_and_rare_pairs(spark, libraries, monkeypatch, common):
    """Spaces of all kinds, pieces for bytes, and pairs beyond the bound of the broadcast."""
    monkeypatch.setattr(alignment, "COMMON", common)
    monkeypatch.setattr(alignment, "KEPT", 20)
    monkeypatch.setattr(alignment, "LONG", 50)
    rows = list(enumerate(HARD + [f"{x} and {y}" for x in HARD[:8] for y in HARD[8:]]))
    got = alignment.align(spark.createDataFrame(rows, "doc_id int, text string").withColumn("row", F.lit("x")).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(libraries, rows)


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, alignment.op11_alignment(spark, sf).collect()), key=repr) == plain(libraries, rows)


def test_nothing_is_shuffled_after_the_tokens(spark, docs):
    """Windows, the join and the gathering of links use the tokens' buckets and order."""
    a, b = (read(public_tokenizers.path(x)) for x in (alignment.A, alignment.B))
    tokens = alignment._tokens(only(docs, doc_id="doc_id", text="text"), a, b)
    with alignment._set(spark, alignment._SETTINGS):
        plan = alignment._aligned(tokens, alignment.links(tokens))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "SortAggregate" in plan and "HashAggregate" not in plan
    forget(tokens)
