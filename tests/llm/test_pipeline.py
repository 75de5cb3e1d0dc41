"""The pipeline against the stages' plain forms in a row."""

from __future__ import annotations

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memengine.llm import bpe, common, quality
from memengine.llm.common import written
from memengine.llm.quality import classify
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def survivors(rows):
    """One row of each class of near duplicates: that of the smallest id, rows without an id last; each row is a document of its own."""
    numbered = list(enumerate(rows))
    of = brute.classes([(n, t) for n, (_, t) in numbered])
    first: dict = {}
    for n, (i, t) in numbered:
        if brute.shingles(t):
            first.setdefault(of[n], []).append((i is None, i or 0, n))
    kept = {min(x)[2] for x in first.values()}
    return [(i, t) for n, (i, t) in numbered if n in kept or not brute.shingles(t)]


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline(spark, docs, rows, tmp_path, odd):
    """Labels reject junk, copies and contaminated rows go, also where ids are missing or repeat."""
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    some, mine = docs, rows
    if not odd:
        some, mine = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), list({i: (i, t) for i, t in rows if i is not None}.values())
    other = next(t for i, t in rows if i == 14)
    extra = [(None, other, "en", "x", 5), (900, "zq " * 200, "en", "x", 600)] if odd else [(900, "zq " * 200, "en", "x", 600)]
    mine = [*mine, *[(x[0], x[1]) for x in extra]]
    some.select(COLUMNS).union(spark.createDataFrame(extra, some.select(COLUMNS).schema)).write.parquet(f"{folder}/documents.parquet")
    good = [(i, 1, 0) for i in (7, 8, 10, 11, 12, 13, 17, 18, 19, 20)]
    spark.createDataFrame([*good, (900, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(other.split()[:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept_rows = quality.kept(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    judged = classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(kept_rows) == judged.where("keep").count()
    stay = [(r["doc_id"], r["text"]) for r in kept_rows]
    texts = {r for r in mine if r not in stay}
    assert (900, "zq " * 200) in texts
    got = corpus_pipeline.run(spark, folder).collect()

    left = survivors([r for r in mine if r not in texts])
    left = [(i, t if len(kept) == n else " ".join(kept)) for (i, n, kept), (_, t) in zip(brute.deduplicated(left), left, strict=True)]
    left = [(i, t) for (i, t), x in zip(left, brute.contaminated(left, items), strict=True) if not x[4]]
    lib = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t in left:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, t, struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["text"], bytes(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    assert not {(14, other), (None, other), (900, "zq " * 200)} & {(r["doc_id"], r["text"]) for r in got}


def test_quality_stage_drops_what_is_rejected(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert kept.columns == docs.columns
    out = {r["doc_id"] for r in classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("NOT keep").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_jaccard_stage_keeps_a_column_named_like_its_own(spark, docs):
    some = docs.where("doc_id IS NULL OR doc_id < 13").withColumn("row_number", F.lit(7))
    got = corpus_pipeline.ngram_jaccard_join(spark, some, "")
    assert got.columns == some.columns and {r["row_number"] for r in got.collect()} == {7}


def test_failed_stage_leaves_no_tables(spark, docs, tmp_path):
    """A stage that fails deletes what it has written, and other threads' tables stay."""
    made = []

    @corpus_pipeline._stage
    def fails(spark, docs, sf_dir):
        made.append(written(docs.limit(1), "made"))
        raise ValueError("no")

    other = written(docs.limit(1), "other")
    with pytest.raises(ValueError, match="no"):
        fails(spark, docs, "")
    assert other.count() == 1
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(made[0].made[0][1]).count()


def test_stages_pass_small_batches(spark, monkeypatch):
    """A stage's tasks, and those that write its result, get few bytes at a time; a larger row comes alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    docs = spark.range(300).coalesce(1).select("id", F.when(F.col("id") == 7, F.repeat(F.lit("x"), 300_000)).otherwise(F.repeat(F.lit("x"), 2000)).alias("text"))
    stage = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "rows long"))
    try:
        monkeypatch.setattr(common, "ARROW_BYTES", 100_000)
        got = [r["rows"] for r in stage(spark, docs, "").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(got) == 300 and max(got) < 60
