"""A training-data pipeline: five operators of memengine.llm in a row.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  run() writes every stage's result as Parquet in the shared
folder and rereads it for the next.  When a stage begins, its predecessor's result
has been written, so the intermediate tables of earlier stages are deleted then.

A row is judged by its own text, so rows without an id and rows that share one are
filtered like others.  Of a group
of near duplicates one row stays, also where rows lack an id or repeat.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm.bpe import encode
from memengine.llm.common import clear, forget, noted, small_batches, table, written
from memengine.llm.decontamination import contamination
from memengine.llm.jaccard_join import similarity_classes
from memengine.llm.quality import kept as kept_by_quality
from memengine.llm.substring_dedup import dedup_substrings

#: Intermediate tables of the stage that ran last in this thread, as .tables: two pipelines of one driver don't meet.
_MADE = threading.local()


def _clear(spark: SparkSession) -> None:
    clear(spark, getattr(_MADE, "tables", []))


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        small_batches(spark)  # not only while it is planned: the caller writes the result
        with noted() as own:
            _MADE.tables = own
            try:
                return f(spark, docs, sf_dir)
            except BaseException:
                _clear(spark)
                raise

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return kept_by_quality(docs, table(spark, sf_dir, "labels"))


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; documents without words stay.

    Only the copies' ids take part in the join with the texts.  Where ids are
    missing or repeat, rows are numbered (in a written table, so that the numbers
    stay) and each is a document of its own."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        copies = written(similarity_classes(docs).where("component_id <> doc_id").select("doc_id"), "copies")
        return docs.join(copies, "doc_id", "left_anti")
    row = "row_number"
    while row in docs.columns:  # a caller's column of that name passes through
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = similarity_classes(rows, id_col=row).where("n_shingles > 0").join(rows.select(row, "doc_id"), row)
    classes = written(classes.select(row, "component_id", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col(row).alias("row")).alias("place")), "row_classes")
    first = classes.groupBy("component_id").agg(F.min("place").alias("place"))
    copies = classes.join(first.select("component_id", F.col("place.row").alias("kept")), "component_id").where(F.col(row) != F.col("kept")).select(row)
    return rows.join(written(copies, "copies"), row, "left_anti").select(docs.columns)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document has in the same 13; n_chars is that of the text kept."""
    kept = dedup_substrings(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed)
    return kept.select(docs.columns)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by an item of the benchmark; a row is known by its id and its text's hash."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    out = written(found.select(F.col("doc_id").alias("out_id"), F.col("print").alias("out_print")).distinct(), "contaminated")
    return docs.join(out, docs["doc_id"].eqNullSafe(out["out_id"]) & F.xxhash64(docs["text"]).eqNullSafe(out["out_print"]), "left_anti")


@_stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (little-endian unsigned 32-bit), their number, and the text that they decode to."""
    out = encode(docs)
    return out.select(*docs.columns, "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe),
]

#: The quality classifier and the tokenizer have no SQL form; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)
    _clear(spark)
    return docs
