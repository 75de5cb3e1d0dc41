"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Trusted text is what labels mark as of good quality.  Four fifths of it (by
crc32 of the id) are counted, and the other fifth gives the thresholds, so that
they hold for text that the model hasn't seen.  A document's perplexity is that
of its symbols (bytes of UTF-8 and an end) after up to four others.

The counts are tables spread by n-gram, never gathered: counts of counts give
the three discounts of each order, a window over each context (at most 256
rows) its total and back-off weight, and a join with the order below its
interpolated probability.  Blocks of text ask for the n-grams that they hold
and get their probabilities back, so nothing that grows is broadcast.

A document is rejected if its perplexity lies above its language's quantile of
unseen trusted text, by a margin, or if it repeats itself: a word repeated again
and again is as likely as the word, so the share of n-grams that are new within
windows of WINDOW symbols must not lie below the same quantile from the other
side.  Each language's quantiles are drawn towards those over all languages by
weight, as if ENOUGH texts had these: the same rule at every size, without a jump.

Defined results: null and empty texts have one symbol, the end; they are judged
like others.  Without any trusted text nothing is rejected.  A null language is
one of its own.  A row without an id can't be labelled and is judged like
others; rows with the same id share its label, and each is judged by its own text.  Ids are whole numbers (TypeError otherwise); a very long text is a
block of its own and must fit a task.
Repeated label rows count once; an id labelled both good and bad isn't trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm import blocks as B
from memengine.llm.common import held, integral, only, table, written
from memengine.llm.ppm import contexts
from memengine.llm.textops import pieces, utf8

ORDER = 4
BLOCK = 12 << 20
#: The quantile of unseen trusted documents that is still good, and the margin above it, as a share of the bits.
UPPER, MARGIN = 0.995, 0.02
#: Texts for which the quantiles over all languages count beside a language's own.
ENOUGH = 50
#: Symbols of median bits that are added to each text.
PRIOR = 60
#: Symbols within which an n-gram counts as new once.
WINDOW = 256


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 of the probability of key's last byte after the others; counts: (key, n), n 0 where only asked for."""
    levels = [counts]
    for k in reversed(range(order)):  # a shorter n-gram counts the bytes that come before it
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        levels.insert(0, written(levels[0].groupBy(suffix.alias("key")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n")), "level"))
    below: DataFrame | None = None
    for k, level in enumerate(levels):
        of = level.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (of[f"n{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d1, d2, d3 = (min(max(i - (i + 1) * y * b / a, 0.1 * i), 0.9 * i) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cut = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = Window.partitionBy(F.shiftright("key", 8))
        here = level.withColumn("cut", cut).withColumns({"total": F.sum("n").over(context), "free": F.sum("cut").over(context)})
        if below is None:
            here = here.withColumn("lower", F.lit(1 / 256))
        else:
            here = here.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut") + F.col("free") * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        below = written(here.select("key", p.alias("p")), "order")
    return below.select("key", F.log10("p").alias("value"))


def _block_pieces(rows: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(rows.column(rows.schema.names.index("text")))
    for a, b in pieces(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def fresh_counts(keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many of each text's n-grams are new within their window of WINDOW symbols."""
    size = np.diff(begins)
    place = np.arange(len(keys)) - np.repeat(begins[:-1], size)
    window = np.cumsum(place % WINDOW == 0)
    by = np.lexsort((keys, window))
    new = np.ones(len(keys), dtype=np.int64)
    new[by[1:]] = (keys[by[1:]] != keys[by[:-1]]) | (window[by[1:]] != window[by[:-1]])
    return np.add.reduceat(new, begins[:-1])


def trusted(labels: DataFrame) -> DataFrame:
    """(id, counted): the documents labelled as of good quality only; counted ones train, the others give thresholds."""
    good = only(labels, id="doc_id", quality="quality").groupBy("id").agg(F.min("quality").alias("quality")).where("quality = 1 AND id IS NOT NULL")
    return good.select("id", (~held("id", 5, 4)).alias("counted"))


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, lang, n_symbols, log10_p, n_fresh, block, place) of each row of docs; log10_p is that of the whole text, n_fresh counts the symbols whose n-gram is new in its window."""
    integral(docs, "doc_id")
    return _perplexities(B.pack(only(docs, doc_id="doc_id", text="text", lang="lang"), "text", "quality_blocks", BLOCK), docs.schema["doc_id"].dataType, labels, order)


def _perplexities(blocks: DataFrame, id_type: T.DataType, labels: DataFrame, order: int) -> DataFrame:

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in B.each(batches):
            ids, valid = B.longs(block.column(block.schema.names.index("doc_id")))
            yield pa.RecordBatch.from_pydict({"id": ids[valid], "block": np.full(int(valid.sum()), number)})

    where = blocks.select("block", "body").mapInArrow(ids_of, "id long, block long").distinct()
    training = where.join(trusted(labels).where("counted"), "id").select("block", "id")
    asked_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "block", "n")])
    asked_kind = B.to_arrow_schema(asked_schema)

    def ask(block: pa.RecordBatch, train: pa.Table) -> pa.Table:
        ids, valid = B.longs(block.column(block.schema.names.index("doc_id")))
        counts = np.isin(ids, train.column("id").to_numpy()) & valid
        keys, ns = [], []
        for a, b, data, offsets in _block_pieces(block):
            of, begins = contexts(data, offsets, order)
            inside = np.repeat(counts[a:b], np.diff(begins))
            u, n = np.unique(of[inside], return_counts=True)
            rest = np.unique(of[~inside])
            keys += [u, rest]
            ns += [n, np.zeros(len(rest))]
            if len(keys) >= 8:  # few pieces at once
                u, which = np.unique(np.concatenate(keys), return_inverse=True)
                keys, ns = [u], [np.bincount(which, weights=np.concatenate(ns), minlength=len(u))]
        u, which = np.unique(np.concatenate(keys), return_inverse=True)
        number = train.column("block")[0].as_py() if train.num_rows else -1
        return pa.Table.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), number)), pa.array(np.bincount(which, weights=np.concatenate(ns), minlength=len(u)).astype(np.int64))], schema=asked_kind)

    # Every block is named in its answers at least once, so that it knows its own number.
    named = training.union(blocks.select("block", F.lit(None).cast("long").alias("id")))
    # Asked for twice, from the blocks each time: that costs less than a copy of all keys.
    asked = B.answered(blocks, named.select("block", F.coalesce("id", F.lit(-(2**63))).alias("id")), ask, asked_schema)
    values = kneser_ney(written(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts"), order)
    answers = asked.select("key", "block").join(values, "key").select("block", "key", F.col("value").cast("float").alias("value"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("lang", T.StringType()), T.StructField("n_symbols", T.LongType()), T.StructField("log10_p", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in ("n_fresh", "block", "place")]])
    kind = B.to_arrow_schema(schema)

    def judge(block: pa.RecordBatch, got: pa.Table) -> pa.Table:
        keys, value = got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy().astype(np.float64)
        by = np.argsort(keys)
        keys, value = keys[by], value[by]
        size, total, fresh = [], [], []
        for _, _, data, offsets in _block_pieces(block):
            of, begins = contexts(data, offsets, order)
            size.append(np.diff(begins))
            total.append(np.add.reduceat(value[np.searchsorted(keys, of)], begins[:-1]))
            fresh.append(fresh_counts(of, begins))
        # Every text has an end, so every block has answers.
        where = [np.full(block.num_rows, got.column("block")[0].as_py()), np.arange(block.num_rows)]
        columns = [*(block.column(block.schema.names.index(c)) for c in ("doc_id", "lang")), np.concatenate(size), np.concatenate(total), np.concatenate(fresh), *where]
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return B.answered(blocks, answers, judge, schema)


def _by_language(unseen: DataFrame, stats: dict[str, tuple[str, float]]) -> DataFrame:
    """One row for each language and one (every = true) over all; stats: value and quantile of each new column.

    A language of n texts has n parts of its own value and ENOUGH of that over all."""
    # percentile merges counts of rounded values; no language is gathered unreduced.
    q = [F.percentile(F.round(value, 3), F.lit(quantile)).alias(name) for name, (value, quantile) in stats.items()]
    whole = unseen.agg(*q)
    own = unseen.groupBy("lang").agg(*q, F.count("*").alias("n")).crossJoin(F.broadcast(whole.select(*[F.col(n).alias(f"whole_{n}") for n in stats])))
    drawn = [((F.col("n") * F.col(n) + ENOUGH * F.col(f"whole_{n}")) / (F.col("n") + ENOUGH)).alias(n) for n in stats]
    return own.select(F.lit(False).alias("every"), "lang", *drawn).union(whole.select(F.lit(True), F.lit(None).cast("string"), *stats))


def _with(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """rows with their language's values of stats, or those over all languages."""
    own = stats.where("NOT every").select(F.col("lang").alias("own_lang"), *[F.col(n).alias(f"own_{n}") for n in names])
    whole = stats.where("every").select(*[F.col(n).alias(f"whole_{n}") for n in names])
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left").crossJoin(F.broadcast(whole))
    return out.withColumns({n: F.coalesce(f"own_{n}", f"whole_{n}") for n in names}).drop("own_lang", *[f"{side}_{n}" for side in ("own", "whole") for n in names])


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = UPPER, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """(doc_id, lang, perplexity, shrunk, threshold, fresh, least_fresh, keep) for each row of docs.

    shrunk is the perplexity after `prior` more symbols of the language's median
    bits, so that a few odd symbols don't condemn a short text; it is rejected
    above threshold.  fresh is the share of new n-grams, with as many more symbols
    of the language's median share; a text is rejected below least_fresh."""
    return _judged(perplexities(docs, labels, order), labels, quantile, margin, prior).drop("block", "place")


def kept(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = UPPER, margin: float = MARGIN, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns.  They come out of the blocks that were scored, so only decisions move."""
    integral(docs, "doc_id")
    blocks = B.pack(docs, "text", "quality_blocks", BLOCK)
    judged = _judged(_perplexities(blocks, docs.schema["doc_id"].dataType, labels, order), labels, quantile, margin, prior)
    rejected = written(judged.where("NOT keep").select("block", "place"), "rejected")
    kind = B.to_arrow_schema(docs.schema)

    def cut(block: pa.RecordBatch, out: pa.Table) -> pa.Table:
        keep = np.ones(block.num_rows, dtype=bool)
        keep[out.column("place").to_numpy()] = False
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(block.columns, kind, strict=True)], schema=kind).filter(pa.array(keep))

    return B.answered(blocks, rejected, cut, docs.schema)


def _judged(found: DataFrame, labels: DataFrame, quantile: float, margin: float, prior: int) -> DataFrame:
    found = found.withColumns({"bits": -F.col("log10_p") / F.col("n_symbols") / F.log10(F.lit(2.0)), "fresh": F.col("n_fresh") / F.col("n_symbols")})
    found = written(found, "perplexities")
    known = trusted(labels).where("NOT counted")
    medians = written(_by_language(found.join(known, "id"), {"median": ("bits", 0.5), "median_fresh": ("fresh", 0.5)}), "medians")
    found = _with(found, medians, ["median", "median_fresh"])
    for name, median in (("bits", "median"), ("fresh", "median_fresh")):
        found = found.withColumn(f"{name}_shrunk", F.coalesce((F.col(name) * F.col("n_symbols") + F.col(median) * prior) / (F.col("n_symbols") + prior), name))
    limits = written(_by_language(found.join(known, "id"), {"limit": ("bits_shrunk", quantile), "least": ("fresh_shrunk", 1 - quantile)}), "limits")
    out = _with(found, limits, ["limit", "least"]).withColumns({"limit": F.col("limit") * (1 + margin), "least": F.col("least") * (1 - margin)})
    two = F.lit(2.0)
    return out.select(
        F.col("id").alias("doc_id"), "lang", F.pow(two, "bits").alias("perplexity"), F.pow(two, "bits_shrunk").alias("shrunk"), F.pow(two, "limit").alias("threshold"), F.col("fresh_shrunk").alias("fresh"), F.col("least").alias("least_fresh"),
        F.coalesce((F.col("bits_shrunk") <= F.col("limit")) & (F.col("fresh_shrunk") >= F.col("least")), F.lit(True)).alias("keep"), "block", "place",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
