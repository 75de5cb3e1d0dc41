"""Prediction by partial matching: code lengths of documents under a byte-context trie.

The trie of all contexts of up to five bytes is learned from the training
documents and never gathered in one place: each depth is a table of (bytes,
count), spread by key.  A symbol is predicted by the longest context in which it
was seen.  A context escapes to its suffix by method D (a symbol seen c times
among n in all weighs 2c - 1 of 2n, the d distinct ones give d to the escape),
and the symbols seen in a longer context are excluded from the shorter one's
counts.  As a context's symbols are all seen in its suffix too, the mass to
exclude is one number for each context, so a symbol's probability depends on its
last six bytes alone and is worked out once for each distinct six bytes, in five
joins over the depths.

Documents are held in blocks.  Each block names the distinct byte sequences
(and words, for the baseline) that it holds, and gets back their values; no
model is broadcast and no value depends on how documents are dealt to blocks.  Words that
stand in most blocks are counted by the tasks first (at most COMMON words, whose totals may be
broadcast), so no task gathers a row of each block for one word.  Values go back as 32-bit
numbers and are summed in 64 bits.  Words are compared by 64-bit hashes: among 10**9 distinct
words the chance that any two agree is 3 per cent.

Texts are bytes of UTF-8, whole, between a start mark and an end symbol; the end
is predicted like any other.

Defined results: null and empty texts have only the end; without training rows
all counts are zero (score: uniform over 255 symbols); rows without an id train
and are scored; repeated rows count as often as they stand there; other columns
are ignored; an empty table gives an empty result.  A very long text is a block of its own and
must fit a task together with its answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm import blocks as B
from memengine.llm.common import held, only, table, written
from memengine.llm.textops import LOWER, Words, pieces, utf8

ORDER = 5
#: Bytes that UTF-8 never holds: before a text's start, and after its end.
START, END = 0xFE, 0xFF
SYMBOLS = 255
BLOCK = 10 << 20
#: From so many blocks on, words that stand in a quarter of the blocks looked at are counted by the tasks first; at most COMMON of them.
MANY_BLOCKS, COMMON = 64, 20_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text's bytes and end: the last order + 1 bytes as a number; and where each text begins among them."""
    n, texts = len(data), len(offsets) - 1
    step = order + 1
    out = np.full(n + step * texts, START, dtype=np.uint8)
    out[np.arange(n) + np.repeat(np.arange(texts) * step + order, np.diff(offsets))] = data
    out[offsets[1:] + np.arange(texts) * step + order] = END
    keys = np.zeros(len(out) - order, dtype=np.uint64)
    for j in range(step):
        keys <<= np.uint64(8)
        keys |= out[j : j + len(keys)]
    return keys[out[order:] != START], offsets + np.arange(texts + 1)


def _block_pieces(rows: pa.RecordBatch) -> Iterator[tuple]:
    data, offsets = utf8(rows.column(rows.schema.names.index("text")))
    held_out = np.asarray(rows.column(rows.schema.names.index("held_out")).to_numpy(zero_copy_only=False), dtype=bool)
    for a, b in pieces(offsets):
        yield held_out[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


class Answers:
    """Values by 64-bit key.  A key lies in one slot of a table, by its hash; the few whose slot another one took are searched in order.

    A block asks for each of its bytes, in no order: a search over all keys would miss the cache at every step."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, (2 * len(keys)).bit_length())
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, dtype=np.int32)
        at, own = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        self.slots[at] = own
        lost = np.flatnonzero(self.slots[at] != own)
        lost = lost[np.argsort(keys[lost])]
        self.lost, self.lost_values = keys[lost], values[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> self.shift).astype(np.int64)

    def find(self, of: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(np.asarray(otherwise, dtype=float), of.shape)
        spot = self.slots[self._slot(of)]
        hit = self.keys[spot] == of
        out = np.where(hit, self.values[spot], otherwise)
        if len(self.lost):
            missed = np.flatnonzero(~hit)
            keys = of[missed]
            spot = np.minimum(np.searchsorted(self.lost, keys), len(self.lost) - 1)
            found = self.lost[spot] == keys
            out[missed[found]] = self.lost_values[spot[found]]
        return out


def _asked(blocks: DataFrame, keys_of, name: str) -> DataFrame:
    """(key, block, n): the distinct keys of each block and their number in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in B.each(batches):
            found = []
            for held_out, data, offsets in _block_pieces(rows):
                keys, of = keys_of(data, offsets)
                train = np.repeat(~held_out, np.diff(of))
                u, n = np.unique(keys[train], return_counts=True)
                rest = np.unique(keys[~train])
                found += [(u, n), (rest, np.zeros(len(rest)))]
                if len(found) >= 8:
                    found = [_counted(found)]
            keys, n = _counted(found)
            for a in range(0, len(keys), 1 << 17):
                part = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_pydict({"key": keys[part].view(np.int64), "block": np.full(len(keys[part]), number), "n": n[part]})

    return blocks.select("block", "body").mapInArrow(run, "key long, block long, n long")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets, table=LOWER)
    return words.hashes(), words.of


def _common(blocks: DataFrame) -> DataFrame | None:
    """(key): words of a quarter of some blocks, if there are many blocks.  It only decides on which way a word's counts go."""
    n = blocks.count()
    if n < MANY_BLOCKS:
        return None
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(1, n // MANY_BLOCKS))) == 0)
    least = max(2, some.count() // 4)
    found = _asked(some, _words, "words").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return written(found.orderBy(F.desc("n"), "key").limit(COMMON).select("key"), "common")


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 of the probability of the last byte of key after the others, for every key.

    counts: (key, n) with the training count, 0 for keys that only need a value."""
    levels = [counts]
    for k in reversed(range(order)):  # update exclusion: a shorter context counts the longer ones in which the symbol stands
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        levels.insert(0, written(levels[0].groupBy(suffix.alias("key")).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n")), "level"))
    depth: DataFrame | None = None
    for k, here in enumerate(levels):
        context = Window.partitionBy(F.shiftright("key", 8))  # at most 256 rows
        here = here.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(context)})
        if depth is None:
            below = -F.log10(F.lit(SYMBOLS) - F.col("kinds"))
            depth = written(here.withColumn("below", F.when(F.col("n") == 0, below)), "depth")
            continue
        shorter = depth.select(F.col("key").alias("suffix"), F.col("n").alias("n1"), F.col("total").alias("total1"), F.col("kinds").alias("kinds1"), F.col("below").alias("below1"))
        here = here.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "suffix")
        here = here.withColumn("excluded", F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)).over(context))
        mass, left = F.col("total1") - F.col("excluded"), F.col("kinds1") - F.col("kinds")
        found = F.log10((2 * F.col("n1") - 1) / (2 * mass))
        escape = F.when(mass > 0, F.log10(left / (2 * mass))).otherwise(0.0) + F.col("below1")
        below = F.when(F.col("n") == 0, F.when(F.col("n1") > 0, found).otherwise(escape))
        depth = written(here.select("key", "n", "total", "kinds", below.alias("below")), "depth")
    own = F.log10((2 * F.col("n") - 1) / (2 * F.col("total")))
    escape = F.when(F.col("total") > 0, F.log10(F.col("kinds") / (2 * F.col("total")))).otherwise(0.0) + F.col("below")
    return depth.select("key", F.when(F.col("n") > 0, own).otherwise(escape).alias("value"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = "held_out", order: int = ORDER) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); rows with held_out don't train."""
    rows = only(docs, id=id_col, text=text_col, held_out=held_out)
    blocks = B.pack(rows, "text", "ppm_blocks", BLOCK)

    asked = _asked(blocks, lambda data, offsets: contexts(data, offsets, order), "grams")
    values = log_probabilities(written(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts"), order)
    no_count = F.lit(None).cast("long").alias("count")
    grams = asked.select("key", "block").join(values, "key").select("block", "key", F.col("value").cast("float").alias("value"), no_count)

    seen, of_word = Observation(), Window.partitionBy("key")
    words, shared_common, tokens, kinds = _asked(blocks, _words, "words"), None, 0, 0
    common = _common(blocks)
    if common is not None:
        often = words.join(F.broadcast(common), "key", "left_semi")
        totals = written(often.groupBy("key").agg(F.sum("n").alias("all")), "common_words")  # at most COMMON rows
        tokens, kinds = totals.agg(F.sum("all"), F.count_if(F.col("all") > 0)).first()
        shared_common = often.join(F.broadcast(totals), "key")
        words = words.join(F.broadcast(common), "key", "left_anti")
    words = words.withColumns({"all": F.sum("n").over(of_word), "rows": F.count("*").over(of_word), "first": F.min("block").over(of_word)})
    words = words.observe(seen, F.sum("n").alias("tokens"), F.sum(F.when((F.col("first") == F.col("block")) & (F.col("all") > 0), 1).otherwise(0)).alias("kinds"))
    # A word that only one block holds needs no answer: the block counts it itself.
    answer = ("block", "key", F.lit(None).cast("float").alias("value"), F.col("all").alias("count"))
    shared = written(words.where("rows > 1").select(*answer), "shared_words")
    if shared_common is not None:
        shared = shared.union(shared_common.select(*answer))
    ends = rows.agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("n")).first()["n"] or 0
    total = (tokens or 0) + (seen.get["tokens"] or 0) + ends
    kinds = (kinds or 0) + (seen.get["kinds"] or 0) + (1 if ends else 0)
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
            *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "bits_per_byte")],
        ]
    )
    kind = B.to_arrow_schema(schema)
    per_token = np.log10(total + kinds + 1)
    base_end, known_end = np.log10(ends + 1) - per_token, int(ends > 0)

    def judge(block: pa.RecordBatch, answers: pa.Table) -> pa.Table:
        is_gram = np.asarray(answers.column("count").is_null())
        keys = answers.column("key").to_numpy().view(np.uint64)

        def sums(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = np.zeros(len(of) - 1)
            some = of[1:] > of[:-1]
            if some.any():
                out[some] = np.add.reduceat(x, of[:-1][some])
            return out

        own: list[tuple[np.ndarray, np.ndarray]] = []  # training counts of the block's own words
        for held_out_, data, offsets in _block_pieces(block):
            words_, of = _words(data, offsets)
            own.append(np.unique(words_[np.repeat(~held_out_, np.diff(of))], return_counts=True))
        own_keys, own_counts = _counted(own)
        del own
        grams_of = Answers(keys[is_gram], answers.column("value").to_numpy()[is_gram])
        words_of, own_words = Answers(keys[~is_gram], answers.column("count").fill_null(0).to_numpy()[~is_gram]), Answers(own_keys, own_counts)
        del keys, is_gram
        n_tokens, n_known, base, scored, size = [], [], [], [], []
        for _, data, offsets in _block_pieces(block):
            words_, of = _words(data, offsets)
            counts = words_of.find(words_, own_words.find(words_, 0.0))
            n_tokens.append(np.diff(of) + 1)
            n_known.append(sums((counts > 0).astype(float), of).astype(np.int64) + known_end)
            base.append(sums(np.log10(counts + 1), of) - np.diff(of) * per_token + base_end)
            grams_, begins = contexts(data, offsets, order)
            scored.append(sums(grams_of.find(grams_, np.nan), begins))
            size.append(np.diff(offsets))
        whole = np.concatenate(scored)
        columns = [block.column(0), block.column(block.schema.names.index("held_out")), np.concatenate(n_tokens), np.concatenate(n_known), np.full(len(whole), total), np.concatenate(base), whole, -whole / np.log10(2) / (np.concatenate(size) + 1)]
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return B.answered(blocks, grams.union(shared), judge, schema)


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held("doc_id", 7, 2).alias("held_out"))
    return score(docs)
