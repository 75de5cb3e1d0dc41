"""Substring dedup with a count-min prefilter.

A window is 13 consecutive words of one text.  A word goes if it lies in a
window that also starts in a document with a smaller id; all windows are judged
on the input.

1. Each block of text turns its windows into cells of a count-min sketch (two
   rows) and sends them, sorted and delta coded, to the sketch's shards.  A shard
   sums what it gets and answers each block with two bits a cell: counted at
   least twice, counted often.  A cell's count is never below the number of times
   that any of its windows occurs.  The sketch has about as many cells as the
   corpus has bytes, whatever its size, so it never fills up; no shard and no
   block sees more than its own part, and nothing is broadcast.
2. A window is kept for exact grouping unless one of its cells was counted once;
   no repeated window is lost.
3. The kept windows are grouped exactly, one row for each block of text and
   window (a passage in a third of all rows is one row a block), and the smallest
   document id goes back to the blocks that asked.  Windows counted often are
   pre-aggregated by the tasks first and joined with their blocks in SALTS parts,
   so no task gathers the rows of a passage that stands everywhere.

Windows are compared by two independent 64-bit hashes of their words, 128 bits
together: among 10**13 windows the chance that any two differ and agree is below
10**-12.

Defined results: a null or empty text has no words and stays as it is; texts of
fewer than 13 words stay whole; a very long text is a block of its own and must
fit a task; ids are whole numbers (TypeError otherwise); a row without an id is left as it is and is no
source for others; rows with the same id are one document and never remove
each other's words; other columns pass through unread.  The result of an empty
table is empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm import blocks as B
from memengine.llm.common import integral, only, table, written
from memengine.llm.textops import Words, grams, inside, mix, pieces, text_of, utf8

WINDOW = 13
#: Bytes of text hashed at once, and windows mixed at once: what a task holds for them beside its block.
PIECE_BYTES, MIXED = 1 << 18, 1 << 17
#: Bytes of text in a block: its windows' hashes, cells and answers are held at once, about 40 times as much.
BLOCK_BYTES = 4 << 20
#: Cells of one shard of the sketch (one byte each while it is summed), as a power of two: up to the larger, so that there are 2**SHARDS shards before
#: they get more numerous, as a block sends each shard a body of its own.
LOG2_SHARD, LOG2_LARGE, SHARDS = 22, 26, 10
#: Counts stop here; cells counted so often, at most twice by each block, are shared by many blocks.
MOST, OFTEN = 255, 128
SALTS = 16
_SALTS = (0x0, 0x5851F42D4C957F2D)


def _windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hashes, word positions) of all windows, and the words."""
    words = Words(data, offsets)
    at = np.flatnonzero(inside(words.of, k, len(words.starts)))
    return grams(words.hashes(), k)[at], at, words


def _second(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """The second hashes of the windows at these positions."""
    return grams(words.hashes(second=True), k, salt=1)[at]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    out = np.empty(len(hashes), dtype=np.uint32 if bits <= 32 else np.int64)
    for a in range(0, len(hashes), MIXED):
        out[a : a + MIXED] = mix(hashes[a : a + MIXED] ^ np.uint64(_SALTS[row])) >> np.uint64(64 - bits)
    return out


def _shrink(cells: np.ndarray) -> bytes:
    """Sorted numbers below 2**32 as steps, byte by byte of lower value first: the upper ones are mostly zero."""
    steps = np.diff(cells, prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _grow(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _each_piece(rows: pa.RecordBatch, id_col: str, text_col: str) -> Iterator[tuple]:
    """(ids, has an id, data, offsets) of the pieces of a block."""
    names = rows.schema.names
    data, offsets = utf8(rows.column(names.index(text_col)))
    ids, valid = B.longs(rows.column(names.index(id_col)))
    for a, b in pieces(offsets, PIECE_BYTES):
        yield ids[a:b], valid[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _all_windows(block: pa.RecordBatch, id_col: str, text_col: str, k: int) -> np.ndarray:
    """The hashes of all windows of a block's rows that have an id, in order."""
    found = [np.zeros(0, np.uint64)]
    for _, valid, data, offsets in _each_piece(block, id_col, text_col):
        hashes, at, words = _windows(data, offsets, k)
        found.append(hashes[valid[text_of(words.of, at)]])
    return np.concatenate(found)


def _answers(blocks: DataFrame, id_col: str, text_col: str, k: int, bits: int) -> DataFrame:
    """(block, row, shard, n, twice, often): for the block's n distinct cells in a shard, in order, two bit arrays."""
    low = min(bits, max(LOG2_SHARD, min(LOG2_LARGE, bits - SHARDS)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in B.each(batches):
            whole = _all_windows(block, id_col, text_col, k)
            for row in range(len(_SALTS)):
                found = np.sort(_cells(whole, row, bits))
                more = np.ones(len(found), dtype=bool)
                more[2:] = found[2:] != found[:-2]  # a count of two is as good as any above
                found = found[more]
                some, begin = np.unique(found >> low, return_index=True)  # the work is that of the shards met, not of all
                bodies = [_shrink(found[a:b] - (i << low)) for i, a, b in zip(some.tolist(), begin.tolist(), [*begin[1:].tolist(), len(found)], strict=True)]
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(some), row), pa.int32()), "shard": pa.array(some, pa.int64()), "block": np.full(len(some), number), "body": pa.array(bodies, pa.binary())})

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << low, dtype=np.uint8), []
        for part in parts:
            held.append(part)
            for body in part.column("body"):
                got = _grow(body.as_py())
                counts[got] = np.minimum(counts[got], MOST - 1) + 1
                again = got[1:][got[1:] == got[:-1]]
                counts[again] = np.minimum(counts[again], MOST - 1) + 1
        for part in held:
            n, twice, often = [], [], []
            for body in part.column("body"):
                got = _grow(body.as_py())
                got = counts[got[np.append(True, got[1:] != got[:-1])]]
                n.append(len(got))
                twice.append(np.packbits(got >= 2).tobytes())
                often.append(np.packbits(got >= OFTEN).tobytes() if (got >= OFTEN).any() else None)
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("block", "row", "shard")} | {"n": pa.array(n, pa.int64()), "twice": pa.array(twice, pa.binary()), "often": pa.array(often, pa.binary())})

    # Each type hint matters: with iterators Spark hands a shard over batch by batch.
    summed.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sent = blocks.select("block", "body").mapInArrow(cells, "row int, shard long, block long, body binary")
    return sent.groupBy("row", "shard").applyInArrow(summed, "block long, row int, shard long, n long, twice binary, often binary")


def _bits(got: pa.Table, row: int, column: str) -> np.ndarray:
    """The bits of one row's answers to a block, in the order of the cells."""
    own = got.filter(pa.compute.equal(got.column("row"), row)).sort_by("shard")
    parts = [np.zeros(0, dtype=bool)]
    for n, body in zip(own.column("n").to_pylist(), own.column(column).to_pylist(), strict=True):
        parts.append(np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=n).astype(bool) if body is not None else np.zeros(n, dtype=bool))
    return np.concatenate(parts)


def _located(known: tuple[np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is known, place) of each pair of hashes among known pairs in order; rows with the same first hash follow each other."""
    spot = np.searchsorted(known[0], first)
    hit = np.zeros(len(first), dtype=bool)
    while True:
        here = ~hit & (spot < len(known[0]))
        here[here] = known[0][spot[here]] == first[here]
        if not here.any():
            return hit, np.where(hit, spot, 0)
        hit[here] = known[1][spot[here]] == second[here]
        spot[here & ~hit] += 1


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """Every row of docs with its columns, text_col holding the kept words joined by one space where words went,
    and n_words, n_removed (long) and kept_words (the kept words joined by one space, also where nothing went)."""
    integral(docs, id_col)
    blocks = B.pack(docs, text_col, "substring_blocks", BLOCK_BYTES)
    size = blocks.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    bits = max(10, math.ceil(math.log2(size + 1)))
    judged = written(_answers(blocks, id_col, text_col, k, bits), "substring_cells")
    asked_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "second", "block", "lowest")] + [T.StructField(n, T.BooleanType()) for n in ("several", "often")])
    asked_kind = B.to_arrow_schema(asked_schema)

    def ask(block: pa.RecordBatch, got: pa.Table) -> pa.Table:
        whole = _all_windows(block, id_col, text_col, k)
        keep, often = np.ones(len(whole), dtype=bool), np.ones(len(whole), dtype=bool)
        for row in range(len(_SALTS)):
            _, which = np.unique(_cells(whole, row, bits), return_inverse=True)
            keep &= _bits(got, row, "twice")[which]
            often &= _bits(got, row, "often")[which]
            del which
        seconds, ids_of, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for ids, valid, data, offsets in _each_piece(block, id_col, text_col):
            _, at, words = _windows(data, offsets, k)
            of = text_of(words.of, at)
            at, of = at[valid[of]], of[valid[of]]
            own = keep[n : n + len(at)]
            n += len(at)
            seconds.append(_second(words, at[own], k))
            ids_of.append(ids[of[own]])
        first, often = whole[keep], often[keep]
        del whole, keep
        second, ids = np.concatenate(seconds), np.concatenate(ids_of)
        del seconds, ids_of
        order = np.lexsort((ids, second, first))
        first = first[order]
        second = second[order]
        ids, often = ids[order], often[order]
        del order
        begin = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)])
        last = np.append(begin[1:], len(first)) - 1 if len(begin) else begin
        number = got.column("block")[0].as_py() if got.num_rows else -1
        columns = [first[begin].view(np.int64), second[begin].view(np.int64), np.full(len(begin), number), ids[begin], ids[begin] != ids[last], often[begin]]
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, asked_kind, strict=True)], schema=asked_kind)

    asked = B.answered(blocks, judged, ask, asked_schema)
    window = ["first", "second"]
    rare = asked.where("NOT often").withColumn("least", F.min("lowest").over(Window.partitionBy(*window)))
    answers = rare.select(*window, "block", "lowest", "several", "least")
    if not judged.where("often IS NOT NULL").isEmpty():
        common = written(asked.where("often").drop("often"), "substring_common")  # read twice below
        least = common.groupBy(*window).agg(F.min("lowest").alias("least"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        common = common.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(least, [*window, "salt"])
        answers = answers.union(common.select(*window, "block", "lowest", "several", "least"))
    answers = answers.where((F.col("least") < F.col("lowest")) | F.col("several")).select("block", *window, "least")
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_words", T.StringType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])
    kind = B.to_arrow_schema(schema)

    def cut(block: pa.RecordBatch, got: pa.Table) -> pa.Table:
        firsts, seconds = (got.column(c).to_numpy().view(np.uint64) for c in ("first", "second"))
        order = np.lexsort((seconds, firsts))
        known, least = (firsts[order], seconds[order]), got.column("least").to_numpy()[order]
        n_words, n_removed, kept_words = [], [], []
        for ids, valid, data, offsets in _each_piece(block, id_col, text_col):
            hashes, at, words = _windows(data, offsets, k)
            of = text_of(words.of, at)
            gone = np.zeros(len(words.starts) + 1, dtype=np.int32)
            if len(least):
                hit, spot = _located(known, hashes, _second(words, at, k))
                hit &= (least[spot] < ids[of]) & valid[of]
                np.add.at(gone, at[hit], 1)
                np.add.at(gone, at[hit] + k, -1)
            keep = np.cumsum(gone)[:-1] == 0
            n_words.append(np.diff(words.of))
            total = np.append(0, np.cumsum(~keep))
            n_removed.append(total[words.of[1:]] - total[words.of[:-1]])
            raw = data.tobytes()
            for i in range(len(ids)):
                own = raw[offsets[i] : offsets[i + 1]].split()
                kept_words.append(b" ".join(compress(own, keep[words.of[i] : words.of[i + 1]].tolist())))
        columns = {n: block.column(i) for i, n in enumerate(block.schema.names)}
        columns["n_words"], columns["n_removed"] = pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed))
        columns["kept_words"] = pa.array(kept_words, pa.binary()).cast(pa.string())
        removed = pa.compute.greater(columns["n_removed"], 0)
        columns[text_col] = pa.compute.if_else(removed, columns["kept_words"], columns[text_col].cast(pa.string()))
        return pa.Table.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)

    return B.answered(blocks, answers, cut, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


#: The words of a text are cut out by position, so the windows keep their order; windows are compared as text.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 12)) AS p, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') AS g FROM s),
m AS (SELECT g, min(doc_id) AS lowest FROM k GROUP BY g),
c AS (SELECT DISTINCT k.doc_id, unnest(generate_series(k.p, k.p + 12)) AS q FROM k JOIN m USING (g) WHERE m.lowest < k.doc_id),
r AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
f AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id)),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS q FROM w),
h AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM e LEFT JOIN c USING (doc_id, q) WHERE c.q IS NULL GROUP BY e.doc_id)
SELECT f.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM f LEFT JOIN h USING (doc_id)
"""
