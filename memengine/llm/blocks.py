"""Blocks: whole rows packed, compressed, into pieces of bounded size.

Operators whose lookups need a table that grows with the corpus don't
broadcast it.  They cut the corpus into blocks, let each block name the keys it
needs, join those with the table, and bring a block and its answers together
again.  A block is written once, so its number stays the same when a task runs
again on another executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memengine.llm.common import saved
from memengine.llm.textops import give_back, pieces, utf8

#: Bytes of text in a block; a longer text is a block of its own, so one text must fit a task together with its answers.
BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, rows long, bytes long, body binary"


def _freeze(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 6)


def thaw(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.decompress(body)) as rows:
        return rows.read_next_batch()


def pack(df: DataFrame, text: str, name: str, most: int = BLOCK_BYTES) -> DataFrame:
    """All rows of df, with all columns, as a table of blocks (block, rows, bytes, body).

    The table is written to the warehouse in buckets by block, so that bringing
    the blocks together with their answers moves only the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"block": [number], "rows": [whole.num_rows], "bytes": [size], "body": [_freeze(whole)]}, schema=_BLOCK_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = utf8(batch.column(batch.schema.names.index(text)))
            for a, b in pieces(offsets, most):
                part, n = batch.slice(a, b - a), int(offsets[b] - offsets[a])
                if held and size + n > most:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield out()
            held = []
        give_back()

    return saved(df.mapInArrow(run, BLOCK_SCHEMA), name, "block")


_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, its rows) of batches of the block table."""
    for batch in batches:
        for number, body in zip(batch.column(batch.schema.names.index("block")).to_pylist(), batch.column(batch.schema.names.index("body")), strict=True):
            yield number, thaw(body.as_py())
            give_back()


def answered(blocks: DataFrame, answers: DataFrame, make: Callable[[pa.RecordBatch, pa.Table], Iterator[pa.RecordBatch] | pa.Table], schema: T.StructType) -> DataFrame:
    """make(rows of a block, its answers) for every block; answers has a column block and may have none for some."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(schema).empty_table()
        out = make(thaw(left.column("body")[0].as_py()), right)
        give_back()
        return out

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(schema)


def longs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, is valid) of an integer column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
