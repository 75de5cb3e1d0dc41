"""Byte-level BPE by a rank file, encoding and decoding, in padded numpy matrices.

A text falls into pre-tokens (the matches of a pattern).  A worker encodes each
distinct pre-token once: pre-tokens of like length are the rows of one matrix of
symbols, padded with -1, beside a matrix of their neighbours' ranks.  In each
round every row merges its leftmost pair of minimum rank, the matrices lose a
column (compaction), only the two pairs at the merge are looked up again, and
rows without a pair left leave.  Ranks of pairs come from a hash table in two
arrays, probed for all rows at once.  Two neighbours merge when their bytes
together are a token, as rank files say nothing of pairs.

A pre-token of more than WIDEST bytes is a row of its own and merges all places of
its minimum rank in one round, from the left: the same as one place a round, as
long as no pair made on the way has that rank or a smaller one; where one has, only the
leftmost is merged.

The rank file is a parameter; the driver reads it and sends its bytes (a few MB,
whatever the input) to the tasks; it is never trained or changed.

Defined results: null and empty texts have no tokens, null ids decode to nothing;
special tokens' strings are plain text; equal rows give equal results; an empty table
gives an empty table.  Columns named n_tokens and ids (encode) or decoded (decode)
are replaced, all others pass through.  A very long text is encoded whole and must fit a
task with its ids.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.common import only, table
from memengine.llm.textops import give_back, pieces, utf8

RANKS = "byte_bpe_50k.tiktoken"
#: Longest pre-token, in bytes, that shares a matrix; and the widths of the matrices.
WIDEST = 64
WIDTHS = (3, 4, 6, 8, 10, 12, 16, 24, 32, 48, WIDEST)
#: Rows of one matrix: both matrices of the widest stay below 5 MB.
ROWS = 8192
#: Distinct pre-tokens whose ids a worker keeps, and bytes of them; beyond either it forgets them and starts again.
KEPT, KEPT_BYTES = 200_000, 32 << 20
#: Bytes of texts taken together, and ids decoded together.
BATCH_BYTES, BATCH_IDS = 1 << 20, 1 << 20
#: The rank of a pair that never merges.
NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """rank of (left, right) by open addressing with linear probing, for arrays of pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys = left.astype(np.int64) << 32 | right
        spot, todo = self._spot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[spot[todo]] < 0
            slots, first = np.unique(spot[todo[free]], return_index=True)
            chosen = todo[free][first]
            self.keys[slots], self.ranks[slots] = keys[chosen], rank[chosen]
            todo = todo[self.keys[spot[todo]] != keys[todo]]
            spot[todo] = (spot[todo] + 1) & self.mask

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it never merges or either side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        keys[(right < 0).ravel() | (left < 0).ravel()] = -2
        spot = self._spot(keys)
        out = np.full(len(keys), NONE, dtype=np.int32)
        have = self.keys[spot]
        hit = have == keys
        out[hit] = self.ranks[spot[hit]]
        todo = np.flatnonzero(~hit & (have >= 0))
        while len(todo):
            spot[todo] = (spot[todo] + 1) & self.mask
            have = self.keys[spot[todo]]
            hit = have == keys[todo]
            out[todo[hit]] = self.ranks[spot[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out.reshape(left.shape)


class Ranks:
    """Encodes and decodes with one rank file, given as its bytes (a line for each token: base64 and rank)."""

    def __init__(self, body: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, body.splitlines()))}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a rank file needs all 256 single bytes")
        # The rank files' libraries take white space by its Unicode property, which leaves out 1C to 1F.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.rank_of = PairTable(*np.array(pairs, dtype=np.int32).reshape(-1, 3).T)
        size = np.zeros(max(self.ranks.values()) + 2, dtype=np.int64)
        for t, r in self.ranks.items():
            size[r + 1] = len(t)
        self.size, self.start = size[1:].copy(), np.cumsum(size)[:-1]
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def _matrix(self, sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their symbols, padded with -1) as rows end."""
        rows = np.arange(len(sym))
        ranks = self.rank_of(sym[:, :-1], sym[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, sym
                return
            best = ranks.argmin(axis=1)  # of equal ranks the leftmost
            low = ranks[np.arange(len(rows)), best]
            ended = low == NONE
            if ended.any():
                yield rows[ended], sym[ended]
                rows, sym, ranks, best, low = (x[~ended] for x in (rows, sym, ranks, best, low))
            width, at = sym.shape[1], np.arange(len(rows))
            places = np.arange(width - 1)
            sym = np.take_along_axis(sym, places + (places > best[:, None]), axis=1)
            sym[at, best] = low
            places = places[:-1]
            ranks = np.take_along_axis(ranks, places + (places >= best[:, None]), axis=1)
            has = np.flatnonzero(best > 0)
            ranks[has, best[has] - 1] = self.rank_of(sym[has, best[has] - 1], low[has])
            has = np.flatnonzero(best < width - 2)
            ranks[has, best[has]] = self.rank_of(low[has], sym[has, best[has] + 1])

    def _long(self, sym: np.ndarray) -> np.ndarray:
        """One pre-token of many bytes."""
        ranks = self.rank_of(sym[:-1], sym[1:])
        while len(ranks) and (low := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == low)
            run = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]  # every other place of a run overlaps
            inner = at[at + 2 < len(sym)]
            if (self.rank_of(np.full(len(inner), low), sym[inner + 2]) <= low).any():
                at = at[:1]
            new, ranks_now = self._merged(sym, ranks, at, low)
            if len(at) > 1 and (ranks_now[np.maximum(at - np.arange(len(at)) - 1, 0)] <= low).any():
                new, ranks_now = self._merged(sym, ranks, at[:1], low)
            sym, ranks = new, ranks_now
        return sym

    def _merged(self, sym: np.ndarray, ranks: np.ndarray, at: np.ndarray, low: np.int32) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        new = sym.copy()
        new[at] = low
        new = new[keep]
        out = np.append(ranks, NONE)[keep][:-1]
        spot = at - np.arange(len(at))
        spot = np.unique(np.concatenate([spot, spot - 1]))
        spot = spot[(spot >= 0) & (spot < len(out))]
        out[spot] = self.rank_of(new[spot], new[spot + 1])
        return new, out

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit integers."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        start = np.cumsum(size) - size
        data = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        whole = np.array([self.ranks.get(x, -1) for x in raw], dtype=np.int32)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0][:, None])]
        open_ = np.flatnonzero(whole < 0)
        for i in open_[size[open_] > WIDEST].tolist():
            done.append((np.array([i]), self._long(data[start[i] : start[i] + size[i]])[None, :]))
        narrow = open_[size[open_] <= WIDEST]
        bucket = np.searchsorted(WIDTHS, size[narrow])
        for b in np.unique(bucket).tolist():
            own, places = narrow[bucket == b], np.arange(WIDTHS[b])
            for a in range(0, len(own), ROWS):
                part = own[a : a + ROWS]
                cells = data[np.minimum(start[part][:, None] + places, len(data) - 1)]
                cells[places >= size[part][:, None]] = -1
                done.extend((part[rows], sym) for rows, sym in self._matrix(cells))
        count = np.zeros(len(raw), dtype=np.int64)
        for rows, sym in done:
            count[rows] = (sym >= 0).sum(axis=1)
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<i4")
        for rows, sym in done:
            has = sym >= 0
            out[((ends - count)[rows][:, None] + np.arange(sym.shape[1]))[has]] = sym[has]
        body, cuts = out.tobytes(), [0, *(4 * ends).tolist()]
        return [body[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        if len(self.known) > KEPT or self.kept > KEPT_BYTES:
            self.known, self.kept = {}, 0
        parts = [self.split.findall(t) for t in texts]
        new = list({p for own in parts for p in own if p not in self.known})
        merged = self.merge(new)
        self.known.update(zip(new, merged, strict=True))
        self.kept += sum(map(len, new)) + sum(map(len, merged))
        find = self.known.__getitem__
        return [b"".join(map(find, own)) for own in parts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id without a token")
        out = [np.zeros(0, dtype=np.uint8)]
        for a in range(0, len(ids), BATCH_IDS):
            own = ids[a : a + BATCH_IDS]
            size = self.size[own]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.start[own] - (ends - size), size) + np.arange(ends[-1])])
        return np.concatenate(out)


_RANKS: dict[tuple[int, str], Ranks] = {}


def _ranks(body: bytes, pattern: str) -> Ranks:
    """One for each Python worker and rank file."""
    key = (hash(body), pattern)
    if key not in _RANKS:
        _RANKS.clear()
        _RANKS[key] = Ranks(body, pattern)
        gc.freeze()  # the tables stay, so the collector needn't visit them again
    return _RANKS[key]


def _defaults(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def _with(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType]], column: str, cut: Callable[[pa.Array], Iterator[tuple[int, int]]], make: Callable[[Ranks, pa.Array], dict[str, pa.Array]], path: str | None, pattern: str | None) -> DataFrame:
    """df with columns that make() gives for pieces of one column, [a, b) by cut(), so that a task holds one piece's objects at a time."""
    body, pattern = _defaults(path, pattern)
    sent = df.sparkSession.sparkContext.broadcast(body)
    schema = T.StructType([f for f in df.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ranks(sent.value, pattern)
        for batch in batches:
            names = batch.schema.names
            given = batch.column(names.index(column))
            for a, b in cut(given):
                columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(names)} | make(own, given.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)
            give_back()

    return df.mapInArrow(run, schema)


def _by_bytes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return pieces(utf8(texts)[1], BATCH_BYTES)


def _by_ids(lists: pa.Array) -> Iterator[tuple[int, int]]:
    return pieces(_offsets(lists), BATCH_IDS)


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.cumsum([0, *[n or 0 for n in pc.list_value_length(lists).to_pylist()]])


def _ids(own: Ranks, texts: pa.Array) -> dict[str, pa.Array]:
    ids = own.encode([t or "" for t in texts.to_pylist()])
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
    return {"n_tokens": pa.array(np.diff(ends)), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))}


def _decoded(own: Ranks, lists: pa.Array) -> dict[str, pa.Array]:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    data = own.decode(ids)
    ends = np.append(0, np.cumsum(own.size[ids]))[_offsets(lists)]
    return {"decoded": pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])}


_ENCODED = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
_DECODED = [("decoded", T.BinaryType())]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with n_tokens long and ids array<int>."""
    return _mapped(docs, _ENCODED, text_col, _by_bytes, _ids, path, pattern)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded with decoded binary, the bytes of its ids."""
    return _mapped(encoded, _DECODED, ids_col, _by_ids, _decoded, path, pattern)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass: one Python worker a task instead of two."""
    both = lambda own, texts: (made := _ids(own, texts)) | _decoded(own, made["ids"])
    return _mapped(docs, _ENCODED + _DECODED, text_col, _by_bytes, both, path, pattern)


def op12_padded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are Spark's; encoding and decoding take one pass, without a shuffle."""
    coded = round_trip(only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
