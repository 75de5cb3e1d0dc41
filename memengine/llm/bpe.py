"""Byte-pair encoding and decoding by a pair occurrence index.

A task gathers the distinct pre-tokens of a partition's batch and lays their
symbols out in one array.  An index maps the rank of each mergeable pair to all
positions where that pair stands.  Active ranks are taken in ascending order:
each position of the rank is merged, and only the lists of the pairs to its
left and right change.  A merge can only make pairs of higher rank, so one pass
over the ranks encodes all pre-tokens of the batch at once.

The tokenizer file is a parameter; the driver reads it and sends its bytes (a few MB,
whatever the input) to the tasks; it is never trained or changed.  Texts that hold a special token's string get that
token's id there, as the tokenizers library does by default.

Defined results: null and empty texts have no tokens and decode to an empty
text; every other column passes through; equal rows give equal results; a very long text is
encoded whole and must fit a task with its symbols' arrays (about 50 bytes a byte of a text without any space).
"""

from __future__ import annotations

import gc
import heapq
import json
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.common import only, table
from memengine.llm.textops import give_back

TOKENIZER = "byte_bpe_50k.json"
#: Half of the distinct pre-tokens whose ids a worker keeps; beyond them, it forgets them and starts again.
KEPT_PIECES = 100_000
#: And the characters and bytes of them all: texts without spaces are pieces as a whole.
KEPT_BYTES = 48 << 20
#: Ids whose bytes are gathered together.
DECODED_IDS = 1 << 16
#: Texts taken together, in characters.
BATCH_CHARS = 1 << 20
# White space is spelled out as a property: the tokenizer's \s has none of the ASCII separators 1C to 1F.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
_UNSAFE = regex.compile(r" \p{White_Space}")
_BLANK = regex.compile(r"\p{White_Space}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies use for each byte: itself if printable, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes texts with the merges of one tokenizer file, given as its bytes."""

    def __init__(self, body: bytes):
        spec = json.loads(body)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.left, self.right, self.made, keys = [], [], [], []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
            keys.append(vocab[a] << 32 | vocab[b])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.rank = np.append(order, -1)
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**63 - 1))
        first = np.array(self.symbol, dtype=np.int64)
        #: the rank of each pair of bytes (left << 8 | right); as 16-bit numbers ranks are sorted by radix
        self.byte_ranks = self.ranks_of((first[:, None] << 32 | first).ravel()).astype(np.int32)
        self.sorted_as = np.uint16 if len(keys) <= 1 << 16 else np.int32
        size = np.zeros(max(self.bytes_of) + 2, dtype=np.int64)
        for i, x in self.bytes_of.items():
            size[i + 1] = len(x)
        #: where each id's bytes lie in those of all ids
        self.size, self.place = size[1:].copy(), np.cumsum(size)[:-1]
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), dtype=np.uint8)
        #: pre-tokens of a space and letters, under the letters, and others
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.kept = 0

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair (left << 32 | right), -1 for those that never merge."""
        spot = self.keys.searchsorted(pairs)  # the last key is above all pairs
        return np.where(self.keys[spot] == pairs, self.rank[spot], -1)

    def merge(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pretokens]
        ends = np.cumsum([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        total = len(data)
        #: one place more, without a symbol: what lies beyond either end of a pre-token
        sym = np.append(np.asarray(self.symbol, dtype=np.int32)[data], np.int32(-1))
        #: the index: rank -> positions of the pair's left symbol
        inner = np.ones(max(0, total - 1), dtype=bool)
        inner[ends[:-1] - 1] = False
        at = np.flatnonzero(inner)
        ranks = self.byte_ranks[data[at].astype(np.int32) << 8 | data[at + 1]]
        known = np.flatnonzero(ranks >= 0)
        at, ranks = at[known], ranks[known]
        order = np.argsort(ranks.astype(self.sorted_as), kind="stable")
        at, ranks = at[order], ranks[order]
        active, first = np.unique(ranks, return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(active.tolist(), np.split(at, first[1:]), strict=True)} if len(active) else {}
        heap = active.tolist()
        nxt, prv = np.arange(1, total + 2), np.arange(-1, total)
        nxt[ends - 1] = nxt[total] = total
        prv[ends[:-1]] = prv[0] = total
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.left[r], self.right[r], self.made[r]
            p = index.pop(r)
            p = np.concatenate(p) if len(p) > 1 else p[0]
            q = nxt[p]
            ok = (sym[p] == a) & (sym[q] == b)
            if not ok.all():
                p, q = p[ok], q[ok]
            if a == b and len(p):  # of a run of equal symbols, from the left
                order, taken, free = np.argsort(p), [], -1
                for i in order.tolist():
                    if p[i] != free:
                        taken.append(i)
                        free = q[i]
                    else:
                        free = -1
                p, q = p[taken], q[taken]
            if not len(p):
                continue
            after = nxt[q]
            sym[p], sym[q], nxt[p] = new, -1, after
            prv[after] = p
            before = prv[p]
            same = sym[before] == new
            if same.any():  # a left neighbour that is merged just now has the pair as its right one
                before = before[~same | ~np.isin(before, p)]
            changed = np.concatenate([p, before])
            found = self.ranks_of(sym[changed].astype(np.int64) << 32 | sym[nxt[changed]])
            known = (found >= 0).nonzero()[0]
            if not len(known):
                continue
            at, found = changed[known], found[known]
            order = found.astype(self.sorted_as).argsort(kind="stable")
            at, found = at[order], found[order]
            cut = [0, *((found[1:] != found[:-1]).nonzero()[0] + 1).tolist(), len(at)]
            for s, x, y in zip(found[cut[:-1]].tolist(), cut, cut[1:], strict=False):
                if s in index:
                    index[s].append(at[x:y])
                else:
                    index[s] = [at[x:y]]
                    heapq.heappush(heap, s)
        sym = sym[:total]
        alive = sym >= 0
        counts = np.cumsum(alive)[ends - 1] * 4
        body = sym[alive].astype("<u4").tobytes()
        return [body[x:y] for x, y in zip([0, *counts[:-1].tolist()], counts.tolist(), strict=True)]

    def learn(self, inner: Iterable[str], starts: Iterable[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """The ids of pieces after a space, and of pieces at a start.

        Pre-tokens are kept, a space and letters under the letters; a piece of several pre-tokens is put together anew for each batch."""
        find, words, tokens = _SPLIT.findall, self.words, self.tokens
        after: dict[str, bytes] = {}
        first: dict[str, bytes] = {}
        new_words, new, todo = set(), set(), [(first, c, find(c)) for c in starts]
        for c in inner:
            x = words.get(c)
            if x is not None:
                after[c] = x
            elif c.isalpha():
                new_words.add(c)
            else:
                head = c.rstrip(string.punctuation)
                todo.append((after, c, [" " + head, c[len(head) :]] if head.isalpha() else find(" " + c)))
        fresh = list(new_words)
        for _, _, parts in todo:
            for t in parts:
                if t[0] == " " and t[1:].isalpha():
                    if t[1:] not in words:
                        new_words.add(t[1:])
                elif t not in tokens:
                    new.add(t)
        if new_words or new:
            given = list(new_words)
            merged = self.merge([*map(" ".__add__, given), *new])
            words.update(zip(given, merged, strict=False))
            tokens.update(zip(new, merged[len(given) :], strict=True))
            self.kept += sum(map(len, given)) + sum(map(len, new)) + sum(map(len, merged))
        after.update(zip(fresh, map(words.__getitem__, fresh), strict=True))
        for where, c, parts in todo:
            where[c] = b"".join([words[t[1:]] if t[0] == " " and t[1:] in words else tokens[t] for t in parts])
        return after, first

    @staticmethod
    def pieces(text: str) -> list[str]:
        """text cut at spaces, such that the pieces can be encoded apart: a cut that leaves white space behind it is undone.

        The pre-token after a cut then starts with the space itself and a visible letter."""
        parts = text.split(" ")
        if not text.endswith(" ") and not (any(" " + c in text for c in " \n\t\r\v\f") if text.isascii() else _UNSAFE.search(text)):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if not p or _BLANK.match(p):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def sections(self, text: str) -> list[str | int]:
        """Special tokens' ids and the texts between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text] if text else []
        return [self.special.get(x, x) for x in self.cut.split(text) if x]

    def forget(self) -> None:
        """Drop the pre-tokens kept."""
        self.words, self.tokens, self.kept = {}, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        sections = [[x if isinstance(x, int) else self.pieces(x) for x in self.sections(t)] for t in texts]
        starts = {x[0] for own in sections for x in own if not isinstance(x, int)}
        inner: set[str] = set()
        for own in sections:
            for x in own:
                if not isinstance(x, int):
                    inner.update(x[1:])
        if len(self.words) + len(self.tokens) > 2 * KEPT_PIECES or self.kept > KEPT_BYTES:
            self.forget()
        after, first = self.learn(inner, starts)
        out = []
        for own in sections:
            body = []
            for x in own:
                if isinstance(x, int):
                    body.append(x.to_bytes(4, "little"))
                else:
                    body.append(first[x[0]])
                    body.extend(map(after.__getitem__, x[1:]))
            out.append(b"".join(body))
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0].as_py()

    def decode_all(self, bodies: list[bytes]) -> pa.Array:
        """The text of each element's ids, from the bytes of all of them at once; what isn't UTF-8 is replaced text by text."""
        own = np.frombuffer(b"".join(bodies), dtype="<u4")
        ends = np.append(0, np.cumsum(self.size[own]))
        data = np.empty(ends[-1], dtype=np.uint8)
        for a in range(0, len(own), DECODED_IDS):
            some, x = own[a : a + DECODED_IDS], ends[a : a + DECODED_IDS + 1]
            data[x[0] : x[-1]] = self.all_bytes[np.repeat(self.place[some] - x[:-1], np.diff(x)) + np.arange(x[0], x[-1])]
        cuts = ends[np.cumsum([0, *[len(x) // 4 for x in bodies]])]
        if ends[-1] < 1 << 31:
            out = pa.Array.from_buffers(pa.string(), len(bodies), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
            try:
                out.validate(full=True)
                return out
            except pa.ArrowInvalid:
                pass
        return pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


_ENCODERS: dict[int, Encoder] = {}


def encoder(body: bytes) -> Encoder:
    """One encoder for each Python worker and tokenizer."""
    key = hash(body)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(body)
        gc.freeze()  # the vocabulary's objects stay, so the collector needn't visit them again
    return _ENCODERS[key]


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens long, ids binary (little-endian unsigned 32-bit integers) and decoded string."""
    body = docs.sparkSession.sparkContext.broadcast(read(path or default_path()))
    added = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in dict(added)] + [T.StructField(n, t) for n, t in added])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(body.value)
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            for a, b in _batches(texts):
                ids = own.encode(texts[a:b])
                columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(names)}
                columns |= {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": own.decode_all(ids)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)
            give_back()
        own.forget()  # the worker lives on beside those of later stages
        give_back()

    return docs.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return encode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
