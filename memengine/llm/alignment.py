"""Alignment of the tokens of two tokenizers, in relations.

The tokenizers' ids of each text (A: byte-level BPE of space + text; B: sentencepiece, which adds the space itself)
are written as one row a document, in buckets by row number.  From there on it
is Spark's relational algebra, and as everything goes by row number nothing is shuffled again:

1. posexplode gives a row for each token (its code: id and bytes), and a window over the document's
   tokens its end: the running sum of bytes.
2. An equi-join of A's and B's tokens on document and end gives the links: the
   byte offsets where tokens of both end.  As no token is empty, at most one of each ends there.
3. A running count of the links numbers the groups that they cut; a group is the range
   of A's and of B's tokens since the link before.  The ranges are kept as offsets in the
   comma-joined ids (running sums of their digits), so the text of a group of several tokens is a slice.
4. Links are counted by pair of ids.  Pairs are looked up by broadcast as far as COMMON
   of them reach, the most frequent ones (the bound is checked by a histogram of counts); links of rarer pairs are joined by shuffle.

Texts that are null or empty, or whose joined A or B bytes differ from space + text,
have no tokens: all numbers are 0 and the digest is empty.  Special tokens' strings
are plain text.  Each row is a document of its own, also where ids repeat or
are null; an empty table gives an empty result; other columns are not read.  A very long text
is one row of the token table; its tokens are rows that sort and spill like any.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.bpe import Encoder, byte_letters, read
from memengine.llm.common import forget, integral, only, saved, table, written
from memengine.llm.textops import give_back, pieces, utf8

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose tokens are sorted in one task.  At most TASKS times the shuffle partitions are made, though: beyond, they grow and spill.
TASK_BYTES, TASKS = 2 << 20, 8
#: Texts of more characters are encoded by this package's encoder, which is linear in the length of a pre-token.
LONG = 1 << 16
#: Words whose B ids a worker keeps, and bytes of texts taken together.
KEPT, BATCH_BYTES = 200_000, 1 << 20
#: Pairs of ids that are broadcast, at most (a few MB).
COMMON = 1 << 17
TOKENS = "row long, doc_id long, a array<int>, b array<int>"
_LONE = regex.compile(r"(?<=[^ ]) (?=[^ ])")
#: While the tokens are joined: both sides lie in buckets by row alone, and rows in order need no hash table to be gathered.
_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Pair:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a: bytes, b: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        spec = json.loads(a)
        back, special = {c: i for i, c in byte_letters().items()}, {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary of A must be in the order of its merges")
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Encoder(a)
        self.slow.cut = None  # special tokens' strings are plain text
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        n = self.pieces.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        #: words can be encoded apart if no piece has a space behind another letter
        self.apart = not any(" " in x.lstrip(b" ").decode() for i, x in enumerate(self.bytes_of) if not self.pieces.is_byte(i))
        #: each id's code: the id and, in the lowest eight bits, its token's bytes
        self.codes = [self._codes({i: len(s) for s, i in ranks.items()}), self._codes(dict(enumerate(map(len, self.bytes_of))))]
        self.known: dict[str, bytes | None] = {}

    @staticmethod
    def _codes(lengths: dict[int, int]) -> np.ndarray:
        if max(lengths.values()) > 255 or max(lengths) >= 1 << 23:
            raise ValueError("tokens of more than 255 bytes, or too many")
        out = np.arange(max(lengths) + 1, dtype="<i4") << 8
        out[list(lengths)] += np.array(list(lengths.values()), dtype="<i4")
        return out

    def ids_a(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            ids = self.slow.encode([" " + t])[0] if len(t) > LONG else np.array(self.fast.encode_ordinary(" " + t), dtype="<i4").tobytes()
            out.append(ids)
        return out

    def _whole(self, text: str, ids: list[int]) -> bytes | None:
        """ids as little-endian 32-bit integers, or None if their bytes aren't space + text."""
        return np.array(ids, dtype="<i4").tobytes() if b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode() else None

    def ids_b(self, texts: list[str]) -> list[bytes | None]:
        parts = [[t] if not self.apart else t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " else _LONE.split(t) for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = list({p for own in parts for p in own if p not in self.known})
        for p, ids in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            self.known[p] = self._whole(p, ids)
        find, out = self.known.__getitem__, []
        for t, own in zip(texts, parts, strict=True):
            found = list(map(find, own))
            out.append(self._whole(t, self.pieces.encode(t)) if None in found else b"".join(found))
        return out


_PAIRS: dict[tuple[int, int], Pair] = {}


def _pair(a: bytes, b: bytes) -> Pair:
    """One for each Python worker and pair of files."""
    key = (hash(a), hash(b))
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(a, b)
    return _PAIRS[key]


def _lists(bodies: list[bytes], codes: np.ndarray) -> pa.Array:
    ends = np.cumsum([0, *[len(x) // 4 for x in bodies]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[np.frombuffer(b"".join(bodies), dtype="<i4")]))


def _tokens(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """TOKENS of docs (doc_id, text), a row a document, in buckets by row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((a, b))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(least, -(-size // TASK_BYTES)), TASKS * least)
    kind = to_arrow_schema(spark.createDataFrame([], TOKENS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pair(*sent.value)
        for batch in batches:
            row, ids, given = (batch.column(batch.schema.names.index(c)) for c in ("row", "doc_id", "text"))
            for x, y in pieces(utf8(given)[1], BATCH_BYTES):
                texts = [t or "" for t in given.slice(x, y - x).to_pylist()]
                b_ids = [ids if t else None for t, ids in zip(texts, own.ids_b(texts), strict=True)]
                a_ids = own.ids_a(texts)
                lists = [_lists(x, own.codes[i]) for i, x in enumerate(([p if q else b"" for p, q in zip(a_ids, b_ids, strict=True)], [q or b"" for q in b_ids]))]
                columns = [row.slice(x, y - x), ids.slice(x, y - x).cast(pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)
            give_back()

    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartition(n, "row")
    return saved(dealt.mapInArrow(run, TOKENS), "alignment_tokens", "row", n)


def _digits(number: Column) -> Column:
    """Digits of a token's id, and one for the comma behind it."""
    out = F.when(number < 10, 2)
    for n in range(2, 8):
        out = out.when(number < 10**n, n + 1)
    return out.otherwise(9)


def _ends(tokens: DataFrame, name: str) -> DataFrame:
    """A row for each token: its end in bytes, and the end of its id in the comma-joined ids; one running sum has both, one above the other."""
    so_far = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.shiftright(name, 8)
    step = F.shiftleft(_digits(number).cast("long"), 32) + F.col(name).bitwiseAND(255)
    rows = tokens.select("row", F.posexplode(name).alias("place", name)).select("row", "place", number.alias(name), step.alias("step"))
    rows = rows.select("row", name, F.sum("step").over(so_far).alias("sum"))
    return rows.select("row", F.col("sum").bitwiseAND(0xFFFFFFFF).alias("end"), name, F.shiftright("sum", 32).cast("int").alias(f"{name}_to"))


def links(tokens: DataFrame) -> DataFrame:
    """(row, end, a, b, group, ...): A's and B's tokens that end together, with the number of the group that they close and its ranges."""
    both = _ends(tokens, "a").hint("merge").join(_ends(tokens, "b"), ["row", "end"])
    order = Window.partitionBy("row").orderBy("end")
    before = {f"{c}_from": F.coalesce(F.lag(f"{c}_to").over(order), F.lit(0)) for c in ("a", "b")}
    return both.withColumns({"group": F.row_number().over(order), **before})


def _aligned(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each document: its numbers, the digest of its groups, and its links' pairs of ids.

    The links come in order and are gathered in order: the join sorts them by row and end, a sorted
    aggregate reads them as they come, and nothing is shuffled between."""
    alone = [F.col(f"{c}_to") - F.col(f"{c}_from") == _digits(F.col(c)) for c in ("a", "b")]
    text = F.when(alone[0] & alone[1], F.concat(F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string")))
    size = lambda c: (F.col(f"{c}_to") - F.col(f"{c}_from") - 1).alias(f"{c}_size")
    cut = F.struct("group", text.alias("text"), "a", "b", "a_from", size("a"), "b_from", size("b"))
    # Read twice, so that the struct is made by generated code below the aggregate and not field by field within it.
    cuts = found.select("row", cut.alias("cut")).groupBy("row").agg(F.collect_list("cut").alias("cuts"), F.max("cut.group").alias("n_groups"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: F.shiftright(x, 8)).cast("array<string>"), ",").cast("binary").alias(f"{c}_text")
    rows = tokens.select("row", "doc_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), ids("a"), ids("b")).join(cuts, "row", "left")
    part = lambda x, own, c: F.substring(own[f"{c}_text"], x[f"{c}_from"] + 1, x[f"{c}_size"]).cast("string")
    group = lambda x, own: F.coalesce(x["text"], F.concat(part(x, own, "a"), F.lit("|"), part(x, own, "b")))
    # Both texts are bound by an outer lambda over one element: as columns they would be copied whole for each slice.
    joined = lambda own: F.array_join(F.transform("cuts", lambda x: group(x, own)), ";")
    groups = F.transform(F.array(F.struct("a_text", "b_text")), joined)[0]
    return rows.select(
        "row", "doc_id", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"),
        F.when(F.col("cuts").isNull(), "").otherwise(F.sha2(groups.cast("binary"), 256)).alias("groups_sha256"), F.col("cuts.a").alias("a"), F.col("cuts.b").alias("b"),
    )


def _frequent(counts: DataFrame) -> int:
    """The least count such that at most COMMON pairs have it or more, by powers of two; 0 if all pairs are few enough."""
    steps = counts.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count("*").alias("pairs")).collect()
    least, total = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["power"]):
        total += r["pairs"]
        if total > COMMON:
            return least
        least = 1 << r["power"]
    return 0


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    n_best counts the links whose pair is the most frequent of its B id, ties included; count_sum adds up the links' pairs' counts in all documents."""
    import public_tokenizers

    integral(docs, doc_id)
    spark = docs.sparkSession
    a, b = read(path_a or public_tokenizers.path(A)), read(path_b or public_tokenizers.path(B))
    tokens = _tokens(only(docs, doc_id=doc_id, text=text), a, b)
    with _set(spark, _SETTINGS):
        aligned = written(_aligned(tokens, links(tokens)), "aligned")
    forget(tokens)
    pair = F.explode(F.arrays_zip("a", "b")).alias("pair")
    counts = written(aligned.select(pair).groupBy("pair.a", "pair.b").count(), "pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(best.hint("merge"), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    least = _frequent(counts)
    each = aligned.select("row", pair).select("row", "pair.a", "pair.b").join(F.broadcast(judged.where(F.col("count") >= least)), ["a", "b"], "left")
    sums = lambda df: df.groupBy("row").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    if least:
        rare = each.where(F.col("count").isNull()).select("row", "a", "b").join(judged.where(F.col("count") < least).hint("merge"), ["a", "b"])
        found = sums(each.where(F.col("count").isNotNull())).union(sums(rare)).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    else:
        found = sums(each)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *map(number, ("n_links", "n_best", "count_sum")), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
