"""Exact n-gram Jaccard join with set-relation skipping.

Sets are the distinct five-word shingles of a text.  Two sets are linked when
100 * intersection >= 80 * union.  The result is each document's class: the
smallest document id that it reaches by links.

Relations between sets save work, none of them loses a link:

* equal sets are one set with several members (a class of copies is never
  expanded into pairs);
* sets that share a minimum hash with their smallest fellow are compared with it at
  once: those linked are one family, and pairs inside it are skipped;
* a set within RADIUS of its family's first set doesn't search for itself.  Only the
  first set probes the index, under a bound loosened by the radius; by the triangle
  inequality its answers hold those of all the sets around it.  If the first sets of
  two families are linked, so are the families; only where they are close but not
  linked do the sets around them search on their own, among each other;
* overlaps of a family's sets with a third set are derived from the first one
  computed, by the few shingles in which the sets differ.

The rest are found by an inverted index over prefixes: shingles are put in one
global order, rare ones first, and two sets of similarity t share one of their first
n - ceil(t n) + 1.  A list is sorted by set size and position and cut into blocks
of BLOCK entries; a block is skipped as a whole if its sizes and positions allow no
pair.  The order uses an estimate of how often shingles occur, kept in a table of
2**22 counters (16 MB at any input size); any estimate gives right results.

Shingles are 64-bit hashes: two different ones of two compared sets of 10,000 agree
with a chance of 10**-11.  Sets count as equal by 128 bits.

Defined results: null and empty texts have no shingles, are linked with nothing
and are their own class; texts of one to four words have one shingle, the whole
sequence; rows without an id have no class (null); rows with the same id are one
document, so their texts' links are that document's; ids are whole numbers (TypeError
otherwise); a very long text is one row and its set must fit a task; other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm.blocks import longs
from memengine.llm.common import integral, only, saved, table, written
from memengine.llm.components import components
from memengine.llm.textops import LOWER, Words, give_back, grams, mix, pieces, utf8

SHINGLE = 5
PERCENT = 80
LOG2_COUNTERS = 22
#: A shingle counts towards the estimate where a task meets it so often within _FLUSH of them.
FREQUENT = 2
MINIMA = 4
#: Per cent of distance up to which a set leaves the search to its family's first set.
RADIUS = 5
#: Entries of a list that are skipped together; shorter lists are scanned entry by entry.
BLOCK = 64
#: Pairs of one set that one task compares; more are dealt to several.
PAIRS_A_TASK = 256
_SALTS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, MINIMA, dtype=np.uint64)
_FLUSH = 1_500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, table=LOWER)
    hashes = words.hashes()
    whole = grams(hashes, k)
    for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield grams(hashes[a:b], b - a, salt=b - a)
        else:
            yield np.zeros(0, np.uint64)


def _sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, bool, np.ndarray, bytes]]:
    """(id, has an id, shingles, text) of batches with columns id and text."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.names.index("text")))
        ids, valid = longs(batch.column(batch.schema.names.index("id")))
        for a, b in pieces(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            for i, s in enumerate(shingle_sets(part, own, k)):
                yield int(ids[a + i]), bool(valid[a + i]), s, part[own[i] : own[i + 1]]


def _estimate(docs: DataFrame, k: int) -> np.ndarray:
    """2**22 counters of frequent shingles, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            cells, counts = (found[often] & np.uint64((1 << LOG2_COUNTERS) - 1)).astype(np.int32), counts[often]
            by = np.argsort(cells, kind="stable")
            cells, counts = cells[by], counts[by]
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])  # as many numbers as cells met, not one for each counter
            return pa.RecordBatch.from_pydict({"cell": cells[first], "n": np.add.reduceat(counts, first) if len(first) else counts})

        for _, _, s, _ in _sets_of(batches, k):
            held.append(s)
            size += len(s)
            if size > _FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()
            held = []
        give_back()

    counters = np.zeros(1 << LOG2_COUNTERS, dtype=np.int64)
    for x in docs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counters[x.column("cell").to_numpy()] = x.column("n").to_numpy()
    return np.minimum(counters, np.iinfo(np.int32).max).astype(np.int32)


def _bodies(docs: DataFrame, k: int) -> DataFrame:
    """Each document's set id, set size, minimum hashes and packed text, in buckets by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, valid, set_ids, sizes, bodies, minima = zip(*rows, strict=True)
            both = np.array(set_ids, dtype=np.uint64).view(np.int64)
            columns = {"id": pa.array(ids, pa.int64(), mask=~np.array(valid)), "set_id": pa.array(both[:, 0]), "set_id2": pa.array(both[:, 1]), "n": pa.array(sizes, pa.int64()), "body": pa.array(bodies, pa.binary())}
            lows = np.array(minima, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_pydict(columns | {f"low{j}": pa.array(lows[:, j]) for j in range(MINIMA)})

        for id_, valid, s, text in _sets_of(batches, k):
            lows = [mix(s ^ salt).min() if len(s) else 0 for salt in _SALTS]
            set_ids = [np.bitwise_xor.reduce(mix(s + np.uint64(77))), np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D)))] if len(s) else [0, 0]
            rows.append((id_, valid, set_ids, len(s), pack(text.tobytes()), lows))
            if len(rows) == 2000:
                yield out()
                rows = []
        if rows:
            yield out()
            rows = []
        give_back()

    schema = "id long, set_id long, set_id2 long, n long, body binary, " + ", ".join(f"low{j} long" for j in range(MINIMA))
    return saved(docs.mapInArrow(run, schema), "jaccard_sets", "id")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: int) -> DataFrame:
    """(a, b, family, common, union) of the pairs (a, b, family: a's) whose similarity is at least `least` per cent.

    A set of many pairs comes to several tasks, with its text."""
    parts = pairs.groupBy("a").agg(F.floor(F.count("*") / PAIRS_A_TASK).cast("int").alias("last"))
    pairs = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int")).drop("last")
    left = texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    right = texts.select(F.col("id").alias("b"), F.col("body").alias("body_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kept: dict[bytes, np.ndarray] = {}
        changes: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        base = None  # (b and its text, family, a's text, a's set, overlap with b's) that others of the family are derived from

        def shingles(body: bytes) -> np.ndarray:
            if body not in kept:
                if len(kept) > 200:
                    kept.clear()
                raw = np.frombuffer(unpack(body), dtype=np.uint8)
                kept[body] = next(shingle_sets(raw, np.array([0, len(raw)]), k))
            return kept[body]

        def overlap(x: np.ndarray, y: np.ndarray) -> int:
            if len(x) > len(y):
                x, y = y, x
            if not len(x):
                return 0
            return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            good, shared, union = [], [], []
            for b, family, a_text, b_text in zip(col["b"].to_pylist(), col["family"].to_pylist(), col["body_a"].to_pylist(), col["body_b"].to_pylist(), strict=True):
                y, x, a = shingles(b_text), shingles(a_text), a_text
                if base and base[:2] == ((b, b_text), family) and base[2] != a:
                    if (base[2], a) not in changes:
                        if len(changes) > 2000:
                            changes.clear()
                        changes[base[2], a] = np.setdiff1d(base[3], x, assume_unique=True), np.setdiff1d(x, base[3], assume_unique=True)
                    less, more = changes[base[2], a]
                    common = base[4] - overlap(less, y) + overlap(more, y)
                else:
                    common = overlap(x, y)
                    base = (b, b_text), family, a, x, common
                shared.append(common)
                union.append(len(x) + len(y) - common)
                good.append(100 * common >= least * union[-1])
            found = {n: col[n] for n in ("a", "b", "family")} | {"common": pa.array(shared, pa.int64()), "union": pa.array(union, pa.int64())}
            yield pa.RecordBatch.from_pydict({n: c.filter(pa.array(good, pa.bool_())) for n, c in found.items()})
        kept.clear()
        changes.clear()
        give_back()

    rows = pairs.join(left, ["a", "part"]).join(right, "b").sortWithinPartitions("b", "family", "a")
    return rows.select("a", "b", "family", "body_a", "body_b").mapInArrow(run, "a long, b long, family long, common long, union long")


def _candidates(entries: DataFrame) -> DataFrame:
    """Pairs of sets of different families that meet in a list and pass the size and position bounds.

    entries: (token, id, family, n, at: the token's position, loose: per cent that the set's bound is lowered by)."""

    def within(n_x: np.ndarray, p_x: np.ndarray, l_x: np.ndarray, n_y: np.ndarray, p_y: np.ndarray, l_y: np.ndarray) -> np.ndarray:
        """The bounds for the similarity that the pair must have; p are the positions of the shared shingle."""
        percent = PERCENT - l_x - l_y
        least = -(-percent * (n_x + n_y) // (100 + percent))
        return (100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)) & (1 + np.minimum(n_x - p_x - 1, n_y - p_y - 1) >= least)

    def short(t: np.ndarray, s: np.ndarray, f: np.ndarray, n: np.ndarray, p: np.ndarray, l: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows against those a fixed number of rows further on, as far as lists reach."""
        at, lag = np.arange(len(t)), 1
        while True:
            at = at[at + lag < len(t)]
            at = at[(t[at + lag] == t[at]) & (100 * n[at] >= (PERCENT - 2 * RADIUS) * n[at + lag])]  # sizes only grow: the scan of this row ends
            if not len(at):
                return
            ok = at[(f[at] != f[at + lag]) & within(n[at], p[at], l[at], n[at + lag], p[at + lag], l[at + lag])]
            if len(ok):
                yield s[ok], s[ok + lag], f[ok], f[ok + lag]
            lag += 1

    def long(s: np.ndarray, f: np.ndarray, n: np.ndarray, p: np.ndarray, l: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """One list by blocks.  Most entries may be of one family: those are met by the others', not by each other."""
        families, counts = np.unique(f, return_counts=True)
        if len(families) == 1:
            return
        main = families[counts.argmax()]
        begin = np.arange(0, len(s), BLOCK)
        ends = np.append(begin[1:], len(s))
        low_n, high_n, low_p, high_l = n[begin], n[ends - 1], np.minimum.reduceat(p, begin), np.maximum.reduceat(l, begin)
        others = np.flatnonzero(f != main)
        for c in range(0, len(others), BLOCK):
            i = others[c : c + BLOCK]
            # The best that a pair of an entry here and one of a block could be: if that isn't enough, the block is skipped.
            percent = PERCENT - l[i].max() - high_l
            sizes = (100 * n[i].max() >= percent * low_n) & (100 * high_n >= percent * n[i].min())
            least = -(-percent * (n[i].min() + low_n) // (100 + percent))
            reach = 1 + np.minimum((n[i] - p[i] - 1).max(), high_n - low_p - 1) >= least
            blocks = np.flatnonzero(sizes & reach)
            if not len(blocks):
                continue
            j = np.concatenate([np.arange(begin[x], ends[x]) for x in blocks.tolist()])
            x, y = i[:, None], j[None, :]
            ok = (f[x] != f[y]) & ((f[y] == main) | (y > x)) & within(n[x], p[x], l[x], n[y], p[y], l[y])
            x, y = np.nonzero(ok)
            if len(x):
                x, y = i[x], j[y]
                yield s[x], s[y], f[x], f[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            t = rows[0]
            cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            sizes = np.diff(np.append(cut, len(t)))
            small = np.repeat((sizes > 1) & (sizes <= BLOCK), sizes)
            found = list(short(*[x[small] for x in rows]))
            for c, z in zip(cut[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True):
                found += long(*[x[c : c + z] for x in rows[1:]])
            if found:
                a, b, fa, fb = (np.concatenate(x) for x in zip(*found, strict=True))
                turn = a > b
                a, b, fa, fb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, fb, fa), np.where(turn, fa, fb)
                _, first = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
                yield pa.RecordBatch.from_pydict({"a": a[first], "b": b[first], "family": fa[first]})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(batch.schema.names.index(c)).to_numpy() for c in ("token", "id", "family", "n", "at", "loose")]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from pairs([x[:last] for x in rows])
            carry = [x[last:].copy() for x in rows]
        if carry is not None:
            yield from pairs(carry)
            carry = None
        give_back()

    ordered = entries.repartition("token").sortWithinPartitions("token", "n", "at")
    return ordered.mapInArrow(run, "a long, b long, family long").groupBy("a", "b").agg(F.min("family").alias("family"))


def _entries(rows: DataFrame, order, k: int) -> DataFrame:
    """The index entries of rows (id, family, loose, body): each set's prefix for PERCENT less its own loosening and its partner's, at most RADIUS."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = order.value
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for id_, family, loose, most, body in zip(*[col[c].to_pylist() for c in ("id", "family", "loose", "partner")], col["body"], strict=True):
                raw = np.frombuffer(unpack(body.as_py()), dtype=np.uint8)
                s = next(shingle_sets(raw, np.array([0, len(raw)]), k))
                size = len(s) - -(-(PERCENT - loose - most) * len(s) // 100) + 1
                rare = np.lexsort((s, weights[(s & np.uint64((1 << LOG2_COUNTERS) - 1)).astype(np.int64)]))[:size]
                out.append((s[rare].view(np.int64), np.full(size, id_), np.full(size, family), np.full(size, len(s)), np.arange(size), np.full(size, loose)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("token", "id", "family", "n", "at", "loose"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))
        give_back()

    return rows.select("id", "family", "loose", "partner", "body").mapInArrow(prefixes, "token long, id long, family long, n long, at long, loose long")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of docs."""
    integral(docs, id_col)
    spark = docs.sparkSession
    docs = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    order = spark.sparkContext.broadcast(_estimate(docs, k))
    bodies = _bodies(docs, k)
    some = bodies.where("n > 0 AND id IS NOT NULL")
    lows = [f"low{j}" for j in range(MINIMA)]
    # One row for each distinct set: its smallest document stands for it.
    sets = written(some.groupBy("set_id", "set_id2").agg(F.min("id").alias("id"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in lows]), "sets")
    texts = some.select("id", "body").join(sets.select("id"), "id", "left_semi")

    # Families: sets that share a minimum hash with their smallest fellow and are linked with it.
    keys = sets.select("id", F.posexplode(F.array(*lows)).alias("j", "low"))
    leaders = keys.groupBy("j", "low").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    near = keys.join(leaders, ["j", "low"]).where("id <> a").select("a", F.col("id").alias("b"), F.col("a").alias("family")).distinct()
    stars = written(_verified(near, texts, k, PERCENT), "stars")
    families = components(stars)

    # Sets within RADIUS of a set that isn't itself so near to another leave the search to it.
    close = stars.where(f"100 * common >= {100 - RADIUS} * union").select("a", "b")
    roots = close.select("a").distinct().join(close.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    around = written(close.join(roots, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first")), "around")
    first = around.select(F.col("first").alias("id")).distinct().withColumn("loose", F.lit(RADIUS).cast("long"))
    named = texts.join(families.select(F.col("vertex").alias("id"), F.col("component").alias("family")), "id", "left").withColumn("family", F.coalesce("family", "id"))
    searching = named.join(around.select("id"), "id", "left_anti").join(first, "id", "left").withColumn("loose", F.coalesce("loose", F.lit(0).cast("long")))
    # A partner's loosening counts only if there is any.
    partner = F.lit(0 if around.isEmpty() else RADIUS).cast("long")
    met = written(_candidates(_entries(searching.withColumn("partner", partner), order, k)), "candidates")
    judged = written(_verified(met, texts, k, PERCENT - 2 * RADIUS), "judged")
    linked = F.col("common") * 100 >= F.col("union") * PERCENT
    links = judged.where(linked).select("a", "b").union(stars.select("a", "b"))

    # Families whose first sets are close but not linked: all their sets search among each other.
    loose_pairs = judged.where(~linked).join(first.select(F.col("id").alias("a"), F.col("loose").alias("loose_a")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("loose").alias("loose_b")), "b", "left")
    loose_pairs = loose_pairs.where(F.col("common") * 100 >= F.col("union") * (PERCENT - F.coalesce("loose_a", F.lit(0)) - F.coalesce("loose_b", F.lit(0)))).where("loose_a IS NOT NULL OR loose_b IS NOT NULL")
    unsure = written(loose_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "unsure")
    if not unsure.isEmpty():
        again = unsure.union(around.join(unsure.withColumnRenamed("id", "first"), "first", "left_semi").select("id")).distinct()
        rows = named.join(again, "id", "left_semi").withColumns({"loose": F.lit(0).cast("long"), "partner": F.lit(0).cast("long")})
        links = links.union(_verified(written(_candidates(_entries(rows, order, k)), "candidates"), texts, k, PERCENT).select("a", "b"))
    classes = components(links)
    found = sets.select("set_id", "set_id2", "id").join(classes.withColumnRenamed("vertex", "id"), "id", "left").select("set_id", "set_id2", F.coalesce("component", "id").alias("component"))
    empty = F.col("n") > 0
    out = bodies.select("id", F.when(empty, F.col("set_id")).alias("set_id"), F.when(empty, F.col("set_id2")).alias("set_id2"), "n").join(found, ["set_id", "set_id2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))
