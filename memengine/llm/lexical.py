"""Ranked lexical search by sort-based accumulation: a stated set of items against all documents.

Terms are longest runs of ASCII letters, digits and all that is beyond ASCII, with A-Z lower-cased.

1. One pass over the texts keeps, of each document with a term, its length and
   the (term, occurrences) of those terms that an item holds.  This thin table is
   written; document counts, lengths and document frequencies come from it.
2. It is dealt by ranges of document ids.  A task looks up each (document,
   term) in the items' lists, concatenates the matched arrays of item, document and
   impact, radix-sorts them by the packed key of item and document, and adds up equal
   keys with reduceat.  As a document lies in one range, no sum is split.
3. Each item keeps a heap of its k best documents in a task; a score that can't enter it
   leaves at once.  The tasks' heaps meet in two steps, by groups of tasks and then all.

Items are taken in blocks of at most BLOCK_BYTES of text and BLOCK_ITEMS rows on average (by hash), so what
is broadcast is a block's lists, whatever the number of items; each block reads the
texts once.  Nothing is dealt by term or item, so a common term or a large item makes no hot key.

With N documents that have a term, L their terms with repeats, n those of one
document, df the documents holding a term and tf its occurrences in one:
w = floor(1000 ln((2N + 2) / (2df + 1))) in doubles; m = 100 - 75 + (75 n N) div L;
a term adds w ((10^9 tf) div (1000 tf + 8m)) for each time the item holds it.
All but w are 64-bit integers.

Defined results: null and empty texts, and those without a term, are no documents
and match nothing; such items have no rows.  Each row is a document, and each row an
item, also where ids repeat or are null; equal scores come by ascending id, a
null first.  Only scores above 0 are returned.  Empty tables give an empty result; other
columns are not read.  Terms are compared by 64 bits of their bytes' hash.  A very long text is
one row of a task with its words' hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.llm.blocks import to_arrow_schema
from memengine.llm.common import forget, integral, only, table, written
from memengine.llm.textops import LOWER, Words, give_back, pieces, utf8

BEST = 10
#: Bytes of item text, and items, of a block.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 1 << 14
#: Matched (item, document, impact) entries sorted at once; a single document's may be more.
ENTRIES = 1 << 19
#: Documents numbered within one sort: their number is one 16-bit digit of the packed key.
PLACES = 1 << 16
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
POSTINGS = "row long, id long, n long, terms array<int>, counts array<int>"


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, one 16-bit digit after another; digits already in order cost no pass."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, offsets by row)."""
    words = Words(*utf8(column), separator=SEPARATOR, table=LOWER)
    return words.hashes(), words.of


class Items:
    """A block's items: for each term its items and how often they hold it."""

    def __init__(self, texts: list[str | None]):
        hashes, of = _terms(pa.array([t or "" for t in texts], pa.large_string()))
        item = np.repeat(np.arange(len(texts)), np.diff(of))
        self.terms, term = np.unique(hashes, return_inverse=True)
        pair, count = np.unique(term.astype(np.int64) << 32 | item, return_counts=True)
        self.start = np.searchsorted(pair >> 32, np.arange(len(self.terms) + 1))
        self.item, self.repeats = (pair & 0xFFFFFFFF).astype(np.int64), count.astype(np.int64)
        #: first look: most words of a text are no item's, and this table fits the cache
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes that are terms, their numbers)."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        hit = self.terms[spot] == hashes[at]
        return at[hit], spot[hit]


def _postings(docs: DataFrame, items: Items) -> DataFrame:
    """POSTINGS of docs (id, text): row numbers the documents for good, as the table is written."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = to_arrow_schema(docs.sparkSession.createDataFrame([], POSTINGS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, own = TaskContext.get().partitionId() << 33, sent.value
        for batch in batches:
            texts, ids = batch.column(batch.schema.names.index("text")), batch.column(batch.schema.names.index("id"))
            for a, b in pieces(utf8(texts)[1]):
                hashes, of = _terms(texts.slice(a, b - a))
                n = np.diff(of)
                at, term = own.find(hashes)
                pair, count = np.unique((np.searchsorted(of, at, side="right") - 1) << 32 | term, return_counts=True)
                has = np.flatnonzero(n)
                cuts = np.searchsorted(pair >> 32, np.append(has, len(n)))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x.astype(np.int32))) for x in (pair & 0xFFFFFFFF, count)]
                columns = [pa.array(row + np.arange(len(has))), ids.slice(a, b - a).cast(pa.int64()).take(pa.array(has)), pa.array(n[has].astype(np.int64)), *lists]
                row += len(has)
                yield pa.RecordBatch.from_arrays(columns, schema=kind)
            give_back()

    return docs.mapInArrow(run, POSTINGS)


class _Heaps:
    """The k best (score, least id first) of each item; documents come in the order of ids."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, place: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Scores of documents for items; place is the document's number in the task, which grows, and known tells ids from nulls."""
        good = np.flatnonzero(score > self.least[item])  # an equal score of a later document isn't better
        good = good[np.lexsort((place[good], -score[good], item[good]))]
        good = good[np.arange(len(good)) - np.searchsorted(item[good], item[good]) < self.k]
        for i, s, p, d, has in zip(*(x[good].tolist() for x in (item, score, place, ids, known)), strict=True):
            heap, entry = self.heaps[i], (s, -p, d if has else None)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _accumulated(postings: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score, task): each task's k best of each item."""
    sent = postings.sparkSession.sparkContext.broadcast((items, weight))
    schema = "item int, id long, score long, task int"
    kind = to_arrow_schema(postings.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, w = sent.value
        width = np.diff(own.start)
        heaps, before = _Heaps(int(own.item.max()) + 1 if len(own.item) else 0, k), 0
        for batch in batches:
            terms, counts = (batch.column(batch.schema.names.index(c)) for c in ("terms", "counts"))
            of = np.asarray(terms.offsets, dtype=np.int64) - terms.offsets[0].as_py() if len(terms) else np.zeros(1, dtype=np.int64)
            term, tf = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n = batch.column(batch.schema.names.index("id")), batch.column(batch.schema.names.index("n")).to_numpy(zero_copy_only=False)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            entry = np.append(0, np.cumsum(width[term]))[of]
            a = 0
            while a < len(n):
                b = min(max(a + 1, int(np.searchsorted(entry, entry[a] + ENTRIES, side="right")) - 1), a + PLACES, len(n))
                x, y = of[a], of[b]
                doc = np.repeat(np.arange(b - a), np.diff(of[a : b + 1]))
                impact = w[term[x:y]] * ((1_000_000_000 * tf[x:y]) // (1000 * tf[x:y] + 8 * m[a:b][doc]))
                size = width[term[x:y]]
                at = np.repeat(own.start[term[x:y]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                keys = (own.item[at] << 16 | np.repeat(doc, size)).astype(np.uint64)
                order = radix_order(keys)
                keys = keys[order]
                if len(keys):
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    score = np.add.reduceat((np.repeat(impact, size) * own.repeats[at])[order], first)
                    keys = keys[first].astype(np.int64)
                    item, at = keys >> 16, a + (keys & 0xFFFF)
                    heaps.add(item, score, before + at, ids[at], known[at])
                a = b
            before += len(n)
        out = [(i, d, s) for i, heap in enumerate(heaps.heaps) for s, _, d in heap]
        task = TaskContext.get().partitionId()
        columns = [[x[c] for x in out] for c in range(3)] + [[task] * len(out)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return postings.mapInArrow(run, schema)


def _best(found: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, items: list, k: int, id_type: str) -> DataFrame | None:
    """The result for one block of items, written, or None if no document has a term."""
    spark, block = docs.sparkSession, Items([r["text"] for r in items])
    if not len(block.terms):
        return None
    postings = written(_postings(docs, block), "postings")
    total = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    weight = np.zeros(len(block.terms), dtype=np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = postings.repartitionByRange(tasks, "id", "row").sortWithinPartitions("id", "row")
    found = _accumulated(ranges, block, weight, total["docs"], total["terms"], k)
    found = _best(found.withColumn("group", F.floor(F.col("task") / math.isqrt(tasks))), ["item", "group"], k)
    names = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {id_type}"))
    out = written(_best(found, ["item"], k).join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked")
    forget(postings)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank int, doc_id, score long): the k documents that score highest for each item."""
    integral(docs, doc_id)
    docs, items = only(docs, id=doc_id, text=doc_text), only(items, item_id=item_id, text=item_text)
    size = items.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil((size["bytes"] or 0) / BLOCK_BYTES), math.ceil(size["rows"] / BLOCK_ITEMS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)))
    id_type = items.schema["item_id"].dataType.simpleString()
    parts = [_searched(docs, dealt.where(F.col("block") == b).select("item_id", "text").collect(), k, id_type) for b in range(blocks)]
    kept = [p for p in parts if p is not None]
    if not kept:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    out = kept[0]
    for p in kept[1:]:
        out = out.union(p)
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH words AS (SELECT row, doc_id, unnest({_TERMS}) AS term FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
 tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY row, doc_id, term),
 lengths AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
 total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
 asked AS (SELECT item, item_id, term, count(*) AS repeats FROM (SELECT item, item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark)) GROUP BY item, item_id, term),
 df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
 weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
 scores AS (SELECT item, item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM tf JOIN asked USING (term) JOIN weights USING (term) JOIN lengths USING (row), total GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= {BEST}"""
