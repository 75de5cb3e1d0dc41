"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of 13 words (a shorter item is one window).  A
window occurs in a document only if all its shingles do, so one necessary
shingle is enough to find it: the rarest.  A window's shingles are its words; document
frequencies over all documents order them, the rarest comes first, and ties go
to the smaller word.

1. The words of all documents are counted where they are words of items.
2. Each distinct window gives one row: its rarest word, the word's place, its
   length and its words.  The join that ranks a window's words is dealt in SALTS
   parts, as frequent words stand in many windows.
3. Documents' words are joined with those rows on the word.  Position and length
   bounds (the window must lie inside the document) drop matches, and
   comparing the slice of the document with the window's words verifies the
   rest exactly.
4. Occurrences that overlap are united by a running maximum over each
   document's occurrences, which gives the words that are hit.

The items' tables are broadcast while their measured bytes lie below a bound.
Beyond it only (document, place, word) rows are joined by a shuffle, in SALTS
parts, and the candidates meet their document's words by its id afterwards; both
ways give the same rows.

Words are runs of letters, digits and characters beyond ASCII; A-Z are lowered.

Defined results: a null or empty text has no words and no hits; an empty
benchmark hits nothing; items without words are ignored; a null item id isn't
counted among the items, but its windows hit; repeated items count once by id;
rows of documents with the same id are each judged by their own words (print is the text's
hash); a very long text is one row and its words must fit a task; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.llm.common import only, table, written

WINDOW = 13
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
SALTS = 16
CONTAMINATED = 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(ws, items): the distinct windows of items (id, text) and the ids of those that hold them."""
    own = items.select("id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    each = own.select("id", "all", F.explode(starts).alias("from")).select("id", F.slice("all", F.col("from"), size).alias("ws"))
    return each.groupBy("ws").agg(F.sort_array(F.collect_set("id")).alias("items"))


def _salted(df: DataFrame) -> DataFrame:
    """Each row once for each of the SALTS parts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _spots(texts: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """(id, print, ws, at and a window's key row) wherever a document has a window's key word."""
    if small:
        return texts.select("id", "print", "ws", F.posexplode("ws").alias("at", "key")).join(F.broadcast(keys), "key")
    thin = texts.select("id", "print", F.posexplode("ws").alias("at", "key")).withColumn("salt", _salt("id", "print", "at"))
    met = thin.join(_salted(keys), ["key", "salt"]).where("at >= place").drop("salt", "key").withColumnsRenamed({"id": "spot_id", "print": "spot_print"}).distinct()
    return met.join(texts.dropDuplicates(["id", "print"]), F.col("spot_id").eqNullSafe(F.col("id")) & F.col("spot_print").eqNullSafe(F.col("print")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, share: int = CONTAMINATED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id_col, print, n_words, n_hit, n_items, items, contaminated) for each row of docs; items is the sorted array of item ids."""
    wanted = written(windows(only(items, id="item_id", text="text"), size), "windows")
    vocabulary = written(wanted.select(F.explode("ws").alias("w")).distinct(), "vocabulary")
    rows = only(docs, id=id_col, text=text_col)
    # A row's own number keeps rows of the same id apart; the hash of the text makes it the same if a task runs again.
    texts = rows.select("id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("ws"))

    each = texts.select(F.explode("ws").alias("w"))
    if (vocabulary.agg(F.sum(F.octet_length("w") + 16).alias("n")).first()["n"] or 0) <= broadcast_bytes:
        frequency = each.join(F.broadcast(vocabulary), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    else:  # counted by the tasks first
        frequency = each.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w", "left_semi")
    ranked = wanted.select("ws", "items", _salt("ws").alias("salt"), F.posexplode("ws").alias("place", "w")).join(_salted(frequency), ["w", "salt"], "left")
    # A window none of whose occurrences is possible (a word that no document has) goes with that word: it matches nothing.
    keys = ranked.groupBy("ws").agg(F.first("items").alias("items"), F.min_by(F.struct("w", "place"), F.struct(F.coalesce("n", F.lit(0)), "w", "place")).alias("rarest"))
    keys = written(keys.select(F.col("rarest.w").alias("key"), F.col("rarest.place").alias("place"), F.size("ws").alias("length"), F.col("ws").alias("window"), "items"), "window_keys")
    taken = keys.agg(F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.size("window") + 8 * F.size("items") + 64).alias("n")).first()["n"] or 0

    spots = _spots(texts, keys, taken <= broadcast_bytes)
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("length") <= F.size("ws"))
    found = spots.where(inside).where(F.slice("ws", start + 1, F.col("length")) == F.col("window"))
    found = found.select("id", "print", start.alias("from"), (start + F.col("length")).alias("to"), "items")
    # Equal rows give equal occurrences; one of each is enough for their common key.
    by_doc = Window.partitionBy("id", "print").orderBy("from", "to")
    before = F.coalesce(F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.groupBy("id", "print", "from", "to").agg(F.first("items").alias("items"))
    spans = spans.withColumn("fresh", F.greatest(F.col("to") - F.greatest(F.col("from"), before), F.lit(0)))
    hits = spans.groupBy("id", "print").agg(F.sum("fresh").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    counts = texts.select("id", "print", F.size("ws").cast("long").alias("n_words"))
    out = counts.join(hits.withColumnsRenamed({"id": "hit_id", "print": "hit_print"}), F.col("id").eqNullSafe(F.col("hit_id")) & F.col("print").eqNullSafe(F.col("hit_print")), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.sort_array(F.coalesce("items", F.array().cast(hits.schema["items"].dataType)))})
    return out.select(F.col("id").alias(id_col), "print", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS p FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g FROM i),
ks AS (SELECT DISTINCT k FROM w),
s AS (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d, ks WHERE len(ws) >= k),
o AS (SELECT s.doc_id, s.p, s.k, w.item_id FROM s JOIN w ON s.k = w.k AND array_to_string(list_slice(s.ws, s.p, s.p + s.k - 1), ' ') = w.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
