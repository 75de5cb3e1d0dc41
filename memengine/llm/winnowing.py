"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of up to eight characters without white space, case folded; a
longer run has a token of eight characters at each of its positions, so that
unspaced text shares tokens wherever its characters agree.
Every five consecutive tokens (k) have a polynomial (rolling) hash modulo the
prime 2**31 - 1.  It is put together from those of fewer tokens by doubling: the
hash of 2w tokens at a place is that of w tokens there, moved up, plus that of the
w behind them, so neighbours share their parts and no k-gram is hashed anew.
Of every four consecutive hashes
(w) the smallest is chosen, of equal ones the rightmost, and its position is
kept.  Two texts that share w + k - 1 = 8 consecutive tokens share a chosen
hash; within one long run these are 15 characters.  A text with fewer than k tokens has one hash, of all its tokens; one with
fewer hashes than w has one window.

Hash and position share one number, hash first and positions counted down, so
the least of a window is the smallest hash at its rightmost place.  The minima
over w hashes are taken in two steps of pairs.  All of a text's work stays in one
row: no explode and no shuffle.

Defined results: null and empty texts, and those of white space only, have no
tokens and an empty fingerprint; two empty fingerprints are alike (1), one empty
and one not are unlike (0).  A very long text is one row and its tokens must fit a task.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.llm.common import only, table, written

K = 5
#: A power of two: minima are taken by doubling.
W = 4
GAP = r"[\x20\x09-\x0D]+"
LONG = 8
#: One character, and ahead of it, as a group, the token that begins there.
AHEAD = rf"(?s)(?=(.{{{LONG}}}))."
PRIME, BASE = (1 << 31) - 1, 1_000_003
_PLACES = 1 << 31


def _code(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PRIME))


def _codes(text: Column) -> Column:
    """A number below PRIME for each token."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), GAP)
    within = lambda run: F.transform(F.regexp_extract_all(run, F.lit(AHEAD), F.lit(1)), _code)
    return F.flatten(F.transform(runs, lambda run: F.when(run == "", F.array().cast("array<bigint>")).when(F.char_length(run) <= LONG, F.array(_code(run))).otherwise(within(run))))


def _followed(hashes: Column, tokens: int, more: Column, width: int) -> Column:
    """Hashes of tokens + width tokens, from those of `tokens` and, that many places on, those of `width`."""
    n = F.greatest(F.size(more) - tokens, F.lit(0))
    up = pow(BASE, width, PRIME)
    return F.zip_with(F.slice(hashes, 1, n), F.slice(more, tokens + 1, n), lambda x, y: (x * up + y) % PRIME)


def _grams(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """Hashes of k consecutive codes instead of the codes in these columns (one of all, if there are fewer)."""
    ones = {m: f"{m}_codes" for m in names}
    df = df.withColumns({one: F.col(m) for m, one in ones.items()})
    done, width, part = 0, 1, ones  # width: tokens in the hashes of `part`; done: tokens in those of the result so far
    kept = {}
    while width <= k:
        if k & width:
            if done:
                kept_now, n = dict(kept), done
                df = df.withColumns({f"{m}_{width}_kept": _followed(F.col(part[m]), width, F.col(kept_now[m]), n) for m in names})
                kept = {m: f"{m}_{width}_kept" for m in names}
            else:
                kept = part
            done += width
        if 2 * width <= k:
            df = df.withColumns({f"{m}_{2 * width}": _followed(F.col(part[m]), width, F.col(part[m]), width) for m in names})
            part = {m: f"{m}_{2 * width}" for m in names}
        width *= 2
    whole = lambda c: F.when(F.size(c) > 0, F.array(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: (s * BASE + x) % PRIME))).otherwise(c)
    df = df.withColumns({m: F.when(F.size(ones[m]) >= k, F.col(kept[m])).otherwise(whole(F.col(ones[m]))) for m in names})
    return df.drop(*[c for c in df.columns if any(c.startswith(f"{m}_") and c.removeprefix(f"{m}_").removesuffix("_kept").replace("codes", "0").isdigit() for m in names)])


def _packed(hashed: Column) -> Column:
    return F.transform(hashed, lambda h, i: h * _PLACES + (_PLACES - 1 - i))


def _doubled(least: Column, width: int) -> Column:
    """Minima over twice the width; with fewer than two minima that far apart, the least of all there are."""
    n = F.size(least)
    far = F.slice(least, width + 1, F.greatest(n - width, F.lit(0)))
    wide = F.zip_with(F.slice(least, 1, F.greatest(n - width, F.lit(0))), far, lambda x, y: F.least(x, y))
    return F.when(n > width, wide).when(n > 0, F.array(F.array_min(least))).otherwise(least)


def _marks(least: Column) -> Column:
    return F.transform(F.array_distinct(least), lambda v: F.struct(F.shiftright(v, 31).cast("int").alias("hash"), (_PLACES - 1 - v.bitwiseAND(F.lit(_PLACES - 1))).cast("int").alias("position")))


def with_marks(df: DataFrame, texts: dict[str, str], k: int = K, w: int = W) -> DataFrame:
    """df with, for each new column name: text column, the array of its chosen (hash, position), in order of position.

    Each step is a column of its own, so that an array is made once and not again wherever a function looks into it."""
    df = df.withColumns({m: _codes(F.col(t)) for m, t in texts.items()})
    df = _grams(df, list(texts), k)
    df = df.withColumns({m: _packed(F.col(m)) for m in texts})
    width = 1
    while width < w:
        df = df.withColumns({m: _doubled(F.col(m), width) for m in texts})
        width *= 2
    return df.withColumns({m: _marks(F.col(m)) for m in texts})


def fingerprint(marks: Column) -> Column:
    """The chosen hashes as text, in order of position."""
    return F.array_join(F.transform(marks["hash"], lambda h: F.hex(h.cast("long"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with marks, an array of (hash, position), and fingerprint."""
    return with_marks(docs, {"marks": f"`{text_col}`"}, k, w).withColumn("fingerprint", fingerprint(F.col("marks")))


def edited(text: Column, other: Column) -> Column:
    """text with its last half of code points (rounded down) replaced by as many of other's first, or all of them."""
    text, other = F.coalesce(text, F.lit("")), F.coalesce(other, F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


#: Ids in a range, about, and the most ranges.
RANGE_IDS, MOST_RANGES = 10_000, 100_000


def successors(docs: DataFrame) -> DataFrame:
    """(id, next): each id and the next smaller one, the largest after the smallest.

    Ids are dealt to ranges of about equal numbers (bounds sampled by Spark), which a
    written table keeps; a window runs within each, and one row a range tells the
    last id of the range before."""
    ids = docs.select("id").where("id IS NOT NULL").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("next", F.col("id"))
    dealt = written(ids.repartitionByRange(max(1, min(n // RANGE_IDS, MOST_RANGES)), "id").withColumn("cell", F.spark_partition_id()), "ids")
    inside = dealt.withColumn("next", F.max("id").over(Window.partitionBy("cell").orderBy("id").rowsBetween(-1, -1)))
    # At most MOST_RANGES rows: the largest id of each range and of those below it.
    tops = dealt.groupBy("cell").agg(F.max("id").alias("top"))
    below = tops.select("cell", F.max("top").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("below"))
    return inside.join(below, "cell").select("id", F.coalesce("next", "below", F.lit(dealt.agg(F.max("id")).first()[0])).alias("next"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like they and the next document's are.

    Rows without an id have no next document (an empty text); of rows with the
    same id the smallest text is the next document of the one before."""
    rows = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = rows.where("id IS NOT NULL")
    follow = successors(rows)
    # The texts are dealt out by id once for both joins, and a second time under the id of the document before.
    other = known.join(follow.select(F.col("next").alias("id"), F.col("id").alias("before")), "id").select("before", F.col("text").alias("other"))
    if known.count() != follow.count():
        other = other.groupBy("before").agg(F.min("other").alias("other"))
    after = known.join(other, F.col("id") == F.col("before")).select("id", "text", "other")
    after = after.union(rows.where("id IS NULL").select("id", "text", F.lit("")))
    after = after.withColumn("changed", edited(F.col("text"), F.col("other")))
    marked = with_marks(after.select("id", "text", "changed", "other"), {"marks": "text", "edited_marks": "changed", "other_marks": "other"})
    marked = marked.withColumns({"own": F.array_distinct(F.col("marks")["hash"]), "new": F.array_distinct(F.col("edited_marks")["hash"]), "far": F.array_distinct(F.col("other_marks")["hash"])})
    return marked.select(
        F.col("id").alias(id_col),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("far")).alias("near_next"),
        F.col("marks")["position"].alias("positions"),
    )


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
