"""Threads, alerts and limits: pairing, resume, overlaps, packing of checkpoints, cooldowns, fixed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stride_pairs(turns: DataFrame, least_chars: int = 20) -> DataFrame:
    """(conv_id, pair, human, reply): turns two by two, swapped where the assistant comes first; short human texts are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = turns.where("role IN ('user', 'assistant')").withColumn("p", F.row_number().over(w) - 1)
    x = x.groupBy("conv_id", F.floor(F.col("p") / 2).alias("pair")).agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("human"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("reply"), F.count("*").alias("n"))
    return x.where((F.col("n") == 2) & (F.char_length("human") >= least_chars) & F.col("reply").isNotNull()).drop("n")


def worth_keeping(pairs: DataFrame) -> DataFrame:
    """Pairs (human, reply) that aren't both short (15 and 30 characters); heartbeats and replies that say nothing go."""
    short = (F.char_length("human") < 15) & (F.char_length("reply") < 30)
    return pairs.where(~short & ~F.col("human").contains("HEARTBEAT") & ~F.col("reply").contains("NO_REPLY"))


def overlapping(ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """(thread, asked_from, first): asked turn ranges (thread, asked_from, asked_to) and the first stored range (from, to) that overlaps them.

    Stretches of 64 turns make it an equi-join: two ranges that overlap share one."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 64), F.floor(F.col(b) / 64)))
    left, right = asked.withColumn("cell", cells("asked_from", "asked_to")), ranges.withColumn("cell", cells("from", "to"))
    met = left.join(right, ["thread", "cell"]).where((F.col("asked_from") <= F.col("to")) & (F.col("from") <= F.col("asked_to")))
    return met.groupBy("thread", "asked_from").agg(F.min("from").alias("first"))


def prior_thread(threads: DataFrame) -> DataFrame:
    """(owner, thread, prior): for each thread (owner, thread, last_seen) the same owner's latest other one.

    Only the owner's latest two matter, so nothing is ordered but those."""
    last = threads.groupBy("owner").agg(F.max(F.struct("last_seen", "thread")).alias("first"))
    rest = threads.join(last, "owner").where(F.col("thread") != F.col("first.thread")).groupBy("owner").agg(F.max(F.struct("last_seen", "thread")).alias("second"))
    both = threads.join(last, "owner", "left").join(rest, "owner", "left")
    return both.select("owner", "thread", F.when(F.col("thread") != F.col("first.thread"), F.col("first.thread")).otherwise(F.col("second.thread")).alias("prior"))


def resumed(checkpoints: DataFrame, budget: int, most: int) -> DataFrame:
    """Checkpoints (thread, seq, tokens, preserved) to resume with.

    Preserved ones come first, whatever they take; of the others, in order, each that still fits is taken, and one that doesn't is skipped.
    No more than `most` stay.  What is taken depends on what was taken before, so a thread's checkpoints (some tens) are folded in order."""
    order = F.array_sort(F.collect_list(F.struct((~F.col("preserved")).alias("later"), "seq", "tokens")))
    kind = "struct<used:bigint,taken:array<struct<later:boolean,seq:bigint,tokens:bigint>>>"
    fits = lambda a, x: ~x["later"] | ((a["used"] + x["tokens"] <= budget) & (F.size(a["taken"]) < most))
    add = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["tokens"]).alias("used"), F.array_append(a["taken"], x).alias("taken"))).otherwise(a)
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<later:boolean,seq:bigint,tokens:bigint>>").alias("taken")).cast(kind)
    rows = checkpoints.withColumns({"seq": F.col("seq").cast("bigint"), "tokens": F.col("tokens").cast("bigint")})
    out = rows.groupBy("thread").agg(F.slice(F.aggregate(order, start, add)["taken"], 1, most).alias("taken")).select("thread", F.explode("taken").alias("x"))
    return out.select("thread", "x.seq", "x.tokens", (~F.col("x.later")).alias("preserved"))


def cooled(alerts: DataFrame, seconds: int) -> DataFrame:
    """Alerts (key, at) that are sent: one is held back within the cooldown after the last one sent.

    The next alert to send depends on the last one sent, so a key's alerts are folded in order; they are few, as each is a breach."""
    order = F.array_sort(F.collect_list(F.unix_seconds(F.col("at").cast("timestamp"))))
    none = F.array().cast("array<bigint>")
    sent = F.aggregate(order, none, lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= seconds), F.array_append(s, t)).otherwise(s))
    return alerts.groupBy("key").agg(sent.alias("sent")).select("key", F.explode("sent").alias("at_seconds"))


def first_hit_windows(hits: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(key, start, n, refused): windows that begin with the first hit after the last one ended (a counter that expires), and the hits beyond the limit."""
    order = F.array_sort(F.collect_list(F.unix_seconds(F.col("at").cast("timestamp"))))
    kind = "array<struct<start:bigint,n:bigint>>"
    step = lambda s, t: F.when(
        (F.size(s) == 0) | (t - F.element_at(s, -1)["start"] >= seconds), F.array_append(s, F.struct(t.alias("start"), F.lit(1).cast("bigint").alias("n")))
    ).otherwise(F.array_append(F.slice(s, 1, F.size(s) - 1), F.struct(F.element_at(s, -1)["start"].alias("start"), (F.element_at(s, -1)["n"] + 1).alias("n"))))
    out = hits.groupBy("key").agg(F.aggregate(order, F.array().cast(kind), step).alias("w")).select("key", F.explode("w").alias("w"))
    return out.select("key", "w.start", "w.n", F.greatest(F.col("w.n") - limit, F.lit(0)).alias("refused"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("r") <= n).drop("r")
