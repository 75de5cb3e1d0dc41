"""Writes as folds over logs: reinforcement, upserts, expiry, importance, quotas, retention, cascades, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the memory model.
DUPLICATE, SAME_TYPE_DUPLICATE = 0.92, 0.85
CASCADE_STRENGTH, CASCADE_NEIGHBOURS = 0.4, 10
#: Entity types, in this order: phrases of the memory around the entity's own name, or parts of the name.
PERSON_PHRASES = ("{} is a person", "{} said", "{} prefers")
ORGANIZATION_PARTS = ("inc", "corp", "llc", "ltd", "company", "academy", "university")
PROJECT_PARTS = ("project", "phase", "module")
LOCATION_PHRASES = ("in {}", "at {}", "from {}")


def duplicate_check(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, duplicate_of, similarity): of the three nearest (id, other, similarity) the first at 0.92, or at 0.85 and of the same type."""
    kind = memories.select("id", "memory_type")
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where("r <= 3")
    near = near.join(kind, "id").join(kind.select(F.col("id").alias("other"), F.col("memory_type").alias("other_type")), "other")
    hit = near.where((F.col("similarity") >= DUPLICATE) | ((F.col("similarity") >= SAME_TYPE_DUPLICATE) & (F.col("memory_type") == F.col("other_type"))))
    return hit.groupBy("id").agg(F.min_by(F.struct("other", "similarity"), "r").alias("m")).select("id", F.col("m.other").alias("duplicate_of"), F.col("m.similarity").alias("similarity"))


def reinforced(mentions: DataFrame, base: float = 0.5) -> DataFrame:
    """(id, reinforcement_count, relevance_score, last_accessed) after each mention (id, at): one more, +0.1 up to 1."""
    out = mentions.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last_accessed"))
    return out.select("id", (F.col("n") + 1).alias("reinforcement_count"), F.least(F.lit(1.0), base + 0.1 * F.col("n")).alias("relevance_score"), "last_accessed")


def cascade(edges: DataFrame, corrected: DataFrame) -> DataFrame:
    """(id, neighbour, strength): the ten strongest neighbours of corrected memories (id), flagged at strength 0.4; an edge counts from both ends.

    Of an edge (src, dst, strength) that comes more than once the greatest strength counts; it is taken of the edges at corrected memories only, where their join left them."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "strength").union(edges.select("dst", "src", "strength"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that they aren't joined into a few large ones again
    near = both.repartition(parts, "id").join(corrected.select("id").distinct(), "id").groupBy("id", "neighbour").agg(F.max("strength").alias("strength"))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("strength"), "neighbour"))).where(F.col("r") <= CASCADE_NEIGHBOURS)
    return top.where(F.col("strength") >= CASCADE_STRENGTH).drop("r")


def entity_nodes(mentions: DataFrame) -> DataFrame:
    """(entity, kind, mention_count, last_seen) after each upsert (entity, kind, at): a later kind that isn't null overwrites."""
    return mentions.groupBy("entity").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("at", "kind"))).alias("kind"), F.count("*").alias("mention_count"), F.max("at").alias("last_seen"))


def entity_kind(entity: Column, text: Column) -> Column:
    """person, organization, project, location or unknown, from the entity's name and the text of its memory."""
    name, low = F.lower(entity), F.lower(F.coalesce(text, F.lit("")))
    around = lambda phrases: reduce(lambda a, b: a | b, [F.contains(low, F.concat(F.lit(p.split("{}")[0]), name, F.lit(p.split("{}")[1]))) for p in phrases])
    within = lambda parts: reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])
    return F.when(around(PERSON_PHRASES), "person").when(within(ORGANIZATION_PARTS), "organization").when(within(PROJECT_PARTS), "project").when(around(LOCATION_PHRASES), "location").otherwise("unknown")


def relation_pairs(memories: DataFrame) -> DataFrame:
    """(id, a, b): all pairs i < j of a memory's own entities (id, entities), a few each."""
    one = memories.select("id", "entities", F.posexplode("entities").alias("i", "a"))
    return one.select("id", "a", F.explode(F.slice("entities", F.col("i") + 2, F.size("entities"))).alias("b"))


def expired(memories: DataFrame, as_of: str) -> DataFrame:
    """(id, superseded_at): what has expired by then."""
    now = F.expr(f"timestamp_ntz '{as_of}'")
    return memories.where((F.col("expires_at") < now) & F.col("superseded_at").isNull()).select("id", now.alias("superseded_at"))


def importance_changes(feedback: DataFrame, memories: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """(id, change, importance) from a week's feedback (id, kind) on memories (id, importance, memory_type, created_at).

    Two contradictions queue a memory for review and leave its importance; three uses without an ignored one raise it by 0.05, up to 1, three ignored without a
    use lower it, down to 0.1.  Identities and memories of under 48 hours stay as they are."""
    n = feedback.groupBy("id").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("used", "ignored", "contradicted")]).where(F.col("n") >= least)
    old = F.col("created_at") <= F.expr(f"timestamp_ntz '{as_of}' - INTERVAL 48 HOURS")
    rows = n.join(memories.where((F.col("memory_type") != "identity") & old).select("id", F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(0.5)).alias("now")), "id")
    change = F.when(F.col("contradicted") >= 2, "queue").when((F.col("used") >= 3) & (F.col("ignored") == 0), "raise").when((F.col("ignored") >= 3) & (F.col("used") == 0), "lower")
    step = F.when(F.col("change") == "raise", F.least(F.lit(0.05), 1.0 - F.col("now"))).when(F.col("change") == "lower", F.greatest(F.lit(-0.05), 0.1 - F.col("now"))).otherwise(0.0)
    return rows.withColumn("change", change).where("change IS NOT NULL").select("id", "change", F.round(F.col("now") + step, 3).alias("importance"))


def topic_depth(topics: DataFrame) -> DataFrame:
    """(topic, n, depth): depth goes by the count before the last mention."""
    n = topics.groupBy("topic").agg(F.count("*").alias("n"))
    return n.withColumn("depth", F.when(F.col("n") - 1 >= 5, "deep").when(F.col("n") - 1 >= 2, "moderate").otherwise("shallow"))


def field_changes(versions: DataFrame, fields: list[str], tolerance: float = 0.01) -> DataFrame:
    """(id, version, field, old, new): numbers that differ from the version before by more than the tolerance."""
    w = Window.partitionBy("id").orderBy("version")
    rows = versions.withColumns({f"was_{f}": F.lag(f).over(w) for f in fields})
    diffs = [F.struct(F.lit(f).alias("field"), F.col(f"was_{f}").alias("old"), F.col(f).alias("new")) for f in fields]
    out = rows.select("id", "version", F.explode(F.array(*diffs)).alias("d")).select("id", "version", "d.*")
    return out.where(F.abs(F.col("old") - F.col("new")) > tolerance)


def pair_store(pairs: DataFrame) -> DataFrame:
    """Unordered pairs once, the smaller id first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def redirected(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with merged memories (loser, winner) replaced, without self loops."""
    to = lambda c: merged.select(F.col("loser").alias(c), F.col("winner").alias(f"{c}_to"))
    out = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    out = out.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"))
    return out.where("src <> dst").distinct()


def queue_gate(pairs: DataFrame) -> DataFrame:
    """One row: n, p90 of confidence (continuous), and the gate: below 12 pairs or 0.85 no go, below 0.9 caution (5), else go (10)."""
    out = pairs.agg(F.count("*").alias("n"), F.percentile("confidence", F.lit(0.9)).alias("p90"))
    stop, care = (F.col("n") < 12) | (F.col("p90") < 0.85), F.col("p90") < 0.9
    return out.withColumns({"gate": F.when(stop, "NO-GO").when(care, "CAUTION").otherwise("GO"), "most": F.when(stop, 0).when(care, 5).otherwise(10)})


def without_deleted(df: DataFrame, deleted: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns names a deleted id (id): the cascade of a delete."""
    for c in columns:
        df = df.join(deleted.select(F.col("id").alias(c)), c, "left_anti")
    return df


def over_quota(use: DataFrame, tiers: DataFrame) -> DataFrame:
    """Rows (tenant_id, plan, used, asked) that their plan's limit (plan, quota) doesn't allow; a null limit allows all."""
    return use.join(F.broadcast(tiers), "plan").where(F.col("used") + F.col("asked") > F.col("quota"))


def retained(logs: DataFrame, as_of: str) -> DataFrame:
    """Audit rows (event_type, created_at) still kept: 365 days for auth_ and key_ events, always for gdpr_ ones, else 90 days."""
    now = F.expr(f"timestamp_ntz '{as_of}'")
    long = F.col("event_type").like("auth%") | F.col("event_type").like("key%")
    days = F.when(long, 365).otherwise(90)
    return logs.where(F.col("event_type").like("gdpr%") | (F.date_diff(now, "created_at") <= days))


def initial_confidence(base: Column, kind: Column, explicit: Column, shared: Column) -> Column:
    """0.2 more for explicit wording, at least 0.85 for identities and 0.7 for decisions, 0.1 more beside a sure memory of the same entity; between 0.1 and 0.95."""
    c = base + F.when(explicit, 0.2).otherwise(0.0)
    c = F.when(kind == "identity", F.greatest(c, F.lit(0.85))).when(kind == "decision", F.greatest(c, F.lit(0.7))).otherwise(c)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), c + F.when(shared, 0.1).otherwise(0.0)))


def boosted(confidence: Column, recalls: Column) -> Column:
    """0.05 less a tenth of it for each recall so far, up to 0.95; none from the tenth on."""
    return F.when(recalls >= 10, confidence).otherwise(F.least(F.lit(0.95), confidence + 0.05 * (1 - recalls / 10)))


def valid_relations(relations: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """Relations (src, dst, kind, strength) between known ids, not to themselves, of a known kind, strength clamped to 1 and at least 0.3."""
    out = relations.where((F.col("src") != F.col("dst")) & F.col("kind").isin(kinds)).withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "strength")))
    for c in ("src", "dst"):
        out = out.join(known.select(F.col("id").alias(c)), c, "left_semi")
    return out.where("strength >= 0.3")
