"""Search and re-ranking: query analysis, predicates by request, routing, criteria, gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed word lists of the memory model.
CLASSIFY_STOP = (
    "the a an and or but in on at to for of with is are was were be been being have has had do does did will would could should may might can this that these those i you he she it we they"
).split()
KEYWORD_STOP = "this that with from what when where which about have been will would could should their there the and for are but not you all can her was one our out".split()
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Words are runs of letters, digits and underscores of any script.
GAP = r"[^\p{L}\p{N}_]"
PROPER = rf"(^|{GAP})[A-Z][a-z]+($|{GAP})"
DATES = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{2,4}", rf"({MONTHS})\s+\d{{4}}", rf"\d{{1,2}}\s+({MONTHS})")
#: Criteria: base score and words, each of which adds 0.15.
CRITERIA = {
    "urgency": (0.3, ["urgent", "asap", "immediately", "critical", "deadline", "overdue", "blocker", "now"]),
    "positivity": (0.2, ["great", "excellent", "love", "happy", "success", "win", "celebrate", "perfect", "amazing"]),
    "risk": (0.2, ["fail", "error", "broken", "risk", "problem", "issue", "bug", "concern", "worry", "loss"]),
    "actionability": (0.2, ["should", "must", "need to", "todo", "action", "next step", "implement", "build", "fix"]),
}

#: Other names of criteria.
SYNONYMS = {"joy": "positivity", "negativity": "risk"}


def classified(queries: DataFrame) -> DataFrame:
    """queries (q) with keywords, signals, whether keywords dominate, and how sure that is."""
    low = F.lower(F.trim("q"))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    keywords = F.filter(words, lambda w: ~w.isin(CLASSIFY_STOP) & (F.char_length(w) > 2))
    dated = reduce(lambda a, b: a | b, [F.regexp_like(low, F.lit(d)) for d in DATES])
    out = queries.withColumns({"keywords": keywords, "proper": F.regexp_like("q", F.lit(PROPER)), "dated": dated, "exact": (F.size(words) <= 5) | low.contains('"')})
    signals = F.col("proper").cast("int") + F.col("dated").cast("int") + F.col("exact").cast("int") + (F.size("keywords") > 0).cast("int")
    sure = F.col("proper").cast("int") * 0.4 + F.col("dated").cast("int") * 0.3 + F.col("exact").cast("int") * 0.2 + (F.size("keywords") >= 2).cast("int") * 0.1
    return out.withColumns({"dominant": (signals >= 2) | F.col("proper") | F.col("dated"), "confidence": F.least(F.lit(1.0), F.round(sure, 6))})


def sanitised(q: Column) -> Column:
    """Trimmed, hyphens as spaces, one space between words."""
    return F.regexp_replace(F.regexp_replace(F.trim(q), "-", " "), r"\s+", " ")


def keywords(text: Column, most: int = 5) -> Column:
    """The first words of three letters or more that aren't stop words."""
    words = F.split(F.lower(text), f"{GAP}+")
    return F.slice(F.filter(words, lambda w: F.regexp_like(w, F.lit("^[a-z]{3,}$")) & ~w.isin(KEYWORD_STOP)), 1, most)


def requested(df: DataFrame, types: list[str] | None = None, actor: int | None = None, since: str | None = None, until: str | None = None, role: str | None = None, agent: str | None = None, project: str | None = None) -> DataFrame:
    """Rows that every given condition allows; what isn't given doesn't filter.  All reach the scan as one filter."""
    parts = []
    if types is not None:
        parts.append(F.col("event_type").isin(types))
    if actor is not None:
        parts.append(F.col("user_id") == actor)
    if since is not None:
        parts.append(F.col("ts") >= F.expr(f"timestamp_ntz '{since}'"))
    if until is not None:
        parts.append(F.col("ts") < F.expr(f"timestamp_ntz '{until}'"))
    if role is not None and role != "admin":
        parts.append(F.col("role_tag").isNull() | F.col("role_tag").isin(role, "public"))
    if agent is not None:
        parts.append((F.col("agent_id") == agent) | (F.col("memory_type") == "synthesis"))
    if project is not None:
        parts.append(F.col("project_id") == project)
    return df.where(reduce(lambda a, b: a & b, parts, F.lit(True)))


def criterion(name: str, text: Column, confidence: Column, importance: Column) -> Column:
    """Score of a text by one criterion; unknown ones go by importance."""
    low, name = F.lower(text), name.lower()
    name = SYNONYMS.get(name, name)
    if name in CRITERIA:
        base, words = CRITERIA[name]
        hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
        out = F.least(F.lit(1.0), base + 0.15 * hits)
    elif name == "complexity":
        out = F.least(F.lit(1.0), F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) / 200)
    else:
        out = F.coalesce(confidence, F.lit(0.8)) if name == "confidence" else F.coalesce(importance, F.lit(0.5))
    return F.round(out, 3)


def reranked(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """candidates (composite, text, confidence, importance) with final: 0.7 composite + 0.3 weighted mean of the criteria."""
    scores = [criterion(n, F.col("text"), F.col("confidence"), F.col("importance")) * w for n, w in weights.items()]
    return candidates.withColumn("final", 0.7 * F.col("composite") + 0.3 * reduce(lambda a, b: a + b, scores) / sum(weights.values()))


def gaps(asked: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """(topic, known_topics, state): asked topics and up to three known ones (topic, depth) that hold or are held by them; asked is a request: a few rows."""
    from pyspark.sql import Window

    met = topics.select(F.lower("topic").alias("known"), "depth").join(F.broadcast(asked.select("topic", F.lower("topic").alias("low"))), F.contains("known", "low") | F.contains("low", "known"))
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("known"))).where(F.col("r") <= most)
    found = met.groupBy("topic").agg(F.count("*").alias("known_topics"), F.bool_and(F.col("depth") == "shallow").alias("thin"))
    out = asked.join(found, "topic", "left")
    return out.select("topic", F.coalesce("known_topics", F.lit(0)).alias("known_topics"), F.when(F.col("known_topics").isNull(), "unknown").when(F.col("thin"), "shallow").otherwise("known").alias("state"))
