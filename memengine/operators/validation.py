"""Untrusted JSON: schemas compiled to one Column of errors, and extraction results made whole.

JSON texts become variants once; every rule is a built-in expression over them, so a check of many rules is one projection."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the memory model.
UUID = {"type": "string", "format": "uuid"}
CHECKPOINT = {
    "required": ["level", "thread_id", "checkpoint_sequence", "checkpoint_type", "turn_range", "turn_count", "time_span_seconds", "parent_memory_ids", "child_memory_ids", "source"],
    "properties": {
        "level": {"type": "integer", "enum": [1]},
        "thread_id": UUID,
        "project_id": UUID | {"nullable": True},
        "checkpoint_sequence": {"type": "integer", "minimum": 1},
        "checkpoint_type": {"type": "string", "enum": ["mid_thread", "end_of_thread", "auto_resume_meta", "tail_recovery"]},
        "turn_range": {"type": "array", "length": 2, "items": {"type": "integer"}, "ordered": True},
        "turn_count": {"type": "integer", "minimum": 1},
        "time_span_seconds": {"type": "integer", "minimum": 0},
        "parent_memory_ids": {"type": "array", "items": {"format": "uuid"}},
        "child_memory_ids": {"type": "array"},
        "parent_checkpoint_id": UUID | {"nullable": True},
        "source": {"type": "string", "enum": ["server_job", "agent", "extension"]},
        "thread_title": {"type": "string", "nullable": True},
        "project_name": {"type": "string", "nullable": True},
        "prompt_version": {"type": "string", "nullable": True},
    },
}
MEMORY_TYPES = ("fact", "decision", "preference", "task", "correction", "relationship", "identity")
TEMPORAL_TYPES = ("permanent", "current", "event", "goal", "ephemeral")
LEAST_CONFIDENCE, DEFAULT_CONFIDENCE, DEFAULT_IMPORTANCE, DEFAULT_TTL = 0.3, 0.8, 0.5, 12
_WHOLE = r"^(BIGINT|BOOLEAN|DECIMAL\((19|[2-9][0-9]),0\))$"
_NUMBER = r"^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*)$"
_TYPES = {"string": "^STRING$", "number": _NUMBER, "integer": _WHOLE, "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*"}


def _uuid(text: Column) -> Column:
    """Whether a text is a UUID: 32 hexadecimal digits, with hyphens, braces and the urn prefix as they may come."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    return F.coalesce(F.regexp_like(bare, F.lit("^[0-9a-fA-F]{32}$")), F.lit(False))


def _rules(value: Column, name: str, rule: dict) -> list[Column]:
    """Errors (or nulls) of one value that is there; rules of a value hold only for values of the right type."""
    kind, out = F.schema_of_variant(value), []
    text = F.try_variant_get(value, "$", "string")
    typed = F.regexp_like(kind, F.lit(_TYPES[rule["type"]])) if "type" in rule else F.lit(True)
    there = ~F.is_variant_null(value) if rule.get("nullable") else F.lit(True)
    say = lambda bad, message: out.append(F.when(there & bad, F.lit(f"{name} {message}")))
    if "type" in rule:
        say(~typed, f"must be {'an' if rule['type'][0] in 'aio' else 'a'} {rule['type']}")
    if "enum" in rule:
        say(typed & ~F.coalesce(F.to_json(value).isin([json.dumps(x) for x in rule["enum"]]), F.lit(False)), f"must be one of {rule['enum']}")
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in rule:
        say(typed & (number < rule["minimum"]), f"must be >= {rule['minimum']}")
    if "maximum" in rule:
        say(typed & (number > rule["maximum"]), f"must be <= {rule['maximum']}")
    if rule.get("format") == "uuid":
        say(typed & ~_uuid(text), "must be a valid UUID")
    items = F.try_variant_get(value, "$", "array<variant>")
    if "length" in rule:
        say(typed & (F.size(items) != rule["length"]), f"must have {rule['length']} items")
    if "items" in rule:
        wrong = lambda x: reduce(lambda a, b: a | b, [F.coalesce(e.isNotNull(), F.lit(False)) for e in _rules(x, name, rule["items"])])
        say(typed & F.exists(items, wrong), "has an item that isn't valid")
    if rule.get("ordered"):
        at = lambda i: F.try_variant_get(F.get(items, F.lit(i)), "$", "double")
        say(typed & (at(0) > at(1)), "must be in order")
    return out


def errors(value: Column, schema: dict) -> Column:
    """All errors of a variant against a schema (required, properties with type, enum, minimum, maximum, format, length, items, ordered, nullable).

    Fields that the schema doesn't name are allowed; a value that is no object has one error.  As in the model, a boolean counts as a number."""
    found = lambda n: F.try_variant_get(value, f"$['{n}']", "variant")
    missing = [F.when(found(n).isNull(), F.lit(f"missing required field: {n}")) for n in schema.get("required", [])]
    wrong = [F.when(found(n).isNotNull(), e) for n, rule in schema.get("properties", {}).items() for e in _rules(found(n), n, rule)]
    object_ = F.coalesce(F.regexp_like(F.schema_of_variant(value), F.lit("^OBJECT")), F.lit(False))
    return F.when(~object_, F.array(F.lit("must be an object"))).otherwise(F.array_compact(F.array(*missing, *wrong)))


def validated(rows: DataFrame, schema: dict, column: str = "json") -> DataFrame:
    """rows with errors array<string>: empty where the JSON text is valid; a text that can't be parsed is no object."""
    # bound by a lambda: otherwise each rule would parse the text again
    return rows.withColumn("errors", F.get(F.transform(F.array(F.try_parse_json(column)), lambda v: errors(v, schema)), F.lit(0)))


def _replies(texts: DataFrame) -> DataFrame:
    """(id, agent_id, at, item variant) of extraction replies (id, agent_id, text, at): fences go, an array's items or an object's memories; item is null where a reply isn't JSON."""
    trimmed = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    fenced = F.regexp_replace(F.regexp_replace(trimmed, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    value = F.try_parse_json(F.when(trimmed.startswith("```"), fenced).otherwise(trimmed))
    rows = texts.select("id", "agent_id", "at", value.alias("v"))
    inner = F.coalesce(F.try_variant_get("v", "$.memories", "variant"), F.try_variant_get("v", "$.extracted_memories", "variant"), F.col("v"))
    rows = rows.select("id", "agent_id", "at", inner.alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return rows.select("id", "agent_id", "at", F.explode(items).alias("item"))


def normalised(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, rejects) of extraction replies (id, agent_id, text, at timestamp): whatever the replies hold, none fails.

    memories: id (of headline and time), source, agent_id, headline, context, full_content, memory_type, importance, confidence, temporal_type, entities, categories, scope,
    project, ttl_hours.  Missing values take their defaults, numbers are clamped to 0 and 1, unknown types become fact and current, permanent facts become identities.
    rejects: source, reason, n.  Reasons: not_json, not_an_object, no_headline, bad_value (a text that is no text or a number that is none), unsure (under 0.3)."""
    rows = _replies(texts)
    get = lambda n, t="string": F.try_variant_get("item", f"$.{n}", t)
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get("item", f"$.{n}", "variant")), F.lit("NONE"))
    number = lambda n, default: F.when(kind(n) == "NONE", F.lit(float(default))).otherwise(get(n, "double"))
    headline = F.trim(get("headline"))
    context = F.trim(F.when(kind("context") == "NONE", headline).otherwise(get("context")))
    content = F.trim(F.when(kind("full_content") == "NONE", context).otherwise(get("full_content")))
    texts_fine = reduce(lambda a, b: a & b, [kind(n).isin("STRING", "NONE") for n in ("headline", "context", "full_content")])
    confidence, importance = number("confidence", DEFAULT_CONFIDENCE), number("importance", DEFAULT_IMPORTANCE)
    ephemeral = F.coalesce(get("temporal_type") == "ephemeral", F.lit(False))
    ttl = F.when(ephemeral, number("ttl_hours", DEFAULT_TTL))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    reason = (
        F.when(F.col("item").isNull(), "not_json").when(~F.regexp_like(F.schema_of_variant("item"), F.lit("^OBJECT")), "not_an_object").when(~texts_fine, "bad_value")
        .when(F.coalesce(headline, F.lit("")) == "", "no_headline").when(confidence.isNull() | F.isnan(confidence) | importance.isNull() | F.isnan(importance) | (ephemeral & ttl.isNull()), "bad_value").when(clamp(confidence) < LEAST_CONFIDENCE, "unsure")
    )
    known = lambda c, allowed, default: F.when(c.isin(*allowed), c).otherwise(default)
    temporal = known(F.coalesce(get("temporal_type"), F.lit("current")), TEMPORAL_TYPES, "current")
    memory = known(F.coalesce(get("memory_type"), F.lit("fact")), MEMORY_TYPES, "fact")
    strings = lambda n: F.coalesce(get(n, "array<string>"), F.array().cast("array<string>"))
    made = rows.withColumn("reason", reason)
    fine = made.where("reason IS NULL").select(
        F.substring(F.sha2(F.concat_ws(":", headline, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).cast("binary"), 256), 1, 16).alias("id"), F.col("id").alias("source"), "agent_id", headline.alias("headline"), context.alias("context"), content.alias("full_content"),
        F.when((temporal == "permanent") & (memory == "fact"), "identity").otherwise(memory).alias("memory_type"), clamp(importance).alias("importance"), clamp(confidence).alias("confidence"), temporal.alias("temporal_type"),
        strings("entities").alias("entities"), strings("categories").alias("categories"), F.coalesce(get("scope"), F.lit("/")).alias("scope"), get("project").alias("project"), ttl.cast("int").alias("ttl_hours"),
    )
    rejects = made.where("reason IS NOT NULL").groupBy(F.col("id").alias("source"), "reason").agg(F.count("*").alias("n"))
    return fine, rejects
