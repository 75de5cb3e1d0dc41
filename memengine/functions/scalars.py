"""Scalar functions of the memory model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, differently sized or zero vectors."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one, null for a zero or empty one: normalise once, then only dot products remain."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def recency(age_days: Column, half_life_days: float) -> Column:
    fresh = F.exp(-0.693 * age_days / max(half_life_days, 0.01))
    return F.when(age_days < 1, fresh * 2.5).otherwise(fresh)


def age_days(created: Column, as_of: str) -> Column:
    return F.expr(f"unix_seconds(cast(timestamp_ntz '{as_of}' AS timestamp))").cast("double") / 86400 - F.unix_seconds(created.cast("timestamp")).cast("double") / 86400


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.char_length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(values, lambda v, i: F.when((n - 1 - i) % 2 == 1, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v)), F.lit(0), lambda s, x: s + x
    )
    return (n >= 13) & (total % 10 == 0)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n), F.lit(0.0), lambda s, p: s + p * F.log2(p))


def words3(text: Column) -> Column:
    """Lower-case words of at least three letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
