"""Text operators: claims, citations, turns and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claims(text: Column) -> Column:
    """The sentences of a text, lower case, white space collapsed, without closing signs."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    plain = F.transform(parts, lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"[.!?,;:]+$", ""))
    return F.filter(plain, lambda c: c != "")


def claim_votes(candidates: DataFrame) -> DataFrame:
    """(cluster, claim, votes, retained): sentences and whether at least half of the cluster's agents state them."""
    own = candidates.select("cluster", "agent", F.explode(claims(F.col("text"))).alias("claim"))
    votes = own.groupBy("cluster", "claim").agg(F.count_distinct("agent").alias("votes"))
    n = candidates.groupBy("cluster").agg(F.count_distinct("agent").alias("agents"))
    return votes.join(n, "cluster").select("cluster", "claim", "votes", (F.col("votes") >= F.ceil(F.col("agents") / 2)).alias("retained"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user_text, reply): each user turn with the assistant turn that directly follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("text").over(w)})
    return x.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "reply")


def sliding_context(turns: DataFrame, size: int = 4) -> DataFrame:
    """(conv_id, turn, n_before, context_chars): the turns right before each, as a window."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-size, -1)
    return turns.select("conv_id", "turn", F.count("*").over(w).alias("n_before"), F.coalesce(F.sum(F.char_length("text")).over(w), F.lit(0)).alias("context_chars"))


def _cuts(text: str, size: int, overlap: int) -> Iterator[str]:
    start, n = 0, len(text)
    while start < n:
        end, half = start + size, start + size // 2
        if end < n:
            at = text.rfind("\n\n", half, end + 200)
            if at > start:
                end = at
            else:  # the kinds of sentence end in turn; the first kind that is found counts
                found = next(((at, mark) for mark in SENTENCE_ENDS if (at := text.rfind(mark, half, end + 100)) > start), None)
                end = found[0] + len(found[1]) if found else end
        if part := text[start:end].strip():
            yield part
        start = end - overlap


#: Fixed order in which sentence ends are tried.
SENTENCE_ENDS = (". ", ".\n", "! ", "? ", "\n")


def chunks(texts: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(id, chunk, part): overlapping parts of a text (id, text), cut at a paragraph's or sentence's end near the size; shorter texts are one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(*[batch.column(batch.schema.names.index(c)) for c in ("id", "text")], strict=True):
                whole = text.as_py() or ""
                parts = [whole] if len(whole) <= size else list(_cuts(whole, size, overlap))
                yield pa.RecordBatch.from_pydict({"id": pa.array([id_.as_py()] * len(parts), batch.schema.field("id").type), "chunk": pa.array(range(len(parts)), pa.int32()), "part": pa.array(parts, pa.string())})

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, chunk int, part string")
