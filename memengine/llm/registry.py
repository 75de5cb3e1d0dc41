"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from memengine.llm import alignment, bpe, decontamination, jaccard_join, language_id, lexical, padded_bpe, ppm, quality, substring_dedup, toxicity, warc, winnowing

_QUERIES = {
    "op3_warc": (warc.op3_warc, warc.SQL),
    "op2_winnowing": (winnowing.op2_winnowing, None),
    "op9_decontaminate": (decontamination.op9_decontaminate, decontamination.SQL),
    "op4_toxicity": (toxicity.op4_toxicity, None),
    "op6_language_id": (language_id.op6_language_id, None),
    "op7_quality": (quality.op7_quality, None),
    "op1_ppm": (ppm.op1_ppm, None),
    "op5_jaccard_join": (jaccard_join.op5_jaccard_join, None),
    "op8_bpe": (bpe.op8_bpe, None),
    "op10_substring_dedup": (substring_dedup.op10_substring_dedup, substring_dedup.SQL),
    "op11_alignment": (alignment.op11_alignment, None),
    "op12_padded_bpe": (padded_bpe.op12_padded_bpe, None),
    "op13_lexical": (lexical.op13_lexical, lexical.SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
