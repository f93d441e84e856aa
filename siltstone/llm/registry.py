"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, language, neighbours, packing, pii, quality, simhash, substring, toxicity, warc


def queries() -> dict:
    return {
        "op1_substring": substring.op1_substring,
        "op2_quality": quality.op2_quality,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_language": language.op4_language,
        "op5_bpe": bpe.op5_bpe,
        "op6_simhash": simhash.op6_simhash,
        "op7_pii": pii.op7_pii,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_warc": warc.op9_warc,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring": substring.OP1_SQL,
        "op2_quality": quality.OP2_SQL,
        "op9_warc": warc.OP9_SQL,
    }
