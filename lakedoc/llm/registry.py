"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontaminate, language_id, line_dedup, lm_scoring, media, minhash, mixing, quality_crf, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_near_dedup": minhash.op3_near_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_warc": warc.op5_warc,
        "op6_media": media.op6_media,
        "op7_quality": quality_crf.op7_quality,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": decontaminate.OP8_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op10_mixing": mixing.OP10_SQL}
