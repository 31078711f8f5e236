"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from canonframe.llm import decontamination, jaccard_join, line_dedup, mpeg_audio, packing, pii, quality, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_media": mpeg_audio.op5_media,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontamination.op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op8_suffix_dedup": substring_dedup.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
}
