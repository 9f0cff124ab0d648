"""The queries of the training-text operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, language, licences, media, packing, quality, sharding, shingle_join, spelling, suffix_dedup, token_counts, token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": language.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_quality": quality.query,
    "op4_licences": licences.query,
    "op5_token_counts": token_counts.query,
    "op6_media": media.query,
    "op7_best_fit_packing": packing.query,
    "op8_shingle_join": shingle_join.query,
    "op9_decontamination": decontaminate.query,
    "op10_token_records": token_records.query,
    "op11_spelling_variants": spelling.query,
    "op12_source_divergence": divergence.query,
    "op13_sharding": sharding.query,
}
ORACLE_SQL: dict[str, str] = {"op4_licences": licences.oracle_sql(), "op12_source_divergence": divergence.oracle_sql()}
