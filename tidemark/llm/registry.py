"""The queries of this folder and their DuckDB statements."""

from __future__ import annotations

from . import (
    ann_search,
    byte_bpe,
    chat_format,
    decontaminate,
    language_id,
    minhash_forest,
    quality_knn,
    suffix_dedup,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op1_language_id_pages": language_id.op1_language_id_pages,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_nearest_neighbours": ann_search.op3_nearest_neighbours,
        "op4_minhash_forest": minhash_forest.op4_minhash_forest,
        "op5_toxicity_channel": toxicity.op5_toxicity_channel,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_url_filters": url_filter.op7_url_filters,
        "op8_quality_knn": quality_knn.op8_quality_knn,
        "op9_chat_formatting": chat_format.op9_chat_formatting,
        "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup.OP2_SQL,
        "op4_minhash_forest": minhash_forest.OP4_SQL,
        "op7_url_filters": url_filter.OP7_SQL,
        "op9_chat_formatting": chat_format.OP9_SQL,
        "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    }
