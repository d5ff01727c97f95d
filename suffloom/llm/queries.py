"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suffloom.llm.decontamination import op5_benchmark_decontamination
from suffloom.llm.html_text import op9_html_extraction
from suffloom.llm.importance import op1_importance_resampling
from suffloom.llm.kneser_ney import op2_kneser_ney
from suffloom.llm.language_id import op4_language_id
from suffloom.llm.packing import op7_packing
from suffloom.llm.quality_rules import op3_quality_rules
from suffloom.llm.simhash import op8_simhash_dedup
from suffloom.llm.token_counts import op6_token_counts
from suffloom.llm.url_filter import SQL as URL_SQL
from suffloom.llm.url_filter import op10_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": URL_SQL}
