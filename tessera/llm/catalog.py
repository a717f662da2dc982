"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .decontamination import op3_decontamination
from .html_extraction import op7_html_extraction
from .language_id import op1_language_id
from .license_scan import OP4_SQL, op4_license_scan
from .quality import op6_quality
from .simhash import op8_simhash
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .vector_search import op9_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash": op8_simhash,
    "op9_vector_search": op9_vector_search,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = {"op4_license_scan": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op10_chat_format": OP10_SQL}
