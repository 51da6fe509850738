"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import ann, bpe, exact_dedup, html_text, jaccard_join, langid, line_dedup, lm, mixing, toxicity


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, room=bpe.WIDE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": jaccard_join.query,
    "op2_html_extraction": html_text.query,
    "op3_mixing_sources": mixing.query,
    "op4_byte_level_bpe": _bpe,
    "op5_toxicity": toxicity.query,
    "op6_language_id": langid.query,
    "op7_line_dedup": line_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_nearest_neighbours": ann.query,
    "op10_lm_scoring": lm.query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
}
