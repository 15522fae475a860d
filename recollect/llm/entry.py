"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import chat, chosen_path, licenses, line_dedup, minhash, packing, pieces, quality, repeats, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_fingerprints": minhash.query,
    "op2_suffix_array_dedup": repeats.query,
    "op3_chat_formatting": chat.query,
    "op4_line_dedup": line_dedup.query,
    "op5_packing": packing.query,
    "op6_quality_rules": quality.query,
    "op7_ngram_jaccard_join": chosen_path.query,
    "op8_lm_scoring": scoring.query,
    "op9_license_scan": licenses.query,
    "op10_sentencepiece": pieces.query,
}
SQL: dict[str, str] = {
    "op2_suffix_array_dedup": repeats.SQL,
    "op3_chat_formatting": chat.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op6_quality_rules": quality.sql(),
    "op7_ngram_jaccard_join": chosen_path.SQL,
    "op9_license_scan": licenses.sql(),
}
