"""Queries of the training-data operators and their SQL, for __spark_entry__."""

from __future__ import annotations

import importlib

#: query -> module of this subpackage that holds query() and, where SQL can tell the result, ORACLE_SQL.
MODULES = {
    "op1_bpe_codec": "bpe",
    "op2_toxicity": "toxicity",
    "op3_html_text": "html_text",
    "op4_near_dedup": "near_dedup",
    "op5_lang_id": "lang_id",
    "op6_substring_dedup": "substring_dedup",
    "op7_benchmark_decontamination": "benchmark_filter",
    "op8_fertility_quality": "quality",
    "op9_token_store": "token_store",
    "op10_label_sharding": "sharding",
    "op11_lexical_search": "lexical_search",
    "op12_token_alignment": "alignment",
    "op13_matroska_media": "matroska",
}


def _base() -> dict:
    """The base columns of the quality rules, beside op8, whose verdict SQL can't tell."""
    quality = importlib.import_module(".quality", __package__)
    return {"quality_base": (quality.base_query, quality.BASE_SQL)}


def queries() -> dict:
    return {k: q for k, (q, _) in _base().items()} | {k: importlib.import_module(f".{m}", __package__).query for k, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {k: getattr(importlib.import_module(f".{m}", __package__), "ORACLE_SQL", None) for k, m in MODULES.items()}
    return {k: sql for k, (_, sql) in _base().items()} | {k: v for k, v in found.items() if v}
