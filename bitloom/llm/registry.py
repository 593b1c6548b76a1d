"""Queries and SQL of the operators, as __spark_entry__.py registers them."""

from __future__ import annotations

import importlib

#: Query name and the module that has it; a module's SQL, where it has one, is named SQL.
MODULES = {
    "op1_ngram_jaccard_join": "op1_jaccard",
    "op2_bpe": "op2_bpe",
    "op3_warc": "op3_warc",
    "op4_html_extraction": "op4_html",
    "op5_url_filters": "op5_url",
    "op6_exact_topk": "op6_topk",
    "op7_decontamination": "op7_winnowing",
    "op8_language_id": "op8_langid",
    "op9_line_dedup": "op9_lines",
    "op10_pii": "op10_pii",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"bitloom.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"bitloom.llm.{m}"), "SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}
