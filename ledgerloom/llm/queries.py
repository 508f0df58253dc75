"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name: its module here.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_token_records": "records",
    "op3_embeddings": "embeddings",
    "op4_minhash": "minhash",
    "op5_decontamination": "contamination",
    "op6_quality": "quality",
    "op7_token_counts": "prefix_counts",
    "op8_packing": "packing",
    "op9_sharding": "sharding",
    "op10_substring_dedup": "substrings",
    "op11_clustering": "clustering",
    "op12_line_dedup": "lines",
    "op13_alignment": "alignment",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in dict.fromkeys(MODULES.values()) for name, sql in getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).items()}
