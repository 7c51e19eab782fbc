"""The text operators' queries and their DuckDB SQL."""

from __future__ import annotations

import importlib

#: Query name and the module that defines it.
MODULES = {
    "op1_sentencepiece": "sentencepiece_codec",
    "op2_substring_dedup": "substring_dedup",
    "op3_exact_dedup": "exact_dedup",
    "op4_packing": "packing",
    "op5_toxicity": "toxicity",
    "op6_lm_scoring": "lm_scoring",
    "op7_simhash": "simhash",
    "op8_chat_format": "chat_format",
    "op9_vector_search": "vector_search",
    "op10_quality": "quality",
    "op11_sharding": "sharding",
    "op12_whitening": "whitening",
    "op13_lexical_search": "lexical_search",
}


def _module(name: str):
    return importlib.import_module(f"undertow.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update({k: v for k, v in getattr(_module(name), "ORACLE", {}).items() if k == name})
    return found
