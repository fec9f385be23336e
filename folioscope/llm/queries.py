"""The registered queries of this folder, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> (module, function). A module is imported when its query is asked for.
_NAMES = {
    "op1_packing": "packing",
    "op2_exact_topk": "topk",
    "op3_repeated_substrings": "substrings",
    "op4_language_id": "langid",
    "op5_quality_rules": "quality",
    "op6_near_duplicates": "near_dup",
    "op7_source_mix": "mixing",
    "op8_secret_scan": "secrets",
    "op9_toxicity": "toxicity",
    "op10_html_text": "html_text",
    "op11_token_counts": "token_counts",
    "op12_merkle_manifest": "merkle",
    "op13_centroid_clusters": "clustering",
    "quality_rule_ablations": "quality",
}


def queries() -> dict:
    return {name: getattr(import_module(f"folioscope.llm.{module}"), name) for name, module in _NAMES.items()}


#: Query name -> (module, constant) with its DuckDB SQL.
_ORACLES = {
    "op2_exact_topk": ("topk", "ORACLE_SQL"),
    "op5_quality_rules": ("quality", "ORACLE_SQL"),
    "op6_near_duplicates": ("near_dup", "ORACLE_SQL"),
    "op8_secret_scan": ("secrets", "ORACLE_SQL"),
    "quality_rule_ablations": ("quality", "ABLATIONS_SQL"),
    "op12_merkle_manifest": ("merkle", "ORACLE_SQL"),
    "op13_centroid_clusters": ("clustering", "ORACLE_SQL"),
}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"folioscope.llm.{module}"), constant) for name, (module, constant) in _ORACLES.items()}
