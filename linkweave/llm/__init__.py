"""Operators for training-data corpora, their queries and their SQL. Nothing else in the library imports this."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

# executors need not have this package: functions that run there travel with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = {
    "op1_quality_classifier": "op1_quality_classifier",
    "op2_token_counts": "op2_token_counts",
    "op3_quality_rules": "op3_quality_rules",
    "op4_suffix_dedup": "op4_suffix_dedup",
    "op5_sentencepiece": "op5_sentencepiece",
    "op6_minhash": "op6_minhash",
    "op7_pii": "op7_pii",
    "op8_fingerprints": "op8_fingerprints",
    "op9_line_dedup": "op9_line_dedup",
    "op10_mixing": "op10_mixing",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
