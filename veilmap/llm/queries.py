"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_chat_formatting": "chat",
    "op2_mixing": "mixing",
    "op3_ann": "ann",
    "op4_minhash_dedup": "minhash",
    "op5_token_counts": "token_counts",
    "op6_sentencepiece": "lattice",
    "op7_toxicity": "toxicity",
    "op8_exact_topk": "exact_topk",
    "op9_warc": "warc",
    "op10_token_files": "token_files",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from .chat import OP1_SQL
    from .exact_topk import OP8_SQL
    from .warc import OP9_SQL

    return {"op1_chat_formatting": OP1_SQL, "op8_exact_topk": OP8_SQL, "op9_warc": OP9_SQL}
