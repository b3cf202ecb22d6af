"""Collects the queries and oracles of this package; each operator's are in a module of their own."""

from __future__ import annotations

import importlib

MODULES = ("q_mixing", "q_warc", "q_quality_model", "q_substrings", "q_bpe", "q_chat", "q_sharding", "q_minhash", "q_simhash", "q_rules", "q_token_files", "q_prefix_trie", "q_vector_codes")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"strandline.llm.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
