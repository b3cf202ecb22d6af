"""Collects the queries and oracles of the library's query modules."""

from __future__ import annotations

import importlib

#: Query modules of this package; each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("q_evidence", "q_facets", "q_statistics", "q_peptides", "q_intervals", "q_sources")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"strandline.plans.{module}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
