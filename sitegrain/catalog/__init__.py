"""Registered queries: each runs an operator over whole given tables."""

from __future__ import annotations

import importlib

MODULES = ("pages_checks", "links_checks", "text_checks", "scoring_checks", "runs_checks", "planning_checks",
           "audit_checks", "markup_checks", "files_checks")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"sitegrain.catalog.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
