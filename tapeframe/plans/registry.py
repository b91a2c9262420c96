"""All registered queries and oracles."""

from __future__ import annotations

import importlib

MODULES = ("features", "tape", "splits", "accounting", "book", "quoting", "lake", "streaming")


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        for name, v in getattr(importlib.import_module(f"tapeframe.plans.{m}"), attr).items():
            if name in out:
                raise ValueError(f"query name used twice: {name}")
            out[name] = v
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
