"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

from flowlens.plans.registry import ORACLES, QUERIES

MODULES = ("q_alerts", "q_features", "q_respond", "q_views", "q_ingest", "q_tables", "q_resample", "q_models", "q_streams")

for _name in MODULES:
    importlib.import_module(f"flowlens.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
