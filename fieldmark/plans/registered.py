"""Load every query module and hand out the registry."""

from __future__ import annotations

import importlib

from fieldmark.plans import catalog

MODULES = ("q_sources", "q_filters", "q_encounter", "q_joins", "q_ranges", "q_spatial", "q_splits", "q_raster",
           "q_samples", "q_scores", "q_baselines", "q_scenes", "q_quality")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"fieldmark.plans.{name}")


def queries():
    _load()
    return dict(catalog.QUERIES)


def oracle_sql():
    _load()
    return dict(catalog.ORACLE)
