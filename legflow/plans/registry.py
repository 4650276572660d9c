"""Collects every registered query module."""

from __future__ import annotations

import importlib

from legflow.plans.catalog import REGISTRY

MODULES = ["legflow.plans.q_core", "legflow.plans.q_report", "legflow.plans.q_ml", "legflow.plans.q_io",
           "legflow.plans.q_linear", "legflow.plans.q_checked", "legflow.plans.q_keyed"]


def all_queries():
    for m in MODULES:
        importlib.import_module(m)
    return dict(REGISTRY)
