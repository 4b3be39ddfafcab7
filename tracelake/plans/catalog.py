"""Registered queries and their SQL."""

from __future__ import annotations

import importlib

from tracelake.plans import registry

MODULES = ("q_basic", "q_spans", "q_graph", "q_series", "q_logs", "q_vectors", "q_reports", "q_streaming", "q_composites", "q_regression", "q_prediction", "q_incident", "q_behaviour", "q_courses", "q_sources")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracelake.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)


def entry(spark):
    return queries()["g1_dependency_edges"](spark, "/root/testdata/sf0.001")
