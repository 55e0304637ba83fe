"""Registered queries and the SQL each one is checked against."""

from importlib import import_module

MODULES = ["source_plans", "link_plans", "stats_plans", "history_plans", "graph_plans", "risk_plans", "learning_plans", "stream_plans"]


def load_plans() -> None:
    """Imports every plan module, which registers its queries."""
    for name in MODULES:
        import_module(f"tracewell.plans.{name}")
