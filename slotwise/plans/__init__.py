"""Registered queries, each with the SQL it is checked against where SQL can say it."""
from importlib import import_module

FAMILIES = ["q_grid", "q_sources", "q_filters", "q_quality", "q_joins", "q_functions", "q_windows", "q_forecast", "q_explore", "q_models", "q_stream"]


def load():
    """Import every family once and return the registry."""
    for f in FAMILIES:
        import_module(f"slotwise.plans.{f}")
    return import_module("slotwise.plans.registry")
