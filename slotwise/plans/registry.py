"""Query registry: name -> (Spark callable, SQL text or None)."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.sources.stand_ins import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EXTRA_VIEWS: dict[str, str] = {}


def define_view(name: str, sql: str) -> None:
    """Add a SQL view for oracles; it may use the views defined before it."""
    EXTRA_VIEWS[name] = sql


def _expand(sql: str) -> str:
    """Prefix the WITH list of the views the text uses, dependencies first."""
    views = {**SQL_VIEWS, **EXTRA_VIEWS}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for v in set(re.findall(r"\bv_\w+\b", text)):
            if v in views and v not in needed:
                needed.add(v)
                visit(views[v])

    visit(sql)
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({views[v]})" for v in views if v in needed)
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` together with the SQL that checks it."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def oracle_texts() -> dict[str, str]:
    return {k: _expand(v) for k, v in ORACLES.items()}
