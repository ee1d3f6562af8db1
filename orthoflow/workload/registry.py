"""Registry of runnable queries and their DuckDB counterparts.

A query reads the given tables through the derived input views, runs library operators on them and
returns flat columns. Its SQL counterpart may name any view of :mod:`views`; the needed common table
expressions are added in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoflow.workload.views import ORACLE_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEW = re.compile(r"\bv_[a-z_0-9]+\b")


def with_views(body: str, local: dict[str, str] | None = None) -> str:
    known = {**ORACLE_VIEWS, **(local or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_VIEW.findall(text)):
            if name in known and name not in ordered:
                visit(known[name].replace(name, ""))
                ordered.append(name)

    visit(body)
    parts = [f"{name} AS ({known[name]})" for name in ordered]
    text = body.strip()
    head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
    if text.startswith("WITH "):
        return head + ",\n".join([*parts, text[len(head):]])
    return (head + ",\n".join(parts) + "\n" + text) if parts else text


def query(name: str, sql: str | None = None, local: dict[str, str] | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, local)
        return function

    return register
