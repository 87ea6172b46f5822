"""Named queries, each with the SQL that states the same result over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from isotherm.plans.views import VIEWS
from isotherm.sources.tables import Tables


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under a name."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return REGISTRY[name].build(Tables(spark, folder))


def _expand_rounding(sql: str) -> str:
    """``R6(expr)`` becomes a six-decimal double without a negative zero."""
    while (at := sql.find("R6(")) >= 0:
        depth, end = 0, at + 2
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        sql = f"{sql[:at]}(round(({sql[at + 3 : end]})::DOUBLE, 6) + 0.0){sql[end + 1 :]}"
    return sql


def _mentions(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"(?<![.\w]){v}(?![\w(])", sql)]


def statement(name: str) -> str | None:
    """The query's SQL with the views it mentions as leading table expressions."""
    sql = REGISTRY[name].sql
    if sql is None:
        return None
    sql = _expand_rounding(sql.strip())
    needed: set[str] = set()
    pending = _mentions(sql)
    while pending:
        view = pending.pop()
        if view not in needed:
            needed.add(view)
            pending += [v for v in _mentions(VIEWS[view]) if v != view]
    parts = [f"{v} AS ({_expand_rounding(VIEWS[v].strip())})" for v in VIEWS if v in needed]
    if sql.upper().startswith("WITH "):
        parts.append(sql[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
