"""Registry of runnable queries: each entry pairs a Spark plan with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tomeflow.plans import role_sql
from tomeflow.plans.roles import Roles

PLANS: dict[str, Callable[[Roles], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    def add(fn):
        if name in PLANS:
            raise ValueError(f"{name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = role_sql.with_roles(sql, roles)
        return fn

    return add
