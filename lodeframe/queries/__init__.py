"""Registered queries over the canonical panels, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans.panels import Panels, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(select: str | None = None, *ctes: str) -> Callable:
    """Registers a function of :class:`Panels` as a query, with its SQL."""

    def add(function: Callable[[Panels], DataFrame]) -> Callable:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Panels(spark, sf_dir))
        if select:
            ORACLES[name] = oracle(select, *ctes)
        return function

    return add


def r(expression: str, alias: str | None = None) -> str:
    """Rounded expression in SQL, as :func:`lodeframe.functions.columns.tidy` does it."""
    return f"floor(({expression}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE + 0.0::DOUBLE" + (f" AS {alias}" if alias else "")


from lodeframe.queries import composites, ics, loading, portfolios, regressions, transforming  # noqa: E402, F401
