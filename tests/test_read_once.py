"""Steps that many plans read are computed once, and rows without a value are dealt over tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import order
from lodeframe.plans import panels
from lodeframe.plans.panels import Panels
from lodeframe.queries import composites, portfolios, regressions
from lodeframe.session import kept


def test_order_lines_are_not_summed_by_every_reader(spark, small):
    p = Panels(spark, small)
    tests = composites.evaluations(p)
    for df in (composites.together(p).rows, tests["h1"].panel, tests["h2"].panel, composites.model_rows(p), *regressions.groups_and_hl(p)):
        assert "l_suppkey" not in df._jdf.queryExecution().analyzed().toString()


def scans(written: list) -> int:
    """How often what was written reads the order lines."""
    return sum(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") for df in written)


def test_quotes_and_panel_group_the_order_lines_once(spark, small, monkeypatch):
    written = []
    monkeypatch.setattr(panels, "kept", lambda df: written.append(df) or kept(df))
    p, stored = Panels(spark, small), Panels(spark, small).stored("quotes")
    assert scans(written) == 1
    for name in ("panel", "quotes"):
        want, got = getattr(p, name), getattr(stored, name)
        assert got.columns == want.columns
        assert got.orderBy("date", "code").collect() == want.orderBy("date", "code").collect()


def test_pricing_tests_write_forward_returns_and_not_the_panel(spark, small, monkeypatch):
    written = []
    for module in (panels, regressions):
        monkeypatch.setattr(module, "kept", lambda df: written.append(df.columns) or kept(df))
    groups, _ = regressions.groups_and_hl(Panels(spark, small))
    assert written[0] == ["date", "price", "disc", "ret"] and len(written) == 3
    compared = [df.orderBy("date", "grp").toPandas() for df in (groups, portfolios.single(Panels(spark, small)))]
    assert compared[0]["ret"].values == pytest.approx(compared[1]["ret"].values, rel=1e-12)


@pytest.fixture
def plain_joins(spark):
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    yield
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
        spark.conf.unset(name)


def test_rows_without_a_value_are_dealt_over_tasks(spark, plain_joins):
    rows = spark.range(400).select(F.lit(1).alias("date"), F.col("id").alias("code"), F.when(F.col("id") < 40, (F.col("id") % 7).cast("double")).alias("x"))
    known = order.distribution(rows, "x", ["date"], ranges=4)
    ranked = order.with_ranks(rows, "x", ["date"], "r", known=known)
    placed = ranked.select("x", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in placed if r.x is None}) > 1
    got = {r.code: r.r for r in ranked.collect()}
    xs = [c % 7 for c in range(40)]
    assert got == {c: sum(x < xs[c] for x in xs) + (xs.count(xs[c]) + 1) / 2 if c < 40 else None for c in range(400)}
    bounded = [order.with_median_bounds(ranked, "x", 1.0, ["date"], "o", known=k).orderBy("code").collect() for k in (known, None)]
    assert bounded[0] == bounded[1]
