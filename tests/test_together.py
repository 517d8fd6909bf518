"""Many tests in one plan against the same tests one by one."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.plans import evaluate
from lodeframe.plans.panels import Panels
from lodeframe.plans.together import Test, run_together


@pytest.fixture(scope="module")
def tables(spark):
    p = Panels(spark, "/root/testdata/sf0.001")
    panel = p.panel.select("date", "code", "disc", "cap", F.col("volume").cast("double").alias("volume"))
    return p.quotes, p.instruments, panel, p.panel.select("date", "code", F.col("cap").alias("weight"))


def operators(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.search(r"[A-Za-z]+", re.sub(r"^[ :+*(\d)\-]*", "", line))[0] for line in plan.splitlines()]


def test_fifty_tests_have_the_plan_of_two(tables):
    quotes, instruments, panel, _ = tables
    many = {f"t{i:02d}": Test(("disc", "cap") if i % 2 else ("volume", "disc"), 1 + i % 2, ("cap",) if i % 3 else (), begin=datetime.date(1992, 1 + i % 12, 1)) for i in range(50)}
    few = {k: many[k] for k in ("t01", "t02")}
    plans = [operators(run_together(quotes, instruments, panel, tests, groups=2, roll=12).tables["groups"]) for tests in (few, many)]
    assert plans[0] == plans[1]


def test_rows_of_every_table_as_one_by_one(tables):
    quotes, instruments, panel, weight = tables
    begin, end = datetime.date(1993, 2, 1), datetime.date(1997, 6, 1)
    tests = {"a": Test(("disc", "volume"), 2, ("cap",)), "b": Test(("volume",), 3, ("cap", "disc"), rebalance=False, begin=begin, end=end)}
    got = run_together(quotes, instruments, panel, tests, groups=2, roll=12, weight=weight)
    for key, t in tests.items():
        columns = panel.select("date", "code", *dict.fromkeys([*t.factors, *t.baseline]))
        alone = evaluate.run_test(quotes, instruments, columns, list(t.factors), "price", t.horizon, 2, 12, list(t.baseline), t.rebalance, weight, t.begin, t.end)
        assert alone.factors == [*t.factors, *(f"{f}_ortho" for f in t.factors)]
        for table, by, values in (("coverage", ["factor", "date"], ["coverage"]), ("ic", ["factor", "date"], ["ic"]), ("groups", ["factor", "date", "grp"], ["ret"])):
            mine, other = ({tuple(r[k] for k in by): tuple(r[v] for v in values) for r in df.select(*by, *values).collect()} for df in (got.tables[table].where(F.col("test_key") == key), alone.tables[table]))
            assert mine.keys() == other.keys(), (key, table)
            for k, v in other.items():
                assert mine[k] == tuple(None if x is None else pytest.approx(x, rel=1e-6, abs=1e-9) for x in v), (key, table, k)
        alone.close()
    got.close()


def test_tests_need_factors(tables):
    quotes, instruments, panel, _ = tables
    for tests in ({}, {"a": Test(())}):
        with pytest.raises(ValueError, match="names factors"):
            run_together(quotes, instruments, panel, tests)
    with pytest.raises(ValueError, match="method"):
        run_together(quotes, instruments, panel, {"a": Test(("disc",))}, method="kendall")
