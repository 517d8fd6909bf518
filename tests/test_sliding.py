"""Sliding sums over blocks against sums of every window; correlations in tiles against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.operators.ic import factor_correlation
from lodeframe.operators.sliding import rolled, sliding_sums


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, None if rng.random() < 0.2 else float(rng.normal() * 10.0 ** int(rng.integers(-3, 9)))) for c in range(6) for i in range(1, 90) if rng.random() < (1.0 if c == 0 else 0.5)]
    return spark.createDataFrame(rows, "code long, date_idx int, x double").cache()


@pytest.mark.parametrize("window", [1, 2, 7, 30, 88, 89, 200])
def test_sums_of_every_window(gappy, window):
    rows = gappy.collect()
    got = sliding_sums(gappy, {"s": F.col("x"), "n": F.when(F.col("x").isNotNull(), F.lit(1))}, window)
    assert got.columns == ["code", "date_idx", "x", "s", "n"]
    found = {(r.code, r.date_idx): (r.x, r.s, r.n) for r in got.collect()}
    assert len(found) == len(rows)
    for r in rows:
        own = [q.x for q in rows if q.code == r.code and r.date_idx - window < q.date_idx <= r.date_idx and q.x is not None]
        x, s, n = found[r.code, r.date_idx]
        assert (x, n) == (r.x, len(own) or None)
        assert s == (pytest.approx(sum(own), rel=1e-12, abs=1e-12 * max(map(abs, own))) if own else None)


@pytest.mark.parametrize("least", [None, 0, 3])
def test_either_way_gives_the_same(gappy, least):
    ways = [{(r.code, r.date_idx): (r.total, r.mean) for r in rolled(gappy, "x", 9, {"total": "sum", "mean": "mean"}, least, linear=way).collect()} for way in (False, True)]
    assert ways[0].keys() == ways[1].keys()
    for k, (total, mean) in ways[0].items():
        assert ways[1][k] == ((None, None) if total is None else (pytest.approx(total, rel=1e-9, abs=1e-3), pytest.approx(mean, rel=1e-9, abs=1e-3)))


def test_one_shuffle_and_no_sliding_frame(gappy):
    done = sliding_sums(gappy, {"s": F.col("x")}, 30)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sliding_sums(gappy.limit(0), {"s": F.col("x")}, 3).count() == 0
    with pytest.raises(ValueError, match="one position"):
        sliding_sums(gappy, {"s": F.col("x")}, 0)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_two_hundred_factors_in_one_plan(spark, method):
    rng = np.random.default_rng(9)
    names = [f"f{i:03d}" for i in range(200)]
    frame = pd.DataFrame(rng.integers(0, 40, (90, 200)).astype(float), columns=names)
    frame.loc[rng.random(90) < 0.2, names[:60]] = np.nan
    frame.loc[rng.random(90) < 0.3, names[50:55]] = np.nan
    frame[names[7]] = 3.0
    frame.insert(0, "date", np.repeat([1, 2, 3], 30))
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "date long, " + ", ".join(f"{n} double" for n in names))
    done = factor_correlation(rows, names[::-1], method, tile=64)
    assert len(done._jdf.queryExecution().executedPlan().toString().splitlines()) < 12
    got = {(r.date, r.f1, r.f2): r["corr"] for r in done.collect()}
    assert len(got) == 3 * 200 * 199 // 2
    for day, own in frame.groupby("date"):
        corr = own[names].corr(method)
        for i in range(0, 200, 3):
            for j in range(i + 1, 200):
                a, b = corr.iloc[i, j], got[day, names[i], names[j]]
                assert (a != a and b is None) or a == pytest.approx(b, abs=1e-9), (day, i, j)
    assert factor_correlation(rows.limit(0), names, method).count() == 0
