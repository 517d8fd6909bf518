"""Panel operators: every query against its SQL, and rules on small panels against plain numpy and pandas."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from lodeframe.functions import columns, tails
from lodeframe.operators import calendar, ic, portfolio, pricing, regression, returns, series, transforms
from lodeframe.plans import composites, evaluate
from lodeframe.plans.panels import Panels
from lodeframe.queries import ORACLES, QUERIES, loading, regressions
from lodeframe.sources.store import FactorStore, parse_path

DAY = datetime.date
DAYS = [DAY(2024, 1, d) for d in (2, 3, 4, 5)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small).toPandas(), connect(small).execute(ORACLES[name]).df())


def panel(spark, rows, schema="date date, code long, x double, y double, w double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def gaps(spark):
    values = [1.0, None, 2.0, 5.0]
    rows = [(d, c, None if v is None else v * c, float(c), float(c - 2)) for c in (1, 2, 3, 4, 5) for d, v in zip(DAYS, values, strict=True) if not (c == 2 and d == DAYS[2])]
    return panel(spark, rows)


def by_key(df, column):
    return {(r["date"], r["code"]): r[column] for r in df.collect()}


def test_calendar_shift_and_row_shift_differ_over_a_gap(gaps):
    rows = calendar.with_date_idx(gaps.where("x is not null"))
    got = by_key(rows.withColumn("s", transforms.shift("x", 1)).withColumn("o", transforms.row_shift("x", 1)).select("date", "code", F.struct("s", "o").alias("v")), "v")
    assert tuple(got[DAYS[3], 2]) == (None, 2.0)
    assert tuple(got[DAYS[3], 1]) == (2.0, 2.0)


def test_ewm_as_pandas(spark):
    x = [1.0, None, 2.0]
    rows = calendar.dense_grid(panel(spark, [(d, 1, v, None, None) for d, v in zip(DAYS, x, strict=False)]))
    got = [(r.m, r.s) for r in transforms.ewm(rows, "x", 0.5, {"m": "mean", "s": "sum"}).orderBy("date").collect()]
    assert got == [(1.0, 1.0), (1.0, 0.5), (pytest.approx(1.8), 2.25)]


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.9, 0.999])
def test_ewm_over_many_blocks_as_pandas(spark, alpha):
    rng = np.random.default_rng(4)
    x = pd.Series(np.where(rng.random(700) < 0.2, np.nan, rng.normal(size=700)))
    x.iloc[:5] = np.nan
    frame = pd.DataFrame({"code": 1, "date_idx": np.arange(1, 701), "x": x}).astype({"x": object}).where(lambda f: f.notna(), None)
    got = transforms.ewm(spark.createDataFrame(frame, "code long, date_idx int, x double"), "x", alpha, {"m": "mean", "s": "sum"}).orderBy("date_idx").toPandas()
    np.testing.assert_allclose(got.m.to_numpy(float), x.ewm(alpha=alpha).mean(), rtol=1e-9)
    total, sums = 0.0, []
    for v in x:
        total = total * (1 - alpha) + (0.0 if np.isnan(v) else v)
        sums.append(total)
    np.testing.assert_allclose(got.s.to_numpy(float)[5:], sums[5:], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("linear", [False, True])
@pytest.mark.parametrize("xs", [["x"], ["x", "y"]])
def test_rolling_regression_as_numpy(spark, xs, linear):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame([(c, i, *rng.normal(size=3)) for c in (1, 2) for i in range(1, 40) if (c, i) != (2, 7)], columns=["code", "date_idx", "x", "y", "r"])
    frame.loc[3, "r"] = None
    frame.loc[frame.code == 2, "x"] = 1.5
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "code long, date_idx int, x double, y double, r double")
    got = regression.rolling_regression(rows.withColumn("date", F.col("date_idx")), "r", xs, window=10, least=6, linear=linear).toPandas()
    assert len(got) == len(frame) * (1 + len(xs))
    for (code, day), own in got.groupby(["code", "date"]):
        used = frame[(frame.code == code) & frame.date_idx.between(day - 9, day)].dropna()
        if len(used) < 6 or code == 2:  # a constant regressor has no slope
            assert own.beta.isna().all()
            assert own.t.isna().all()
            continue
        b, t, _, _ = ols(used[xs].to_numpy(), used.r.to_numpy(), hc=False)
        own = own.set_index("term").loc[["const", *xs]]
        np.testing.assert_allclose(own.beta, b, rtol=1e-8)
        np.testing.assert_allclose(own.t, t, rtol=1e-7)


def test_missing_and_constant_values(spark):
    rows = panel(spark, [(DAYS[0], c, 3.0, None, 1.0) for c in range(4)] + [(DAYS[1], 1, float("nan"), 1.0, 1.0), (DAYS[1], 2, float("inf"), 2.0, 0.0), (DAYS[2], 1, 7.0, 1.0, -1.0)])
    rows = columns.clean(rows)
    out = rows.select("date", "code", transforms.zscore("x").alias("z"), transforms.minmax("x").alias("m"), transforms.weightify("w").alias("w"), transforms.std_outlier("x", 1.0).alias("o")).collect()
    assert all(r.z is None and r.m is None for r in out)
    assert [r.o for r in out if r.date == DAYS[1]] == [None, None]
    got = portfolio.quantile_portfolios(rows.withColumn("ret", F.lit(0.1)), "x", 5)
    assert got.count() == 0
    assert ic.information_coefficient(rows.withColumn("ret", F.col("y")), ["x"]).where("ic is not null").count() == 0


@pytest.mark.parametrize("n", [2, 5, 10])
def test_buckets_as_qcut(spark, n):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"date": np.repeat(DAYS, 60), "code": np.tile(np.arange(60), 4), "x": np.concatenate([rng.normal(size=60), rng.integers(0, 4, 60), np.arange(60), np.ones(60)])})
    expected = frame.groupby("date").x.transform(lambda s: pd.qcut(s, n, labels=False, duplicates="drop") + 1 if s.nunique() > 1 else np.nan)
    got = columns.quantile_bucket(spark.createDataFrame(frame, "date date, code long, x double"), "x", n, ["date"], "b").toPandas().sort_values(["date", "code"]).b
    np.testing.assert_array_equal(got.to_numpy(float), expected.to_numpy(float))


def test_group_returns_fall_back_to_equal_weights(spark):
    rows = panel(spark, [(DAYS[0], c, float(c), 0.1 * c, w) for c, w in ((1, 0.0), (2, -1.0), (3, 1.0), (4, 3.0))])
    got = {r.grp: r.ret for r in portfolio.quantile_portfolios(rows.withColumn("ret", F.col("y")), "x", 2, weight="w").collect()}
    assert got == pytest.approx({1: 0.15, 2: (0.3 + 3 * 0.4) / 4})


def ols(x, y, w=None, hc=True):
    x = np.column_stack([np.ones(len(x)), x])
    s = np.ones(len(y)) if w is None else np.sqrt(w)
    x, y = x * s[:, None], y * s
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    n, p = x.shape
    v = inv @ (x.T * e**2) @ x @ inv * n / (n - p) if hc else inv * (e @ e) / (n - p)
    return b, b / np.sqrt(np.diag(v)), 1 - e @ e / ((y - y.mean()) ** 2).sum(), e


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(2)
    n = 400
    frame = pd.DataFrame({"date": [DAYS[i % 4] for i in range(n)], "code": np.arange(n), "a": rng.normal(50, 3, n), "b": rng.normal(size=n), "cap": rng.lognormal(3, 1, n), "ind": rng.integers(0, 4, n).astype(str)})
    frame["ret"] = 0.3 * frame.a - frame.b + rng.normal(size=n) * (1 + frame.b.abs()) + frame.ind.astype(int)
    return frame, spark.createDataFrame(frame).withColumn("date", F.to_date("date"))


@pytest.mark.parametrize("weight", [None, "cap"])
@pytest.mark.parametrize("cov", ["white", "none"])
def test_regression_as_numpy(noisy, weight, cov):
    frame, df = noisy
    got = regression.fit(df, "ret", ["a", "b"], ["date"], weight=weight, cov=cov).toPandas()
    for day, own in frame.groupby("date"):
        b, t, r2, _ = ols(own[["a", "b"]].to_numpy(), own.ret.to_numpy(), None if weight is None else own.cap.to_numpy(), cov == "white")
        g = got[got.date == day].set_index("term").loc[["const", "a", "b"]]
        np.testing.assert_allclose(g.beta, b, rtol=1e-7)
        np.testing.assert_allclose(g.t, t, rtol=1e-6)
        np.testing.assert_allclose(g.r2, r2, rtol=1e-7)


def test_newey_west_as_numpy(noisy):
    frame, df = noisy
    got = regression.fit(df.withColumn("one", F.lit(1)), "ret", ["a", "b"], ["one"], cov="nw", nw_lag=3, order="code").toPandas().set_index("term").loc[["const", "a", "b"]]
    x = np.column_stack([np.ones(len(frame)), frame[["a", "b"]]])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ frame.ret
    s = x * (frame.ret - x @ b).to_numpy()[:, None]
    meat = s.T @ s + sum((1 - k / 4) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in (1, 2, 3))
    np.testing.assert_allclose(got.t, b / np.sqrt(np.diag(inv @ meat @ inv)), rtol=1e-6)


def test_singular_and_short_groups_are_missing(spark):
    rows = panel(spark, [(DAYS[0], c, float(c), 2.0 * c, 1.0) for c in range(6)] + [(DAYS[1], c, float(c), float(c), 1.0) for c in range(2)])
    got = regression.fit(rows.withColumn("r", F.rand(1)), "r", ["x", "y"], ["date"], cov="white")
    assert got.where("beta is null").count() == got.count() == 6


def test_cross_sectional_model_as_numpy(noisy):
    frame, df = noisy
    df = df.withColumnRenamed("ind", "first_industry_code")
    found, specific = composites.barra_regression(df, ["a", "b"], min_codes=50)
    other, _ = composites.barra_regression(df, ["a", "b"], min_codes=50, base_rule="first")
    key = ["date", "term"]
    pd.testing.assert_frame_equal(found.toPandas().sort_values(key).reset_index(drop=True), other.toPandas().sort_values(key).reset_index(drop=True), rtol=1e-9)
    got, rest = found.toPandas(), specific.toPandas()
    for day, own in frame.groupby("date"):
        d = pd.get_dummies(own.ind).astype(float)
        share = own.groupby("ind").cap.sum() / own.cap.sum()
        base = share.idxmax()
        x = np.column_stack([np.ones(len(own)), own[["a", "b"]], d.drop(columns=base)])
        s = np.sqrt(own.cap.to_numpy())
        b = np.linalg.lstsq(x * s[:, None], own.ret * s, rcond=None)[0]
        level = pd.Series(0.0, d.columns)
        level[d.drop(columns=base).columns] = b[3:]
        shift = (level * share).sum()
        g = got[got.date == day].set_index("term").ret
        np.testing.assert_allclose(g["const"], b[0] + shift, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose([g["a"], g["b"]], b[1:3], rtol=1e-6)
        np.testing.assert_allclose([g[f"ind_{i}"] for i in level.index], level - shift, rtol=1e-6, atol=1e-8)
        assert abs(sum(g[f"ind_{i}"] * share[i] for i in share.index)) < 1e-9
        e = rest[rest.date == day].set_index("code").specific.loc[own.code]
        np.testing.assert_allclose(e, own.ret - x @ b, rtol=1e-6, atol=1e-8)


def test_pricing_as_numpy(spark):
    rng = np.random.default_rng(3)
    t, n = 120, 4
    f = rng.normal(0.01, 0.05, (t, 2))
    r = 0.002 + f @ rng.normal(size=(2, n)) + rng.normal(0, 0.02, (t, n))
    days = [DAY(2000, 1, 1) + datetime.timedelta(i) for i in range(t)]
    assets = spark.createDataFrame([(days[i], j, float(r[i, j])) for i in range(t) for j in range(n)], "date date, grp long, ret double")
    factors = spark.createDataFrame([(days[i], float(f[i, 0]), float(f[i, 1])) for i in range(t)], "date date, f double, g double")
    got = pricing.grs_test(assets, factors, ["f", "g"]).first()
    x = np.column_stack([np.ones(t), f])
    b = np.linalg.lstsq(x, r, rcond=None)[0]
    sigma, omega, mu = np.cov(r - x @ b, rowvar=False), np.cov(f, rowvar=False), f.mean(axis=0)
    assert got.grs == pytest.approx((t - n - 2) / n * b[0] @ np.linalg.solve(sigma, b[0]) / (1 + mu @ np.linalg.solve(omega, mu)), rel=1e-6)
    gmm = pricing.gmm_linear(assets, factors, ["f", "g"]).first()
    a, m = r.T @ f / t, r.mean(axis=0)
    first = np.linalg.lstsq(a, m, rcond=None)[0]
    w = np.linalg.pinv(np.cov(r * (1 - f @ first)[:, None], rowvar=False))
    price = np.linalg.solve(a.T @ w @ a, a.T @ w @ m)
    gap = m - a @ price
    assert gmm["lambda"] == pytest.approx(price.tolist(), rel=1e-5)
    assert gmm.j == pytest.approx(t * gap @ w @ gap, rel=1e-4)
    # the same in tiles of three portfolios, after a date that lacks one of them
    lacking = assets.union(spark.createDataFrame([(DAY(1999, 1, 1), 0, 0.5)], assets.schema))
    longer = factors.union(spark.createDataFrame([(DAY(1999, 1, 1), 0.1, 0.1)], factors.schema))
    tiled = pricing.grs_test(lacking, longer, ["f", "g"], tile=3).first()
    assert tiled.grs == pytest.approx(got.grs, rel=1e-9)
    assert (tiled.pvalue, tiled.n_dates, tiled.n_assets) == (pytest.approx(got.pvalue), t, n)
    tiled = pricing.gmm_linear(lacking, longer, ["f", "g"], tile=3).first()
    assert tiled["lambda"] == pytest.approx(price.tolist(), rel=1e-7)
    assert tiled.j == pytest.approx(t * gap @ w @ gap, rel=1e-7)
    one = pricing.gmm_linear(lacking, longer, ["f", "g"], two_step=False, tile=3).first()
    assert one.j == pytest.approx(t * ((m - a @ first) ** 2).sum(), rel=1e-7)
    # a portfolio that is there twice, no dates, too few dates
    twice = assets.union(assets.where("grp = 1").withColumn("grp", F.lit(9).cast("long")))
    assert pricing.grs_test(twice, factors, ["f", "g"], tile=2).first().grs is None
    assert pricing.gmm_linear(twice, factors, ["f", "g"], tile=2).first().j is None
    assert pricing.grs_test(assets, factors.limit(0), ["f"], tile=2).first().asDict() == {"grs": None, "pvalue": None, "n_dates": 0, "n_assets": n}
    assert pricing.gmm_linear(assets, factors.limit(0), ["f"], tile=2).count() == 0
    assert pricing.grs_test(assets, factors.where("date < '2000-01-05'"), ["f"], tile=2).first().grs is None


def test_pricing_of_many_portfolios(spark):
    """More portfolios than one task solves, in tiles of which the last is narrow, against numpy."""
    t, n = 1100, 600
    days = spark.range(t).select(F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date"), F.randn(5).alias("f"))
    assets = days.crossJoin(spark.range(n).withColumnRenamed("id", "grp")).select("date", "grp", F.expr("0.02 + 0.01 * (grp % 7) * f + 0.05 * (pmod(xxhash64(date, grp), 100001) / 50000 - 1)").alias("ret"))
    got = pricing.grs_test(assets, days, ["f"]).first()
    wide = assets.toPandas().pivot(index="date", columns="grp", values="ret").to_numpy()
    f = days.orderBy("date").toPandas().f.to_numpy()
    x = np.column_stack([np.ones(t), f])
    b = np.linalg.lstsq(x, wide, rcond=None)[0]
    e = wide - x @ b
    grs = (t - n - 1) / n * b[0] @ np.linalg.solve(e.T @ e / (t - 1), b[0]) / (1 + f.mean() ** 2 / f.var(ddof=1))
    assert (got.n_dates, got.n_assets) == (t, n)
    assert got.grs == pytest.approx(grs, rel=1e-7)


def test_white_test_as_numpy(noisy):
    frame, df = noisy
    rows = regression.residuals(df, "ret", ["a", "b"], ["date"])
    got = {r.date: (r.lm, r.df) for r in regression.white_test(rows, "resid", ["a", "b"], ["date"]).collect()}
    for day, own in frame.groupby("date"):
        x = own[["a", "b"]].to_numpy()
        e = ols(x, own.ret.to_numpy())[3]
        r2 = ols(np.column_stack([x, x**2, x[:, 0] * x[:, 1]]), e**2)[2]
        assert got[day] == (pytest.approx(len(own) * r2, rel=1e-4), 6)


@pytest.mark.parametrize(
    ("value", "expected"),
    [(tails.t_tail(2.228, 10), 0.05), (tails.t_tail(1.812, 10, "greater"), 0.05), (tails.t_tail(-1.812, 10, "less"), 0.05), (tails.chi2_tail(18.307, 10), 0.05), (tails.chi2_tail(3.841, 1), 0.05), (tails.f_tail(3.326, 5, 10), 0.05), (tails.f_tail(10.04, 1, 10), 0.01), (tails.chi2_tail(40.0, 10), 1.69447e-05)],
)
def test_tails_as_published_tables(value, expected):
    assert value == pytest.approx(expected, rel=2e-3)


def test_short_and_flat_series(spark):
    rows = panel(spark, [(d, 1, 0.0, None, None) for d in DAYS] + [(DAYS[0], 2, 1.0, None, None)])
    t = {r.code: (r.n, r.t) for r in regression.t_test(rows, "x", ["code"]).collect()}
    assert t == {1: (4, 0.0), 2: (1, None)}
    assert series.newey_west(rows, "x", ["code"]).where("nw_t is not null").count() == 0
    assert series.break_scan(rows, "x", ["code"]).count() == 0


def test_forward_return_and_inverted(spark):
    rows = panel(spark, [(d, 1, p, None, None) for d, p in zip(DAYS, (1.0, 2.0, 3.0, 6.0), strict=True)])
    got = rows.select("date", returns.forward_return("x").alias("r"), returns.forward_return("x", inverted=True).alias("i")).orderBy("date").collect()
    assert [r.r for r in got] == [0.5, 1.0, None, None]
    assert [r.i for r in got] == [pytest.approx(-1 / 3), -0.5, None, None]


@pytest.mark.parametrize(("path", "expected"), [("t/c", ("t", "c", "c")), ("t/c as d", ("t", "c", "d")), (" t / c  AS  d ", ("t", "c", "d"))])
def test_paths(path, expected):
    assert parse_path(path) == expected


@pytest.mark.parametrize("path", ["t", "t/", "/c", "a/b/c", "t/c as "])
def test_bad_paths(path):
    with pytest.raises(ValueError, match="expected table"):
        parse_path(path)


def test_store_contracts(spark, tmp_path, gaps):
    s = FactorStore(spark, str(tmp_path))
    assert s.latest_date("none") is None
    assert not s.register("none")
    assert [tuple(r) for r in s.date_gap("none", "none").collect()] == [(DAY(1900, 1, 1),) * 2]
    rows = gaps.select("date", "code", "x")
    s.save("t", rows)
    s.save("t", rows.where("code = 1").withColumn("x", F.lit(9.0)))
    got = by_key(s.table("t"), "x")
    assert len(got) == rows.count()
    assert {v for (_, c), v in got.items() if c == 1} == {9.0}
    assert (s.earliest_date("t"), s.latest_date("t")) == (DAYS[0], DAYS[-1])
    with pytest.raises(ValueError, match="repeat"):
        s.upsert("t", rows.unionByName(rows), ["date", "code"])
    with pytest.raises(ValueError, match="unknown table"):
        s.load("other/x").count()
    with pytest.raises(ValueError, match="join is one of"):
        s.load("t/x", join="cross")
    with pytest.raises(ValueError, match="use AS"):
        s.attach("u", rows).load(["t/x", "u/x"])
    with pytest.raises(ValueError, match="missing key"):
        s.save("t", rows.drop("code"))
    with pytest.raises(ValueError, match="lack the time column"):
        s.upsert("t", rows, ["code"])
    ordered = [(r.date, r.code) for r in s.load("t/x", ordered=True).collect()]
    assert ordered == sorted(ordered)


def test_empty_batches_leave_a_readable_table(spark, tmp_path, gaps):
    s, rows = FactorStore(spark, str(tmp_path)), gaps.select("date", "code", "x")
    s.save("t", rows.limit(0))
    assert (s.table("t").dtypes, s.table("t").count()) == ([("date", "date"), ("code", "bigint"), ("x", "double")], 0)
    assert s.latest_date("t") is None
    assert s.load("t/x").count() == 0
    s.save("t", rows)
    s.save("t", rows.limit(0))
    assert s.table("t").count() == rows.count()


def test_short_series_have_no_stability(spark):
    days = [DAY(2024, 1, 1) + datetime.timedelta(i) for i in range(80)]
    rng = np.random.default_rng(6)
    rows = panel(spark, [(d, c, float(rng.normal()), None, None) for c, n in ((1, 80), (2, 49)) for d in days[:n]])
    got = {r.code: r.asDict() for r in series.stability(rows, "x", ["code"], 12).collect()}
    assert {v for k, v in got[2].items() if k not in ("code", "n")} == {None}
    assert None not in got[1].values()
    one = rows.where("code = 1")
    assert got[1]["acf1"] == pytest.approx(series.autocorrelation(one, "x", ["code"]).first().acf1)
    assert got[1]["lb_q"] == pytest.approx(series.ljung_box(one, "x", ["code"]).first().lb_q)
    assert got[1]["break_date"] == series.break_scan(one, "x", ["code"]).first().break_date
    spread = series.rolling_stats(one, "x", ["code"], 12).agg(F.stddev_samp("roll_mean"), F.stddev_samp("roll_ir")).first()
    assert (got[1]["roll_mean_std"], got[1]["roll_ir_std"]) == (pytest.approx(spread[0]), pytest.approx(spread[1]))
    assert series.stability(one, "x", ["code"], 76).first().acf1 is None


def test_filters_and_columns_reach_the_scan(spark, small):
    p = Panels(spark, small)
    rows = p.lineitem.where("l_shipdate < date'1995-01-01'").select("l_suppkey", "l_tax")
    text = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate,1995-01-01)]" in text or "LessThan(l_shipdate" in text
    made = p.panel._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in made
    assert "l_tax" not in made


def test_windows_stay_in_the_engine_and_share_a_shuffle(spark, small):
    p = Panels(spark, small)
    rows = p.panel.select("date", "code", transforms.zscore("price").alias("a"), transforms.minmax("price").alias("b"), transforms.weightify("cap").alias("c"), transforms.std_outlier("price", 2).alias("d"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("Exchange hashpartitioning(date") == 1


def test_evaluation_with_baseline(spark, small):
    p = Panels(spark, small)
    got = evaluate.run_test(p.quotes, p.instruments, p.panel.select("date", "code", "disc", "cap"), ["disc"], groups=2, roll=12, baseline=["cap"])
    assert got.factors == ["disc", "disc_ortho"]
    assert got.incremental == ["disc_ortho"]
    assert {r.factor: r.restype for r in got.summary().select("factor", "restype").collect()} == {"disc": "raw", "disc_ortho": "inc"}
    apart = portfolio.quantile_portfolios(got.panel, "disc", 2, feasible="feasible").select("date", "grp", "ret").collect()
    assert sorted(got.tables["groups"].where("factor = 'disc'").select("date", "grp", "ret").collect()) == sorted(apart)
    got.close()


def test_queries_with_tail_probabilities(spark, small):
    """Queries without SQL: their rows from the table by numpy and the tested tail functions."""
    p = Panels(spark, small)
    rows = regressions.base(p).where("ret is not null").toPandas()
    got = {(r.date, r.term): r for r in QUERIES["cs_regression_multi"](spark, small).collect()}
    solved = 0
    for day, own in rows.groupby("date"):
        x = np.column_stack([own.price.astype(float), np.log(own.volume.astype(float)), own.disc])
        if len(own) < 6:
            continue
        b, t, r2, _ = ols(x, own.ret.to_numpy(), own.cap.to_numpy(float))
        for i, term in enumerate(["const", "price", "lv", "disc"]):
            solved += 1
            assert got[day, term].beta == pytest.approx(b[i], rel=1e-4, abs=2e-9)
            assert got[day, term].r2 == pytest.approx(r2, abs=1e-5)
    assert solved > 20
    for r in QUERIES["white_test"](spark, small).collect():
        assert r.pvalue is None if r.lm is None else r.pvalue == pytest.approx(tails.chi2_tail(r.lm, 3), abs=1e-5)
    for r in QUERIES["ic_pvalues"](spark, small).collect():
        i = regressions.ics_of(p).where(F.col("factor") == r.factor)
        t, q, b = regression.t_test(i, "ic", ["factor"]).first(), series.ljung_box(i, "ic", ["factor"]).first(), series.break_scan(i, "ic", ["factor"]).first()
        assert (r.t_p, r.greater_p, r.lb_p, r.break_p) == tuple(pytest.approx(v, abs=2e-6) for v in (tails.t_tail(t.t, t.n - 1), tails.t_tail(t.t, t.n - 1, "greater"), tails.chi2_tail(q.lb_q, q.lags), tails.t_tail(b.welch_t, b.welch_df)))
    groups = regressions.single(p).toPandas().pivot(index="date", columns="grp", values="ret")
    both = groups.join(regressions.hl(p).toPandas().set_index("date")).dropna()
    f, r4, r5 = both[["f"]].to_numpy(), both[[1, 2, 3, 4]].to_numpy(), both[[1, 2, 3, 4, 5]].to_numpy()
    n = len(both)
    x = np.column_stack([np.ones(n), f])
    b = np.linalg.lstsq(x, r4, rcond=None)[0]
    sigma = np.cov(r4 - x @ b, rowvar=False)
    grs = (n - 5) / 4 * b[0] @ np.linalg.solve(sigma, b[0]) / (1 + f.mean() ** 2 / f.var(ddof=1))
    assert QUERIES["grs"](spark, small).first().grs == pytest.approx(grs, rel=1e-3, abs=2e-6)
    a, m = r5.T @ f / n, r5.mean(axis=0)
    w = np.linalg.pinv(np.cov(r5 * (1 - f @ np.linalg.lstsq(a, m, rcond=None)[0])[:, None], rowvar=False))
    assert QUERIES["gmm"](spark, small).first().price == pytest.approx(float(np.linalg.solve(a.T @ w @ a, a.T @ w @ m)[0]), rel=1e-3)


def test_unstack_covers_the_whole_table(spark, small):
    p = Panels(spark, small)
    long = p.factor_a.select("date", "code", F.lit("price").alias("name"), F.col("price").alias("value"))
    wide = loading.unstack(long)
    assert sorted(map(int, wide.columns[2:])) == sorted(r.code for r in long.select("code").distinct().collect())
    assert wide.count() == long.select("date").distinct().count()
    keys = QUERIES["unstack_whole"](spark, small).select("date", "code", "name").toPandas()
    assert len(keys) == len(keys.drop_duplicates()) == 2 * long.count()


def test_stream_refresh_replaces_stored_rows(spark, small, monkeypatch):
    stored, upsert = [], FactorStore.upsert

    def watched(self, table, df, keys):
        old = self.table(table)
        stored.append(0 if old is None else old.join(df, keys, "left_semi").where("price = 0").count())
        upsert(self, table, df, keys)

    monkeypatch.setattr(FactorStore, "upsert", watched)
    for name in ("stream_refresh", "stream_refresh_whole"):
        stored.clear()
        rows = QUERIES[name](spark, small)
        assert rows.where("price = 0").isEmpty()
        assert stored == [0, rows.count()]


@pytest.mark.parametrize("name,table", [("upsert_merge_whole", "factor_a"), ("stream_refresh_whole", "panel")])
def test_whole_refresh_keeps_every_date(spark, small, name, table):
    assert QUERIES[name](spark, small).count() == getattr(Panels(spark, small), table).count()
