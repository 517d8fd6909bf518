"""Elementwise, cross-sectional and time transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import by, correlation, tidy
from lodeframe.operators import calendar as cal
from lodeframe.operators import order
from lodeframe.operators import transforms as t
from lodeframe.operators.sliding import rolled
from lodeframe.plans.panels import Panels
from lodeframe.queries import query, r

_GRID = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel) AS x),
grid AS (
  SELECT c.code, cal.date, cal.k, p.price, p.volume, p.disc
  FROM (SELECT DISTINCT code FROM panel) AS c CROSS JOIN cal LEFT JOIN panel AS p ON p.code = c.code AND p.date = cal.date)"""


def _cross(p: Panels, **columns: object) -> DataFrame:
    return p.panel.select("date", "code", *(tidy(c).alias(n) for n, c in columns.items()))


@query(
    f"""
SELECT date, code, {r('price + disc', 'plus')}, {r('CASE WHEN price IS NULL AND disc IS NULL THEN NULL ELSE coalesce(price, 0) - coalesce(disc, 0) END', 'minus')},
       {r('price * disc', 'times')}, {r('price / nullif(disc, 0)', 'ratio')}
FROM factor_a FULL JOIN factor_b USING (date, code)"""
)
def x_arith(p: Panels) -> DataFrame:
    """Arithmetic on outer-aligned keys, one with a fill."""
    a = p.factor_a.select("date", "code", F.col("price").alias("v"))
    b = p.factor_b.select("date", "code", F.col("disc").alias("v"))
    out = None
    for op, name, fill in (("add", "plus", None), ("sub", "minus", 0.0), ("mul", "times", None), ("div", "ratio", None)):
        part = t.arithmetic(a, b, op, "v", fill=fill).select("date", "code", tidy("v").alias(name))
        out = part if out is None else out.join(part, ["date", "code"], "full")
    return out


@query(
    """
SELECT date, code, CASE WHEN disc > 0.05 THEN price END AS kept, CASE WHEN coalesce(disc > 0.05, false) THEN -1.0 ELSE price END AS masked,
       coalesce(CASE WHEN disc > 0.05 THEN price END, 0.0) AS filled, abs(disc - 0.05) AS away
FROM panel"""
)
def x_mask_where(p: Panels) -> DataFrame:
    """Where, mask, fill, absolute."""
    cond = F.col("disc") > 0.05
    return p.panel.select("date", "code", t.where("price", cond).alias("kept"), t.mask("price", cond, -1.0).alias("masked"), t.fill(t.where("price", cond)).alias("filled"), t.absolute(F.col("disc") - 0.05).alias("away"))


@query(f"SELECT date, code, {r('ln(price + 1e-6 - min(price) OVER d)', 'lg')}, {r('sqrt(price - min(price) OVER d)', 'root')} FROM panel WINDOW d AS (PARTITION BY date)")
def x_log_sqrt(p: Panels) -> DataFrame:
    """X3, X4."""
    return _cross(p, lg=t.shifted_log("price"), root=t.shifted_sqrt("price"))


@query(f"SELECT date, code, {r('(price - avg(price) OVER d) / nullif(stddev_samp(price) OVER d, 0)', 'z')} FROM panel WINDOW d AS (PARTITION BY date)")
def x_zscore(p: Panels) -> DataFrame:
    """X5."""
    return _cross(p, z=t.zscore("price"))


@query(f"SELECT date, code, {r('(price - sum(w * price) OVER d) / nullif(stddev_samp(price) OVER d, 0)', 'z')} FROM (SELECT *, disc / 10 AS w FROM panel) AS x WINDOW d AS (PARTITION BY date)")
def x_wscore(p: Panels) -> DataFrame:
    """X6."""
    return _cross(p, z=t.wscore("price", F.col("disc") / 10))


@query(
    f"""
SELECT date, code, {r('CASE WHEN w IS NOT NULL THEN (price - mean) / nullif(sqrt(greatest(sq - mean * mean, 0)), 0) END', 'z')}
FROM (SELECT date, code, price, w, sum(w * price) OVER d / sum(w) OVER d AS mean, sum(w * price * price) OVER d / sum(w) OVER d AS sq
      FROM (SELECT date, code, price, CASE WHEN disc - 0.03 > 0 THEN disc - 0.03 END AS w FROM panel) AS x WINDOW d AS (PARTITION BY date)) AS y"""
)
def x_weighted_z(p: Panels) -> DataFrame:
    """Weights that are not positive drop out."""
    return _cross(p, z=t.weighted_zscore("price", F.col("disc") - 0.03))


@query(f"SELECT date, code, {r('(price - min(price) OVER d) / nullif(max(price) OVER d - min(price) OVER d, 0)', 'u')} FROM panel WINDOW d AS (PARTITION BY date)")
def x_minmax(p: Panels) -> DataFrame:
    """X8."""
    return _cross(p, u=t.minmax("price"))


_MAD = """mid AS (SELECT date, code, price, median(price) OVER (PARTITION BY date) AS m FROM panel),
dev AS (SELECT *, median(abs(price - m)) OVER (PARTITION BY date) AS mad FROM mid)"""


@query(f"SELECT date, code, {r('least(greatest(price, m - 2 * mad), m + 2 * mad)', 'clipped')}, {r('CASE WHEN price BETWEEN m - 2 * mad AND m + 2 * mad THEN price END', 'dropped')} FROM dev", _MAD)
def x_mad(p: Panels) -> DataFrame:
    """Clipped and dropped."""
    rows = t.mad_outlier(t.mad_outlier(p.panel, "price", 2.0, out="clipped"), "price", 2.0, drop=True, out="dropped")
    return rows.select("date", "code", tidy("clipped").alias("clipped"), tidy("dropped").alias("dropped"))


_LINES = """li AS (SELECT l_orderkey AS o, l_linenumber AS l, l_extendedprice AS x, CASE WHEN l_linenumber <= 3 THEN CAST(l_quantity AS DOUBLE) END AS q FROM lineitem),
mm AS (SELECT median(x) AS m FROM li), dd AS (SELECT median(abs(x - m)) AS d FROM li, mm)"""


@query(
    f"""
SELECT o, l, rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS down,
       CASE WHEN q IS NOT NULL THEN rank() OVER (PARTITION BY q IS NULL ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 END AS tied,
       {r('least(greatest(x, m - 2 * d), m + 2 * d)', 'clipped')}
FROM li, mm, dd""",
    _LINES,
)
def order_one_date(p: Panels) -> DataFrame:
    """W4, W5, X9 of all order lines as one date, in ranges of values: ranks of spread and of tied values, median bounds."""
    rows = p.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("x"), F.when(F.col("l_linenumber") <= 3, F.col("l_quantity").cast("double")).alias("q"), F.lit(1).alias("date"))
    x, q = (order.distribution(rows, c, ["date"]) for c in "xq")
    rows = order.with_ranks(rows, "x", ["date"], "down", ascending=False, known=x)
    rows = order.with_ranks(rows, "q", ["date"], "tied", known=q)
    rows = order.with_median_bounds(rows, "x", 2.0, ["date"], "clipped", known=x)
    return rows.select("o", "l", "down", "tied", tidy("clipped").alias("clipped"))


@query(f"SELECT date, code, {r('least(greatest(price, m - 1.5 * s), m + 1.5 * s)', 'clipped')} FROM (SELECT date, code, price, avg(price) OVER d AS m, stddev_samp(price) OVER d AS s FROM panel WINDOW d AS (PARTITION BY date)) AS x")
def x_std_clip(p: Panels) -> DataFrame:
    """X10."""
    return _cross(p, clipped=t.std_outlier("price", 1.5))


@query(f"SELECT date, code, {r('least(greatest(price, lo), hi)', 'clipped')} FROM (SELECT date, code, price, quantile_cont(price, 0.05) OVER d AS lo, quantile_cont(price, 0.95) OVER d AS hi FROM panel WINDOW d AS (PARTITION BY date)) AS x")
def x_quantile_clip(p: Panels) -> DataFrame:
    """X11."""
    return _cross(p, clipped=t.quantile_outlier("price", 0.1))


@query(f"SELECT date, code, {r('cap / sum(cap) OVER d', 'w')} FROM panel WINDOW d AS (PARTITION BY date)")
def x_weightify(p: Panels) -> DataFrame:
    """X12."""
    return _cross(p, w=t.weightify("cap"))


@query(f"SELECT date, code, {r('1.0 / count(*) OVER d', 'w')} FROM panel WINDOW d AS (PARTITION BY date)")
def equal_weight(p: Panels) -> DataFrame:
    """X13."""
    return _cross(p, w=t.equal_weight())


@query(
    f"""
SELECT g.code, g.date, {r('lag(price, 2) OVER c', 'back')}, {r('lead(price, 1) OVER c', 'ahead')}, {r('price - lag(price, 1) OVER c', 'change')},
       {r('CASE WHEN k = 1 THEN price ELSE price - lag(price, 1) OVER c END', 'levelled')}, {r('own', 'own')}
FROM grid AS g LEFT JOIN (SELECT date, code, lag(price) OVER (PARTITION BY code ORDER BY date) AS own FROM panel) AS o ON o.date = g.date AND o.code = g.code
WINDOW c AS (PARTITION BY g.code ORDER BY g.k) QUALIFY price IS NOT NULL""",
    _GRID,
)
def w_shift_diff(p: Panels) -> DataFrame:
    """Calendar shift against row shift."""
    rows = cal.with_date_idx(p.panel)
    columns = {"back": t.shift("price", 2), "ahead": t.shift("price", -1), "change": t.diff("price"), "levelled": t.diff("price", first_keeps_level=True), "own": t.row_shift("price", 1)}
    return rows.select("code", "date", *(tidy(c).alias(n) for n, c in columns.items()))


@query(
    f"""
SELECT code, date, {r('CASE WHEN count(price) OVER c >= 6 THEN sum(price) OVER c END', 'total')}, {r('CASE WHEN count(price) OVER c >= 6 THEN avg(price) OVER c END', 'mean')}
FROM grid WINDOW c AS (PARTITION BY code ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    _GRID,
)
def w_rolling(p: Panels) -> DataFrame:
    """Six calendar dates, all present."""
    grid = cal.dense_grid(p.panel)
    return grid.select("code", "date", tidy(t.rolling("price", 6, "sum")).alias("total"), tidy(t.rolling("price", 6)).alias("mean"))


@query(
    f"""
SELECT code, date, {r('CASE WHEN count(price) OVER c >= 20 THEN sum(price) OVER c END', 'total')}, {r('CASE WHEN count(price) OVER c >= 20 THEN avg(price) OVER c END', 'mean')}
FROM grid WINDOW c AS (PARTITION BY code ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    _GRID,
)
def w_rolling_long(p: Panels) -> DataFrame:
    """Fifty calendar dates, twenty present at least, by sums over blocks."""
    rows = rolled(cal.dense_grid(p.panel), "price", 50, {"total": "sum", "mean": "mean"}, min_periods=20, linear=True)
    return rows.select("code", "date", tidy("total").alias("total"), tidy("mean").alias("mean"))


@query(
    f"""
SELECT code, date, {r('CASE WHEN count(price) OVER c >= 4 THEN sum(price) OVER c END', 'total')}, {r('CASE WHEN count(price) OVER c >= 4 THEN avg(price) OVER c END', 'mean')}
FROM grid WINDOW c AS (PARTITION BY code ORDER BY k)""",
    _GRID,
)
def w_expanding(p: Panels) -> DataFrame:
    """W7, W8 over all dates so far, four at least."""
    grid = cal.dense_grid(p.panel)
    return grid.select("code", "date", tidy(t.rolling("price", -4, "sum")).alias("total"), tidy(t.rolling("price", -4)).alias("mean"))


@query(
    f"""
SELECT code, date, {r('CASE WHEN w > 0 THEN s END', 'total')}, {r('CASE WHEN w > 0 THEN s / w END', 'mean')} FROM ew""",
    _GRID,
    """RECURSIVE ew AS (
  SELECT code, date, k, coalesce(price, 0.0) AS s, CASE WHEN price IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS w FROM grid WHERE k = 1
  UNION ALL
  SELECT g.code, g.date, g.k, s * 0.7::DOUBLE + coalesce(g.price, 0.0), w * 0.7::DOUBLE + CASE WHEN g.price IS NULL THEN 0.0 ELSE 1.0 END
  FROM ew JOIN grid AS g ON g.code = ew.code AND g.k = ew.k + 1)""",
)
def w_ewm(p: Panels) -> DataFrame:
    """Exponentially weighted sum and mean."""
    rows = t.ewm(cal.dense_grid(p.panel), "price", 0.3, {"total": "sum", "mean": "mean"})
    return rows.select("code", "date", tidy("total").alias("total"), tidy("mean").alias("mean"))


@query(f"SELECT code, date, {r('CASE WHEN price IS NOT NULL THEN sum(price) OVER (PARTITION BY code ORDER BY k) END', 'total')} FROM grid", _GRID)
def w_cumsum(p: Panels) -> DataFrame:
    """W11."""
    return cal.dense_grid(p.panel).select("code", "date", tidy(t.cumsum("price")).alias("total"))


@query(f"SELECT code, date, {r('CASE WHEN disc IS NOT NULL THEN product(1 + disc) OVER (PARTITION BY code ORDER BY k) END', 'total')} FROM grid", _GRID)
def w_cumprod(p: Panels) -> DataFrame:
    """W12."""
    grid = cal.dense_grid(p.panel).withColumn("g", 1 + F.col("disc"))
    return grid.select("code", "date", tidy(t.cumprod("g")).alias("total"))


@query(
    """
SELECT date, code, rank() OVER (PARTITION BY code ORDER BY f DESC) + (count(*) OVER (PARTITION BY code, f) - 1) / 2.0 AS over_time,
       rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS across
FROM tied"""
)
def w_rank(p: Panels) -> DataFrame:
    """Average ranks over time (descending) and across codes."""
    return p.tied.select("date", "code", t.rank_over_time("f").alias("over_time"), t.rank_across("f", ascending=True).alias("across"))


@query(
    f"""
SELECT 'code' AS axis, CAST(code AS VARCHAR) AS label, {r('coalesce(sum(price), 0)', 'total')}, {r('avg(price)', 'mean')} FROM factor_a GROUP BY code
UNION ALL SELECT 'date', CAST(date AS VARCHAR), {r('coalesce(sum(price), 0)')}, {r('avg(price)')} FROM factor_a GROUP BY date"""
)
def a_sum_mean(p: Panels) -> DataFrame:
    """A1, A2: by code and by date."""
    out = [p.factor_a.groupBy(axis).agg(tidy(F.coalesce(F.sum("price"), F.lit(0.0))).alias("total"), tidy(F.avg("price")).alias("mean")).select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("label"), "total", "mean") for axis in ("code", "date")]
    return out[0].unionByName(out[1])


@query(
    f"""
SELECT 'code' AS axis, CAST(code AS VARCHAR) AS label, {r('CASE WHEN NOT isnan(corr(price, disc)) THEN corr(price, disc) END', 'c')} FROM panel GROUP BY code
UNION ALL SELECT 'date', CAST(date AS VARCHAR), {r('CASE WHEN NOT isnan(corr(price, disc)) THEN corr(price, disc) END')} FROM panel GROUP BY date"""
)
def a_corr_axis(p: Panels) -> DataFrame:
    """A3: correlation by code and by date."""
    out = [p.panel.groupBy(axis).agg(tidy(correlation("price", "disc")).alias("c")).select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("label"), "c") for axis in ("code", "date")]
    return out[0].unionByName(out[1])


@query(f"SELECT date, code, {r('price - avg(price) OVER (PARTITION BY date, code % 5)', 'above')} FROM panel")
def excess_group(p: Panels) -> DataFrame:
    """Excess over the mean of a group."""
    return p.panel.withColumn("g", F.col("code") % 5).select("date", "code", tidy(t.excess("price", "date", "g")).alias("above"))
