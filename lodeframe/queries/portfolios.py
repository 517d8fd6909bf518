"""Quantile portfolios and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import tidy
from lodeframe.operators import portfolio, returns, transforms
from lodeframe.plans.panels import Panels
from lodeframe.queries import query, r
from lodeframe.queries.ics import RET, base

N = 5


def bucket(source: str, target: str, x: str, keys: str, n: int, out: str) -> str:
    """CTE that adds an exact quantile bucket to the rows of another."""
    edge = f"CASE WHEN (m * k) % {n} = 0 THEN v[(m * k) // {n} + 1] ELSE v[(m * k) // {n} + 1] + (v[(m * k) // {n} + 2] - v[(m * k) // {n} + 1]) * (((m * k) % {n}) / {n}.0::DOUBLE) END"
    using = " AND ".join(f"e.{k.strip()} IS NOT DISTINCT FROM s.{k.strip()}" for k in keys.split(","))
    return f"""{target}_v AS (SELECT {keys}, list(CAST({x} AS DOUBLE) ORDER BY {x}) AS v, count(*) - 1 AS m FROM {source} WHERE {x} IS NOT NULL GROUP BY {keys}),
{target}_e AS (SELECT {keys}, list_distinct([{edge} FOR k IN range(0, {n} + 1)]) AS e FROM {target}_v),
{target} AS (
  SELECT s.*, CASE WHEN s.{x} IS NOT NULL AND len(e.e) >= 2 THEN CAST(greatest(1, len([y FOR y IN e.e IF y < s.{x}])) AS INTEGER) END AS {out}
  FROM {source} AS s LEFT JOIN {target}_e AS e ON {using})"""


_ROWS = "rows_ AS (SELECT * FROM base WHERE ret IS NOT NULL)"
_G = bucket("rows_", "gb", "price", "date", N, "grp")
_SINGLE = "groups_ AS (SELECT date, grp, sum(disc * ret) / sum(disc) AS ret FROM gb WHERE grp IS NOT NULL GROUP BY 1, 2)"


def single(p: Panels) -> DataFrame:
    return portfolio.quantile_portfolios(base(p), "price", N, weight="disc")


@query("SELECT date, code, b FROM bk", bucket("tied", "bk", "f", "date", 5, "b"))
def quantile_buckets(p: Panels) -> DataFrame:
    """Buckets of a factor with many ties; equal edges merge."""
    from lodeframe.functions.columns import quantile_bucket

    return quantile_bucket(p.tied, "f", 5, ["date"], "b").select("date", "code", "b")


@query(f"SELECT date, grp, {r('ret', 'ret')} FROM groups_", RET, _ROWS, _G, _SINGLE)
def group_single(p: Panels) -> DataFrame:
    """Weighted returns of quantile groups."""
    return single(p).select("date", "grp", tidy("ret").alias("ret"))


@query(f"SELECT date, CAST(c AS VARCHAR) AS cell, grp, {r('avg(ret)', 'ret')} FROM i2 WHERE c IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2, 3", RET, _ROWS, bucket("rows_", "i1", "volume", "date", 3, "c"), bucket("i1", "i2", "price", "date", 3, "grp"))
def group_independent(p: Panels) -> DataFrame:
    """A13."""
    found = portfolio.quantile_portfolios(base(p), "price", 3, "independent", ["volume"])
    return found.select("date", "cell", "grp", tidy("ret").alias("ret"))


_COND = "c1 AS (SELECT * REPLACE (CASE WHEN max(c) OVER (PARTITION BY date) IS NULL THEN 0 ELSE c END AS c) FROM i1)"


@query(
    f"SELECT date, CAST(c AS VARCHAR) AS cell, grp, {r('avg(ret)', 'ret')} FROM k2 WHERE grp IS NOT NULL GROUP BY 1, 2, 3",
    RET, _ROWS, bucket("rows_", "i1", "volume", "date", 3, "c"), _COND, "k1 AS (SELECT * FROM c1 WHERE c IS NOT NULL)", bucket("k1", "k2", "price", "date, c", 3, "grp"),
)
def group_conditional(p: Panels) -> DataFrame:
    """A14."""
    found = portfolio.quantile_portfolios(base(p), "price", 3, "conditional", ["volume"])
    return found.select("date", "cell", "grp", tidy("ret").alias("ret"))


@query(
    f"SELECT date, {r('sum(CASE WHEN grp = 3 THEN ret WHEN grp = 1 THEN -ret END)', 'hl')} FROM (SELECT date, c, grp, avg(ret) AS ret FROM i2 WHERE c IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2, 3) AS x GROUP BY 1",
    RET, _ROWS, bucket("rows_", "i1", "volume", "date", 3, "c"), bucket("i1", "i2", "price", "date", 3, "grp"),
)
def hl_return(p: Panels) -> DataFrame:
    """Highest less lowest group, summed over cells."""
    found = portfolio.high_minus_low(portfolio.quantile_portfolios(base(p), "price", 3, "independent", ["volume"]))
    return found.select("date", tidy("hl").alias("hl"))


@query(f"SELECT date, grp, {r('product(1 + coalesce(ret, 0)) OVER (PARTITION BY grp ORDER BY date)', 'nav')} FROM groups_", RET, _ROWS, _G, _SINGLE)
def nav(p: Panels) -> DataFrame:
    """W13."""
    return single(p).select("date", "grp", tidy(returns.net_asset_value("ret", "grp")).alias("nav"))


@query(f"SELECT grp, (SELECT count(DISTINCT date) FROM groups_) AS n, {r('avg(ret)', 'mean')}, {r('avg(ret) / (stddev_samp(ret) / sqrt((SELECT count(DISTINCT date) FROM groups_)))', 't')} FROM groups_ GROUP BY 1", RET, _ROWS, _G, _SINGLE)
def group_summary(p: Panels) -> DataFrame:
    """A16, A17, A21."""
    return portfolio.group_summary(single(p)).select("grp", "n", tidy("mean").alias("mean"), tidy("t").alias("t"))


@query(f"SELECT date, grp, {r('ret - avg(ret) OVER (PARTITION BY date)', 'above')} FROM groups_", RET, _ROWS, _G, _SINGLE)
def group_excess(p: Panels) -> DataFrame:
    """X14 on group returns."""
    return single(p).select("date", "grp", tidy(transforms.excess("ret", "date")).alias("above"))


_MONO = """ok AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM groups_ WHERE ret IS NOT NULL),
mr AS (SELECT date, grp, ret, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY date ORDER BY grp) AS rg FROM ok WHERE n >= 5),
md AS (SELECT date, CASE WHEN NOT isnan(corr(rg, rr)) THEN corr(rg, rr) END AS sp, regr_slope(ret, grp) AS sl FROM mr GROUP BY 1),
mk AS (SELECT a.date, sum(sign(b.ret - a.ret)) / nullif(sqrt(count(*) * sum(pow(sign(b.ret - a.ret), 2))), 0) AS kt FROM mr AS a JOIN mr AS b ON a.date = b.date AND a.grp < b.grp GROUP BY 1)"""


@query(
    f"""
SELECT {r('avg(sp)', 'spearman_mean')}, {r('CASE WHEN count(sp) >= 30 THEN avg(sp) / (stddev_samp(sp) / sqrt(count(sp))) END', 'spearman_t')}, {r('avg(CASE WHEN sp > 0 THEN 1.0 WHEN sp IS NOT NULL THEN 0.0 END)', 'win_rate')},
       {r('avg(sl)', 'slope_mean')}, {r('avg(kt)', 'kendall_mean')}, {r('CASE WHEN count(kt) >= 30 THEN avg(kt) / (stddev_samp(kt) / sqrt(count(kt))) END', 'kendall_t')}, {r('(SELECT t FROM sw)', 'slope_nw_t')}
FROM md LEFT JOIN mk ON mk.date = md.date""",
    RET, _ROWS, _G, _SINGLE, _MONO,
    """se AS (SELECT sl AS x, sl - avg(sl) OVER () AS e, count(*) OVER () AS n, row_number() OVER (ORDER BY date) AS i FROM md WHERE sl IS NOT NULL),
sg AS (SELECT k, sum(a.e * b.e) AS g, max(a.n) AS n, floor(4 * pow(max(a.n) / 100, 2.0 / 9)) AS l FROM se AS a JOIN (SELECT unnest(range(0, 25)) AS k) AS q ON true JOIN se AS b ON b.i = a.i - k GROUP BY 1),
sw AS (SELECT (SELECT avg(x) FROM se) / (sqrt(sum(CASE WHEN k = 0 THEN g WHEN k <= l THEN 2 * (1 - k / (l + 1)) * g ELSE 0 END)) / max(n)) AS t FROM sg)""",
)
def monotonicity(p: Panels) -> DataFrame:
    """R13."""
    found = portfolio.monotonicity(single(p), N)
    return found.select(*(tidy(c).alias(c) for c in found.columns))


@query(
    f"""
SELECT grp, n, {r('e - 1', 'total_return')}, {r('pow(e, 12.0 / n) - 1', 'annual_return')}, {r('s * sqrt(12)', 'volatility')}, {r('m / nullif(s, 0) * sqrt(12)', 'sharpe')}, {r('least(dd, 0)', 'max_drawdown')}
FROM (SELECT grp, count(*) AS n, max_by(nav, date) AS e, avg(ret) AS m, stddev_samp(ret) AS s, min(nav / greatest(peak, 1) - 1) AS dd
      FROM (SELECT *, max(nav) OVER (PARTITION BY grp ORDER BY date) AS peak FROM (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY grp ORDER BY date) AS nav FROM groups_) AS x) AS y GROUP BY 1) AS z""",
    RET, _ROWS, _G, _SINGLE,
)
def nav_performance(p: Panels) -> DataFrame:
    """W20, on our own definition."""
    found = returns.performance(single(p), "ret", ["grp"])
    return found.select("grp", "n", *(tidy(c).alias(c) for c in found.columns if c not in ("grp", "n")))
