"""Cross-sectional, time-series and rolling regressions; pricing and specification tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import tidy
from lodeframe.functions.tails import chi2_pvalue, t_pvalue
from lodeframe.operators import calendar as cal
from lodeframe.operators import portfolio, pricing, regression, series
from lodeframe.plans.panels import Panels
from lodeframe.queries import query, r
from lodeframe.queries.ics import IC, LONG, RET, base, ics_of
from lodeframe.queries.portfolios import _G, _ROWS, _SINGLE, N, single
from lodeframe.session import kept

_CS = """cs AS (
  SELECT date, n, b, my - b * mx AS a, r2 FROM (SELECT date, count(*) AS n, regr_slope(ret, disc) AS b, avg(disc) AS mx, avg(ret) AS my, regr_r2(ret, disc) AS r2 FROM base WHERE ret IS NOT NULL GROUP BY 1) AS x WHERE n >= 3),
ce AS (SELECT base.date, disc AS x, ret - a - b * disc AS e FROM base JOIN cs ON cs.date = base.date WHERE ret IS NOT NULL),
cv AS (
  SELECT date, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(e * e) AS m0, sum(e * e * x) AS m1, sum(e * e * x * x) AS m2 FROM ce GROUP BY 1),
ct AS (
  SELECT cs.date, cs.n, a, b, r2, sqrt(cs.n / (cs.n - 2) * (sxx * sxx * m0 - 2 * sxx * sx * m1 + sx * sx * m2)) / (cs.n * sxx - sx * sx) AS sa,
         sqrt(cs.n / (cs.n - 2) * (sx * sx * m0 - 2 * cs.n * sx * m1 + cs.n * cs.n * m2)) / (cs.n * sxx - sx * sx) AS sb
  FROM cs JOIN cv ON cv.date = cs.date)"""


@query(f"SELECT date, 'const' AS term, {r('a', 'beta')}, {r('a / sa', 't')}, {r('r2', 'r2')}, n FROM ct UNION ALL SELECT date, 'disc', {r('b')}, {r('b / sb')}, {r('r2')}, n FROM ct", RET, _CS)
def cs_regression_1f(p: Panels) -> DataFrame:
    """One factor, White HC1."""
    out = regression.cross_sectional(base(p), ["disc"]).where("beta is not null")
    return out.select("date", "term", tidy("beta").alias("beta"), tidy("t").alias("t"), tidy("r2").alias("r2"), "n")


@query()
def cs_regression_multi(p: Panels) -> DataFrame:
    """R4 with several factors and weights; tested against numpy."""
    out = regression.cross_sectional(base(p).withColumn("lv", F.log("volume")), ["price", "lv", "disc"], weight="cap")
    return out.select("date", "term", tidy("beta", 9).alias("beta"), tidy("t").alias("t"), tidy("r2").alias("r2"), "n")


def nw_sql(source: str, lag: int) -> str:
    """CTEs for mean and Newey-West t of ``x`` by ``term`` in date order."""
    return f"""ne AS (SELECT term, x, x - avg(x) OVER (PARTITION BY term) AS e, row_number() OVER (PARTITION BY term ORDER BY date) AS i FROM {source}),
ng AS (SELECT a.term, k, sum(a.e * b.e) AS g FROM ne AS a JOIN (SELECT unnest(range(0, {lag + 1})) AS k) AS q ON true JOIN ne AS b ON b.term = a.term AND b.i = a.i - k GROUP BY 1, 2),
nt AS (SELECT term, count(*) AS n, avg(x) AS mean FROM ne GROUP BY 1),
nf AS (SELECT nt.term, nt.n, mean, mean / (sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / {lag + 1}.0) * g END)) / nt.n) AS t FROM nt JOIN ng ON ng.term = nt.term GROUP BY nt.term, nt.n, mean)"""


@query(f"SELECT term, n, {r('mean', 'mean')}, {r('t', 'nw_t')} FROM nf", RET, _CS, "fp AS (SELECT date, 'const' AS term, a AS x FROM ct UNION ALL SELECT date, 'disc', b FROM ct)", nw_sql("fp", 3))
def fama_macbeth(p: Panels) -> DataFrame:
    """R3, R5."""
    out = regression.fama_macbeth(regression.cross_sectional(base(p), ["disc"], cov="none"), 3)
    return out.select("term", "n", tidy("mean").alias("mean"), tidy("nw_t").alias("nw_t"))


_HL = "hl AS (SELECT date, sum(CASE WHEN grp = 5 THEN w WHEN grp = 1 THEN -w END) AS f FROM (SELECT date, grp, sum(disc * ret) / sum(disc) AS w FROM gb WHERE grp IS NOT NULL GROUP BY 1, 2) AS x GROUP BY 1)"


def hl(p: Panels) -> DataFrame:
    return portfolio.high_minus_low(single(p)).withColumnRenamed("hl", "f")


def groups_and_hl(p: Panels) -> tuple[DataFrame, DataFrame]:
    """Group returns and the highest less the lowest of them, both from one evaluation: pricing tests read them many times.

    Forward returns are written, not the panel: buckets read them twice and need no column more.
    """
    rows = kept(base(p).where("ret is not null").select("date", "price", "disc", "ret"))
    groups = kept(portfolio.quantile_portfolios(rows, "price", N, weight="disc"))
    return groups, kept(portfolio.high_minus_low(groups).withColumnRenamed("hl", "f"))


@query(
    f"""
SELECT code, 'const' AS term, {r('a', 'beta')}, n FROM ts UNION ALL SELECT code, 'f', {r('b')}, n FROM ts""",
    RET, _ROWS, _G, _HL,
    "ts AS (SELECT code, count(*) AS n, regr_slope(ret, f) AS b, regr_intercept(ret, f) AS a FROM base JOIN hl ON hl.date = base.date WHERE ret IS NOT NULL AND f IS NOT NULL GROUP BY 1)",
)
def ts_regression_1f(p: Panels) -> DataFrame:
    """Every code on the high-minus-low return."""
    out = regression.time_series(base(p), hl(p), ["f"])
    return out.select("code", "term", tidy("beta").alias("beta"), "n")


@query(
    f"""
SELECT code, date, {r('CASE WHEN n >= 6 THEN b END', 'beta')}
FROM (SELECT b.code, b.date, count(f + ret) OVER w AS n, regr_slope(CASE WHEN f IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN f END) OVER w AS b
      FROM (SELECT base.*, dense_rank() OVER (ORDER BY base.date) AS k FROM base) AS b LEFT JOIN hl ON hl.date = b.date WINDOW w AS (PARTITION BY b.code ORDER BY k RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) AS x""",
    RET, _ROWS, _G, _HL,
)
def rolling_beta(p: Panels) -> DataFrame:
    """Twelve dates, six at least."""
    rows = cal.with_date_idx(base(p)).join(hl(p), "date", "left")
    out = regression.rolling_regression(rows, "ret", ["f"], window=12, least=6).where("term = 'f'")
    return out.select("code", "date", tidy("beta").alias("beta"))


@query(
    f"""
SELECT code, date, {r('CASE WHEN n >= 30 THEN b END', 'beta')}
FROM (SELECT b.code, b.date, count(f + ret) OVER w AS n, regr_slope(CASE WHEN f IS NOT NULL THEN ret END, CASE WHEN ret IS NOT NULL THEN f END) OVER w AS b
      FROM (SELECT base.*, dense_rank() OVER (ORDER BY base.date) AS k FROM base) AS b LEFT JOIN hl ON hl.date = b.date WINDOW w AS (PARTITION BY b.code ORDER BY k RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)) AS x""",
    RET, _ROWS, _G, _HL,
)
def rolling_beta_long(p: Panels) -> DataFrame:
    """Sixty dates, thirty at least, by sums over blocks."""
    rows = cal.with_date_idx(base(p)).join(hl(p), "date", "left")
    out = regression.rolling_regression(rows, "ret", ["f"], window=60, least=30, linear=True).where("term = 'f'")
    return out.select("code", "date", tidy("beta").alias("beta"))


@query(f"SELECT date, code, {r('price - my - b * (disc - mx)', 'ortho')} FROM (SELECT date, code, price, disc, regr_slope(price, disc) OVER d AS b, avg(disc) OVER d AS mx, avg(price) OVER d AS my FROM panel WINDOW d AS (PARTITION BY date)) AS x")
def ortho_residual(p: Panels) -> DataFrame:
    """One baseline."""
    return regression.orthogonalise(p.panel, "price", ["disc"]).select("date", "code", tidy("price_ortho").alias("ortho"))


@query()
def grs(p: Panels) -> DataFrame:
    """Quantile groups on the high-minus-low return; tested against numpy."""
    groups, f = groups_and_hl(p)
    out = pricing.grs_test(groups.where("grp < 5"), f, ["f"])
    return out.select(tidy("grs").alias("grs"), tidy("pvalue").alias("pvalue"), "n_dates", "n_assets")


@query()
def gmm(p: Panels) -> DataFrame:
    """R9; tested against numpy."""
    groups, f = groups_and_hl(p)
    out = pricing.gmm_linear(groups, f, ["f"])
    return out.select(tidy(F.col("lambda")[0]).alias("price"), tidy("j").alias("j"), tidy("pvalue").alias("pvalue"))


@query(
    f"""
SELECT {r('CASE WHEN t > 2 THEN t - 2 ELSE t END * alpha * alpha / ((crr - cfr * cfr / cff) / (t - 1)) / (1 + mf * mf / (cff / (t - 1)))', 'grs')}, t AS n_dates, CAST(1 AS BIGINT) AS n_assets
FROM (SELECT *, mr - cfr / cff * mf AS alpha
      FROM (SELECT count(*) AS t, avg(ret) AS mr, avg(f) AS mf, regr_syy(ret, f) AS crr, regr_sxx(ret, f) AS cff, regr_sxy(ret, f) AS cfr
            FROM groups_ JOIN hl ON hl.date = groups_.date WHERE grp = 3 AND ret IS NOT NULL AND f IS NOT NULL) AS x) AS y""",
    RET, _ROWS, _G, _SINGLE, _HL,
)
def grs_one(p: Panels) -> DataFrame:
    """R8 of one portfolio, where the statistic has a closed form."""
    groups, f = groups_and_hl(p)
    out = pricing.grs_test(groups.where("grp = 3"), f, ["f"])
    return out.select(tidy("grs").alias("grs"), "n_dates", "n_assets")


@query(
    f"""
SELECT {r("(t - 3) / 2.0 * (t - 1) * (a2 * a2 * e44 - 2 * a2 * a4 * e24 + a4 * a4 * e22) / (e22 * e44 - e24 * e24) / (1 + (t - 1) * mf * mf / cff)", 'grs')}, t AS n_dates, CAST(2 AS BIGINT) AS n_assets
FROM (SELECT t, mf, cff, m2 - c2f / cff * mf AS a2, m4 - c4f / cff * mf AS a4, c22 - c2f * c2f / cff AS e22, c44 - c4f * c4f / cff AS e44, c24 - c2f * c4f / cff AS e24
      FROM (SELECT count(*) AS t, avg(f) AS mf, regr_sxx(two.ret, f) AS cff, avg(two.ret) AS m2, avg(four.ret) AS m4, regr_sxy(two.ret, f) AS c2f, regr_sxy(four.ret, f) AS c4f,
                   regr_syy(two.ret, f) AS c22, regr_syy(four.ret, f) AS c44, regr_sxy(two.ret, four.ret) AS c24
            FROM groups_ AS two JOIN groups_ AS four ON four.date = two.date JOIN hl ON hl.date = two.date
            WHERE two.grp = 2 AND four.grp = 4 AND two.ret IS NOT NULL AND four.ret IS NOT NULL AND f IS NOT NULL) AS x) AS y""",
    RET, _ROWS, _G, _SINGLE, _HL,
)
def grs_two(p: Panels) -> DataFrame:
    """R8 of two portfolios, a tile each."""
    groups, f = groups_and_hl(p)
    out = pricing.grs_test(groups.where("grp in (2, 4)"), f, ["f"], tile=1)
    return out.select(tidy("grs").alias("grs"), "n_dates", "n_assets")


@query(
    f"""
SELECT {r('price', 'price')}, {r('t * (power(b1 - a1 * price, 2) + power(b5 - a5 * price, 2))', 'j')}
FROM (SELECT *, (a1 * b1 + a5 * b5) / (a1 * a1 + a5 * a5) AS price
      FROM (SELECT count(*) AS t, avg(one.ret * f) AS a1, avg(five.ret * f) AS a5, avg(one.ret) AS b1, avg(five.ret) AS b5
            FROM groups_ AS one JOIN groups_ AS five ON five.date = one.date JOIN hl ON hl.date = one.date
            WHERE one.grp = 1 AND five.grp = 5 AND one.ret IS NOT NULL AND five.ret IS NOT NULL AND f IS NOT NULL) AS x) AS y""",
    RET, _ROWS, _G, _SINGLE, _HL,
)
def gmm_two(p: Panels) -> DataFrame:
    """R9 of two portfolios in one step, where price and statistic have a closed form."""
    groups, f = groups_and_hl(p)
    out = pricing.gmm_linear(groups.where("grp in (1, 5)"), f, ["f"], two_step=False)
    return out.select(tidy(F.col("lambda")[0]).alias("price"), tidy("j").alias("j"))


@query(
    f"""
SELECT date, term, {r("CASE term WHEN 'const' THEN my - b1 * m1 - b2 * m2 WHEN 'disc' THEN b1 ELSE b2 END", 'beta')}, {r('(b1 * s1y + b2 * s2y) / syy', 'r2')}, n
FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
      FROM (SELECT date, count(*) AS n, avg(disc) AS m1, avg(lv) AS m2, avg(ret) AS my, regr_sxx(ret, disc) AS s11, regr_sxx(ret, lv) AS s22, regr_sxy(disc, lv) AS s12,
                   regr_sxy(ret, disc) AS s1y, regr_sxy(ret, lv) AS s2y, regr_syy(ret, disc) AS syy
            FROM (SELECT date, disc, ln(volume) AS lv, ret FROM base WHERE ret IS NOT NULL) AS w GROUP BY 1) AS x WHERE n >= 4) AS y, (VALUES ('const'), ('disc'), ('lv')) AS k(term)""",
    RET,
)
def cs_regression_two(p: Panels) -> DataFrame:
    """R1, R4 of two factors, by closed form in SQL."""
    out = regression.cross_sectional(base(p).withColumn("lv", F.log("volume")), ["disc", "lv"], cov="none").where("beta is not null")
    return out.select("date", "term", tidy("beta").alias("beta"), tidy("r2").alias("r2"), "n")


def white(p: Panels) -> DataFrame:
    rows = regression.residuals(base(p).where("ret is not null"), "ret", ["disc"], ["date"])
    return regression.white_test(rows, "resid", ["disc"], ["date"])


@query(
    f"""
SELECT date, {r('CASE WHEN n > 3 AND syy > 0 THEN n * (syu * syu / suu + syq * syq / sqq) / syy END', 'lm')}, 3 AS df
FROM (SELECT date, count(*) AS n, sum(y * y) AS syy, sum(y * u) AS syu, sum(u * u) AS suu, sum(y * q) AS syq, sum(q * q) AS sqq
      FROM (SELECT date, u, y, v - u * sum(u * v) OVER d / sum(u * u) OVER d AS q
            FROM (SELECT date, e * e - avg(e * e) OVER d AS y, x - avg(x) OVER d AS u, pow(x - mx, 2) - avg(pow(x - mx, 2)) OVER d AS v
                  FROM (SELECT date, x, avg(x) OVER d AS mx, ret - avg(ret) OVER d - regr_slope(ret, x) OVER d * (x - avg(x) OVER d) AS e, count(*) OVER d AS n
                        FROM (SELECT date, disc AS x, ret FROM base WHERE ret IS NOT NULL) AS a WINDOW d AS (PARTITION BY date)) AS b WHERE n > 2 WINDOW d AS (PARTITION BY date)) AS c WINDOW d AS (PARTITION BY date)) AS f GROUP BY 1) AS g""",
    RET,
)
def white_lm(p: Panels) -> DataFrame:
    """R10 per date: the statistic, without its tail probability."""
    return white(p).select("date", tidy("lm").alias("lm"), F.col("df").cast("int").alias("df"))


@query()
def white_test(p: Panels) -> DataFrame:
    """R10 per date; its tail probability has no SQL and is tested against tables."""
    out = white(p)
    return out.select("date", tidy("lm").alias("lm"), "df", tidy(chi2_pvalue(F.col("lm"), F.col("df"))).alias("pvalue"))


@query(f"SELECT factor, n, {r('m / (s / sqrt(n))', 't')} FROM (SELECT factor, count(ic) AS n, avg(ic) AS m, stddev_samp(ic) AS s FROM ics GROUP BY 1) AS x", RET, LONG, IC)
def t_test(p: Panels) -> DataFrame:
    """T of the mean IC."""
    return regression.t_test(ics_of(p), "ic", ["factor"]).select("factor", "n", tidy("t").alias("t"))


@query()
def ic_pvalues(p: Panels) -> DataFrame:
    """Tail probabilities of the IC statistics; tested against tables."""
    i = ics_of(p)
    t = regression.t_test(i, "ic", ["factor"])
    q = series.ljung_box(i, "ic", ["factor"])
    b = series.break_scan(i, "ic", ["factor"])
    out = t.join(q, "factor").join(b, "factor")
    n = F.col("n") - 1
    return out.select("factor", tidy(t_pvalue(F.col("t"), n)).alias("t_p"), tidy(t_pvalue(F.col("t"), n, "greater")).alias("greater_p"), tidy(chi2_pvalue(F.col("lb_q"), F.col("lags"))).alias("lb_p"), tidy(t_pvalue(F.col("welch_t"), F.col("welch_df"))).alias("break_p"))
