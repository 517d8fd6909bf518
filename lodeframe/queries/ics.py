"""Forward returns, information coefficients and their statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import tidy
from lodeframe.operators import ic, returns, series
from lodeframe.plans.panels import Panels
from lodeframe.queries import query, r

FACTORS = ["price", "volume", "disc"]

RET = """base AS (
  SELECT *, lead(price, 2) OVER (PARTITION BY code ORDER BY date) / nullif(lead(price, 1) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel)"""
LONG = """long AS (
  SELECT date, 'price' AS factor, CAST(price AS DOUBLE) AS x, ret FROM base UNION ALL SELECT date, 'volume', CAST(volume AS DOUBLE), ret FROM base
  UNION ALL SELECT date, 'disc', disc, ret FROM base)"""
IC = """rk AS (
  SELECT date, factor, rank() OVER (PARTITION BY date, factor ORDER BY x) + (count(*) OVER (PARTITION BY date, factor, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY date, factor ORDER BY ret) + (count(*) OVER (PARTITION BY date, factor, ret) - 1) / 2.0 AS ry
  FROM long WHERE x IS NOT NULL AND ret IS NOT NULL),
raw AS (SELECT date, factor, count(*) AS n, corr(rx, ry) AS c FROM rk GROUP BY 1, 2),
allic AS (SELECT DISTINCT date, factor FROM long),
ics AS (SELECT a.date, a.factor, CASE WHEN n >= 2 AND NOT isnan(c) THEN c END AS ic FROM allic AS a LEFT JOIN raw ON raw.date = a.date AND raw.factor = a.factor),
good AS (SELECT * FROM ics WHERE ic IS NOT NULL)"""


def base(p: Panels) -> DataFrame:
    return p.panel.withColumn("ret", returns.forward_return("price", 1))


def ics_of(p: Panels) -> DataFrame:
    return ic.information_coefficient(base(p), FACTORS)


@query(f"SELECT {r('avg(ic)', 'mean_ic')}, count(ic) AS n FROM ics WHERE factor = 'price'", RET, LONG, IC)
def flagship_ic(p: Panels) -> DataFrame:
    """Monthly supplier panel, forward returns, rank correlation per date, its mean."""
    found = ic.information_coefficient(base(p), ["price"])
    return found.agg(tidy(F.avg("ic")).alias("mean_ic"), F.count("ic").alias("n"))


@query(f"SELECT date, code, {r('ret', 'ret')}, {r('lead(price, 1) OVER (PARTITION BY code ORDER BY date) / nullif(lead(price, 4) OVER (PARTITION BY code ORDER BY date), 0) - 1', 'inverted')} FROM base", RET)
def forward_returns(p: Panels) -> DataFrame:
    """Returns over own rows, and the reciprocal convention."""
    return base(p).withColumn("inverted", returns.forward_return("price", 3, inverted=True)).select("date", "code", tidy("ret").alias("ret"), tidy("inverted").alias("inverted"))


@query(f"SELECT date, {r('count(v) / nullif(count(ret), 0)', 'coverage')} FROM (SELECT *, CASE WHEN code % 3 = 0 THEN NULL ELSE disc END AS v FROM base) AS x GROUP BY 1", RET)
def coverage(p: Panels) -> DataFrame:
    """Coverage of a gappy factor."""
    rows = base(p).withColumn("v", F.when(F.col("code") % 3 != 0, F.col("disc")))
    return ic.coverage(rows, ["v"]).select("date", tidy("coverage").alias("coverage"))


@query(f"SELECT factor, {r('avg(c)', 'coverage')} FROM (SELECT date, factor, count(x) / nullif(count(ret), 0) AS c FROM long GROUP BY 1, 2) AS y GROUP BY 1", RET, LONG)
def mean_coverage(p: Panels) -> DataFrame:
    """A7."""
    return ic.coverage(base(p), FACTORS).groupBy("factor").agg(tidy(F.avg("coverage")).alias("coverage"))


@query(f"SELECT date, factor, {r('ic', 'ic')} FROM ics", RET, LONG, IC)
def ic_spearman(p: Panels) -> DataFrame:
    """A8, W5."""
    return ics_of(p).select("date", "factor", tidy("ic").alias("ic"))


@query(f"SELECT date, factor, {r('CASE WHEN NOT isnan(corr(x, ret)) AND count(x + ret) >= 2 THEN corr(x, ret) END', 'ic')} FROM long GROUP BY 1, 2", RET, LONG)
def ic_pearson(p: Panels) -> DataFrame:
    """A8 with plain correlation."""
    return ic.information_coefficient(base(p), FACTORS, method="pearson").select("date", "factor", tidy("ic").alias("ic"))


@query("SELECT factor, CAST(sign(avg(ic)) AS DOUBLE) AS direction FROM ics GROUP BY 1", RET, LONG, IC)
def ic_direction(p: Panels) -> DataFrame:
    """X15."""
    return ic.ic_direction(ics_of(p))


_CORR = """cc AS (
  SELECT date, 'disc' AS f1, 'price' AS f2, corr(disc, price) AS c FROM panel GROUP BY 1 UNION ALL SELECT date, 'disc', 'volume', corr(disc, volume) FROM panel GROUP BY 1
  UNION ALL SELECT date, 'price', 'volume', corr(price, volume) FROM panel GROUP BY 1),
pc AS (SELECT date, f1, f2, CASE WHEN NOT isnan(c) THEN c END AS corr FROM cc)"""


@query(f"SELECT date, f1, f2, {r('corr', 'corr')} FROM pc", _CORR)
def factor_corr(p: Panels) -> DataFrame:
    """A9."""
    return ic.factor_correlation(p.panel, FACTORS).select("date", "f1", "f2", tidy("corr").alias("corr"))


_GAPPY = "gappy AS (SELECT date, CASE WHEN code % 7 <> 3 THEN disc END AS disc, CASE WHEN code % 5 <> 1 THEN round(price, -2) END AS price, CAST(volume AS DOUBLE) AS volume, CAST(CAST(volume AS BIGINT) % 4 AS DOUBLE) AS parts FROM panel)"
_RANKED = """both_ AS (
""" + " UNION ALL ".join(f"SELECT date, '{a}' AS f1, '{b}' AS f2, {a} AS a, {b} AS b FROM gappy" for a, b in combinations(["disc", "parts", "price", "volume"], 2)) + """),
ranked AS (
  SELECT date, f1, f2, rank() OVER (PARTITION BY date, f1, f2 ORDER BY a) + (count(*) OVER (PARTITION BY date, f1, f2, a) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY date, f1, f2 ORDER BY b) + (count(*) OVER (PARTITION BY date, f1, f2, b) - 1) / 2.0 AS b
  FROM both_ WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"SELECT date, f1, f2, {r('CASE WHEN count(*) >= 2 AND NOT isnan(corr(a, b)) THEN corr(a, b) END', 'corr')} FROM ranked GROUP BY 1, 2, 3", _GAPPY, _RANKED)
def factor_corr_spearman(p: Panels) -> DataFrame:
    """A9 by ranks, of four factors that miss different rows."""
    gappy = p.panel.select("date", F.when(F.col("code") % 7 != 3, F.col("disc")).alias("disc"), F.when(F.col("code") % 5 != 1, F.round("price", -2)).alias("price"), F.col("volume").cast("double").alias("volume"), (F.col("volume").cast("long") % 4).cast("double").alias("parts"))
    out = ic.factor_correlation(gappy, ["price", "disc", "volume", "parts"], "spearman", tile=3)
    return out.select("date", "f1", "f2", tidy("corr").alias("corr"))


@query(f"SELECT date, f1 || ' ~ ' || f2 AS pair, {r('corr', 'corr')} FROM pc WHERE (f1, f2) IN (SELECT (f1, f2) FROM (SELECT f1, f2, avg(corr) AS m FROM pc GROUP BY 1, 2 ORDER BY abs(m) DESC, f1, f2 LIMIT 2) AS x)", _CORR)
def corr_pairs_top(p: Panels) -> DataFrame:
    """The two pairs with the largest mean correlation."""
    top = ic.top_pairs(ic.factor_correlation(p.panel, FACTORS), 2)
    return top.select("date", ic.pair_name().alias("pair"), tidy("corr").alias("corr"))


@query(f"SELECT date, {r('max(corr) FILTER (WHERE f1 = ' + repr('disc') + ' AND f2 = ' + repr('price') + ')', 'disc_price')}, {r('max(corr) FILTER (WHERE f1 = ' + repr('price') + ')', 'price_volume')} FROM pc GROUP BY 1", _CORR)
def pair_wide(p: Panels) -> DataFrame:
    """Pairs as columns."""
    wide = ic.factor_correlation(p.panel, FACTORS).withColumn("pair", ic.pair_name()).groupBy("date").pivot("pair", ["disc ~ price", "price ~ volume"]).agg(F.first("corr"))
    return wide.select("date", tidy("disc ~ price").alias("disc_price"), tidy("price ~ volume").alias("price_volume"))


NW = """de AS (SELECT date, factor, ic AS x, ic - avg(ic) OVER (PARTITION BY factor) AS e, count(*) OVER (PARTITION BY factor) AS n, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM good),
lg AS (
  SELECT a.factor, l.k, sum(a.e * b.e) AS g FROM de AS a JOIN (SELECT unnest(range(0, 25)) AS k) AS l ON true JOIN de AS b ON b.factor = a.factor AND b.i = a.i - l.k GROUP BY 1, 2),
nn AS (SELECT factor, n, floor(4 * pow(n / 100, 2.0 / 9)) AS l, avg(x) AS mean FROM de GROUP BY 1, 2),
nw AS (
  SELECT nn.factor, max(nn.n) AS n, max(mean) / (sqrt(sum(CASE WHEN k = 0 THEN g WHEN k <= l THEN 2 * (1 - k / (l + 1)) * g ELSE 0 END)) / max(nn.n)) AS nw_t
  FROM nn JOIN lg ON lg.factor = nn.factor GROUP BY 1)"""


@query(
    f"""
SELECT s.factor, s.n, {r('mean', 'mean')}, {r('std', 'std')}, {r('mean / std', 'ir')}, {r('mean / (std / sqrt(s.n))', 't')}, {r('positive', 'positive')}, {r('p05', 'p05')}, {r('p50', 'p50')}, {r('p95', 'p95')},
       {r('m3 / pow(m2, 1.5)', 'skew')}, {r('kurt', 'kurt')}, {r('outliers', 'outliers')}, {r('nw_t', 'nw_t')}
FROM (SELECT factor, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS positive, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50,
             quantile_cont(x, 0.95) AS p95, avg(e * e) AS m2, avg(e * e * e) AS m3, kurtosis_pop(x) AS kurt FROM de GROUP BY 1) AS s
JOIN (SELECT factor, avg(CASE WHEN abs(e) > 2 * sd THEN 1.0 ELSE 0.0 END) AS outliers FROM (SELECT *, stddev_samp(x) OVER (PARTITION BY factor) AS sd FROM de) AS y GROUP BY 1) AS o ON o.factor = s.factor
JOIN nw ON nw.factor = s.factor""",
    RET, LONG, IC, NW,
)
def ic_summary(p: Panels) -> DataFrame:
    """A18, A19."""
    s = series.summary(ics_of(p), "ic", ["factor"])
    return s.select("factor", "n", *(tidy(c).alias(c) for c in s.columns if c not in ("factor", "n")))


_ROLL = """roll AS (
  SELECT date, factor, ic, CASE WHEN count(ic) OVER w >= 12 THEN avg(ic) OVER w END AS m, CASE WHEN count(ic) OVER w >= 12 THEN stddev_samp(ic) OVER w END AS s
  FROM good WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query(f"SELECT date, factor, {r('m', 'roll_mean')}, {r('s', 'roll_std')}, {r('m / nullif(s, 0)', 'roll_ir')}, {r('sum(ic) OVER (PARTITION BY factor ORDER BY date)', 'cumulative')} FROM roll", RET, LONG, IC, _ROLL)
def ic_rolling(p: Panels) -> DataFrame:
    """Rolling statistics of twelve dates and the running sum."""
    from lodeframe.functions.columns import by

    rows = series.rolling_stats(ics_of(p), "ic", ["factor"], 12)
    rows = rows.withColumn("cumulative", F.sum("ic").over(by("factor").orderBy("date")))
    return rows.select("date", "factor", *(tidy(c).alias(c) for c in ("roll_mean", "roll_std", "roll_ir", "cumulative")))


@query(f"SELECT factor, {r('corr(ic, b)', 'acf1')} FROM (SELECT factor, ic, lag(ic) OVER (PARTITION BY factor ORDER BY date) AS b FROM good) AS x GROUP BY 1", RET, LONG, IC)
def ic_acf(p: Panels) -> DataFrame:
    """W17."""
    return series.autocorrelation(ics_of(p), "ic", ["factor"]).select("factor", tidy("acf1").alias("acf1"))


@query(f"SELECT factor, {r('n * (n + 2) * sum(CASE WHEN k > 0 THEN pow(g / g0, 2) / (n - k) ELSE 0 END)', 'lb_q')} FROM (SELECT lg.factor, k, g, n, max(CASE WHEN k = 0 THEN g END) OVER (PARTITION BY lg.factor) AS g0 FROM lg JOIN nn ON nn.factor = lg.factor WHERE k <= 10) AS x GROUP BY factor, n", RET, LONG, IC, NW)
def ljung_box(p: Panels) -> DataFrame:
    """R11."""
    return series.ljung_box(ics_of(p), "ic", ["factor"]).select("factor", tidy("lb_q").alias("lb_q"))


@query(
    f"""
SELECT factor, date AS break_date, {r('stat', 'break_stat')}, {r('t', 'welch_t')}
FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY stat DESC, i) AS place
      FROM (SELECT factor, date, i, abs(ma - mb) AS stat, (ma - mb) / sqrt(va / a + vb / b) AS t
            FROM (SELECT *, (qa - a * ma * ma) / (a - 1) AS va, (qb - b * mb * mb) / (b - 1) AS vb
                  FROM (SELECT factor, date, i, n, i - 1 AS a, n - i + 1 AS b, sa / (i - 1) AS ma, (st - sa) / (n - i + 1) AS mb, qa, qt - qa AS qb
                        FROM (SELECT *, sum(x) OVER w AS sa, sum(x * x) OVER w AS qa, sum(x) OVER (PARTITION BY factor) AS st, sum(x * x) OVER (PARTITION BY factor) AS qt FROM de
                              WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS y
                        WHERE i - 1 >= 30 AND i - 1 < n - 30) AS z) AS u) AS v) AS q
WHERE place = 1""",
    RET, LONG, IC, NW,
)
def ic_break(p: Panels) -> DataFrame:
    """The largest change of mean."""
    found = series.break_scan(ics_of(p), "ic", ["factor"])
    return found.select("factor", "break_date", tidy("break_stat").alias("break_stat"), tidy("welch_t").alias("welch_t"))
