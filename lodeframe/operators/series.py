"""Statistics of time series, one row per series: Newey-West t, autocorrelation, breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import correlation, ratio


def _numbered(df: DataFrame, x: str, keys: list[str], date: str) -> DataFrame:
    """Present values with ``__i`` (from 0), ``__n`` and ``__e`` (less the mean)."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull()).select(*keys, date, F.col(x).cast("double").alias("__x"))
    rows = rows.withColumn("__n", F.count("*").over(w)).withColumn("__e", F.col("__x") - F.avg("__x").over(w))
    return rows.withColumn("__i", F.row_number().over(w.orderBy(date)) - 1)


def _with_lags(rows: DataFrame, keys: list[str], date: str, most: int, column: str = "__e") -> DataFrame:
    """Adds the products ``__g1, ...`` of a column with its value so many rows before."""
    w = Window.partitionBy(*keys).orderBy(date)
    return rows.select("*", *((F.col(column) * F.lag(column, k).over(w)).alias(f"__g{k}") for k in range(1, most + 1)))


def _products(most: int) -> list[Column]:
    return [F.sum(F.col("__e") * F.col("__e")).alias("__g0"), *(F.sum(f"__g{k}").alias(f"__g{k}") for k in range(1, most + 1))]


def _nw_t(most: int, least: int) -> Column:
    """t of the mean from columns ``n, mean, __l`` and the sums of :func:`_products`."""
    total = F.col("__g0")
    for k in range(1, most + 1):
        total = total + F.when(F.col("__l") >= k, 2 * (1 - k / (F.col("__l") + 1)) * F.coalesce(f"__g{k}", F.lit(0.0))).otherwise(0.0)
    error = F.sqrt(F.when(total > 0, total)) / F.col("n")
    return F.when(F.col("n") >= least, ratio("mean", error))


def _lags(lags: int | None) -> Column:
    return F.floor(4 * F.pow(F.col("__n") / 100, F.lit(2.0 / 9))) if lags is None else F.lit(lags)


def newey_west(df: DataFrame, x: str, keys: list[str], date: str = "date", lags: int | None = None, max_lags: int = 24, least: int = 10) -> DataFrame:
    """``keys, n, mean, nw_t``: t of the mean with Bartlett weights over position lags of present values.

    Without ``lags`` a series of n values takes floor(4 (n / 100) ** (2 / 9)) of them,
    ``max_lags`` at most (enough for three million dates).
    """
    most = max_lags if lags is None else lags
    rows = _with_lags(_numbered(df, x, keys, date).withColumn("__l", _lags(lags)), keys, date, most)
    sums = rows.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__l").alias("__l"), F.avg("__x").alias("mean"), *_products(most))
    return sums.select(*keys, "n", "mean", _nw_t(most, least).alias("nw_t"))


def summary(df: DataFrame, x: str, keys: list[str], date: str = "date", max_lags: int = 24) -> DataFrame:
    """Count, mean, std, ratio, t, Newey-West t, share above zero, quantiles, skew, excess kurtosis, share beyond 2 std: one pass of windows, one aggregation."""
    w = Window.partitionBy(*keys)
    rows = _numbered(df, x, keys, date).withColumn("__l", _lags(None)).withColumn("__far", F.abs(F.col("__e")) > 2 * F.stddev_samp("__x").over(w))
    rows = _with_lags(rows, keys, date, max_lags)
    c = F.col("__x")
    n = F.count("*")
    out = rows.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        ratio(F.avg(c), F.stddev_samp(c)).alias("ir"),
        ratio(F.avg(c), F.stddev_samp(c) / F.sqrt(n)).alias("t"),
        F.avg((c > 0).cast("double")).alias("positive"),
        *(F.percentile(c, F.lit(q / 100)).alias(f"p{q:02d}") for q in (5, 50, 95)),
        F.when(n >= 3, F.skewness(c)).alias("skew"),
        F.when(n >= 4, F.kurtosis(c)).alias("kurt"),
        F.avg(F.coalesce(F.col("__far"), F.lit(False)).cast("double")).alias("outliers"),
        F.max("__l").alias("__l"),
        *_products(max_lags),
    )
    return out.withColumn("nw_t", _nw_t(max_lags, 10)).drop("__l", *(f"__g{k}" for k in range(max_lags + 1)))


def rolling_stats(df: DataFrame, x: str, keys: list[str], window: int, date: str = "date") -> DataFrame:
    """Adds ``roll_mean, roll_std, roll_ir`` over full windows of present values."""
    rows = df.where(F.col(x).isNotNull())
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(window - 1), 0)
    full = F.count(x).over(w) >= window
    rows = rows.withColumn("roll_mean", F.when(full, F.avg(x).over(w))).withColumn("roll_std", F.when(full, F.stddev_samp(x).over(w)))
    return rows.withColumn("roll_ir", ratio("roll_mean", "roll_std"))


def autocorrelation(df: DataFrame, x: str, keys: list[str], date: str = "date") -> DataFrame:
    """``keys, acf1``: correlation of each value with the one before."""
    rows = df.where(F.col(x).isNotNull()).withColumn("__p", F.lag(x).over(Window.partitionBy(*keys).orderBy(date)))
    return rows.groupBy(*keys).agg(correlation(x, "__p").alias("acf1"))


def _lb_q(lags: int) -> Column:
    """Ljung-Box statistic from ``n`` and the sums of :func:`_products`."""
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.when(F.col("n") > k, F.pow(ratio(f"__g{k}", "__g0"), F.lit(2.0)) / (F.col("n") - k)).otherwise(0.0)
    return F.col("n") * (F.col("n") + 2) * q


def ljung_box(df: DataFrame, x: str, keys: list[str], lags: int = 10, date: str = "date") -> DataFrame:
    """``keys, lags, lb_q`` over min(lags, n - 1) lags of the demeaned values."""
    rows = _with_lags(_numbered(df, x, keys, date), keys, date, lags)
    sums = rows.groupBy(*keys).agg(F.max("__n").alias("n"), *_products(lags))
    return sums.select(*keys, F.least(F.lit(lags), F.col("n") - 1).alias("lags"), _lb_q(lags).alias("lb_q"))


def _break_at(rows: DataFrame, keys: list[str], date: str, min_segment: int, candidates: int) -> DataFrame:
    """Adds ``__break``: change of mean and its Welch statistic at the splits that are looked at, null elsewhere."""
    w = Window.partitionBy(*keys).orderBy(date)
    before, all_ = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    for name, c in (("s", F.col("__x")), ("q", F.col("__x") * F.col("__x"))):
        rows = rows.withColumn(f"__{name}a", F.sum(c).over(before)).withColumn(f"__{name}b", F.sum(c).over(all_) - F.col(f"__{name}a"))
    rows = rows.withColumn("__m", F.greatest(F.lit(min_segment), F.floor(F.col("__n") / 10)))
    rows = rows.withColumn("__step", F.greatest(F.lit(1), F.floor((F.col("__n") - 2 * F.col("__m")) / candidates)))
    a, b = F.col("__i").cast("double"), (F.col("__n") - F.col("__i")).cast("double")
    ma, mb = F.try_divide("__sa", a), F.try_divide("__sb", b)
    va, vb = F.try_divide(F.try_divide(F.col("__qa") - a * ma * ma, a - 1), a), F.try_divide(F.try_divide(F.col("__qb") - b * mb * mb, b - 1), b)
    found = F.struct(F.abs(ma - mb).alias("stat"), (-F.col("__i")).alias("first"), F.col(date).alias("date"), ratio(ma - mb, F.sqrt(va + vb)).alias("t"), ratio((va + vb) * (va + vb), va * va / (a - 1) + vb * vb / (b - 1)).alias("df"))
    return rows.withColumn("__break", F.when(F.expr("__i >= __m and __i < __n - __m and (__i - __m) % __step = 0"), found))


def break_scan(df: DataFrame, x: str, keys: list[str], min_segment: int = 30, candidates: int = 200, date: str = "date") -> DataFrame:
    """``keys, break_date, break_stat, welch_t, welch_df``: the split with the largest change of mean.

    Both sides have max(min_segment, n / 10) values at least; about ``candidates`` splits
    are looked at; the first of equals counts.
    """
    rows = _break_at(_numbered(df, x, keys, date), keys, date, min_segment, candidates).where("__break is not null")
    best = rows.groupBy(*keys).agg(F.max("__break").alias("b"))
    return best.select(*keys, F.col("b.date").alias("break_date"), F.col("b.stat").alias("break_stat"), F.col("b.t").alias("welch_t"), F.col("b.df").alias("welch_df"))


def stability(df: DataFrame, x: str, keys: list[str], window: int, lags: int = 10, min_segment: int = 30, candidates: int = 200, date: str = "date", least: int = 50) -> DataFrame:
    """``keys, n, roll_mean_std, roll_ir_std, acf1, lags, lb_q, break_date, break_stat, welch_t, welch_df``.

    How rolling means and ratios vary, the first autocorrelation, Ljung-Box and the
    largest break of a series, by one pass of windows and one aggregation.  All are missing for
    series with fewer than max(least, window + 5) values.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    last = w.rowsBetween(-(window - 1), 0)
    rows = _break_at(_with_lags(_numbered(df, x, keys, date), keys, date, lags), keys, date, min_segment, candidates)
    rows = rows.withColumn("__rm", F.when(F.col("__i") >= window - 1, F.avg("__x").over(last)))
    rows = rows.withColumn("__ri", ratio("__rm", F.when(F.col("__i") >= window - 1, F.stddev_samp("__x").over(last)))).withColumn("__p", F.lag("__x").over(w))
    sums = rows.groupBy(*keys).agg(F.max("__n").alias("n"), F.stddev_samp("__rm").alias("roll_mean_std"), F.stddev_samp("__ri").alias("roll_ir_std"), correlation("__x", "__p").alias("acf1"), F.max("__break").alias("b"), *_products(lags))
    enough = F.col("n") >= max(least, window + 5)
    out = {c: F.col(c) for c in ("roll_mean_std", "roll_ir_std", "acf1")}
    out |= {"lags": F.least(F.lit(lags), F.col("n") - 1), "lb_q": _lb_q(lags), "break_date": F.col("b.date"), "break_stat": F.col("b.stat"), "welch_t": F.col("b.t"), "welch_df": F.col("b.df")}
    return sums.select(*keys, "n", *(F.when(enough, c).alias(name) for name, c in out.items()))
