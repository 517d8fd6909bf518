"""Feasibility, tradable prices, point-in-time alignment, forward returns, net asset values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import col, ratio


def feasible(quotes: DataFrame, instruments: DataFrame, min_list_days: int = 90) -> DataFrame:
    """``quotes`` with a boolean ``feasible``: away from its limits, not special, not suspended, listed long enough.

    A missing flag counts as false, a missing price or limit as not tradable.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    free = F.coalesce(F.col("high") > F.col("limit_down"), F.lit(False)) & F.coalesce(F.col("low") < F.col("limit_up"), F.lit(False))
    aged = F.date_diff(F.col("date"), F.col("listed_date")) > min_list_days
    return quotes.join(instruments, "code").withColumn("feasible", free & ~flag("st") & ~flag("suspended") & aged)


def tradable(prices: DataFrame, mask: DataFrame, price: str) -> DataFrame:
    """Prices where the mask holds; untradable or unknown rows stay, without price."""
    joined = prices.join(mask.select("date", "code", "feasible"), ["date", "code"], "left")
    return joined.withColumn(price, F.when(F.col("feasible"), F.col(price)))


def as_of(grid: DataFrame, sparse: DataFrame, values: list[str]) -> DataFrame:
    """The last known sparse value of the code at every row of the grid."""
    known = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    every = grid.withColumn("__row", F.lit(True)).join(sparse, ["date", "code"], "full")
    filled = every.select("date", "code", "__row", *(F.last(v, ignorenulls=True).over(known).alias(v) for v in values))
    return filled.where("__row").drop("__row")


def forward_return(price: str | Column, horizon: int = 1, delay: int = 1, inverted: bool = False) -> Column:
    """Return of buying ``delay`` rows later and selling ``horizon`` rows after that, by the code's own rows.

    ``inverted`` gives the reciprocal price ratio instead, as an older convention had it.
    """
    w = Window.partitionBy("code").orderBy("date")
    buy, sell = F.lead(col(price), delay).over(w), F.lead(col(price), delay + horizon).over(w)
    return (ratio(buy, sell) if inverted else ratio(sell, buy)) - 1


def net_asset_value(ret: str | Column, *series: str, date: str = "date") -> Column:
    """Running product of 1 + return; a missing return counts as zero."""
    w = Window.partitionBy(*series).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(F.lit(1.0) + F.coalesce(col(ret), F.lit(0.0))).over(w)


def performance(returns: DataFrame, ret: str, series: list[str], periods: float = 12.0, date: str = "date") -> DataFrame:
    """Per series: total and annual return, volatility, Sharpe ratio and largest drawdown.

    Our definition: missing returns count as zero, the annual return compounds over
    ``periods`` dates a year, and the drawdown is measured from the highest value so far,
    1 at the start included.
    """
    so_far = Window.partitionBy(*series).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("__r", F.coalesce(F.col(ret), F.lit(0.0))).withColumn("__nav", net_asset_value(ret, *series, date=date))
    rows = rows.withColumn("__fall", F.col("__nav") / F.greatest(F.max("__nav").over(so_far), F.lit(1.0)) - 1)
    out = rows.groupBy(*series).agg(F.max_by("__nav", date).alias("__end"), F.count("*").alias("n"), F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.min("__fall").alias("max_drawdown"))
    return out.select(
        *series,
        "n",
        (F.col("__end") - 1).alias("total_return"),
        (F.pow("__end", F.lit(periods) / F.col("n")) - 1).alias("annual_return"),
        (F.col("__s") * F.sqrt(F.lit(periods))).alias("volatility"),
        (ratio("__m", "__s") * F.sqrt(F.lit(periods))).alias("sharpe"),
        F.least("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
    )
