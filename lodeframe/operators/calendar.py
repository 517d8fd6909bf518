"""Trading calendars: the distinct dates of a table and positions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """``date, date_idx`` (from 1).  A calendar has one row a date, so its window needs no key."""
    return df.select(date).where(F.col(date).isNotNull()).distinct().withColumn("date_idx", F.row_number().over(Window.orderBy(date)))


def with_date_idx(df: DataFrame, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """Adds the position of every row's date on the calendar."""
    return df.join(dates if dates is not None else calendar(df, date), date)


def neighbours(dates: DataFrame, anchor: object, n: int, date: str = "date") -> DataFrame:
    """The n distinct dates strictly before ``anchor`` (n > 0) or |n| strictly after (n < 0), ascending."""
    days = dates.select(date).distinct()
    if n >= 0:
        return days.where(F.col(date) < F.lit(anchor)).orderBy(F.desc(date)).limit(n).orderBy(date)
    return days.where(F.col(date) > F.lit(anchor)).orderBy(date).limit(-n).orderBy(date)


def rebalance_dates(df: DataFrame, every: int, begin: object = None, end: object = None, date: str = "date") -> DataFrame:
    """Rows on every ``every``-th date, counted from the first date of ``df``, then cut to [begin, end]."""
    out = with_date_idx(df, date).where((F.col("date_idx") - 1) % every == 0).drop("date_idx")
    if begin is not None:
        out = out.where(F.col(date) >= F.lit(begin))
    return out if end is None else out.where(F.col(date) <= F.lit(end))


def dense_grid(df: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """Every date for every code, as a wide frame has it: ``date, code, date_idx`` and the columns of ``df``."""
    dates = calendar(df, date)
    # the calendar is one short array; each code unfolds it, so no two tables are crossed
    row = dates.agg(F.sort_array(F.collect_list(F.struct("date_idx", date))).alias("days"))
    codes = df.select(code).distinct().withColumn("__one", F.lit(1)).join(row.withColumn("__one", F.lit(1)), "__one")
    grid = codes.select(code, F.explode("days").alias("d")).select(code, F.col(f"d.{date}").alias(date), F.col("d.date_idx").alias("date_idx"))
    return grid.join(df, [date, code], "left")
