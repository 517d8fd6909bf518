"""Cross-sectional, elementwise and time transforms.

Functions that need one pass return a Column over windows on ``date`` (across codes) or
``code`` (over time); those that need two return the frame with a column added.
All windows of one kind share their key, so they share one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import average_rank, by, col, keep, named, ratio

Processor = Callable[[DataFrame, str], DataFrame]


# --- elementwise -----------------------------------------------------------------


def where(x: str | Column, cond: Column, other: Column | float | None = None) -> Column:
    """x where the condition holds, else ``other``; a missing condition does not hold."""
    return F.when(F.coalesce(cond, F.lit(False)), col(x)).otherwise(F.lit(other))


def mask(x: str | Column, cond: Column, other: Column | float | None = None) -> Column:
    """x where the condition does not hold, else ``other``; a missing condition does not hold."""
    return F.when(~F.coalesce(cond, F.lit(False)), col(x)).otherwise(F.lit(other))


def fill(x: str | Column, value: float = 0.0) -> Column:
    return F.coalesce(col(x), F.lit(value))


def arithmetic(a: DataFrame, b: DataFrame, op: str, value: str, keys: tuple[str, str] = ("date", "code"), fill: float | None = None) -> DataFrame:
    """``a op b`` of the ``value`` columns on outer-aligned keys; op is add, sub, mul or div.

    With ``fill`` a side that is missing alone takes that value; zero counts as a value.
    """
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), list(keys), "full")
    x, y = F.col("__a"), F.col("__b")
    if fill is not None:
        x, y = F.coalesce(x, F.when(y.isNotNull(), F.lit(fill))), F.coalesce(y, F.when(x.isNotNull(), F.lit(fill)))
    done = {"add": x + y, "sub": x - y, "mul": x * y, "div": ratio(x, y)}[op]
    return both.select(*keys, done.alias(value))


def absolute(x: str | Column) -> Column:
    return F.abs(col(x))


# --- across codes ----------------------------------------------------------------


def shifted_log(x: str | Column, date: str = "date") -> Column:
    """ln(x + 1e-6 - least x of the date)."""
    return F.log(col(x) + F.lit(1e-6) - F.min(col(x)).over(by(date)))


def shifted_sqrt(x: str | Column, date: str = "date") -> Column:
    return F.sqrt(col(x) - F.min(col(x)).over(by(date)))


def zscore(x: str | Column, date: str = "date") -> Column:
    w, x = by(date), col(x)
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def wscore(x: str | Column, weight: str | Column, date: str = "date") -> Column:
    """(x - sum of weight * x) / std; the weights are taken as they are."""
    w, x = by(date), col(x)
    return ratio(x - F.sum(col(weight) * x).over(w), F.stddev_samp(x).over(w))


def usable_weight(x: str | Column, weight: str | Column) -> Column:
    """The weight where it is positive and x is present."""
    return F.when(col(x).isNotNull() & (col(weight) > 0), col(weight))


def weighted_zscore(x: str | Column, weight: str | Column, date: str = "date") -> Column:
    """z-score by weighted mean and weighted population variance; rows without usable weight are missing."""
    w, x = by(date), col(x)
    u = usable_weight(x, weight)
    total = F.sum(u).over(w)
    mean = ratio(F.sum(u * x).over(w), total)
    variance = F.greatest(ratio(F.sum(u * x * x).over(w), total) - mean * mean, F.lit(0.0))
    return F.when(u.isNotNull(), ratio(x - mean, F.sqrt(variance)))


def minmax(x: str | Column, date: str = "date") -> Column:
    w, x = by(date), col(x)
    low = F.min(x).over(w)
    return ratio(x - low, F.max(x).over(w) - low)


def weightify(x: str | Column, date: str = "date") -> Column:
    return ratio(x, F.sum(col(x)).over(by(date)))


def equal_weight(date: str = "date") -> Column:
    return F.lit(1.0) / F.count(F.lit(1)).over(by(date))


def bounded(x: str | Column, low: Column, high: Column, drop: bool) -> Column:
    x = col(x)
    return F.when((x >= low) & (x <= high), x) if drop else keep(x, F.least(F.greatest(x, low), high))


def std_outlier(x: str | Column, dev: float, drop: bool = False, date: str = "date") -> Column:
    w, x = by(date), col(x)
    mean, std = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return bounded(x, mean - dev * std, mean + dev * std, drop)


def quantile_outlier(x: str | Column, dev: float, drop: bool = False, date: str = "date") -> Column:
    """Bounds at the quantiles dev / 2 and 1 - dev / 2, linear."""
    w, x = by(date), col(x)
    return bounded(x, F.percentile(x, F.lit(dev / 2)).over(w), F.percentile(x, F.lit(1 - dev / 2)).over(w), drop)


def mad_outlier(df: DataFrame, x: str, dev: float, drop: bool = False, out: str | None = None, date: str = "date") -> DataFrame:
    """Bounds at the median and ``dev`` median absolute deviations (no scale factor) around it."""
    df = df.withColumn("__mid", F.median(x).over(by(date)))
    df = df.withColumn("__mad", F.median(F.abs(F.col(x) - F.col("__mid"))).over(by(date)))
    reach = dev * F.col("__mad")
    return df.withColumn(out or x, bounded(x, F.col("__mid") - reach, F.col("__mid") + reach, drop)).drop("__mid", "__mad")


def excess(x: str | Column, *keys: str) -> Column:
    """x less its mean over the other rows of the same keys (and itself)."""
    return col(x) - F.avg(col(x)).over(by(*keys))


# --- over time -------------------------------------------------------------------


def over_code(code: str = "code") -> Window:
    return Window.partitionBy(code).orderBy("date_idx")


def shift(x: str | Column, n: int, code: str = "code") -> Column:
    """The value n calendar dates earlier (n < 0: later), missing where the code has no row there."""
    return F.max(col(x)).over(over_code(code).rangeBetween(-n, -n))


def row_shift(x: str | Column, n: int, code: str = "code") -> Column:
    """The value n rows of the code earlier (n < 0: later)."""
    return F.lag(col(x), n).over(over_code(code)) if n >= 0 else F.lead(col(x), -n).over(over_code(code))


def diff(x: str | Column, n: int = 1, first_keeps_level: bool = False, code: str = "code") -> Column:
    change = col(x) - shift(x, n, code)
    return F.when(F.col("date_idx") == 1, col(x)).otherwise(change) if first_keeps_level else change


def cumsum(x: str | Column, code: str = "code") -> Column:
    return keep(x, F.sum(col(x)).over(over_code(code).rowsBetween(Window.unboundedPreceding, 0)))


def cumprod(x: str | Column, code: str = "code") -> Column:
    return keep(x, F.product(col(x)).over(over_code(code).rowsBetween(Window.unboundedPreceding, 0)))


def rank_over_time(x: str | Column, ascending: bool = False, code: str = "code") -> Column:
    return average_rank(x, by(code), ascending)


def rank_across(x: str | Column, ascending: bool = False, date: str = "date") -> Column:
    return average_rank(x, by(date), ascending)


def rolling(x: str | Column, n: int, how: str = "mean", min_periods: int | None = None, code: str = "code") -> Column:
    """Sum or mean of the last n calendar dates (n < 0: of all dates so far, -n at least)."""
    frame = over_code(code).rangeBetween(-(n - 1), 0) if n > 0 else over_code(code).rangeBetween(Window.unboundedPreceding, 0)
    least = min_periods if min_periods is not None else abs(n)
    value = F.sum(col(x)) if how == "sum" else F.avg(col(x))
    return F.when(F.count(col(x)).over(frame) >= least, value.over(frame))


def ewm(df: DataFrame, x: str, alpha: float, outs: dict[str, str], code: str = "code") -> DataFrame:
    """Adds exponentially weighted sums and means over the rows of a dense grid: ``outs`` maps names to ``sum`` or ``mean``.

    Weights are (1 - alpha) ** age with 0 < alpha < 1, ages counted in rows, missing
    ones included; the mean divides by the weights of present values.  Leading missing
    stay missing.

    The rows of a code are cut into blocks as long as the inverse weights stay in range.
    Inside a block a running sum of inversely weighted values is weighted back; the
    few blocks before it are folded from their last rows.  So the work is linear in the rows.
    """
    decay = 1 - alpha
    length = max(1, int(230 / -math.log(decay)))
    df = df.withColumn("__at", (F.col("date_idx") - 1) % length).withColumn("__block", F.floor((F.col("date_idx") - 1) / length))
    inside = Window.partitionBy(code, "__block").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(code).orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    at, last = F.col("__at"), F.col("__at") == length - 1
    weighted = lambda v: F.coalesce(F.sum(v * F.pow(F.lit(decay), -at)).over(inside), F.lit(0.0)) * F.pow(F.lit(decay), at)
    df = df.withColumns({"__s": weighted(F.col(x).cast("double")), "__w": weighted(F.when(F.col(x).isNotNull(), 1.0))})
    past = lambda c: F.aggregate(F.collect_list(F.when(last, F.col(c))).over(before), F.lit(0.0), lambda acc, v: acc * decay**length + v)
    df = df.withColumns({"__s0": past("__s"), "__w0": past("__w")})
    s, w = (F.col(f"__{c}") + F.col(f"__{c}0") * F.pow(F.lit(decay), at + 1) for c in "sw")
    df = df.withColumns({name: F.when(w > 0, s if how == "sum" else s / w) for name, how in outs.items()})
    return df.drop("__at", "__block", "__s", "__w", "__s0", "__w0")


# --- processors ------------------------------------------------------------------


def processor(function: Callable[..., Column], **kwargs: object) -> Processor:
    """A column transform as a step of a chain, named by the function and its keyword arguments."""

    def run(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, function(column, **kwargs))

    run.__name__ = function.__name__ + ("_" if kwargs else "") + "_".join(f"{k}{v}" for k, v in kwargs.items())
    return run


@dataclass(frozen=True)
class Grouped:
    """Code over whole cross-sections as a step of a chain, for what no column expression says.

    ``function`` gets the rows of one date as a pandas frame, one row a code in the order of
    codes, with a column for each processed value, and returns one of the same rows and columns;
    so it may use all values of a date at once.  ``key="code"`` gives it the rows of one code
    in the order of dates instead.  Neighbouring grouped steps of one key run in one pass behind
    one shuffle; the rows of a group are in one task, and a group of more than ``most`` rows
    is an error.
    """

    function: Callable[..., pd.DataFrame]
    key: str = "date"
    most: int = 1_000_000
    keywords: dict = field(default_factory=dict)

    @property
    def __name__(self) -> str:
        return self.function.__name__ + ("_" if self.keywords else "") + "_".join(f"{k}{v}" for k, v in self.keywords.items())


def grouped(function: Callable[..., pd.DataFrame], key: str = "date", **keywords: object) -> Grouped:
    """A function of the frame of one date (or one code) as a step of a chain."""
    return Grouped(function, key, keywords=keywords)


def apply_grouped(df: DataFrame, columns: list[str], steps: list[Grouped], keys: tuple[str, str] = ("date", "code")) -> DataFrame:
    """``df`` with ``columns`` replaced, as doubles, by what the steps (of one key) make of them group by group.

    All other columns pass through, also in rows whose key is null, which form a group.  A
    step that returns other rows or columns than it got is an error.
    """
    key, most = steps[0].key, min(s.most for s in steps)
    if key not in keys:
        raise ValueError(f"a grouped step goes by one of {keys}, not {key!r}")
    order = keys[1 - keys.index(key)]
    calls = [(s.__name__, s.function, dict(s.keywords)) for s in steps]

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > most:
            raise ValueError(f"a group of {key} has {table.num_rows} rows, more than {most}")
        table = table.sort_by(order)
        frame = pd.DataFrame({c: table.column(c).to_numpy().astype(float) for c in columns}, index=pd.Index(table.column(order).to_pylist(), name=order))
        for name, function, keywords in calls:
            made = function(frame, **keywords)
            if not isinstance(made, pd.DataFrame) or len(made) != len(frame) or list(made.columns) != list(frame.columns):
                raise TypeError(f"grouped step {name!r} has to return a frame of the rows and columns that it gets")
            frame = made
        for c in columns:
            values = frame[c].to_numpy(float)
            table = table.set_column(table.column_names.index(c), c, pa.array(values, pa.float64(), mask=~np.isfinite(values)))
        return table

    typed = df.select(*(F.col(c).cast("double").alias(c) if c in columns else named(c) for c in df.columns))
    return typed.groupBy(key).applyInArrow(run, typed.schema)


def processor_name(step: Processor | Grouped) -> str:
    """Suffix of a step; keyword arguments of a partial are part of it."""
    if isinstance(step, partial):
        return "_".join([step.func.__name__, *(f"{k}{v}" for k, v in step.keywords.items())])
    return step.__name__


def process(df: DataFrame, columns: list[str], steps: list[Processor | Grouped]) -> DataFrame:
    """Adds to each column a copy, named ``<column>__<step>__<step>``, that went through all steps; no steps, no copies.

    Column steps (:func:`processor`) stay in the engine.  Grouped steps (:func:`grouped`) run over
    the copies of all columns together; neighbouring ones of one key share one pass.
    """
    if not steps:
        return df
    kept = [named(c) for c in df.columns]
    # under plain names meanwhile: keyword arguments may put dots into the final ones
    outs = {f"__out{i}": "__".join([c, *map(processor_name, steps)]) for i, c in enumerate(columns)}
    df = df.select(*kept, *(named(c).alias(o) for c, o in zip(columns, outs, strict=True)))
    for key, run in groupby(steps, lambda s: s.key if isinstance(s, Grouped) else None):
        if key is not None:
            df = apply_grouped(df, list(outs), list(run))
            continue
        for step in run:
            for out in outs:
                df = step(df, out)
    return df.select(*kept, *(F.col(o).alias(name) for o, name in outs.items()))
