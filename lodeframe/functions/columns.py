"""Column functions for panels.

Missing values are NULL throughout: :func:`clean` turns NaN and infinities into
NULL once, when a table is read, and every division goes through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType
from pyspark.sql.window import WindowSpec


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def named(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite values of floating columns become NULL."""
    finite = lambda c: F.when(~F.isnan(named(c)) & (F.abs(named(c)) < F.lit(float("inf"))), named(c)).alias(c)
    return df.select(*(finite(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else named(f.name) for f in df.schema.fields))


def number(x: str | Column) -> Column:
    """Numeric value; what is not a finite number becomes NULL."""
    value = col(x).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def keep(x: str | Column, value: Column) -> Column:
    """``value`` where x is present; least and greatest skip NULL and would invent one."""
    return F.when(col(x).isNotNull(), value)


def average_rank(x: str | Column, within: WindowSpec, ascending: bool = True) -> Column:
    """Rank from 1 with the mean rank for ties; missing stays missing.  ``within`` has keys only."""
    x = col(x)
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    keys = within.orderBy(order)
    # rows up to the end of the tie less half of the tie
    ties = F.count(x).over(keys.rangeBetween(Window.currentRow, Window.currentRow))
    return keep(x, F.rank().over(keys) + (ties - 1) / 2)


def pair(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Both columns where both are present."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation of complete pairs; NULL for a constant side or fewer than two pairs."""
    a, b = pair(x, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= 2, F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-300, spread)))


def place_in(x: str | Column, edges: Column) -> Column:
    """Bucket of x between right-closed edges, the minimum in bucket 1; NULL with fewer than two edges."""
    x = col(x)
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull() & (F.size(edges) >= 2), F.greatest(F.lit(1), below))


def quantile_bucket(df: DataFrame, x: str, n: int, keys: list[str], out: str) -> DataFrame:
    """Adds the quantile bucket 1..n of ``x`` within each group of ``keys``; equal edges merge.

    Edge k lies at position ``(count - 1) * k / n`` of the sorted values.  Positions are
    computed in integers, so an edge that falls on a value is that value.  Only the
    few rows at those positions are gathered per group.
    """
    order = Window.partitionBy(*keys)
    ranked = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("__x"), (F.row_number().over(order.orderBy(x)) - 1).alias("__r"), (F.count(F.lit(1)).over(order) - 1).alias("__m"))
    near = ranked.where(F.expr(f"exists(sequence(0, {n}), k -> __r - (__m * k) div {n} in (0, 1))"))
    found = near.groupBy(*keys).agg(F.max("__m").alias("__m"), F.map_from_entries(F.collect_list(F.struct("__r", "__x"))).alias("__v"))
    low = "element_at(__v, cast((__m * k) div {n} as int))"
    high = "element_at(__v, cast((__m * k) div {n} + 1 as int))"
    edge = f"if((__m * k) % {n} = 0, {low}, {low} + ({high} - {low}) * (((__m * k) % {n}) / {float(n)}D))".replace("{n}", str(n))
    edges = found.select(*(F.col(k).alias(f"__{k}") for k in keys), F.expr(f"array_distinct(transform(sequence(0, {n}), k -> {edge}))").alias("__e"))
    joined = df.join(edges, [df[k].eqNullSafe(edges[f"__{k}"]) for k in keys], "left")
    return joined.withColumn(out, place_in(x, F.col("__e")).cast("int")).drop("__e", *(f"__{k}" for k in keys))


def tidy(x: str | Column, digits: int = 6) -> Column:
    """Rounded half up for reports, without negative zero, by the same double operations in every engine."""
    unit = F.lit(10.0**digits)
    return F.floor(col(x) * unit + F.lit(0.5)) / unit + F.lit(0.0)
