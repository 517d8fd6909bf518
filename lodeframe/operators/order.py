"""Ranks, quantiles and buckets of groups of any size: one date is many tasks.

The values of a group are first counted (a tie that a third of all rows share arrives as one
row a task), the distinct ones are dealt into ranges in their order, and running counts inside
a range are put on top of the counts of the ranges before it.  All results are exact; the
sample that Spark takes for the ranges only decides where one ends, and the dealt values are written
to the shared folder so that every reader sees the same ranges.  Windows by date
(:mod:`lodeframe.operators.transforms`) do the same with less work where a date fits one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import place_in
from lodeframe.operators.transforms import bounded
from lodeframe.session import kept

#: Ranges that the values of all groups are dealt into.
RANGES = 256


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Keys of ``a`` equal to those of ``b``, which are called ``__k0``, ``__k1`` and so on; NULL is a key."""
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & a[k].eqNullSafe(b[f"__k{i}"])
    return met


def _renamed(df: DataFrame, keys: list[str], *others: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *others)


def distribution(df: DataFrame, x: str, keys: list[str], ranges: int = RANGES, times: str | None = None) -> DataFrame:
    """``keys, value, n, before, total``: how often each present value of ``x`` occurs in its group, the rows with smaller ones, and all.

    A row counts as often as its column ``times`` says (once without it).  Writes the distinct
    values with their counts and ranges; the rest is lazy.
    """
    often = F.col(times) if times else F.lit(1)
    values = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("value"), often.alias("n")).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    placed = kept(values.repartitionByRange(ranges, *keys, "value").withColumn("__range", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "__range").agg(F.sum("n").alias("__sum"))
    by = Window.partitionBy(*keys)
    below = F.sum("__sum").over(by.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = _renamed(sums.select(*keys, F.col("__range").alias("__r"), F.coalesce(below, F.lit(0)).alias("__below"), F.sum("__sum").over(by).alias("total")), keys, "__r", "__below", "total")
    inside = Window.partitionBy(*keys, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("*", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("__in"))
    both = placed.join(sums, _on(placed, sums, keys) & (placed["__range"] == sums["__r"]))
    return both.select(*keys, "value", "n", (F.col("__below") + F.col("__in")).alias("before"), "total")


def with_ranks(df: DataFrame, x: str, keys: list[str], out: str, ascending: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Adds the rank of ``x`` in its group, from 1, with the mean rank for ties; missing stays missing.

    Rows without ``x`` meet nothing, so they are spread over the tasks of the join by all their columns.
    """
    known = distribution(df, x, keys) if known is None else known
    rank = F.col("before") + (F.col("n") + 1) / 2
    ranks = _renamed(known.select(*keys, F.col("value").alias("__value"), (rank if ascending else F.col("total") + 1 - rank).alias("__rank")), keys, "__value", "__rank")
    # zero of every value, but not a constant, which would not be a key of the join
    ranks = ranks.withColumn("__none", F.pmod(F.xxhash64("__value"), F.lit(1)).cast("int"))
    # maps have no hash
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.when(F.col(x).isNull(), F.pmod(F.xxhash64(*hashed), F.lit(4096)).cast("int") + 1).otherwise(0)
    joined = df.join(ranks, _on(df, ranks, keys) & (F.col(x).cast("double") == F.col("__value")) & (spread == F.col("__none")), "left")
    return joined.select(*df.columns, F.col("__rank").alias(out))


def quantile_values(known: DataFrame, keys: list[str], shares: list[tuple[int, int]]) -> DataFrame:
    """``keys, edges``: for each share (k, n) the value at position (total - 1) * k / n of a group, linear between neighbours.

    Positions are computed in integers, so an edge that falls on a value is that value.
    """
    spots = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n")) for i, (k, n) in enumerate(shares)))
    at = "(total - 1) * s.k div s.n"
    hit = f"filter(spots, s -> ({at} >= before and {at} < before + n) or ({at} + 1 >= before and {at} + 1 < before + n))"
    rows = known.withColumn("spots", spots).withColumn("spots", F.expr(hit)).where(F.size("spots") > 0)
    rows = rows.select(*keys, "value", "n", "before", "total", F.explode("spots").alias("s"))
    low, high = (F.max(F.expr(f"if({at} + {d} >= before and {at} + {d} < before + n, value, null)")) for d in (0, 1))
    part = F.max(F.expr("((total - 1) * s.k % s.n) / cast(s.n as double)"))
    edges = rows.groupBy(*keys, F.col("s.i").alias("i")).agg(F.when(part == 0, low).otherwise(low + (high - low) * part).alias("edge"))
    return edges.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge"))), lambda e: e["edge"]).alias("edges"))


def with_buckets(df: DataFrame, x: str, n: int, keys: list[str], out: str, known: DataFrame | None = None) -> DataFrame:
    """Adds the quantile bucket 1..n of ``x`` in its group, as :func:`lodeframe.functions.columns.quantile_bucket` does."""
    known = distribution(df, x, keys) if known is None else known
    edges = quantile_values(known, keys, [(k, n) for k in range(n + 1)])
    edges = _renamed(edges.select(*keys, F.array_distinct("edges").alias("__edges")), keys, "__edges")
    joined = df.join(edges, _on(df, edges, keys), "left")
    return joined.select(*df.columns, place_in(F.col(x).cast("double"), F.col("__edges")).cast("int").alias(out))


def with_median_bounds(df: DataFrame, x: str, dev: float, keys: list[str], out: str, drop: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Adds ``x`` bounded at the median and ``dev`` median absolute deviations around it, as :func:`lodeframe.operators.transforms.mad_outlier` does."""
    half = [(1, 2)]
    known = distribution(df, x, keys) if known is None else known
    middle = _renamed(quantile_values(known, keys, half).select(*keys, F.col("edges")[0].alias("__mid")), keys, "__mid")
    away = known.join(middle, _on(known, middle, keys)).select(*keys, F.abs(F.col("value") - F.col("__mid")).alias("away"), "n")
    spread = _renamed(quantile_values(distribution(away, "away", keys, times="n"), keys, half).select(*keys, F.col("edges")[0].alias("__mad")), keys, "__mad")
    joined = df.join(middle, _on(df, middle, keys), "left").drop(*(f"__k{i}" for i in range(len(keys))))
    joined = joined.join(spread, _on(joined, spread, keys), "left")
    reach = dev * F.col("__mad")
    return joined.select(*df.columns, bounded(x, F.col("__mid") - reach, F.col("__mid") + reach, drop).alias(out))
