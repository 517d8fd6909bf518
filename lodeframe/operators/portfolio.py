"""Quantile portfolios by single, independent and conditional sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import average_rank, by, correlation, quantile_bucket, ratio
from lodeframe.operators.series import newey_west


def group_return(ret: str = "ret", weight: str | None = None) -> Column:
    """Aggregate: weighted return of present returns; weights that are missing or negative count as zero, none positive as equal."""
    r = F.col(ret)
    if weight is None:
        return F.avg(r)
    w = F.when(r.isNotNull() & (F.col(weight) > 0), F.col(weight).cast("double")).otherwise(0.0)
    return F.when(F.sum(w) > 0, ratio(F.sum(w * r), F.sum(w))).otherwise(F.avg(r))


def _split(df: DataFrame, x: str, n: int, keys: list[str], out: str) -> DataFrame:
    """Bucket of ``x``; 0 for a whole group that cannot be split, NULL for rows without x in one that can."""
    df = quantile_bucket(df, x, n, keys, out)
    return df.withColumn(out, F.when(F.max(out).over(Window.partitionBy(*keys)).isNull(), F.lit(0)).otherwise(F.col(out)))


def quantile_portfolios(df: DataFrame, factor: str, n: int = 10, mode: str = "single", controls: list[str] | None = None, control_groups: int | None = None, ret: str = "ret", weight: str | None = None, feasible: str | None = None, date: str = "date", series: tuple[str, ...] = ()) -> DataFrame:
    """``series, date, cell, grp, ret``: returns of the factor's quantile groups, in every series by itself.

    ``single`` sorts within a date.  ``independent`` buckets every control and the factor on
    the whole date; the labels of the controls make a cell.  ``conditional`` splits by the
    first control, inside by the next, then by the factor; a cell that cannot be
    split stays whole.  Only rows with a return (and feasible) count.
    """
    rows = df.where(F.col(ret).isNotNull())
    if feasible:
        rows = rows.where(F.coalesce(F.col(feasible), F.lit(False)))
    m, labels = control_groups or n, []
    for i, control in enumerate(controls or []):
        label = f"__c{i}"
        if mode == "independent":
            rows = quantile_bucket(rows, control, m, [*series, date], label)
        elif mode == "conditional":
            rows = _split(rows, control, m, [*series, date, *labels], label).where(F.col(label).isNotNull())
        else:
            raise ValueError("controls go with an independent or conditional sort")
        labels.append(label)
    if mode not in ("single", "independent", "conditional"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = quantile_bucket(rows, factor, n, [*series, date, *labels] if mode == "conditional" else [*series, date], "grp")
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*labels, "grp"]))
    cell = F.concat_ws("_", *(F.col(c).cast("string") for c in labels)) if labels else F.lit("")
    return rows.withColumn("cell", cell).groupBy(*series, date, "cell", "grp").agg(group_return(ret, weight).alias("ret"))


def high_minus_low(groups: DataFrame, date: str = "date") -> DataFrame:
    """``date, hl``: return of the highest group less that of the lowest, summed over cells; missing sides count as zero if any is there."""
    ends = groups.where("ret is not null").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    marked = groups.withColumn("__k", F.lit(1)).join(ends.withColumn("__k", F.lit(1)), "__k")
    return marked.groupBy(date).agg(F.sum(F.when(F.col("grp") == F.col("hi"), F.col("ret")).when(F.col("grp") == F.col("lo"), -F.col("ret"))).alias("hl"))


def group_summary(groups: DataFrame, date: str = "date", series: tuple[str, ...] = ()) -> DataFrame:
    """``series, grp, n, mean, t`` over dates, cells averaged first; t divides by the root of all dates, missing ones included."""
    groups = groups.withColumn("__k", F.lit(1))
    key = ["__k", *series]
    days = groups.select(*key, date).distinct().groupBy(*key).agg(F.count("*").alias("n"))
    per_day = groups.groupBy(*key, date, "grp").agg(F.avg("ret").alias("ret"))
    out = per_day.groupBy(*key, "grp").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("__s")).join(days, key)
    return out.select(*series, "grp", "n", "mean", ratio("mean", F.col("__s") / F.sqrt("n")).alias("t"))


def monotonicity_by_date(groups: DataFrame, n: int, date: str = "date", series: tuple[str, ...] = ()) -> DataFrame:
    """``series, date, spearman, slope, kendall`` of group return on group number, where max(5, n // 2) groups have a return."""
    key = [*series, date]
    rows = groups.groupBy(*key, "grp").agg(F.avg("ret").alias("ret")).where("ret is not null")
    rows = rows.withColumn("__n", F.count("*").over(by(*key))).where(F.col("__n") >= max(5, n // 2))
    ranked = rows.withColumn("__g", average_rank("grp", by(*key))).withColumn("__r", average_rank("ret", by(*key)))
    # n groups a date at most, and n (n - 1) / 2 signs of their differences
    later = "transform(slice(__all, i + 2, size(__all)), y -> signum(y.ret - x.ret))"
    signs = F.expr(f"flatten(transform(__all, (x, i) -> {later}))")
    out = ranked.groupBy(*key).agg(correlation("__g", "__r").alias("spearman"), F.regr_slope("ret", "grp").alias("slope"), F.sort_array(F.collect_list(F.struct("grp", "ret"))).alias("__all"))
    total = F.expr("aggregate(__signs, 0D, (a, s) -> a + s)")
    met = F.expr("size(__signs) * aggregate(__signs, 0D, (a, s) -> a + s * s)")
    return out.withColumn("__signs", signs).select(*key, "spearman", "slope", ratio(total, F.sqrt(met)).alias("kendall"))


def monotonicity(groups: DataFrame, n: int, date: str = "date", least: int = 30, series: tuple[str, ...] = ()) -> DataFrame:
    """One row a series: means, t (with 30 dates at least), share of positive rank correlations, Newey-West t of the slope."""
    daily = monotonicity_by_date(groups, n, date, series).withColumn("__k", F.lit(1))
    key = ["__k", *series] if series else []

    def t(c: str) -> Column:
        return F.when(F.count(c) >= least, ratio(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c))))

    out = daily.groupBy(*key).agg(
        F.avg("spearman").alias("spearman_mean"),
        t("spearman").alias("spearman_t"),
        F.avg((F.col("spearman") > 0).cast("double")).alias("win_rate"),
        F.avg("slope").alias("slope_mean"),
        F.avg("kendall").alias("kendall_mean"),
        t("kendall").alias("kendall_t"),
    )
    out = out if series else out.withColumn("__k", F.lit(1))
    nw = newey_west(daily, "slope", ["__k", *series], date).select("__k", *series, F.col("nw_t").alias("slope_nw_t"))
    return out.join(nw, ["__k", *series], "left").drop("__k")
