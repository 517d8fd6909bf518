"""Evaluation of factors against forward returns: one panel, many lazy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import by
from lodeframe.operators import ic, portfolio, returns, series
from lodeframe.operators.calendar import rebalance_dates
from lodeframe.operators.regression import orthogonalise
from lodeframe.sources.store import FactorStore

KEYS = ["date", "code"]


@dataclass
class Evaluation:
    """A panel of factors, returns, feasibility and weights, and the tables made of it.

    Factors of ``incremental`` are what a baseline leaves of others.  The panel and its IC are
    kept in executor memory or disk until :meth:`close`.
    """

    panel: DataFrame
    factors: list[str]
    groups: int = 10
    roll: int = 60
    weight: str | None = None
    incremental: list[str] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, method: str = "spearman") -> Evaluation:
        """Describes every table; nothing is computed until one is read.  All factors go through one plan, keyed by factor."""
        t = self.tables
        self.panel = self.panel.persist()
        t["coverage"] = ic.coverage(self.panel, self.factors)
        t["mean_coverage"] = t["coverage"].groupBy("factor").agg(F.avg("coverage").alias("coverage"))
        t["ic"] = ic.information_coefficient(self.panel, self.factors, method=method).persist()
        t["ic_summary"] = series.summary(t["ic"], "ic", ["factor"])
        t["ic_rolling"] = series.rolling_stats(t["ic"], "ic", ["factor"], self.roll)
        t["ic_stability"] = series.stability(t["ic"], "ic", ["factor"], self.roll)
        if len(self.factors) > 1:
            t["correlation"] = ic.factor_correlation(self.panel, self.factors)
        rest = ["ret", "feasible", *([self.weight] if self.weight else [])]
        long = ic.unpivoted(self.panel, self.factors, [*KEYS, *rest])
        key = ("factor",)
        t["groups"] = portfolio.quantile_portfolios(long, "x", self.groups, weight=self.weight, feasible="feasible", series=key)
        t["group_summary"] = portfolio.group_summary(t["groups"], series=key)
        t["performance"] = returns.performance(t["groups"], "ret", ["factor", "grp"])
        t["monotonicity"] = portfolio.monotonicity(t["groups"], self.groups, series=key)
        return self

    def summary(self) -> DataFrame:
        """One row per factor: ``restype`` (raw or inc), coverage, IC summary, stability, monotonicity."""
        t = self.tables
        out = t["mean_coverage"].join(t["ic_summary"], "factor", "left").join(t["ic_stability"].drop("n"), "factor", "left").join(t["monotonicity"], "factor", "left")
        kind = F.when(F.col("factor").isin(self.incremental), "inc").otherwise("raw") if self.incremental else F.lit("raw")
        return out.withColumn("restype", kind)

    def close(self) -> None:
        """Gives the memory of the panel and its IC back."""
        self.panel.unpersist()
        self.tables["ic"].unpersist()


def evaluation_panel(factors: DataFrame, future: DataFrame, feasible: DataFrame | None = None, weight: DataFrame | None = None) -> DataFrame:
    """Factors and returns on common keys; feasibility (unknown: true) and weight where given."""
    out = factors.join(future.select(*KEYS, "ret"), KEYS)
    if feasible is not None:
        out = out.join(feasible.select(*KEYS, F.col("feasible").alias("__f")), KEYS, "left")
        out = out.withColumn("feasible", F.coalesce("__f", F.lit(True))).drop("__f")
    else:
        out = out.withColumn("feasible", F.lit(True))
    return out if weight is None else out.join(weight.select(*KEYS, F.col("weight")), KEYS, "left")


def run_test(
    quotes: DataFrame,
    instruments: DataFrame,
    factors: DataFrame,
    names: list[str],
    price: str = "price",
    horizon: int = 1,
    groups: int = 10,
    roll: int = 60,
    baseline: list[str] | None = None,
    rebalance: bool = True,
    weight: DataFrame | None = None,
    begin: object = None,
    end: object = None,
    min_list_days: int = 90,
) -> Evaluation:
    """Mask untradable prices, take forward returns, keep rebalance dates from ``begin`` to ``end``, optionally less a baseline, evaluate.

    With a baseline every other factor also appears as ``<factor>_ortho``, the part that the
    baseline of the same date does not explain.  ``weight`` (date, code, weight) weights the
    returns of the groups.
    """
    mask = returns.feasible(quotes, instruments, min_list_days)
    masked = returns.tradable(quotes.select(*KEYS, price), mask, price)
    future = masked.select(*KEYS, returns.forward_return(price, horizon).alias("ret"))
    if rebalance and horizon > 1:
        future = rebalance_dates(future, horizon)
    if begin is not None:
        future = future.where(F.col("date") >= F.lit(begin))
    if end is not None:
        future = future.where(F.col("date") <= F.lit(end))
    rows = evaluation_panel(factors, future, mask, weight)
    left = []
    for f in names if baseline else []:
        if f not in baseline:
            rows = orthogonalise(rows, f, baseline)
            left.append(f"{f}_ortho")
    return Evaluation(rows, [*names, *left], groups, roll, "weight" if weight is not None else None, left).run()


def load_test(store: FactorStore, factors: list[str], price: str, weight: str | None = None, begin: object = None, end: object = None, horizon: int = 1, quotes: str = "quotes", instruments: str = "instruments", baseline: list[str] | None = None, **rules: object) -> Evaluation:
    """:func:`run_test` on columns of a store's tables, named by paths; prices reach ``horizon + 1`` dates beyond the end."""
    names = lambda df: [c for c in df.columns if c not in KEYS]
    x = store.load([*factors, *(b for b in baseline or [] if b not in factors)], begin, end)
    own, base = names(store.load(factors, begin, end)), names(store.load(baseline, begin, end)) if baseline else None
    prices = store.load(price, begin, end, pad_end=horizon + 1)
    flags = store.load([f"{quotes}/{c}" for c in ("high", "low", "limit_up", "limit_down", "st", "suspended")], begin, end, pad_end=horizon + 1)
    weights = store.load(f"{weight} AS weight", begin, end) if weight else None
    column = names(prices)[0]
    traded = flags.join(prices.select(*KEYS, F.col(column).alias("__price")), KEYS, "left").withColumnRenamed("__price", column)
    return run_test(traded, store.table(instruments), x, own, column, horizon, baseline=base, weight=weights, begin=begin, end=end, **rules)


def run_tests(tests: dict[str, Evaluation]) -> DataFrame:
    """The summaries of several tests as rows with ``test_key``."""
    out = None
    for key, test in tests.items():
        part = test.summary().withColumn("test_key", F.lit(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def total_correlation(tests: dict[str, Evaluation], method: str = "pearson") -> DataFrame:
    """``date, f1, f2, corr`` over the outer-joined factors of all tests, named ``<test>__<factor>``."""
    out, names = None, []
    for key, test in tests.items():
        own = {f: f"{key}__{f}" for f in test.factors}
        part = test.panel.select(*KEYS, *(F.col(f).alias(n) for f, n in own.items()))
        out = part if out is None else out.join(part, KEYS, "full")
        names += own.values()
    return ic.factor_correlation(out, names, method)


def return_distribution(groups: DataFrame, bins: int = 30) -> DataFrame:
    """``grp, bin, n``: histogram of each group's returns between its extremes.

    Returns and extremes come from one evaluation: sums taken twice may differ in the last bit, and
    the least return would then fall below its own extreme.
    """
    within = by("grp")
    rows = groups.where("ret is not null").select("grp", "ret", F.min("ret").over(within).alias("lo"), F.max("ret").over(within).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("ret") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return rows.groupBy("grp", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
