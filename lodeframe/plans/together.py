"""Many tests of factors in one plan: a table of tests meets the panel, and every table is keyed by test and factor.

The number of operators does not depend on the number of tests or factors: tests are rows.  Only
each distinct baseline adds a regression, and each distinct horizon one expression of a window that all share.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import average_rank, by, correlation, pair, ratio
from lodeframe.operators import ic, portfolio, returns, series
from lodeframe.operators.calendar import with_date_idx
from lodeframe.operators.regression import residuals

KEYS = ["date", "code"]
TEST = ("test_key", "factor")


@dataclass(frozen=True)
class Test:
    """What one test looks at; with a baseline every factor outside it also appears as ``<factor>_ortho``."""

    __test__ = False  # not a case for pytest

    factors: tuple[str, ...]
    horizon: int = 1
    baseline: tuple[str, ...] = ()
    rebalance: bool = True
    begin: object = None
    end: object = None

    def rows(self, key: str, variants: dict[tuple[str, ...], int]) -> list[tuple]:
        every = self.horizon if self.rebalance else 1
        head = (key, self.horizon, every, self.begin, self.end)
        raw = [(*head, f, 0, f, "raw") for f in self.factors]
        return raw + [(*head, f, variants[self.baseline], f"{f}_ortho", "inc") for f in self.factors if self.baseline and f not in self.baseline]


_PARAMETERS = "test_key string, horizon int, every int, begin date, end date, source string, variant int, factor string, restype string"


@dataclass
class Together:
    """Rows ``test_key, factor, date, code, x, ret, feasible`` (and weight) of all tests, and the tables made of them."""

    rows: DataFrame
    parameters: DataFrame
    names: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """One row a test and factor: ``restype`` (raw or inc), coverage, IC summary, stability, monotonicity."""
        t, key = self.tables, list(TEST)
        out = t["mean_coverage"].join(t["ic_summary"], key, "left").join(t["ic_stability"].drop("n"), key, "left").join(t["monotonicity"], key, "left")
        return out.join(self.parameters.select(*key, "restype"), key)

    def correlation(self, method: str = "pearson") -> DataFrame:
        """``date, f1, f2, corr`` of the factors of all tests, named ``<test>__<factor>``."""
        named = self.rows.select(*KEYS, "x", F.concat_ws("__", *TEST).alias("__name"))
        return ic.factor_correlation(named.groupBy(*KEYS).pivot("__name", self.names).agg(F.first("x")), self.names, method)

    def close(self) -> None:
        """Gives the memory of the rows and their IC back."""
        self.rows.unpersist()
        self.tables["ic"].unpersist()


def _panel(quotes: DataFrame, instruments: DataFrame, factors: DataFrame, price: str, horizons: list[int], weight: DataFrame | None, min_list_days: int) -> DataFrame:
    """Factors with feasibility, weight, the position of the date and returns by horizon (``__rets``)."""
    mask = returns.feasible(quotes, instruments, min_list_days)
    masked = returns.tradable(quotes.select(*KEYS, price), mask, price)
    rets = F.create_map(*(c for h in horizons for c in (F.lit(h), returns.forward_return(price, h))))
    future = with_date_idx(masked.select(*KEYS, rets.alias("__rets")))
    out = factors.join(future, KEYS).join(mask.select(*KEYS, F.coalesce("feasible", F.lit(True)).alias("__f")), KEYS, "left")
    out = out.withColumn("feasible", F.coalesce("__f", F.lit(True))).drop("__f")
    return out if weight is None else out.join(weight.select(*KEYS, "weight"), KEYS, "left")


def run_together(
    quotes: DataFrame,
    instruments: DataFrame,
    factors: DataFrame,
    tests: dict[str, Test],
    price: str = "price",
    groups: int = 10,
    roll: int = 60,
    weight: DataFrame | None = None,
    min_list_days: int = 90,
    method: str = "spearman",
) -> Together:
    """All ``tests`` by the rules of :func:`lodeframe.plans.evaluate.run_test`, in one plan.

    ``factors`` holds the columns of all tests.  Numbers of groups and rolling dates are those of
    the whole run.  Nothing is computed until a table is read; the rows of all tests and their IC are then kept in
    executor memory or disk until :meth:`Together.close`.
    """
    if not tests or not all(t.factors for t in tests.values()):
        raise ValueError("every test names factors")
    if method not in ("pearson", "spearman"):
        raise ValueError(f"method is pearson or spearman, not {method!r}")
    variants = {b: i + 1 for i, b in enumerate(sorted({t.baseline for t in tests.values() if t.baseline}))}
    parameters = quotes.sparkSession.createDataFrame([r for k, t in tests.items() for r in t.rows(k, variants)], _PARAMETERS)
    panel = _panel(quotes, instruments, factors, price, sorted({t.horizon for t in tests.values()}), weight, min_list_days)
    rest = [*KEYS, "date_idx", "__rets", "feasible", *(["weight"] if weight is not None else [])]
    names = sorted({f for t in tests.values() for f in t.factors})
    parts = [ic.unpivoted(panel, names, rest).withColumn("variant", F.lit(0))]
    for baseline, variant in variants.items():
        own = sorted({f for t in tests.values() if t.baseline == baseline for f in t.factors if f not in baseline})
        if own:
            renamed = {b: f"__base{i}" for i, b in enumerate(baseline)}
            wide = panel.withColumns({n: F.col(b).cast("double") for b, n in renamed.items()})
            left = residuals(ic.unpivoted(wide, own, [*rest, *renamed.values()]), "x", list(renamed.values()), ["date", "factor"], "__left")
            parts.append(left.select(*rest, "factor", F.col("__left").alias("x"), F.lit(variant).alias("variant")))
    long = reduce(DataFrame.unionByName, parts).withColumnRenamed("factor", "source")
    t = long.join(parameters.drop("restype"), ["source", "variant"])
    t = t.where("(begin is null or date >= begin) and (end is null or date <= end) and (date_idx - 1) % every = 0")
    keep = [*TEST, *KEYS, "x", F.element_at("__rets", F.col("horizon")).alias("ret"), "feasible", *(["weight"] if weight is not None else [])]
    rows = t.select(*keep).persist()
    found = parameters.select(*TEST, "restype")
    out = Together(rows, found, [f"{k}__{r[7]}" for k, test in tests.items() for r in test.rows(k, variants)])
    _describe(out, groups, roll, "weight" if weight is not None else None, method)
    return out


def _describe(out: Together, groups: int, roll: int, weight: str | None, method: str) -> None:
    t, rows, key = out.tables, out.rows, list(TEST)
    t["coverage"] = rows.groupBy(*key, "date").agg(ratio(F.count("x").cast("double"), F.count("ret")).alias("coverage"))
    t["mean_coverage"] = t["coverage"].groupBy(*key).agg(F.avg("coverage").alias("coverage"))
    x, y = pair("x", "ret")
    both = rows.select(*key, "date", x.alias("x"), y.alias("ret"))
    if method == "spearman":
        w = by(*key, "date")
        both = both.select(*key, "date", average_rank("x", w).alias("x"), average_rank("ret", w).alias("ret"))
    t["ic"] = both.groupBy(*key, "date").agg(correlation("x", "ret").alias("ic")).persist()
    t["ic_summary"] = series.summary(t["ic"], "ic", key)
    t["ic_rolling"] = series.rolling_stats(t["ic"], "ic", key, roll)
    t["ic_stability"] = series.stability(t["ic"], "ic", key, roll)
    t["groups"] = portfolio.quantile_portfolios(rows, "x", groups, weight=weight, feasible="feasible", series=TEST)
    t["group_summary"] = portfolio.group_summary(t["groups"], series=TEST)
    t["performance"] = returns.performance(t["groups"], "ret", [*key, "grp"])
    t["monotonicity"] = portfolio.monotonicity(t["groups"], groups, series=TEST)
