"""Several factors into one: IC-weighted composites, style exposures, the cross-sectional model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import number, ratio
from lodeframe.operators.ic import information_coefficient, unpivoted
from lodeframe.operators.regression import _invert
from lodeframe.operators.returns import forward_return
from lodeframe.operators.transforms import weighted_zscore
from lodeframe.session import kept
from lodeframe.sources.store import FactorStore

KEYS = ["date", "code"]


def rolling_ic_weights(ic: DataFrame, window: int, least: int, lag_days: int = 1) -> DataFrame:
    """``date, factor, weight``: mean IC of the last ``window`` dates, known ``lag_days`` dates before.

    ``lag_days = 0`` uses the same date's IC, which looks ahead.
    """
    dates = Window.partitionBy("factor").orderBy("date")
    frame = dates.rowsBetween(-(window - 1), 0)
    rows = ic.withColumn("__w", F.when(F.count("ic").over(frame) >= least, F.avg("ic").over(frame)))
    return rows.select("date", "factor", (F.lag("__w", lag_days).over(dates) if lag_days else F.col("__w")).alias("weight"))


class Composer:
    """Template of a composite: load, align, preprocess, compose, postprocess.

    Override any hook; each takes and returns DataFrames keyed by (date, code).  The
    result of :meth:`run` has the keys and one column, ``target``.
    """

    def __init__(self, store: FactorStore, factors: list[str], target: str, begin: object = None, end: object = None, window: int = 60, horizon: int = 1):
        self.store, self.factors, self.target = store, factors, target
        self.begin, self.end, self.window, self.horizon = begin, end, window, horizon

    def load_x(self) -> DataFrame:
        """Factors with ``window`` dates of history, values that are no numbers missing."""
        x = self.store.load(self.factors, self.begin, self.end, pad_begin=self.window)
        return x.select(*KEYS, *(number(c).alias(c) for c in x.columns if c not in KEYS))

    def load_y(self) -> DataFrame:
        """Forward returns of the target price, with the dates after the end that they need."""
        prices = self.store.load(self.target, self.begin, self.end, pad_begin=self.window, pad_end=self.horizon + 1)
        price = next(c for c in prices.columns if c not in KEYS)
        return prices.select(*KEYS, forward_return(price, self.horizon).alias("ret"))

    def align(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """Rows whose key is on both sides."""
        return x.join(y, KEYS)

    def preprocess(self, rows: DataFrame) -> DataFrame:
        return rows

    def compose(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def postprocess(self, out: DataFrame) -> DataFrame:
        return out

    def run(self) -> DataFrame:
        out = self.postprocess(self.compose(self.preprocess(self.align(self.load_x(), self.load_y()))))
        if sorted(out.columns) != sorted([*KEYS, "target"]):
            raise ValueError(f"a composite has one column, target; got {out.columns}")
        return out


#: Prefix of the columns that keep what a score was made of.
RAW = "__raw_"


def scored(rows: DataFrame, factors: list[str], weight: str, *others: str) -> DataFrame:
    """Keys, ``others``, the weighted z-score of every factor and, under :data:`RAW`, what it was made of."""
    return rows.select(*KEYS, *others, *(weighted_zscore(f, weight).alias(f) for f in factors), *(F.col(f).alias(RAW + f) for f in factors))


def ic_composite(rows: DataFrame, factors: list[str], window: int, least: int, ret: str = "ret", signed: bool = False, lag_days: int = 1, out: str = "target") -> DataFrame:
    """``date, code, target``: factors weighted by their rolling IC.

    The sum of weight * x over present terms is divided by the sum of the weights'
    absolute values, or of the weights themselves with ``signed``; zero sums give NULL.

    Scores (:func:`scored`) are ranked by what they were made of, which has the same order.  Two
    values one step apart may share a score or not, as the last bits of the date's sums happen to
    fall, so ties among scores would depend on the order of the rows.
    """
    order = rows.select("date", ret, *(F.when(F.col(f).isNotNull(), F.col(RAW + f)).alias(f) if RAW + f in rows.columns else F.col(f) for f in factors))
    weights = rolling_ic_weights(information_coefficient(order, factors, ret), window, least, lag_days)
    long = unpivoted(rows, factors, KEYS).join(weights, ["date", "factor"], "left")
    w = F.when(F.col("x").isNotNull(), F.col("weight"))
    total = F.sum(w if signed else F.abs(w))
    return long.groupBy(*KEYS).agg(ratio(F.sum(w * F.col("x")), total).alias(out))


class IcComposer(Composer):
    """IC-weighted composite between two weighted z-scores."""

    def __init__(self, *args: object, weight: DataFrame | None = None, least: int = 1, lag_days: int = 1, signed: bool = False, **kwargs: object):
        super().__init__(*args, **kwargs)
        self.weight, self.least, self.lag_days, self.signed = weight, least, lag_days, signed

    def preprocess(self, rows: DataFrame) -> DataFrame:
        if self.weight is None:
            return rows
        rows = rows.join(self.weight.select(*KEYS, F.col("weight").alias("__w")), KEYS, "left")
        return scored(rows, [c for c in rows.columns if c not in (*KEYS, "ret", "__w")], "__w", "ret")

    def compose(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in (*KEYS, "ret") and not c.startswith(RAW)]
        return ic_composite(rows, names, self.window, self.least, signed=self.signed, lag_days=self.lag_days)

    def postprocess(self, out: DataFrame) -> DataFrame:
        if self.weight is None:
            return out
        out = out.join(self.weight.select(*KEYS, F.col("weight").alias("__w")), KEYS, "left")
        return out.select(*KEYS, weighted_zscore("target", "__w").alias("target"))


def style_exposures(rows: DataFrame, styles: dict[str, list[str]], weight: str, window: int, least: int, ret: str = "ret", lag_days: int = 1) -> DataFrame:
    """One column per style: its factors z-scored by weight, composed by rolling IC, z-scored again.

    All styles go through one plan, keyed by style.
    """
    out = None
    rows = rows.withColumn("__w", F.col(weight))
    scores = scored(rows, list(dict.fromkeys(f for s in styles.values() for f in s)), "__w", ret)
    for style, factors in styles.items():
        part = ic_composite(scores, factors, window, least, ret, lag_days=lag_days, out="v").withColumn("style", F.lit(style))
        out = part if out is None else out.unionByName(part)
    wide = out.groupBy(*KEYS).pivot("style", list(styles)).agg(F.first("v"))
    wide = wide.join(rows.select(*KEYS, "__w"), KEYS)
    return wide.select(*KEYS, *(weighted_zscore(s, "__w").alias(s) for s in styles))


def industry_caps(rows: DataFrame, industry: str = "first_industry_code", cap: str = "cap") -> DataFrame:
    """``date, industry, cap``: total cap of every industry with a name."""
    return rows.where(F.col(industry).isNotNull()).groupBy("date", F.col(industry).alias("industry")).agg(F.sum(cap).alias("cap"))


def base_industry(rows: DataFrame, industry: str = "first_industry_code", cap: str = "cap") -> DataFrame:
    """``date, industry``: the one with the largest cap, the first by name of equals."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("cap"), "industry"))
    return industry_caps(rows, industry, cap).withColumn("__p", place).where("__p = 1").select("date", "industry")


def style_coverage(rows: DataFrame, styles: list[str]) -> DataFrame:
    """``date`` and the share of present values of every style."""
    return rows.groupBy("date").agg(*(F.avg(F.col(s).isNotNull().cast("double")).alias(s) for s in styles))


def barra_regression(rows: DataFrame, styles: list[str], ret: str = "ret", industry: str = "first_industry_code", cap: str = "cap", min_style_coverage: float = 0.5, min_codes: int = 100, min_rows: int = 20, spare_rows: int = 5, base_rule: str = "max_cap", keep_found: bool = False) -> tuple[DataFrame, DataFrame]:
    """Daily regression of returns on a constant, industries and styles, weighted by cap.

    Returns factor returns ``date, term, ret`` (terms const, ind_<code>, styles) and specific
    returns ``date, code, specific``.  Rows need an industry.  On each date styles with
    too few present values are left out, rows need a return, positive cap and all kept
    styles; the base is the largest industry (``base_rule`` max_cap) or the first by name
    (first), which the levelling below makes the same.  Industry returns are then levelled so
    that their cap-weighted sum is zero, and the constant takes the difference.  Dates with
    fewer codes or rows than the limits give no factor returns.

    Sums are taken per date and industry; one small system per date is solved on them.
    ``keep_found`` writes the factor returns to the shared folder, so that specific returns do not solve again.
    """
    if base_rule not in ("max_cap", "first"):
        raise ValueError(f"base_rule is max_cap or first, not {base_rule!r}")
    named = rows.where(F.col(industry).isNotNull()).withColumn("__ind", F.col(industry).cast("string"))
    daily = named.groupBy("date").agg(F.count("*").alias("__codes"), *(F.avg(F.col(s).isNotNull().cast("double")).alias(f"__c_{s}") for s in styles))
    keep = F.array(*(F.col(f"__c_{s}") >= min_style_coverage for s in styles)) if styles else F.array().cast("array<boolean>")
    named = named.join(daily.select("date", "__codes", keep.alias("__keep")), "date")
    usable = F.col(ret).isNotNull() & (F.col(cap) > 0)
    for i, s in enumerate(styles):
        usable = usable & (~F.col("__keep")[i] | F.col(s).isNotNull())
    w, y = F.col(cap).cast("double"), F.col(ret).cast("double")
    x = [F.when(F.col("__keep")[i], F.col(s).cast("double")).otherwise(0.0) for i, s in enumerate(styles)]
    k = len(styles)
    sums = [F.sum(w), F.sum(w * y), *(F.sum(w * a) for a in x), *(F.sum(w * a * y) for a in x), *(F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k))]
    parts = named.where(usable).groupBy("date", F.col("__ind").alias("ind")).agg(F.count("*").alias("n"), F.first("__codes").alias("codes"), F.first("__keep").alias("keep"), F.array(*sums).alias("g"))

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["date", "term", "ret"])
        f = f.sort_values("ind")
        n = int(f["n"].sum())
        if f["codes"].iloc[0] < min_codes or n < min_rows:
            return none
        kept = [i for i in range(k) if f["keep"].iloc[0][i]]
        g = np.array(f["g"].tolist(), float)
        inds = f["ind"].tolist() if len(f) > 1 else []  # a single industry has no variance
        base = -1 if not inds else int(np.argmax(g[:, 0])) if base_rule == "max_cap" else 0
        used = [i for i in range(len(inds)) if i != base]
        p = 1 + len(kept) + len(used)
        if n < max(min_rows, p + spare_rows):
            return none
        total = g.sum(axis=0)
        style = [2 + i for i in kept]
        square = np.zeros((k, k))
        square[np.triu_indices(k)] = total[2 + 2 * k :]
        square += np.triu(square, 1).T
        a, b = np.zeros((p, p)), np.zeros(p)
        a[0, 0], b[0] = total[0], total[1]
        s, d = slice(1, 1 + len(kept)), slice(1 + len(kept), p)
        a[0, s] = total[style]
        a[s, s] = square[np.ix_(kept, kept)]
        b[s] = total[[2 + k + i for i in kept]]
        a[0, d] = g[used, 0]
        a[d, d] = np.diag(g[used, 0])
        a[s, d] = g[used][:, style].T
        b[d] = g[used, 1]
        a = np.triu(a) + np.triu(a, 1).T
        inverse = _invert(a)
        if inverse is None:
            return none
        beta = inverse @ b
        level = np.zeros(len(inds))
        level[used] = beta[d]
        shift = float(level @ g[:, 0] / total[0]) if inds else 0.0
        out = [("const", beta[0] + shift), *((f"ind_{i}", v - shift) for i, v in zip(inds, level, strict=True)), *((styles[i], v) for i, v in zip(kept, beta[s], strict=True))]
        return pd.DataFrame([(key[0], t, float(v)) for t, v in out], columns=["date", "term", "ret"])

    found = parts.groupBy("date").applyInPandas(solve, f"date {dict(rows.dtypes)['date']}, term string, ret double")
    found = kept(found) if keep_found else found
    table = found.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("term", "ret"))).alias("__f"))
    fitted = F.col("__f")["const"] + F.coalesce(F.col("__f")[F.concat(F.lit("ind_"), F.col("__ind"))], F.lit(0.0))
    for i, s in enumerate(styles):
        fitted = fitted + F.coalesce(F.col("__f")[s], F.lit(0.0)) * x[i]
    specific = named.where(usable).join(table, "date").select("date", "code", (y - fitted).alias("specific"))
    return found, specific


def run_model(store: FactorStore, rows: DataFrame, styles: list[str], returns_table: str = "factor_returns", specific_table: str = "specific_returns", **rules: object) -> None:
    """Fits :func:`barra_regression` and upserts factor returns by (date, term) and specific returns by (date, code)."""
    found, specific = barra_regression(rows, styles, keep_found=True, **rules)
    store.upsert(returns_table, found, ["date", "term"])
    store.upsert(specific_table, kept(specific), ["date", "code"])
