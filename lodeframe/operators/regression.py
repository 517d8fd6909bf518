"""Least squares by group on distributed sums.

Rows of a group are never gathered: Spark sums the products of the regressors (partial
and final aggregation), a small task solves one K x K system per group row, and
covariances come from a second aggregation after the coefficients are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.functions.columns import col, number, ratio
from lodeframe.operators.series import newey_west
from lodeframe.operators.sliding import LINEAR_FROM, sliding_sums

CONST = "const"


def _products(xs: list[Column], y: Column | None = None) -> list[Column]:
    """Upper triangle of x'x, then x'y."""
    out = [xs[i] * xs[j] for i in range(len(xs)) for j in range(i, len(xs))]
    return out if y is None else out + [x * y for x in xs]


def _square(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values[: k * (k + 1) // 2]
    return out + np.triu(out, 1).T


def _inverses(a: np.ndarray) -> np.ndarray:
    """Inverses of a stack of matrices; NaN where one is singular at working precision after scaling."""
    out = np.full(a.shape, np.nan)
    scale = np.sqrt(np.diagonal(a, axis1=1, axis2=2))
    fine = np.isfinite(a).all(axis=(1, 2)) & (scale > 0).all(axis=1)
    outer = scale[fine][:, :, None] * scale[fine][:, None, :]
    s = a[fine] / outer
    known = np.linalg.cond(s) <= 1e12 if len(s) else np.zeros(0, bool)
    fine[fine] = known
    out[fine] = np.linalg.inv(s[known]) / outer[known]
    return out


def _invert(a: np.ndarray) -> np.ndarray | None:
    """Inverse, None where the matrix is singular at working precision after scaling."""
    inverse = _inverses(a[None])[0]
    return None if np.isnan(inverse).any() else inverse


def _solved(g: pd.Series, n: pd.Series, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stacked sums (upper triangle of x'x, then x'y): which have a solution, and their inverses, x'y and coefficients."""
    rows = np.flatnonzero((n >= least).to_numpy() & (n > k).to_numpy())
    sums = np.array([g.iloc[i] for i in rows], float).reshape(len(rows), k * (k + 3) // 2)
    square = np.zeros((len(rows), k, k))
    upper = np.triu_indices(k)
    square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
    inverse = _inverses(square)
    fine = ~np.isnan(inverse).any(axis=(1, 2))
    inverse, xy = inverse[fine], sums[fine][:, -k:]
    return rows[fine], inverse, xy, np.einsum("nij,nj->ni", inverse, xy)


def _prepared(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None, intercept: bool, extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Complete rows scaled by the root of the weight: ``keys, extra, __y, __x0, ...``."""
    root = F.sqrt(number(weight)) if weight else F.lit(1.0)
    columns = [*([F.lit(1.0)] if intercept else []), *(number(x) for x in xs)]
    rows = df.select(*keys, *extra, (number(y) * root).alias("__y"), *((c * root).alias(f"__x{i}") for i, c in enumerate(columns)))
    names = [f"__x{i}" for i in range(len(columns))]
    return rows.where(" and ".join(f"{c} is not null" for c in ["__y", *names])), names


def _betas(rows: DataFrame, names: list[str], keys: list[str], least: int) -> DataFrame:
    """``keys, n, beta, inv, sse, r2`` (arrays; NULL where n < least, n <= K or singular)."""
    k = len(names)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in _products([F.col(x) for x in names], F.col("__y")))).alias("g"), F.sum("__y").alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("syy"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[[*keys, "n"]].copy()
            at, inverse, xy, b = _solved(f["g"], f["n"], k, least)
            n, sy, syy = (f[c].to_numpy(float)[at] for c in ("n", "sy", "syy"))
            rest = np.maximum(syy - (b * xy).sum(axis=1), 0.0)
            total = syy - sy * sy / n
            columns = {"beta": b.tolist(), "inv": inverse.reshape(len(at), k * k).tolist(), "sse": rest.tolist(), "r2": [1 - r / t if t > 0 else None for r, t in zip(rest, total, strict=True)]}
            for name, values in columns.items():
                column = [None] * len(f)
                for i, v in zip(at.tolist(), values, strict=True):
                    column[i] = v
                out[name] = column
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "n long, beta array<double>, inv array<double>, sse double, r2 double"])
    return sums.mapInPandas(solve, schema)


def fit(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None = None, intercept: bool = True, cov: str = "none", hc: str = "HC1", nw_lag: int = 3, order: str = "date", least: int = 0) -> DataFrame:
    """Regression of y on xs in every group: ``keys, term, beta, se, t, r2, n``.

    ``cov`` is none (classical), white (``hc`` HC0 or HC1) or nw (Bartlett weights over
    position lags of complete rows in ``order``).  Rows are scaled by the root of the
    weight; R2 is that of the scaled rows.  Groups with no more rows than terms, fewer
    than ``least`` or a singular system have missing values.
    """
    terms = [*([CONST] if intercept else []), *xs]
    k = len(terms)
    rows, names = _prepared(df, y, xs, keys, weight, intercept, [order] if cov == "nw" else [])
    betas = _betas(rows, names, keys, least)
    if cov in ("white", "nw"):
        back = betas.select(*(F.col(c).alias(f"__{c}") for c in keys), "beta")
        known = rows.join(back, [rows[c].eqNullSafe(back[f"__{c}"]) for c in keys]).where("beta is not null")
        fitted = sum((F.col(x) * F.col("beta")[i] for i, x in enumerate(names)), F.lit(0.0))
        scored = known.select(*keys, *([order] if cov == "nw" else []), *((F.col(x) * (F.col("__y") - fitted)).alias(f"s{i}") for i, x in enumerate(names)))
        s = [F.col(f"s{i}") for i in range(k)]
        parts = [F.sum(c) for c in _products(s)]
        if cov == "nw":
            w = Window.partitionBy(*keys).orderBy(order)
            scored = scored.select("*", *(F.lag(f"s{i}", lag).over(w).alias(f"s{i}_{lag}") for lag in range(1, nw_lag + 1) for i in range(k)))
            pairs = [(i, j) for i in range(k) for j in range(i, k)]
            for lag in range(1, nw_lag + 1):
                share = 1 - lag / (nw_lag + 1)
                parts = [p + share * F.coalesce(F.sum(s[i] * F.col(f"s{j}_{lag}") + s[j] * F.col(f"s{i}_{lag}")), F.lit(0.0)) for p, (i, j) in zip(parts, pairs, strict=True)]
        meat = scored.groupBy(*keys).agg(F.array(*parts).alias("meat"))
        back = meat.select(*(F.col(c).alias(f"__{c}") for c in keys), "meat")
        betas = betas.join(back, [betas[c].eqNullSafe(back[f"__{c}"]) for c in keys], "left").drop(*(f"__{c}" for c in keys))
    else:
        betas = betas.withColumn("meat", F.lit(None).cast("array<double>"))

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for row in f.to_dict("records"):
                head = [row[c] for c in keys]
                if row["beta"] is None:
                    rows += [[*head, t, None, None, None, None, row["n"]] for t in terms]
                    continue
                beta, inv, n = np.asarray(row["beta"]), np.asarray(row["inv"]).reshape(k, k), row["n"]
                if cov == "none":
                    v = inv * row["sse"] / (n - k)
                else:
                    v = inv @ _square(np.asarray(row["meat"], float), k) @ inv
                    v = v * (n / (n - k)) if cov == "white" and hc == "HC1" else v
                se = np.sqrt(np.maximum(np.diag(v), 0))
                rows += [[*head, t, b, e, b / e if e > 0 else None, row["r2"], n] for t, b, e in zip(terms, beta, se, strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, "term", "beta", "se", "t", "r2", "n"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "term string, beta double, se double, t double, r2 double, n long"])
    return betas.mapInPandas(errors, schema)


def cross_sectional(df: DataFrame, factors: list[str], ret: str = "ret", weight: str | None = None, feasible: str | None = None, intercept: bool = True, cov: str = "white", hc: str = "HC1", date: str = "date") -> DataFrame:
    """Premia of the factors on every date, on rows with a return (and feasible)."""
    rows = df.where(F.col(ret).isNotNull())
    if feasible:
        rows = rows.where(F.coalesce(F.col(feasible), F.lit(False)))
    return fit(rows, ret, factors, [date], weight, intercept, cov, hc, least=len(factors) + int(intercept) + 1)


def fama_macbeth(premia: DataFrame, nw_lag: int = 3, date: str = "date") -> DataFrame:
    """``term, n, mean, nw_t``: mean premium and the Newey-West t of the premium series."""
    return newey_west(premia, "beta", ["term"], date, lags=nw_lag, least=2)


def time_series(returns: DataFrame, factor_returns: DataFrame, factors: list[str], ret: str = "ret", nw_lag: int = 3, cov: str = "nw", date: str = "date", code: str = "code") -> DataFrame:
    """Alpha and betas of every code on factor returns of the same dates."""
    return fit(returns.join(factor_returns, date), ret, factors, [code], intercept=True, cov=cov, nw_lag=nw_lag, order=date)


def rolling_regression(df: DataFrame, y: str, xs: list[str], window: int = 252, least: int = 60, intercept: bool = True, date: str = "date", code: str = "code", linear: bool | None = None) -> DataFrame:
    """``code, date, term, beta, t`` over the last ``window`` calendar dates (``date_idx``) of each code.

    The products are summed by windows, long ones (or all with ``linear``) in time that does not depend on their length.  A constant and one regressor are solved by column
    algebra on the sums; more regressors as stacked systems, a batch of rows at a time.
    """
    terms = [*([CONST] if intercept else []), *xs]
    k = len(terms)
    w = Window.partitionBy(code).orderBy("date_idx").rangeBetween(-(window - 1), 0)
    full = " and ".join(f"{c} is not null" for c in ["__y", *(f"__x{i}" for i in range(k))])
    columns = [*([F.lit(1.0)] if intercept else []), *(number(x) for x in xs)]
    rows = df.select(code, date, "date_idx", number(y).alias("__y"), *(c.alias(f"__x{i}") for i, c in enumerate(columns)))
    use = lambda c: F.when(F.expr(full), c)
    x = [F.col(f"__x{i}") for i in range(k)]
    summed = {"__n": F.lit(1), **{f"__g{i}": c for i, c in enumerate(_products(x, F.col("__y")))}, "__yy": F.col("__y") * F.col("__y")}
    if window >= LINEAR_FROM if linear is None else linear:
        sums = sliding_sums(rows, {name: use(c) for name, c in summed.items()}, window, [code])
    else:
        sums = rows.select(code, date, *(F.sum(use(c)).over(w).alias(name) for name, c in summed.items()))
    sums = sums.select(code, date, F.coalesce("__n", F.lit(0)).cast("long").alias("n"), F.array(*(f"__g{i}" for i in range(len(summed) - 2))).alias("g"), F.col("__yy").alias("syy"))
    if intercept and len(xs) == 1:
        return _simple_line(sums, code, date, xs[0], max(least, k + 1))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, inverse, xy, b = _solved(f["g"], f["n"], k, least)
            beta, t = np.full((len(f), k), np.nan), np.full((len(f), k), np.nan)
            rest = np.maximum(f["syy"].to_numpy(float)[at] - (b * xy).sum(axis=1), 0.0) / (f["n"].to_numpy(float)[at] - k)
            error = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2) * rest[:, None], 0))
            beta[at], t[at] = b, np.divide(b, error, out=np.full_like(b, np.nan), where=error > 0)
            out = f.loc[f.index.repeat(k), [code, date]].reset_index(drop=True)
            out["term"] = np.tile(terms, len(f))
            out["beta"], out["t"] = pd.array(beta.ravel()).astype(object), pd.array(t.ravel()).astype(object)
            yield out.where(out.notna(), None)

    kinds = {f.name: f.dataType.simpleString() for f in df.select(code, date).schema}
    return sums.mapInPandas(solve, f"`{code}` {kinds[code]}, `{date}` {kinds[date]}, term string, beta double, t double")


def _simple_line(sums: DataFrame, code: str, date: str, x: str, least: int) -> DataFrame:
    """Constant and slope from sums ``n, g = (n, sx, sxx, sy, sxy), syy``."""
    n, sx, sxx, sy, sxy = (F.col("g")[i] for i in range(5))
    # as for larger systems: nothing where the scaled matrix, of correlation r, has a condition above 1e12
    r = ratio(F.abs(sx), F.sqrt(n * sxx))
    solvable = (F.col("n") >= least) & ((1 + r) <= 1e12 * (1 - r))
    rows = sums.withColumn("__d", F.when(solvable, n * sxx - sx * sx))
    rows = rows.withColumn("__b", (n * sxy - sx * sy) / F.col("__d")).withColumn("__a", (sy - F.col("__b") * sx) / n)
    left = F.greatest(F.col("syy") - F.col("__a") * sy - F.col("__b") * sxy, F.lit(0.0)) / (F.col("n") - 2)
    line = lambda term, beta, spread: F.struct(F.lit(term).alias("term"), beta.alias("beta"), F.try_divide(beta, F.sqrt(left * spread / F.col("__d"))).alias("t"))
    return rows.select(code, date, F.inline(F.array(line(CONST, F.col("__a"), sxx), line(x, F.col("__b"), n))))


def orthogonalise(df: DataFrame, factor: str, baseline: list[str], out: str | None = None, date: str = "date") -> DataFrame:
    """Adds ``<factor>_ortho``: the factor less its regression on the baseline factors of the same date."""
    premia = fit(df, factor, baseline, [date]).groupBy(date).pivot("term", [CONST, *baseline]).agg(F.first("beta"))
    renamed = premia.select(F.col(date), *(F.col(c).alias(f"__b_{c}") for c in [CONST, *baseline]))
    fitted = sum((F.col(f"__b_{c}") * F.col(c) for c in baseline), F.col(f"__b_{CONST}"))
    joined = df.join(renamed, date, "left").withColumn(out or f"{factor}_ortho", F.col(factor) - fitted)
    return joined.drop(*(f"__b_{c}" for c in [CONST, *baseline]))


def white_test(df: DataFrame, resid: str, xs: list[str], keys: list[str]) -> DataFrame:
    """``keys, lm, df``: n R2 of squared residuals on the regressors, their squares and products; df counts the intercept.

    The regressors are centred first, which leaves R2 as it is and the system well conditioned.
    """
    df = df.withColumns({x: F.col(x) - F.avg(x).over(Window.partitionBy(*keys)) for x in xs})
    squares = [(f"__s{i}", F.col(x) * F.col(x)) for i, x in enumerate(xs)]
    cross = [(f"__p{i}_{j}", F.col(xs[i]) * F.col(xs[j])) for i in range(len(xs)) for j in range(i + 1, len(xs))]
    rows = df.withColumns({"__e2": F.col(resid) * F.col(resid), **dict(squares + cross)})
    terms = [*xs, *(n for n, _ in squares + cross)]
    out = fit(rows, "__e2", terms, keys).where(F.col("term") == CONST)
    return out.select(*keys, (F.col("n") * F.col("r2")).alias("lm"), F.lit(len(terms) + 1).alias("df"))


def residuals(df: DataFrame, y: str, xs: list[str], keys: list[str], out: str = "resid") -> DataFrame:
    """Adds the residual of y on xs within each group."""
    renamed = fit(df, y, xs, keys).groupBy(*keys).pivot("term", [CONST, *xs]).agg(F.first("beta"))
    renamed = renamed.select(*(F.col(c).alias(f"__k_{c}") for c in keys), *(F.col(c).alias(f"__b_{c}") for c in [CONST, *xs]))
    fitted = sum((F.col(f"__b_{c}") * F.col(c) for c in xs), F.col(f"__b_{CONST}"))
    joined = df.join(renamed, [df[c].eqNullSafe(renamed[f"__k_{c}"]) for c in keys], "left")
    return joined.withColumn(out, col(y) - fitted).select(*df.columns, out)


def t_test(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """``keys, n, t``: one-sample t of the mean; without spread 0 or an infinity by sign; NULL below two values."""
    agg = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    flat = F.when(F.col("__m") == 0, F.lit(0.0)).when(F.col("__m") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    t = F.when(F.col("__s") > 0, ratio("__m", F.col("__s") / F.sqrt("n"))).otherwise(flat)
    return agg.select(*keys, "n", F.when(F.col("n") >= 2, t).alias("t"))
