"""Coverage, information coefficients and factor correlations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import average_rank, by, correlation, pair, ratio


#: Up to so many factors, plain correlations are aggregates of one expression a pair.
IN_ENGINE = 16


def unpivoted(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """One row per factor: ``keep, factor, x``."""
    doubles = df.select(*keep, *(F.col(f).cast("double").alias(f) for f in factors))
    return doubles.unpivot(keep, factors, "factor", "x")


def coverage(df: DataFrame, factors: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """``date, factor, coverage``: rows with a factor per row with a return."""
    counts = df.groupBy(date).agg(F.count(ret).alias("__r"), *(F.count(f).alias(f) for f in factors))
    ratios = counts.select(date, *(ratio(F.col(f).cast("double"), "__r").alias(f) for f in factors))
    return ratios.unpivot([date], factors, "factor", "coverage")


def information_coefficient(df: DataFrame, factors: list[str], ret: str = "ret", method: str = "spearman", date: str = "date") -> DataFrame:
    """``date, factor, ic``: correlation of factor and return over complete pairs, two at least."""
    long = unpivoted(df.withColumn("__ret", F.col(ret)), factors, [date, "__ret"])
    if method == "spearman":
        x, y = pair("x", "__ret")
        long = long.select(date, "factor", x.alias("x"), y.alias("__ret"))
        w = by(date, "factor")
        long = long.select(date, "factor", average_rank("x", w).alias("x"), average_rank("__ret", w).alias("__ret"))
    elif method != "pearson":
        raise ValueError(f"method is pearson or spearman, not {method!r}")
    return long.groupBy(date, "factor").agg(correlation("x", "__ret").alias("ic"))


def ic_direction(ic: DataFrame) -> DataFrame:
    """``factor, direction``: sign of the mean."""
    return ic.groupBy("factor").agg(F.signum(F.avg("ic")).alias("direction"))


def _ranked(x: np.ndarray) -> np.ndarray:
    """Average ranks of every column."""
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        _, at, count = np.unique(x[:, k], return_inverse=True, return_counts=True)
        out[:, k] = (np.cumsum(count) - (count - 1) / 2)[at]
    return out


def _standard(x: np.ndarray) -> np.ndarray:
    """Columns less their means, of length one; NaN where a column is constant."""
    flat = (x == x[:1]).all(axis=0)
    x = x - x.mean(axis=0)
    length = np.sqrt((x * x).sum(axis=0))
    return x / np.where(flat | (length == 0), np.nan, length)


def pairwise_correlations(a: np.ndarray, b: np.ndarray, spearman: bool) -> np.ndarray:
    """Correlations of every column of ``a`` with every column of ``b`` over the rows where both are present (not NaN).

    Columns that are present in the same rows go through one product of matrices, and are
    ranked once against all columns of another such class.
    """
    out = np.full((a.shape[1], b.shape[1]), np.nan)
    here, class_a = np.unique(~np.isnan(a), axis=1, return_inverse=True)
    there, class_b = np.unique(~np.isnan(b), axis=1, return_inverse=True)
    for u in range(here.shape[1]):
        for v in range(there.shape[1]):
            rows = here[:, u] & there[:, v]
            if np.count_nonzero(rows) < 2:
                continue
            left, right = np.flatnonzero(class_a.ravel() == u), np.flatnonzero(class_b.ravel() == v)
            x, y = a[np.ix_(rows, left)], b[np.ix_(rows, right)]
            if spearman:
                x, y = _ranked(x), _ranked(y)
            out[np.ix_(left, right)] = np.clip(_standard(x).T @ _standard(y), -1, 1)
    return out


def factor_correlation(df: DataFrame, factors: list[str], method: str = "pearson", date: str = "date", tile: int = 128) -> DataFrame:
    """``date, f1, f2, corr`` for pairs f1 < f2 over pairwise complete rows.

    Pearson correlations of few factors are sums in the engine.  Otherwise the columns are
    cut into tiles, and each pair of tiles of a date is a product of two matrices of ``tile``
    columns in one task; so the plan is as small for hundreds of factors, and spearman ranks are
    taken once for all factors that miss the same rows.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"method is pearson or spearman, not {method!r}")
    names = sorted(factors)
    if method == "pearson" and len(names) <= IN_ENGINE:
        pairs = list(combinations(names, 2))
        wide = df.groupBy(date).agg(*(correlation(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
        rows = F.array(*(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
        return wide.select(date, F.inline(rows))
    tiles = [names[i : i + tile] for i in range(0, len(names), tile)]
    cells = [F.array(*(F.col(c).cast("double") for c in t)) for t in tiles]
    met = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cells[i].alias("a"), (cells[j] if j > i else F.lit(None).cast("array<double>")).alias("b")) for i in range(len(tiles)) for j in range(i, len(tiles))]
    rows = df.select(date, F.explode(F.array(*met)).alias("__t")).select(date, "__t.*")
    kind = df.schema[date].dataType.simpleString()

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)

    def run(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in "ij")
        a = matrix(table.column("a"), len(tiles[i]))
        corr = pairwise_correlations(a, a if i == j else matrix(table.column("b"), len(tiles[j])), method == "spearman")
        p, q = np.triu_indices(len(tiles[i]), 1) if i == j else (x.ravel() for x in np.indices(corr.shape))
        found = corr[p, q]
        names_of = lambda t, at: pa.array([tiles[t][k] for k in at], pa.string())
        day = pa.chunked_array([pa.array([table.column(date)[0].as_py()] * len(p), table.schema.field(date).type)])
        return pa.table({date: day, "f1": names_of(i, p), "f2": names_of(j, q), "corr": pa.array(found, pa.float64(), mask=np.isnan(found))})

    return rows.groupBy(date, "i", "j").applyInArrow(run, f"`{date}` {kind}, f1 string, f2 string, corr double")


def mean_correlation(corr: DataFrame) -> DataFrame:
    """``f1, f2, corr``: mean over dates."""
    return corr.groupBy("f1", "f2").agg(F.avg("corr").alias("corr"))


def top_pairs(corr: DataFrame, n: int = 60) -> DataFrame:
    """Rows of the n pairs with the largest mean correlation in absolute value."""
    best = mean_correlation(corr).where("corr is not null").orderBy(F.abs("corr").desc(), "f1", "f2").limit(n)
    return corr.join(best.select("f1", "f2"), ["f1", "f2"], "left_semi")


def pair_name(a: str = "f1", b: str = "f2") -> F.Column:
    return F.concat_ws(" ~ ", F.col(a), F.col(b))
