"""Asset-pricing tests over test portfolios: GRS and linear GMM.

Moments are summed on Spark.  Up to :data:`MOST_ASSETS` test portfolios one small task solves
N x N systems; more go through tiles (:mod:`lodeframe.operators.gram`), where a singular
covariance, as with no more dates than portfolios, gives missing statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.tails import chi2_tail, f_tail
from lodeframe.operators import gram
from lodeframe.operators.reshape import dictionary, wide_blocks
from lodeframe.session import scratch_path

MOST_ASSETS = 500


def _many(assets: DataFrame, asset: str) -> bool:
    return assets.select(asset).distinct().limit(MOST_ASSETS + 1).count() > MOST_ASSETS


class _Blocks:
    """Returns and factors of the dates that have all of them, in blocks of ``tile`` portfolios, written to the shared folder."""

    def __init__(self, assets: DataFrame, factors: DataFrame, names: list[str], asset: str, ret: str, date: str, tile: int) -> None:
        self.names, self.tile = names, tile
        plain = assets.select(F.col(date).alias("date"), F.col(asset).alias("code"), F.col(ret).cast("double").alias("value"))
        codes = dictionary(plain)
        self.n = codes.count()
        full = plain.where("value is not null and code is not null").groupBy("date").agg(F.count_distinct("code").alias("n")).where(F.col("n") == self.n)
        known = factors.select(F.col(date).alias("date"), F.array(*(F.col(c).cast("double") for c in names)).alias("f"))
        days = full.join(known.where(F.forall("f", lambda x: x.isNotNull())), "date").select("date", "f")
        wide = wide_blocks(plain, codes, ["date"], block=tile).select("date", F.col("block").cast("int").alias("block"), "cells").join(days, "date")
        path = scratch_path(assets.sparkSession)
        wide.write.parquet(path)
        self.wide = assets.sparkSession.read.schema(wide.schema).parquet(path)
        self.days = self.wide.where("block = 0").select("date", "f")
        self.t = self.days.count()

    def forms(self, last: list[F.Column], scale: F.Column, lead: bool) -> list[np.ndarray]:
        """Quadratic forms of the portfolios, after the factors if ``lead``, for columns ``last`` of a date."""
        size = -(-self.n // self.tile)
        widths = [len(self.names)] * lead + [min(self.tile, self.n - b * self.tile) for b in range(size)] + [len(last)]
        rows = self.wide.select("date", (F.col("block") + int(lead)).alias("block"), scale.alias("scale"), "cells")
        own = [(F.lit(size + lead), F.array(*last))] + [(F.lit(0), F.col("f"))] * lead
        extra = self.days.select("date", scale.alias("scale"), F.explode(F.array(*(F.struct(b.alias("block"), c.alias("cells")) for b, c in own))).alias("x"))
        return gram.quadratic_forms(rows.union(extra.select("date", "x.block", "scale", "x.cells")), widths, self.t)

    def sums(self) -> np.ndarray:
        """[A b]'[A b] of the means A of return times factor and b of returns, over all portfolios."""
        k = len(self.names)
        cells = self.wide.select("block", "f", F.posexplode("cells").alias("at", "r"))
        means = cells.groupBy("block", "at").agg(*(F.sum(F.col("r") * (F.col("f")[i] if i < k else F.lit(1.0))).alias(f"m{i}") for i in range(k + 1)))
        got = means.agg(*(F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"{i},{j}") for i in range(k + 1) for j in range(k + 1))).first()
        return np.array(got, float).reshape(k + 1, k + 1) / self.t**2


def _grs_blocks(b: _Blocks) -> tuple:
    """The statistic from s'G^-1 s of sums s and products G: of the factors alone, and of the factors and portfolios."""
    n, k, t = b.n, len(b.names), b.t
    if t <= n + k:
        return None, None, t, n
    forms = b.forms([F.lit(1.0)], F.lit(1.0), True)
    # centring takes s s'/t from G
    factor, both = (float(q[0, 0]) / (1 - float(q[0, 0]) / t) / t**2 * (t - 1) if float(q[0, 0]) < t else np.nan for q in (forms[0], forms[-1]))
    grs = (t - n - k) / n * (both - factor) / (1 + factor)
    if not np.isfinite(grs):
        return None, None, t, n
    return float(grs), f_tail(float(grs), n, t - n - k), t, n


def _gmm_blocks(b: _Blocks, two_step: bool) -> tuple:
    n, k, t = b.n, len(b.names), b.t
    moments = b.sums()
    price = np.linalg.pinv(moments[:k, :k]) @ moments[:k, k]
    if two_step:
        if t <= n:
            return price.tolist(), None, None
        discount = F.lit(1.0) - sum((F.col("f")[i] * float(v) for i, v in enumerate(price)), F.lit(0.0))
        q = b.forms([*(F.col("f")[i] for i in range(k)), F.lit(1.0), discount], discount, False)[-1]
        left = t - q[-1, -1]
        if not np.isfinite(q).all() or left <= gram.TINY * t:
            return price.tolist(), None, None
        moments = (q + np.outer(q[-1], q[-1]) / left)[:-1, :-1] * (t - 1) / t**2
        price = np.linalg.pinv(moments[:k, :k]) @ moments[:k, k]
    gap = np.append(-price, 1.0)
    j = float(t * gap @ moments @ gap)
    return price.tolist(), j, chi2_tail(j, max(n - k, 1))


def _moments(assets: DataFrame, factors: DataFrame, names: list[str], asset: str, ret: str, date: str) -> tuple[DataFrame, list[str], int]:
    """One row of first and second moments of returns and factors over dates that have all of them."""
    labels = [r[0] for r in assets.select(asset).distinct().orderBy(asset).limit(MOST_ASSETS + 1).collect()]
    wide = assets.groupBy(date).pivot(asset, labels).agg(F.first(ret)).join(factors.select(date, *names), date)
    v = wide.select(F.array(*(F.col(f"`{x}`").cast("double") for x in [*map(str, labels), *names])).alias("v"))
    v = v.where(F.forall("v", lambda x: x.isNotNull()))
    size = len(labels) + len(names)
    entries = v.select(F.posexplode("v").alias("i", "x"), "v")
    sums = entries.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.array(*(F.sum(F.col("x") * F.col("v")[j]) for j in range(size))).alias("row"))
    return sums.agg(F.sort_array(F.collect_list(F.struct("i", "s", "n", "row"))).alias("m")), labels, len(names)


def _unpack(m: list) -> tuple[int, np.ndarray, np.ndarray]:
    return int(m[0]["n"]), np.array([r["s"] for r in m]), np.array([r["row"] for r in m], float)


def grs_test(assets: DataFrame, factors: DataFrame, names: list[str], asset: str = "grp", ret: str = "ret", date: str = "date", tile: int | None = None) -> DataFrame:
    """One row ``grs, pvalue, n_dates, n_assets``: are all intercepts zero.  Missing where a covariance is singular.

    ``tile`` sends any number of portfolios through tiles of so many columns.
    """
    if tile or _many(assets, asset):
        row = _grs_blocks(_Blocks(assets, factors, names, asset, ret, date, tile or gram.TILE))
        return assets.sparkSession.createDataFrame([row], "grs double, pvalue double, n_dates long, n_assets long")
    moments, labels, k = _moments(assets, factors, names, asset, ret, date)
    n = len(labels)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for m in f["m"]:
                grs = p = None
                t = 0
                if len(m):
                    t, s, g = _unpack(m)
                    mean = s / t
                    c = g - np.outer(s, s) / t  # centred products
                    frr, fr = c[n:, n:], c[n:, :n]
                    try:
                        beta = np.linalg.solve(frr, fr)
                        alpha = mean[:n] - beta.T @ mean[n:]
                        sigma = (c[:n, :n] - fr.T @ beta) / (t - 1)
                        top = (t - n - k) / n if t > n + k else t / n
                        grs = float(top * (alpha @ np.linalg.solve(sigma, alpha)) / (1 + mean[n:] @ np.linalg.solve(frr / (t - 1), mean[n:])))
                        p = f_tail(grs, n, t - n - k if t > n + k else max(t - k - 1, 1))
                    except np.linalg.LinAlgError:
                        grs = p = None
                yield pd.DataFrame([[grs, p, t, n]], columns=["grs", "pvalue", "n_dates", "n_assets"])

    return moments.mapInPandas(solve, "grs double, pvalue double, n_dates long, n_assets long")


def gmm_linear(assets: DataFrame, factors: DataFrame, names: list[str], two_step: bool = True, asset: str = "grp", ret: str = "ret", date: str = "date", tile: int | None = None) -> DataFrame:
    """One row ``lambda, j, pvalue``: prices of the factors in a linear discount factor 1 - f'lambda.

    ``tile`` sends any number of portfolios through tiles; there, prices are those of the first step and the
    statistic is missing where the moments have a singular covariance.
    """
    if tile or _many(assets, asset):
        b = _Blocks(assets, factors, names, asset, ret, date, tile or gram.TILE)
        rows = [_gmm_blocks(b, two_step)] if b.t else []
        return assets.sparkSession.createDataFrame(rows, "lambda array<double>, j double, pvalue double")
    moments, labels, k = _moments(assets, factors, names, asset, ret, date)
    n = len(labels)
    # the covariance of the moments needs fourth products, so it is a second pass over the dates
    first = moments.first()["m"]
    if not first:
        return moments.sparkSession.createDataFrame([], "lambda array<double>, j double, pvalue double")
    t, s, g = _unpack([r.asDict() for r in first])
    a, b = g[:n, n:] / t, s[:n] / t
    price = np.linalg.lstsq(a, b, rcond=None)[0]
    w = np.eye(n)
    if two_step:
        weighted = factors.select(date, (F.lit(1.0) - sum((F.col(x) * float(v) for x, v in zip(names, price, strict=True)), F.lit(0.0))).alias("__m"))
        scaled = assets.join(weighted, date).select(date, asset, (F.col(ret) * F.col("__m")).alias("__x"))
        second, _, _ = _moments(scaled.withColumnRenamed("__x", ret), factors.withColumn("__one", F.lit(1.0)), ["__one"], asset, ret, date)
        t2, s2, g2 = _unpack([r.asDict() for r in second.first()["m"]])
        w = np.linalg.pinv((g2[:n, :n] - np.outer(s2[:n], s2[:n]) / t2) / (t2 - 1))
        price = np.linalg.pinv(a.T @ w @ a) @ (a.T @ w @ b)
    gap = b - a @ price
    j = float(t * gap @ w @ gap)
    return moments.sparkSession.createDataFrame([(price.tolist(), j, chi2_tail(j, max(n - k, 1)))], "lambda array<double>, j double, pvalue double")
