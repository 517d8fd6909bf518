"""Composites do not hang on the order of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodeframe.operators import ic
from lodeframe.plans import composites


def near_ties() -> pd.DataFrame:
    """Twenty dates of forty codes; half the values of a date lie one step (of doubles) above the others."""
    rng, rows = np.random.default_rng(5), []
    for date in range(20):
        level = rng.choice([0.01, 0.02, 0.05, 0.09], 40)
        x = np.where(np.arange(40) % 2 == 1, np.nextafter(level, 1), level)
        rows += [(date, c, float(x[c]), float(rng.uniform(1, 9)), float(rng.uniform(1e3, 1e6)), float(rng.normal())) for c in range(40)]
    return pd.DataFrame(rows, columns=["date", "code", "x", "y", "cap", "ret"])


def test_scores_are_ranked_by_what_they_were_made_of(spark):
    frame = near_ties()
    raw = frame.copy()
    ics = {}
    for date, f in raw.groupby("date"):
        for c in "xy":
            ics[date, c] = f[c].rank().corr(f["ret"].rank())
    weights = pd.DataFrame([(d, c, v) for (d, c), v in ics.items()], columns=["date", "factor", "ic"]).sort_values(["factor", "date"])
    weights["w"] = weights.groupby("factor")["ic"].transform(lambda s: s.rolling(6, min_periods=3).mean().shift(1))
    w = weights.pivot(index="date", columns="factor", values="w").reindex(raw["date"]).to_numpy()

    def z(x: pd.Series) -> pd.Series:
        u = raw["cap"]
        mean = (u * x).groupby(raw["date"]).transform("sum") / u.groupby(raw["date"]).transform("sum")
        var = (u * (x - mean) ** 2).groupby(raw["date"]).transform("sum") / u.groupby(raw["date"]).transform("sum")
        return (x - mean) / np.sqrt(var)

    raw["want"] = z((w[:, 0] * z(raw["x"]) + w[:, 1] * z(raw["y"])) / (abs(w[:, 0]) + abs(w[:, 1])))
    rows = spark.createDataFrame(frame)
    seen = {}
    for name, part in (("up", rows.orderBy("code")), ("down", rows.orderBy(F.desc("code")).coalesce(1)), ("dealt", rows.repartition(7))):
        out = composites.style_exposures(part, {"s": ["x", "y"]}, "cap", 6, 3).orderBy("date", "code").toPandas()
        np.testing.assert_allclose(out["s"].astype(float), raw["want"], rtol=0, atol=1e-9, equal_nan=True, err_msg=name)
        seen[name] = out
    assert len(seen["up"]) == len(frame)


def test_composer_ranks_unscored_values(spark, monkeypatch):
    rows = spark.createDataFrame(near_ties()).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date").cast("int")))
    composer = composites.IcComposer(None, [], "", window=6, least=3, weight=rows.select("date", "code", F.col("cap").alias("weight")))
    ranked = []
    monkeypatch.setattr(composites, "information_coefficient", lambda df, factors, ret: ranked.append(df) or ic.information_coefficient(df, factors, ret))
    out = composer.postprocess(composer.compose(composer.preprocess(rows.select("date", "code", "x", "y", "ret"))))
    assert sorted(out.columns) == ["code", "date", "target"] and out.count() == rows.count()
    got, want = (df.select("x", "y").distinct().count() for df in (ranked[0], rows))
    assert got == want
    assert sorted(map(tuple, ranked[0].select("x", "y").collect())) == sorted(map(tuple, rows.select("x", "y").collect()))
