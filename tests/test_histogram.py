"""Distributions of returns that are evaluated once."""

from __future__ import annotations

import numpy as np

from lodeframe.plans import evaluate


def test_histogram_takes_returns_and_extremes_from_one_evaluation(spark):
    def noisy(frames):
        for f in frames:
            yield f.assign(ret=f["ret"] + np.random.default_rng().uniform(-0.4, 0.4, len(f)))

    groups = spark.range(600).selectExpr("cast(id % 20 as int) as grp", "cast(id as double) as ret").mapInPandas(noisy, "grp int, ret double")
    found = evaluate.return_distribution(groups, 10).toPandas()
    assert found["n"].sum() == 600
    assert (found.groupby("grp")["bin"].agg(["min", "max"]) == [1, 10]).all(axis=None)
