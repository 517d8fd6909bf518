"""Ranks, quantiles and buckets of one huge date against numpy, in several tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.functions.columns import quantile_bucket
from lodeframe.operators import order, reshape, transforms


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=20_000), np.full(9_000, 0.25), rng.integers(0, 5, 3_000), [1e300, -1e300, 0.0, -0.0]])
    rows = pd.DataFrame({"date": 1.0, "code": np.arange(len(x)), "x": x})
    small = pd.DataFrame({"date": 2.0, "code": np.arange(7), "x": [3.0, 1, 1, None, 2, 5, 8]})
    rest = pd.DataFrame({"date": [3.0, 4.0, 4.0, None, None], "code": range(5), "x": [1.0, None, None, 4.0, 6.0]})
    return pd.concat([rows, small, rest], ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, frame):
    plain = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(plain, "date double, code long, x double").repartition(6).cache()


def test_ranks_as_pandas(rows, frame):
    groups = frame.x.groupby(frame.date.fillna(-1))
    for ascending in (True, False):
        got = order.with_ranks(rows, "x", ["date"], "rank", ascending)
        assert got.columns == ["date", "code", "x", "rank"]
        found = got.toPandas().fillna({"date": -1}).set_index(["date", "code"])["rank"]
        assert len(found) == len(frame)
        expected = groups.rank(ascending=ascending)
        np.testing.assert_array_equal(found.loc[list(zip(frame.date.fillna(-1), frame.code, strict=True))].to_numpy(float), expected.to_numpy(float))


def test_one_date_is_many_ranges(rows):
    parts = order.distribution(rows.where("date = 1"), "x", ["date"], ranges=32)
    assert parts.agg(F.sum("n")).first()[0] == parts.first().total == 32_004
    text = parts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(date" in text
    assert "__range" in text
    ends = sorted((r.value, r.before, r.n) for r in parts.collect())
    assert all(b[1] == a[1] + a[2] for a, b in zip(ends, ends[1:], strict=False))
    assert dict((v, n) for v, _, n in ends)[0.25] == 9_000


@pytest.mark.parametrize("n", [2, 5, 10])
def test_buckets_as_by_windows(rows, n):
    one = {(r.date, r.code): r.b for r in order.with_buckets(rows, "x", n, ["date"], "b").collect()}
    two = {(r.date, r.code): r.b for r in quantile_bucket(rows, "x", n, ["date"], "b").collect()}
    assert one == two


@pytest.mark.parametrize("drop", [False, True])
def test_median_bounds_as_by_windows(rows, drop):
    usual = rows.where("abs(x) < 1e200 or x is null")
    one = {(r.date, r.code): r.o for r in order.with_median_bounds(usual, "x", 1.5, ["date"], "o", drop).collect()}
    two = {(r.date, r.code): r.o for r in transforms.mad_outlier(usual, "x", 1.5, drop, "o").collect()}
    assert one.keys() == two.keys()
    for k, v in two.items():
        assert one[k] == (None if v is None else pytest.approx(v, rel=1e-12))
    assert order.with_median_bounds(usual.limit(0), "x", 1.5, ["date"], "o").count() == 0


def test_quantiles_as_numpy(rows, frame):
    known = order.distribution(rows, "x", ["date"])
    got = {r.date: r.edges for r in order.quantile_values(known, ["date"], [(1, 20), (1, 2), (19, 20)]).collect()}
    for day, own in frame.groupby("date"):
        if own.x.notna().any():
            np.testing.assert_allclose(got[day], np.quantile(own.x.dropna(), [0.05, 0.5, 0.95]), rtol=1e-12)


def test_a_hundred_thousand_codes_to_blocks_and_back(spark):
    rows = spark.range(300_000).select((F.col("id") % 3).alias("date"), F.concat(F.lit("c"), F.lpad((F.col("id") % 100_000).cast("string"), 6, "0")).alias("code"), F.when(F.col("id") % 11 != 0, F.rand(4)).alias("value"))
    rows = rows.where("not (date = 1 and code < 'c050000')").cache()
    codes = reshape.dictionary(rows)
    assert codes.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (0, 99_999, 100_000)
    wide = reshape.wide_blocks(rows, codes, ["date"]).cache()
    assert "CartesianProduct" not in wide._jdf.queryExecution().executedPlan().toString()
    assert {r.width for r in wide.collect()} == {1024, 100_000 % 1024}
    assert wide.where("size(cells) <> width").isEmpty()
    ordered = wide.where("date = 0 and block = 2").first().cells
    assert ordered == [r.value for r in rows.where("date = 0 and code >= 'c002048' and code < 'c003072'").orderBy("code").collect()]
    back = reshape.stacked(wide, codes, ["date"])
    given = rows.where("value is not null").select("date", "code", "value")
    assert back.exceptAll(given).isEmpty()
    assert back.count() == given.count()
    assert reshape.wide_blocks(rows.limit(0), reshape.dictionary(rows.limit(0)), ["date"]).count() == 0
