"""Grouped steps of a chain, refreshes by gap and reach, dates from the listing."""

from __future__ import annotations

import datetime
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import calendar as cal
from lodeframe.operators import transforms
from lodeframe.sources import bucketed
from lodeframe.sources.refresh import Carry, done_until, refresh
from lodeframe.sources.store import FactorStore

START = datetime.date(2024, 1, 1)


def day(n: int) -> datetime.date:
    return START + datetime.timedelta(n)


@pytest.fixture(scope="module")
def quotes(spark):
    rng = np.random.default_rng(8)
    rows = [(day(d), c, None if rng.random() < 0.15 else float(rng.normal()), float(rng.integers(1, 9))) for d in range(24) for c in range(9) if rng.random() < 0.85]
    return spark.createDataFrame(rows, "date date, code long, x double, v double")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- grouped steps ---


def functions():
    """Made here, so that they travel to the workers by value."""

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.rank()

    def less(frame: pd.DataFrame, by: float) -> pd.DataFrame:
        return frame - by

    return ranked, less


ranked, less = functions()


def test_grouped_steps_share_one_shuffle_and_keep_all_rows(quotes):
    steps = [transforms.processor(transforms.zscore), transforms.grouped(ranked), transforms.grouped(less, by=2.0), transforms.grouped(ranked)]
    done = transforms.process(quotes, ["x", "v"], steps)
    assert done.columns == ["date", "code", "x", "v", "x__zscore__ranked__less_by2.0__ranked", "v__zscore__ranked__less_by2.0__ranked"]
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(done))) == 1
    assert plan_of(done).count("FlatMapGroupsInArrow") == 1
    got = done.toPandas().sort_values(["date", "code"]).reset_index(drop=True)
    plain = quotes.toPandas().sort_values(["date", "code"]).reset_index(drop=True)
    for c in ("x", "v"):
        expected = plain.groupby("date")[c].rank()
        np.testing.assert_allclose(got[got.filter(like=f"{c}__").columns[0]].to_numpy(float), expected.to_numpy(float))


def test_grouped_steps_by_code_see_dates_in_order(quotes):
    done = transforms.process(quotes, ["v"], [transforms.grouped(lambda f: f.cumsum(), key="code")]).toPandas()
    plain = quotes.toPandas().sort_values(["code", "date"])
    expected = plain.assign(s=plain.groupby("code").v.cumsum()).set_index(["date", "code"]).s
    assert done.set_index(["date", "code"])["v__<lambda>"].to_dict() == expected.to_dict()


def test_grouped_steps_on_odd_rows(spark):
    rows = spark.createDataFrame([(None, 1, 1.0, "s"), (START, None, 2.0, None), (START, 1, None, "t"), (START, 1, float("nan"), "t")], "date date, code long, x double, note string")
    done = transforms.process(rows, ["x"], [transforms.grouped(less, by=1.0)]).collect()
    assert sorted(((r.date, r.code, r["x__less_by1.0"], r.note) for r in done), key=str) == sorted([(None, 1, 0.0, "s"), (START, None, 1.0, None), (START, 1, None, "t"), (START, 1, None, "t")], key=str)
    assert transforms.process(rows.limit(0), ["x"], [transforms.grouped(less, by=1.0)]).count() == 0
    with pytest.raises(Exception, match="rows and columns that it gets"):
        transforms.process(rows, ["x"], [transforms.grouped(lambda f: f.head(0))]).collect()
    with pytest.raises(Exception, match="more than 2"):
        transforms.process(rows, ["x"], [transforms.Grouped(less, most=2, keywords={"by": 1.0})]).collect()
    with pytest.raises(ValueError, match="goes by one of"):
        transforms.process(rows, ["x"], [transforms.grouped(less, key="note", by=1.0)])


# --- refresh ---

CARRY = {"s": Carry("x"), "n": Carry("x", "count"), "lo": Carry("x", "min"), "hi": Carry("x", "max"), "last": Carry("x", "last")}


def windowed(rows):
    return cal.with_date_idx(rows).select("date", "code", transforms.rolling("x", 4, min_periods=1).alias("mean"))


def found(store) -> dict:
    return {(r.date, r.code): tuple(None if v is None else round(v, 9) for v in (r.mean, r.s, r.n, r.lo, r.hi, r["last"])) for r in store.table("out").collect()}


def expected(quotes) -> dict:
    plain = quotes.toPandas()
    wide = plain.pivot(index="date", columns="code", values="x").sort_index()
    mean = wide.rolling(4, min_periods=1).mean()
    out = {}
    for r in plain.itertuples():
        past = plain[(plain.code == r.code) & (plain.date <= r.date)].sort_values("date").x.dropna()
        m = mean.loc[r.date, r.code]
        values = (m, past.sum(), len(past), past.min(), past.max(), past.iloc[-1]) if len(past) else (m, None, 0, None, None, None)
        out[r.date, r.code] = tuple(None if v is None or v != v else round(float(v), 9) for v in values)
    return out


@pytest.fixture
def filled(spark, tmp_path, quotes):
    s = FactorStore(spark, str(tmp_path))
    s.save("quotes", quotes)
    return s


def test_partial_runs_equal_one_run(filled, quotes):
    spans = refresh(filled, "out", "quotes", windowed, reach=3, carry=CARRY, until=day(5))
    spans += refresh(filled, "out", "quotes", windowed, reach=3, carry=CARRY, until=day(13), span=2)
    spans += refresh(filled, "out", "quotes", windowed, reach=3, carry=CARRY)
    assert spans[0] == (day(0), day(5))
    assert spans[-1] == (day(14), day(23))
    assert len(spans) == 6
    assert found(filled) == expected(quotes)
    assert refresh(filled, "out", "quotes", windowed, reach=3, carry=CARRY) == []
    assert done_until(filled, "out") == day(23)


def test_each_span_reads_its_partitions_and_the_reach(filled):
    seen = []

    def watched(rows):
        pruned = re.search(r"PartitionFilters: \[(.*?)\]", plan_of(rows))[1]
        read = sorted(str(r[0]) for r in rows.select("date").distinct().collect())
        seen.append((*re.findall(r"[<>]= (\d{4}-\d\d-\d\d)", pruned), len(read)))
        assert seen[-1] == (read[0], read[-1], len(read))
        return windowed(rows)

    refresh(filled, "out", "quotes", watched, reach=3, until=day(9))
    refresh(filled, "out", "quotes", watched, reach=3, span=8)
    assert seen == [(str(day(0)), str(day(9)), 10), (str(day(7)), str(day(17)), 11), (str(day(15)), str(day(23)), 9)]


@pytest.mark.parametrize("step", ["compute", "upsert", "record"])
def test_a_broken_refresh_is_taken_up_again(filled, quotes, monkeypatch, step):
    calls = []

    def breaking(name, function, when):
        def run(*args, **kwargs):
            calls.append(name)
            if len(calls) == when:
                raise RuntimeError("lost")
            return function(*args, **kwargs)

        return run

    with monkeypatch.context() as m:
        compute = breaking("compute", windowed, 3) if step == "compute" else windowed
        if step == "upsert":
            m.setattr(filled, "upsert", breaking("upsert", filled.upsert, 3))
        if step == "record":
            plain = filled.replace
            m.setattr(filled, "replace", lambda table, df: breaking("record", plain, 2)(table, df) if table.endswith(".progress") else plain(table, df))
        with pytest.raises(RuntimeError, match="lost"):
            refresh(filled, "out", "quotes", compute, reach=3, carry=CARRY, span=5)
    assert done_until(filled, "out") == day({"compute": 9, "upsert": 9, "record": 4}[step])
    refresh(filled, "out", "quotes", windowed, reach=3, carry=CARRY, span=7)
    assert found(filled) == expected(quotes)


def test_codes_that_come_and_go_keep_their_values(spark, tmp_path):
    s = FactorStore(spark, str(tmp_path))
    rows = [(day(0), 1, 5.0), (day(0), None, 1.0), (day(1), 2, 7.0), (day(2), 1, None), (day(3), 1, 2.0), (day(3), None, 4.0)]
    s.attach("quotes", spark.createDataFrame(rows, "date date, code long, x double"))
    refresh(s, "out", "quotes", carry={"s": Carry("x"), "last": Carry("x", "last"), "n": Carry("x", "count")}, span=1)
    got = {(r.date, r.code): (r.s, r["last"], r.n) for r in s.table("out").collect()}
    assert got == {(day(0), 1): (5.0, 5.0, 1), (day(0), None): (1.0, 1.0, 1), (day(1), 2): (7.0, 7.0, 1), (day(2), 1): (5.0, 5.0, 1), (day(3), 1): (7.0, 2.0, 2), (day(3), None): (5.0, 4.0, 2)}
    with pytest.raises(ValueError, match="nothing to compute"):
        refresh(s, "out", "quotes")
    with pytest.raises(ValueError, match="carried measure"):
        Carry("x", "median")


# --- dates from the listing ---


def test_dates_and_bounds_without_reading_data(filled, quotes, monkeypatch):
    assert "PushedFilters" not in plan_of(filled.dates("quotes"))
    assert "Scan parquet" not in plan_of(filled.date_range_of("quotes"))
    assert [r[0] for r in filled.dates("quotes").orderBy("date").collect()] == [day(n) for n in range(24)]
    assert (filled.earliest_date("quotes"), filled.latest_date("quotes")) == (day(0), day(23))
    with monkeypatch.context() as m:
        m.setattr(filled, "dates", None)  # not asked for where both bounds are given
        loaded = filled.load("quotes/x", day(2), day(4))
    assert loaded.count() == quotes.where(F.col("date").between(F.lit(day(2)), F.lit(day(4)))).count()
    padded = filled.load("quotes/x", day(5), day(6), pad_begin=3, pad_end=2).select("date").distinct().orderBy("date").collect()
    assert [r[0] for r in padded] == [day(n) for n in range(3, 9)]


# --- buckets ---


def test_joins_of_bucketed_tables_shuffle_nothing(spark, tmp_path, quotes):
    plain, s = FactorStore(spark), FactorStore(spark, str(tmp_path))
    for n, table in enumerate("abcd"):
        rows = quotes.where(F.col("code") % 4 != n).select("date", "code", F.col("x").alias(f"x{table}"), F.col("v").alias(f"v{table}"))
        plain.attach(table, rows)
        s.save_bucketed(table, rows, 4)
    paths = [f"{t}/{c}{t}" for t in "abcd" for c in "xv"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for how in ("full", "inner", "left"):
            got, wanted = s.load(paths, day(3), day(15), join=how), plain.load(paths, day(3), day(15), join=how)
            assert got.columns == wanted.columns
            assert "Exchange" not in plan_of(got), how
            assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())), how
        # another session opens the tables from their records
        again = FactorStore(spark.newSession(), str(tmp_path))
        for t in "abcd":
            spark.sql(f"DROP TABLE {bucketed._name(s.path(t))}")
        got = again.load(paths)
        assert "Bucketed: true" in plan_of(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.load(paths).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert s.latest_date("a") == day(23)
    with pytest.raises(ValueError, match="as a whole"):
        s.save("a", quotes)
    for bad in (quotes.unionByName(quotes), quotes.withColumn("code", F.lit(None).cast("long")).limit(1)):
        with pytest.raises(ValueError, match="unique and not NULL"):
            s.save_bucketed("e", bad, 2)
    s.save_bucketed("f", quotes.limit(0), 2)
    assert s.table("f").count() == 0


def test_times_of_day_are_kept_or_refused(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 9, 30), 1, 1.0), (datetime.datetime(2024, 1, 1, 9, 31), 1, 2.0)], "date timestamp, code long, x double")
    with pytest.raises(ValueError, match="times of day"):
        FactorStore(spark, str(tmp_path)).save("minutes", rows)
    s = FactorStore(spark, str(tmp_path), time_col="time")
    s.save("minutes", rows.withColumnRenamed("date", "time"))
    s.save("minutes", rows.withColumnRenamed("date", "time").where("x = 2").withColumn("x", F.lit(3.0)))
    got = [(r.time, r.code, r.x, r.date) for r in s.table("minutes").orderBy("time").collect()]
    assert got == [(datetime.datetime(2024, 1, 1, 9, 30), 1, 1.0, day(0)), (datetime.datetime(2024, 1, 1, 9, 31), 1, 3.0, day(0))]
    midnight = spark.createDataFrame([(datetime.datetime(2024, 1, 2), 1, 1.0)], "date timestamp, code long, x double")
    plain = FactorStore(spark, str(tmp_path))
    plain.save("days", midnight)
    assert plain.table("days").first().date == day(1)
