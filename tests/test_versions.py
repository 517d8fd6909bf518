"""Writes that are seen whole or not at all."""

from __future__ import annotations

import datetime
import re
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lodeframe.sources import versions
from lodeframe.sources.store import FactorStore


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


@pytest.fixture
def store(spark, tmp_path):
    s = FactorStore(spark, str(tmp_path))
    s.save("t", rows(spark, range(6), 1.0))
    return s


def rows(spark, days, x, codes=(1, 2, 3)):
    return spark.createDataFrame([(day(d), c, x * c) for d in days for c in codes], "date date, code long, x double")


def content(s, table="t"):
    return sorted(map(tuple, s.table(table).select("date", "code", "x").collect()), key=str)


@pytest.mark.parametrize("when", ["rows", "record"])
def test_a_killed_write_leaves_the_old_rows(spark, store, monkeypatch, when):
    before, plain = content(store), DataFrameWriter.parquet

    def dying(self, path, *args, **kwargs):
        if path.endswith(".commits") or when == "rows":
            if when == "rows":
                plain(self, path, *args, **kwargs)  # all rows are there, the record is not
            raise RuntimeError("killed")
        return plain(self, path, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dying)
        with pytest.raises(RuntimeError, match="killed"):
            store.save("t", rows(spark, range(3, 9), 10.0))
    assert content(store) == before
    assert store.latest_date("t") == day(5)
    store.save("t", rows(spark, range(3, 9), 10.0))
    assert content(store) == sorted([(day(d), c, (1.0 if d < 3 else 10.0) * c) for d in range(9) for c in (1, 2, 3)], key=str)
    gone = store.vacuum("t")
    assert sum("/" not in g for g in gone) == 1  # the killed write's folder
    assert sorted(g.split("/")[1] for g in gone if "/" in g) == [f"date={day(d)}" for d in (3, 4, 5)]
    assert store.vacuum("t") == []
    assert len(content(store)) == 27


def test_an_open_frame_keeps_its_rows_while_others_write(spark, store):
    open_, before = store.table("t"), content(store)
    store.save("t", rows(spark, range(6), 7.0))
    assert sorted(map(tuple, open_.select("date", "code", "x").collect()), key=str) == before
    assert {r.x for r in store.table("t").where("code = 1").collect()} == {7.0}


def test_only_touched_dates_are_read_and_written(spark, store):
    before = versions.latest(spark, store.path("t"))
    store.save("t", rows(spark, [2, 4], 5.0, codes=(2, 9)))
    after = versions.latest(spark, store.path("t"))
    assert after.seq == before.seq + 1
    assert {d for d in after.places if after.places[d] != before.places[d]} == {day(2), day(4)}
    assert len(content(store)) == 20
    part = versions.read(spark, store.path("t"), after, {day(2)})
    assert {re.search(r"date=([^/]*)", f)[1] for f in part.inputFiles()} == {str(day(2))}
    assert sorted((r.code, r.x) for r in part.collect()) == [(1, 1.0), (2, 10.0), (3, 3.0), (9, 45.0)]


def test_new_and_old_columns_and_missing_dates(spark, store):
    store.save("t", rows(spark, [8], 2.0).select("date", "code", F.col("x").alias("y")))
    got = {(r.date, r.code): (r.x, r.y) for r in store.table("t").collect()}
    assert got[day(0), 2] == (2.0, None)  # a partition that was not touched has the new column too
    assert got[day(8), 2] == (None, 4.0)
    for value in (1.0, 3.0):
        undated = spark.createDataFrame([(None, 1, value)], "date date, code long, x double")
        store.save("t", undated)
        assert [r.x for r in store.table("t").where("date is null").collect()] == [value]
    assert store.latest_date("t") == day(8)
    with pytest.raises(ValueError, match="folder"):
        store.save("t", rows(spark, [1], 1.0).withColumn("folder", F.lit("a")))


def test_a_folder_of_parquet_is_taken_over_whole(spark, tmp_path):
    s = FactorStore(spark, str(tmp_path))
    rows(spark, range(4), 1.0).write.partitionBy("date").parquet(s.path("old"))
    rows(spark, range(4), 1.0).write.parquet(s.path("flat"))
    for table in ("old", "flat"):
        assert s.latest_date(table) == day(3)
        s.save(table, rows(spark, [3, 4], 2.0, codes=(1,)))
        assert content(s, table) == sorted([(day(d), c, (2.0 if d == 3 and c == 1 else 1.0) * c) for d in range(4) for c in (1, 2, 3)] + [(day(4), 1, 2.0)], key=str)


def test_vacuum_merges_records(spark, store, tmp_path):
    store.save("t", rows(spark, range(4, 8), 2.0))
    store.save("t", rows(spark, [7], 3.0).withColumn("y", F.lit("new")))
    store.save("t", spark.createDataFrame([(None, 1, 5.0)], "date date, code long, x double"))
    before, at = content(store), Path(store.path("t") + ".commits")
    old = {f.name: f.read_bytes() for f in at.glob("*.parquet")}
    assert len(old) == 4
    columns, last = set(store.table("t").columns), store.latest_date("t")
    store.vacuum("t")
    assert len([*at.glob("*.parquet")]) == 1
    assert content(store) == before
    assert (set(store.table("t").columns), store.latest_date("t")) == (columns, last)
    # a run that was killed before it deleted the older files
    for name, data in old.items():
        (at / name).write_bytes(data)
    assert content(store) == before
    store.save("t", rows(spark, [0], 9.0))
    assert content(store) == sorted([r for r in before if r[0] != day(0)] + [(day(0), c, 9.0 * c) for c in (1, 2, 3)], key=str)
    assert store.vacuum("t") and len([*at.glob("*.parquet")]) == 1
