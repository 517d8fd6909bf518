"""Wide tables of any number of codes and back."""

from __future__ import annotations

from compare import connect, same

import __spark_entry__ as entry
from lodeframe.operators import reshape


def test_wide_and_back_collects_no_codes(spark, small, monkeypatch):
    def refuse(*_):
        raise AssertionError("codes were collected")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", refuse)
        found = entry.queries()["unstack_whole"](spark, small)
    same(found.toPandas(), connect(small).execute(entry.oracle_sql()["unstack_whole"]).df())


def test_blocks_of_columns_hold_every_code(spark):
    long = spark.createDataFrame([(d, c, float(d + c)) for d in (1, 2) for c in range(0, 40, 2) if (d, c) != (2, 38)] + [(1, None, 1.0), (2, 4, None)], "date int, code long, value double")
    codes = reshape.dictionary(long)
    wide = reshape.wide_columns(long, codes, ["date"], block=8)
    assert wide.columns == ["date", "block", *(f"c{i}" for i in range(8))]
    assert {(r.date, r.block, r.c0, r.c3, r.c4) for r in wide.where("block = 2").collect()} == {(1, 2, 33.0, 39.0, None), (2, 2, 34.0, None, None)}
    back = {tuple(r) for r in reshape.columns_stacked(wide, codes, ["date"]).select("date", "code", "value").collect()}
    assert back == {tuple(r) for r in long.where("code is not null and value is not null").collect()}
