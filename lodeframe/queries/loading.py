"""Sources, joins, calendars, masks, reshaping."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.columns import tidy
from lodeframe.operators import calendar as cal
from lodeframe.operators import reshape, returns, transforms
from lodeframe.plans.panels import Panels
from lodeframe.queries import query, r
from lodeframe.session import scratch_path
from lodeframe.sources.refresh import Carry, refresh
from lodeframe.sources.store import FactorStore, industry_dummies

_D = datetime.date


def store(p: Panels, *tables: str) -> FactorStore:
    out = FactorStore(p.spark)
    for t in tables:
        out.attach(t, getattr(p, t))
    return out


@query("SELECT date, code, price, volume, disc AS discount, cap FROM factor_a FULL JOIN factor_b USING (date, code) WHERE date BETWEEN DATE '1993-01-01' AND DATE '1997-12-01'")
def load_full_join(p: Panels) -> DataFrame:
    """Named columns of two tables, keys coalesced."""
    paths = ["factor_a/price", "factor_a/volume", "factor_b/disc AS discount", "factor_b/cap"]
    return store(p, "factor_a", "factor_b").load(paths, _D(1993, 1, 1), _D(1997, 12, 1))


@query(
    """
SELECT date, code, price, volume, disc, mrq
FROM (SELECT date, code, price, volume, disc FROM factor_a FULL JOIN factor_b USING (date, code)) AS x FULL JOIN report USING (date, code)"""
)
def load_bucketed(p: Panels) -> DataFrame:
    """A full join of three tables that lie in buckets by their keys: only saving them shuffles."""
    s = FactorStore(p.spark, scratch_path(p.spark))
    for table, columns in (("factor_a", ["price", "volume"]), ("factor_b", ["disc"]), ("report", ["mrq"])):
        s.save_bucketed(table, getattr(p, table).select("date", "code", *columns), 8)
    return s.load(["factor_a/price", "factor_a/volume", "factor_b/disc", "report/mrq"])


@query("SELECT date, code, price, cap FROM factor_a FULL JOIN factor_b USING (date, code)")
def load_ordered(p: Panels) -> DataFrame:
    """S3, L1: sorted by date and code for output."""
    return store(p, "factor_a", "factor_b").load(["factor_a/price", "factor_b/cap"], ordered=True)


@query("SELECT a.date, a.code, price, cap FROM factor_a AS a JOIN factor_b AS b USING (date, code)")
def load_inner_join(p: Panels) -> DataFrame:
    """S3, J1."""
    return store(p, "factor_a", "factor_b").load(["factor_a/price", "factor_b/cap"], join="INNER")


@query("SELECT b.date, b.code, price, cap FROM factor_a AS a RIGHT JOIN factor_b AS b ON a.date = b.date AND a.code = b.code")
def load_right_join(p: Panels) -> DataFrame:
    """The right-hand keys are kept."""
    return store(p, "factor_a", "factor_b").load(["factor_a/price", "factor_b/cap"], join="right")


@query(
    """
SELECT a.date, a.code, price, cap
FROM factor_a AS a LEFT JOIN factor_b AS b ON a.date = b.date AND a.code = b.code
WHERE a.date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM factor_a WHERE date <= DATE '1995-06-15' ORDER BY date DESC LIMIT 3) AS x)
  AND a.date <= (SELECT max(date) FROM (SELECT DISTINCT date FROM factor_a WHERE date >= DATE '1996-01-15' ORDER BY date LIMIT 3) AS x)"""
)
def load_left_padded(p: Panels) -> DataFrame:
    """S3, J2 with padding: three dates up to begin, two dates after the first from end."""
    return store(p, "factor_a", "factor_b").load(["factor_a/price", "factor_b/cap"], _D(1995, 6, 15), _D(1996, 1, 15), join="left", pad_begin=3, pad_end=2)


@query(
    """
SELECT 'before' AS side, date FROM (SELECT DISTINCT date FROM panel WHERE date < DATE '1995-06-15' ORDER BY date DESC LIMIT 3) AS x
UNION ALL SELECT 'after' AS side, date FROM (SELECT DISTINCT date FROM panel WHERE date > DATE '1995-06-15' ORDER BY date LIMIT 1) AS x"""
)
def calendar_offset(p: Panels) -> DataFrame:
    """Trading days before and after a date."""
    s = store(p, "panel")
    before = s.trading_days(_D(1995, 6, 15), 3, "panel").select(F.lit("before").alias("side"), "date")
    return before.unionByName(s.trading_days(_D(1995, 6, 15), -1, "panel").select(F.lit("after").alias("side"), "date"))


@query("SELECT (SELECT max(date) FROM factor_b WHERE date < DATE '1998-01-01') AS target_date, (SELECT max(date) FROM factor_a) AS base_date, (SELECT min(date) FROM factor_a) AS first_date")
def date_gap(p: Panels) -> DataFrame:
    """Latest dates of two tables and the earliest of one."""
    s = store(p, "factor_a").attach("target", p.factor_b.where(F.col("date") < F.lit(_D(1998, 1, 1))))
    first = s.date_range_of("factor_a").select("first_date", F.lit(1).alias("k"))
    return s.date_gap("target", "factor_a").withColumn("k", F.lit(1)).join(first, "k").drop("k")


@query(f"SELECT date, count(*) AS n, {r('sum(price)', 'total')} FROM factor_a GROUP BY 1")
def raw_sql(p: Panels) -> DataFrame:
    """SQL over registered tables."""
    return store(p, "factor_a").query("SELECT date, count(*) AS n, floor(sum(price) * 1e6D + 0.5D) / 1e6D AS total FROM factor_a GROUP BY 1")


def merged(p: Panels, rows: DataFrame) -> DataFrame:
    s = FactorStore(p.spark, scratch_path(p.spark))
    new = p.factor_a.where("code % 2 = 0").where(F.col("date") >= F.lit(_D(1998, 1, 1)))
    s.save("factor", rows)
    for _ in range(2):
        s.save("factor", new.withColumn("price", -F.col("price")).withColumn("volume", F.col("volume") + 1))
    return s.table("factor").select("date", "code", "price", "volume")


@query(
    """
SELECT date, code, price, volume FROM factor_a WHERE NOT (code % 2 = 0 AND date >= DATE '1998-01-01')
UNION ALL SELECT date, code, -price AS price, volume + 1 AS volume FROM factor_a WHERE code % 2 = 0 AND date >= DATE '1998-01-01'"""
)
def upsert_merge(p: Panels) -> DataFrame:
    """A second save replaces the stored rows of its keys, twice over."""
    return merged(p, p.factor_a)


@query("SELECT a.date, a.code, CASE WHEN a.code % 2 = 1 THEN a.price END AS price, CASE WHEN a.code % 2 = 1 THEN a.volume END AS volume, CASE WHEN a.code % 2 = 0 THEN p.disc END AS disc FROM factor_a AS a JOIN panel AS p ON p.date = a.date AND p.code = a.code")
def upsert_merge_whole(p: Panels) -> DataFrame:
    """S5, S6, J9 with other columns: a batch of half the codes has a column that the table lacks and lacks those it has."""
    s = FactorStore(p.spark, scratch_path(p.spark))
    s.save("factor", p.factor_a)
    s.save("factor", p.factor_a.select("date", "code").where("code % 2 = 0").join(p.panel.select("date", "code", "disc"), ["date", "code"]))
    return s.table("factor").select("date", "code", "price", "volume", "disc")


@query(
    f"""
SELECT date, code, price, {r('(price - avg(price) OVER d) / nullif(stddev_samp(price) OVER d, 0)', 'z')}
FROM factor_b JOIN panel USING (date, code, cap, disc) WINDOW d AS (PARTITION BY date)"""
)
def save_processors(p: Panels) -> DataFrame:
    """A saved column and its processed copy."""
    s = FactorStore(p.spark, scratch_path(p.spark))
    rows = p.panel.where("month(date) <> 3").select("date", "code", "price")
    s.save("factor", rows, [transforms.processor(transforms.zscore)])
    return s.table("factor").select("date", "code", "price", tidy("price__zscore").alias("z"))


def above_sector(frame: pd.DataFrame, sectors: int) -> pd.DataFrame:
    """Every value less the mean of its sector (code modulo ``sectors``) on that date."""
    return frame - frame.groupby(frame.index % sectors).transform("mean")


def share_of_row(frame: pd.DataFrame) -> pd.DataFrame:
    """Every value as a share of the absolute values of its code on that date."""
    return frame.div(frame.abs().sum(axis=1, min_count=1).replace(0.0, np.nan), axis=0)


@query(
    f"""
SELECT date, code, price, volume, {r('p / nullif(abs(p) + abs(v), 0)', 'p_share')}, {r('v / nullif(abs(p) + abs(v), 0)', 'v_share')}
FROM (SELECT date, code, price, volume, pz - avg(pz) OVER s AS p, vz - avg(vz) OVER s AS v
      FROM (SELECT date, code, price, CAST(volume AS DOUBLE) AS volume, (price - avg(price) OVER d) / nullif(stddev_samp(price) OVER d, 0) AS pz,
                   (volume - avg(volume) OVER d) / nullif(stddev_samp(volume) OVER d, 0) AS vz
            FROM panel WINDOW d AS (PARTITION BY date)) AS x WINDOW s AS (PARTITION BY date, code % 7)) AS y"""
)
def save_grouped(p: Panels) -> DataFrame:
    """A column step and two steps of code over whole cross-sections, of two columns together."""
    s = FactorStore(p.spark, scratch_path(p.spark))
    steps = [transforms.processor(transforms.zscore), transforms.grouped(above_sector, sectors=7), transforms.grouped(share_of_row)]
    s.save("factor", p.panel.select("date", "code", "price", F.col("volume").cast("double").alias("volume")), steps)
    tail = "__".join(map(transforms.processor_name, steps))
    return s.table("factor").select("date", "code", "price", "volume", tidy(f"price__{tail}").alias("p_share"), tidy(f"volume__{tail}").alias("v_share"))


def rolling_price(rows: DataFrame) -> DataFrame:
    """Mean price of six dates, three at least: looks back five dates."""
    return cal.with_date_idx(rows).select("date", "code", transforms.rolling("price", 6, min_periods=3).alias("mean"))


CARRIED = {"total": Carry("volume"), "n": Carry("price", "count"), "low": Carry("price", "min"), "high": Carry("price", "max"), "quoted": Carry("disc", "last")}


@query(
    f"""
SELECT g.date, g.code, {r('g.mean', 'mean')}, CAST(total AS DOUBLE) AS total, n, low, high, quoted
FROM (SELECT code, date, price, CASE WHEN count(price) OVER c >= 3 THEN avg(price) OVER c END AS mean FROM grid WINDOW c AS (PARTITION BY code ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS g
JOIN (SELECT date, code, sum(volume) OVER w AS total, count(price) OVER w AS n, min(price) OVER w AS low, max(price) OVER w AS high,
             last_value(CASE WHEN (code + month(date)) % 3 = 0 THEN disc END IGNORE NULLS) OVER w AS quoted
      FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)) AS h ON h.date = g.date AND h.code = g.code""",
    """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel) AS x),
grid AS (
  SELECT c.code, cal.date, cal.k, p.price
  FROM (SELECT DISTINCT code FROM panel) AS c CROSS JOIN cal LEFT JOIN panel AS p ON p.code = c.code AND p.date = cal.date)""",
)
def refresh_in_parts(p: Panels) -> DataFrame:
    """A windowed and five running measures brought up to date in three runs, the last one in spans of two years."""
    s = FactorStore(p.spark, scratch_path(p.spark))
    sparse = F.when((F.col("code") + F.month("date")) % 3 == 0, F.col("disc")).alias("disc")
    s.save("quotes", p.panel.select("date", "code", "price", F.col("volume").cast("double").alias("volume"), sparse))
    for until, span in ((_D(1994, 6, 15), None), (_D(1996, 12, 1), None), (None, 24)):
        refresh(s, "measures", "quotes", rolling_price, reach=5, carry=CARRIED, span=span, until=until)
    return s.table("measures").select("date", "code", tidy("mean").alias("mean"), "total", "n", "low", "high", "quoted")


@query(
    """
SELECT q.date, q.code, coalesce(high > limit_down, false) AND coalesce(low < limit_up, false) AND NOT coalesce(st, false) AND NOT coalesce(suspended, false)
         AND date_diff('day', listed_date, q.date) > 90 AS feasible
FROM quotes AS q JOIN instruments AS i ON i.code = q.code"""
)
def feasible_mask(p: Panels) -> DataFrame:
    """Tradable rows."""
    return returns.feasible(p.quotes, p.instruments, min_list_days=90).select("date", "code", "feasible")


_FEASIBLE = """feas AS (
  SELECT q.date, q.code, price, coalesce(high > limit_down, false) AND coalesce(low < limit_up, false) AND NOT coalesce(st, false) AND NOT coalesce(suspended, false)
         AND date_diff('day', listed_date, q.date) > 90 AS feasible
  FROM quotes AS q JOIN instruments AS i ON i.code = q.code)"""


@query("SELECT q.date, q.code, CASE WHEN feasible THEN q.price END AS price FROM quotes AS q LEFT JOIN feas ON feas.date = q.date AND feas.code = q.code", _FEASIBLE)
def tradable_price(p: Panels) -> DataFrame:
    """Prices where tradable, rows kept."""
    mask = returns.feasible(p.quotes, p.instruments).select("date", "code", "feasible")
    return returns.tradable(p.quotes.select("date", "code", "price"), mask, "price").select("date", "code", "price")


@query("SELECT date, code, price FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM panel) AS x WHERE (k - 1) % 5 = 0 AND date >= DATE '1994-01-01'")
def rebalance_sample(p: Panels) -> DataFrame:
    """P10: every fifth date."""
    return cal.rebalance_dates(p.panel.select("date", "code", "price"), 5, begin=_D(1994, 1, 1))


@query(
    """
SELECT p.date, p.code, last_value(r.mrq IGNORE NULLS) OVER (PARTITION BY p.code ORDER BY p.date) AS mrq
FROM panel AS p LEFT JOIN report AS r ON r.date = p.date AND r.code = p.code"""
)
def pit_ffill(p: Panels) -> DataFrame:
    """Sparse reports carried forward onto the panel's dates."""
    return returns.as_of(p.panel.select("date", "code"), p.report.select("date", "code", "mrq"), ["mrq"])


@query("SELECT date, code, first_industry_code = '0' AS d0, first_industry_code = '1' AS d1, first_industry_code = '2' AS d2, first_industry_code = '3' AS d3, first_industry_code = '4' AS d4 FROM industry WHERE first_industry_code IS NOT NULL AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-01'")
def one_hot_industry(p: Panels) -> DataFrame:
    """Industry dummies; industries that no row has are zero."""
    wide = industry_dummies(p.industry, _D(1995, 1, 1), _D(1996, 12, 1))
    return wide.select("date", "code", *((F.col(f"ind_{i}") == 1 if f"ind_{i}" in wide.columns else F.lit(False)).alias(f"d{i}") for i in range(5)))


@query("SELECT date, code, CAST(price AS DOUBLE) AS value, 'price' AS name FROM factor_a WHERE price IS NOT NULL UNION ALL SELECT date, code, CAST(volume AS DOUBLE), 'volume' FROM factor_a WHERE volume IS NOT NULL")
def stack_unstack(p: Panels) -> DataFrame:
    """Columns to rows; absent cells drop out (:func:`unstack_whole` goes to wide by code and back)."""
    wide = p.factor_a.select("date", "code", F.col("price").cast("double"), F.col("volume").cast("double"))
    return wide.unpivot(["date", "code"], ["price", "volume"], "name", "value").where("value is not null")


def unstack(rows: DataFrame) -> DataFrame:
    """``date, name`` and a column a code from ``date, code, name, value``, for few codes: the plan grows with them (:func:`reshape.wide_columns` has any number)."""
    codes = [c.code for c in rows.select("code").distinct().orderBy("code").collect()]
    return rows.groupBy("date", "name").pivot("code", codes).agg(F.first("value"))


@query("SELECT date, code, CAST(price AS DOUBLE) AS value, 'price' AS name FROM factor_a WHERE price IS NOT NULL UNION ALL SELECT date, code, CAST(volume AS DOUBLE), 'volume' FROM factor_a WHERE volume IS NOT NULL")
def unstack_whole(p: Panels) -> DataFrame:
    """The whole table from long to wide by code, 64 columns a block of codes, and back; absent cells drop out."""
    columns = p.factor_a.select("date", "code", F.col("price").cast("double"), F.col("volume").cast("double"))
    rows = columns.unpivot(["date", "code"], ["price", "volume"], "name", "value")
    codes = reshape.dictionary(rows, "code")
    return reshape.columns_stacked(reshape.wide_columns(rows, codes, ["date", "name"]), codes, ["date", "name"]).select("date", "code", "value", "name")


@query("SELECT date, code, CAST(price AS DOUBLE) AS value, 'price' AS name FROM factor_a WHERE price IS NOT NULL UNION ALL SELECT date, code, CAST(volume AS DOUBLE), 'volume' FROM factor_a WHERE volume IS NOT NULL")
def unstack_blocks(p: Panels) -> DataFrame:
    """The whole table to dense arrays of 64 codes a block and back, without a column a code."""
    columns = p.factor_a.select("date", "code", F.col("price").cast("double"), F.col("volume").cast("double"))
    rows = columns.unpivot(["date", "code"], ["price", "volume"], "name", "value")
    codes = reshape.dictionary(rows, "code")
    return reshape.stacked(reshape.wide_blocks(rows, codes, ["date", "name"], block=64), codes, ["date", "name"]).select("date", "code", "value", "name")


@query("SELECT date, code, cap FROM panel WHERE code % 3 <> 0 UNION ALL SELECT date, code, cap FROM panel WHERE code % 3 = 0 AND date < DATE '1995-01-01'")
def union_parts(p: Panels) -> DataFrame:
    """Parts by range of dates put together, repeated keys once."""
    one, two = p.panel.where("code % 3 <> 0"), p.panel.where(F.col("date") < F.lit(_D(1995, 1, 1)))
    return one.unionByName(two).select("date", "code", "cap").dropDuplicates(["date", "code"])


@query("SELECT a.date, a.code, a.price FROM factor_a AS a WHERE EXISTS (SELECT 1 FROM factor_b AS b WHERE b.date = a.date AND b.code = a.code) AND a.date IN (SELECT date FROM report)")
def key_intersection(p: Panels) -> DataFrame:
    """Rows whose key is in another table and whose date is in a third."""
    rows = p.factor_a.select("date", "code", "price").join(p.factor_b, ["date", "code"], "left_semi")
    return rows.join(p.report.select("date"), "date", "left_semi")


@query("SELECT a.date, a.code, price, n FROM factor_a AS a LEFT JOIN (SELECT date, count(*) AS n FROM factor_b GROUP BY 1) AS b ON b.date = a.date")
def per_date_values(p: Panels) -> DataFrame:
    """Values of a date put on its rows."""
    return p.factor_a.select("date", "code", "price").join(p.factor_b.groupBy("date").agg(F.count("*").alias("n")), "date", "left")


@query("SELECT date, code, try_cast(CASE WHEN code % 4 = 0 THEN 'n/a' ELSE CAST(code AS VARCHAR) END AS DOUBLE) AS v FROM panel WHERE code % 8 <> 0")
def coercion(p: Panels) -> DataFrame:
    """What is no number becomes missing; rows missing a subset are dropped."""
    from lodeframe.functions.columns import number

    text = p.panel.withColumn("s", F.when(F.col("code") % 4 == 0, F.lit("n/a")).otherwise(F.col("code").cast("string")))
    kept = text.withColumn("k", F.when(F.col("code") % 8 != 0, F.lit(1))).na.drop(subset=["k"])
    return kept.select("date", "code", number("s").alias("v"))


@query(f"SELECT date, count(*) AS n, {r('avg(price)', 'mean')}, {r('max(price)', 'high')} FROM (SELECT date, code, avg(price) AS price FROM intraday GROUP BY 1, 2) AS x GROUP BY 1")
def intraday_batches(p: Panels) -> DataFrame:
    """A daily factor from intraday rows in one plan, no loop over ranges."""
    daily = p.intraday.groupBy("date", "code").agg(F.avg("price").alias("price"))
    return daily.groupBy("date").agg(F.count("*").alias("n"), tidy(F.avg("price")).alias("mean"), tidy(F.max("price")).alias("high"))
