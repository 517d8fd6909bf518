"""Canonical panels over the order tables: (date, code) is (month, supplier).

The statements run unchanged in Spark SQL and DuckDB.  Sums of two-decimal amounts
are rounded back to two decimals, so both give the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeframe.session import kept

SQL: dict[str, str] = {
    "panel": """
SELECT date, code, cap / volume AS price, volume, dsum / n AS disc, cap
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS code, round(sum(l_extendedprice), 2) AS cap,
             sum(l_quantity) AS volume, round(sum(l_discount), 2) AS dsum, count(*) AS n
      FROM {lineitem} GROUP BY 1, 2) AS t""",
    "factor_a": "SELECT date, code, price, volume FROM {panel} WHERE code % 5 <> 0",
    "factor_b": "SELECT date, code, disc, cap FROM {panel} WHERE month(date) <> 3",
    "quotes": """
SELECT date, code, price, volume, high, low, lag(price) OVER (PARTITION BY code ORDER BY date) * 1.1 AS limit_up,
       lag(price) OVER (PARTITION BY code ORDER BY date) * 0.9 AS limit_down,
       CASE WHEN code % 7 = 0 THEN NULL ELSE code % 17 = 0 END AS st, (code + month(date)) % 23 = 0 AS suspended
FROM (SELECT p.date, p.code, p.price, p.volume, h.high, h.low
      FROM {panel} AS p
      JOIN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS code,
                   max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low
            FROM {lineitem} GROUP BY 1, 2) AS h ON p.date = h.date AND p.code = h.code) AS t""",
    "instruments": "SELECT code, min(date) AS listed_date FROM {panel} GROUP BY code",
    "industry": """
SELECT p.date, p.code, CASE WHEN p.code % 6 = 0 THEN NULL ELSE CAST(n.n_regionkey AS VARCHAR(8)) END AS first_industry_code
FROM {panel} AS p JOIN {supplier} AS s ON s.s_suppkey = p.code JOIN {nation} AS n ON n.n_nationkey = s.s_nationkey""",
    "report": "SELECT date, code, 'revenue' AS account_name, cap AS mrq FROM {panel} WHERE (code + month(date)) % 3 = 0",
    "intraday": "SELECT CAST(ts AS DATE) AS date, user_id AS code, ts AS time, value AS price FROM {events}",
    "tied": "SELECT date, code, CAST(volume AS BIGINT) % 7 AS f FROM {panel}",
}
_BASE = ("lineitem", "supplier", "nation", "events")
#: Rows of ``panel`` with ``high`` and ``low`` of ``quotes`` beside them, so that one pass over the order lines gives both.
_WIDE = SQL["panel"].replace("disc, cap\n", "disc, cap, high, low\n").replace("count(*) AS n\n", "count(*) AS n,\n             max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low\n")
_QUOTES = SQL["quotes"].partition("FROM (")[0] + "FROM {wide} WHERE date IS NOT NULL AND code IS NOT NULL"


class Panels:
    """Lazy frames of the canonical panels of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*SQL, *_BASE):
            raise AttributeError(name)
        if name not in self._made:
            if name in _BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                needs = {n: getattr(self, n) for n in (*SQL, *_BASE) if f"{{{n}}}" in SQL[name]}
                self._made[name] = self.spark.sql(SQL[name], **needs)
        return self._made[name]

    def stored(self, *names: str) -> Panels:
        """The same panels with those named written once, ``panel`` first: a plan that reads them often would sum the order lines as often.

        With ``quotes`` the order lines are grouped once for both.
        """
        out = Panels(self.spark, self.sf_dir)
        if "quotes" in names:
            wide = kept(self.spark.sql(_WIDE, lineitem=out.lineitem))
            out._made["panel"] = wide.drop("high", "low")
            out._made["quotes"] = kept(self.spark.sql(_QUOTES, wide=wide))
        for name in ("panel", *names):
            if name not in out._made:
                out._made[name] = kept(getattr(out, name))
        return out


def oracle(select: str, *ctes: str) -> str:
    """DuckDB SQL: the canonical panels a statement mentions, further CTEs, and the statement."""
    text = " ".join((*ctes, select))
    need = [n for n in SQL if n == "panel" or f" {n}" in text.replace("\n", " ").replace("(", " ")]
    names = {n: n for n in (*SQL, *_BASE)}
    made = [f"{n} AS ({SQL[n].format(**names)})" for n in need]
    recursive = "RECURSIVE " if any("RECURSIVE" in c for c in ctes) else ""
    return f"WITH {recursive}" + ",\n".join([*made, *(c.replace("RECURSIVE ", "") for c in ctes)]) + "\n" + select
