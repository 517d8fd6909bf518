"""A folder of factor tables: load and join named columns, save, upsert, inspect.

Each table is Parquet, partitioned by ``date`` where it was saved here (see :mod:`versions`).
Everything but :meth:`FactorStore.save` and :meth:`FactorStore.upsert` is lazy.
"""

from __future__ import annotations

import datetime
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.columns import clean, named
from lodeframe.operators.calendar import neighbours
from lodeframe.operators.transforms import Grouped, Processor, process
from lodeframe.sources import bucketed, versions

JOINS = {"inner", "left", "right", "full"}


def parse_path(path: str, sep: str = "/") -> tuple[str, str, str]:
    """(table, column, alias) of ``table/column`` or ``table/column AS alias``."""
    if not isinstance(path, str):
        raise TypeError(f"a factor path is a string, not {type(path).__name__}")
    body, *alias = re.split(r"\s+as(?:\s+|$)", path.strip(), maxsplit=1, flags=re.I)
    parts = [p.strip() for p in body.split(sep)]
    if len(parts) != 2 or not all(parts) or (alias and not alias[0].strip()):
        raise ValueError(f"expected table{sep}column [AS alias]: {path!r}")
    return parts[0], parts[1], alias[0].strip() if alias else parts[1]


class FactorStore:
    """Tables under ``root``, and frames attached by name."""

    def __init__(self, spark: SparkSession, root: str | None = None, time_col: str = "date", code_col: str = "code"):
        self.spark, self.root, self.time_col, self.code_col = spark, root, time_col, code_col
        self._attached: dict[str, DataFrame] = {}

    # --- catalog -----------------------------------------------------------------

    def attach(self, table: str, df: DataFrame) -> FactorStore:
        """Make a frame known as a table."""
        self._attached[table] = df
        return self

    def path(self, table: str) -> str:
        if self.root is None:
            raise ValueError(f"unknown table {table!r}: the store has no root")
        return f"{self.root.rstrip('/')}/{table}"

    def table(self, table: str) -> DataFrame | None:
        """The table, or None where nothing was saved yet."""
        if table in self._attached:
            return self._attached[table]
        if self.root is None:
            return None
        df = self._raw(table)
        return None if df is None else clean(df)

    def _raw(self, table: str) -> DataFrame | None:
        if (found := bucketed.opened(self.spark, self.path(table))) is not None:
            return found
        if (version := versions.latest(self.spark, self.path(table))) is not None:
            return versions.read(self.spark, self.path(table), version)
        for path in (self.path(table), self._columns(table)):
            try:
                return self.spark.read.parquet(path)
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        return None

    def _columns(self, table: str) -> str:
        """An empty table beside the data of one that has had no rows so far: dates without rows leave no files."""
        return f"{self.path(table)}.columns"

    def _known(self, table: str) -> DataFrame:
        df = self.table(table)
        if df is None:
            raise ValueError(f"unknown table {table!r}")
        return df

    def register(self, table: str) -> bool:
        """Make a table visible to :meth:`query` by name; False where it has no data."""
        df = self.table(table)
        if df is not None:
            df.createOrReplaceTempView(table)
        return df is not None

    def query(self, sql: str) -> DataFrame:
        """Any SELECT over registered tables."""
        for name in self._attached:
            self.register(name)
        return self.spark.sql(sql)

    # --- load --------------------------------------------------------------------

    def load(
        self,
        paths: list[str] | str,
        begin: object = None,
        end: object = None,
        *,
        sep: str = "/",
        join: str = "full",
        pad_begin: int = 0,
        pad_end: int = 0,
        base_table: str | None = None,
        ordered: bool = False,
    ) -> DataFrame:
        """Named columns of several tables, cut to a range of dates and joined on (time, code).

        The base table (by default that of the first path) gives the default bounds and the
        calendar for padding, and its columns come first.  Bounds are inclusive.
        ``pad_begin = n`` moves the lower bound to the (n-1)-th date before the last base date
        up to ``begin``; ``pad_end = n`` moves the upper bound to the n-th date after the first
        base date from ``end``; beyond the calendar the first or last date is taken.  A repeated
        alias in one table is taken once; one alias in two tables is an error.  ``ordered`` sorts
        the rows by (time, code), for output.
        """
        how = join.lower()
        if how not in JOINS:
            raise ValueError(f"join is one of {sorted(JOINS)}, not {join!r}")
        if pad_begin < 0 or pad_end < 0:
            raise ValueError("padding is not negative")
        columns: dict[str, dict[str, str]] = {}
        for path in [paths] if isinstance(paths, str) else paths:
            table, column, alias = parse_path(path, sep)
            columns.setdefault(table, {}).setdefault(alias, column)
        if not columns:
            raise ValueError("no factor paths")
        seen: dict[str, str] = {}
        for table, own in columns.items():
            for alias in own:
                if alias in seen:
                    raise ValueError(f"{alias!r} comes from {seen[alias]!r} and {table!r}; use AS")
                seen[alias] = table
        base = base_table or next(iter(columns))
        if base not in columns:
            raise ValueError(f"base table {base!r} is not among {sorted(columns)}")
        low, high = self._bounds(base, begin, end, pad_begin, pad_end)
        keys, out = [self.time_col, self.code_col], None
        tables = [base, *(t for t in columns if t != base)]
        if how == "full" and len(tables) > 2 and self._together(tables):
            # left joins onto all keys: unlike a full join they leave the rows where they are.  Dates are never NULL here; that
            # they might be keeps the filter from changing the columns' nullability, which a union without a shuffle needs alike
            out, how = bucketed.spine([self._known(t).select(*keys).where(self._between(low, high) | F.col(self.time_col).isNull()) for t in tables]), "left"
        for table in tables:
            df = self._known(table).where(self._between(low, high))
            part = df.select(*keys, *(named(c).alias(a) for a, c in columns[table].items()))
            out = part if out is None else out.join(part, keys, how)
        return out.orderBy(*keys) if ordered else out

    def _between(self, low: object, high: object) -> Column:
        t = F.col(self.time_col)
        return (F.lit(True) if low is None else t >= F.lit(low)) & (F.lit(True) if high is None else t <= F.lit(high))

    def _together(self, tables: list[str]) -> bool:
        """Whether all tables are bucketed on the keys in the same way, so that their keys are unique and known."""
        if self.root is None or any(t in self._attached for t in tables):
            return False
        counts = {bucketed.buckets_of(self.spark, self.path(t)) for t in tables}
        return None not in counts and len(counts) == 1

    def _bounds(self, base: str, begin: object, end: object, pad_begin: int, pad_end: int) -> tuple[object, object]:
        """Bounds of dates after padding: nothing is read where both are given and neither is padded, else one small action over the base calendar."""
        if begin is not None and end is not None and not pad_begin and not pad_end:
            return begin, end
        t = F.col(self.time_col)
        dates = self.dates(base)
        first, last = dates.agg(F.min(t), F.max(t)).first()
        low, high = (first if begin is None else begin), (last if end is None else end)
        if pad_begin:
            found = dates.where(t <= F.lit(low)).orderBy(t.desc()).offset(pad_begin - 1).limit(1).first()
            low = found[0] if found else first
        if pad_end:
            found = dates.where(t >= F.lit(high)).orderBy(t).offset(pad_end).limit(1).first()
            high = found[0] if found else last
        return low, high

    # --- save --------------------------------------------------------------------

    def save(self, table: str, df: DataFrame, processors: list[Processor | Grouped] | None = None) -> DataFrame:
        """Upsert ``df`` with a processed copy of every value column; returns what was written."""
        keys = [self.time_col, self.code_col]
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"missing key columns {missing}")
        values = [c for c in df.columns if c not in keys]
        if not values:
            raise ValueError("nothing to save besides keys")
        df = process(df, values, processors or [])
        self.upsert(table, df, keys)
        return df

    def save_bucketed(self, table: str, df: DataFrame, buckets: int) -> None:
        """Save ``df`` whole, dealt into buckets by (time, code) and sorted in them, in place of what the table held.

        Tables with the same number of buckets are joined on their keys without a shuffle, at any
        number of tables.  Keys are unique and not NULL.  Such a table is saved as a whole only: there
        are no date partitions to upsert.
        """
        bucketed.write(df, self.path(table), [self.time_col, self.code_col], buckets)

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """Replace rows whose keys are in ``df`` and add the others.

        The time column is one of the keys, so that the old row of a key lies on the date
        of the new one; keys must be unique in ``df``.  Only the date partitions that ``df``
        touches are read and written anew, and a record makes them visible together: a write that
        was killed leaves the old rows.  Columns that either side lacks become NULL.  No rows leave
        the table as it is, or make an empty one of these columns.  ``df`` is evaluated once; one small
        job tests keys, times of day (refused where the time column is ``date``) and emptiness
        together and finds the dates.  Missing keys equal each other.  A Parquet folder that was not saved here is taken over whole.
        """
        if bucketed.buckets_of(self.spark, self.path(table)) is not None:
            raise ValueError(f"{table!r} is bucketed: save it as a whole")
        if self.time_col not in keys:
            raise ValueError(f"keys {keys} lack the time column {self.time_col!r}")
        t = F.col(self.time_col)
        # a saved date is a day: where the time column has that name, a time of day would be lost
        cut = t.cast("timestamp") != F.to_date(t).cast("timestamp") if self.time_col == "date" else F.lit(False)
        new = df.withColumn("__cut", cut).withColumn("date", F.to_date(t)).persist()
        kept = new
        try:
            per_key = new.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__cut").alias("cut"), F.max("date").alias("day"))
            found = per_key.agg(F.max("n"), F.max("cut"), F.collect_set("day"), F.max(F.col("day").isNull())).first()
            if found[1]:
                raise ValueError("the time column 'date' holds times of day: give it another name, so that they are kept beside the partitions' dates")
            if found[0] is not None and found[0] > 1:
                raise ValueError(f"keys {keys} repeat in the new rows")
            new = new.drop("__cut")
            version = versions.latest(self.spark, self.path(table))
            old = self.table(table) if version is None else clean(versions.read(self.spark, self.path(table), version, {*found[2], *([None] if found[3] else [])}))
            if found[0] is None:
                if old is None:
                    new.write.mode("overwrite").parquet(self._columns(table))
                return
            rows = new
            if old is not None:
                mine = new.select(*(named(k).alias(f"__key{i}") for i, k in enumerate(keys)))
                rows = old.join(mine, [old[f"`{k}`"].eqNullSafe(mine[f"__key{i}"]) for i, k in enumerate(keys)], "left_anti").unionByName(new, allowMissingColumns=True)
            # a date's rows go to one task, or a few where there are many
            versions.write(rows.hint("rebalance", F.col("date")), self.path(table), version)
        finally:
            kept.unpersist()

    def replace(self, table: str, df: DataFrame) -> None:
        """Write ``df``, whose time column holds dates, in place of the partitions of its dates; other dates of the table stay."""
        path = self.path(table)
        versions.write(df.withColumn("date", F.to_date(self.time_col)), path, versions.latest(self.spark, path))

    def vacuum(self, table: str) -> list[str]:
        """Delete what later writes replaced and what killed ones left; see :func:`versions.vacuum`."""
        version = versions.latest(self.spark, self.path(table))
        return [] if version is None else versions.vacuum(self.spark, self.path(table), version)

    # --- dates -------------------------------------------------------------------

    def dates(self, table: str) -> DataFrame:
        """The distinct dates of a table.  Those of one that was saved here are in its records; of other partitioned ones only the files' listing is read."""
        df = self._known(table)
        if self.time_col == "date" and table not in self._attached:
            if (version := versions.latest(self.spark, self.path(table))) is not None:
                return self.spark.createDataFrame([(d,) for d in version.dates()], "date date")
            files = [unquote(x) for x in self._raw(table).inputFiles()]
            found = sorted({m[1] for f in files if (m := re.search(r"/date=(\d{4}-\d{2}-\d{2})/[^/]*$", f))})
            if found and all("/date=" in f for f in files):
                return self.spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in found], "date date")
        return df.select(self.time_col).where(F.col(self.time_col).isNotNull()).distinct()

    def date_range_of(self, table: str) -> DataFrame:
        """One row ``first_date, last_date``, NULL for an empty table."""
        df = self.table(table)
        if df is None:
            return self.spark.range(1).select(F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date"))
        return self.dates(table).agg(F.min(self.time_col).alias("first_date"), F.max(self.time_col).alias("last_date"))

    def latest_date(self, table: str) -> object:
        return self.date_range_of(table).first()["last_date"]

    def earliest_date(self, table: str) -> object:
        return self.date_range_of(table).first()["first_date"]

    def date_gap(self, target: str, base: str, default: str = "1900-01-01") -> DataFrame:
        """One row ``target_date, base_date``: the latest dates, ``default`` for empty tables."""
        latest = lambda t, c: self.date_range_of(t).select(F.coalesce(F.col("last_date").cast("date"), F.lit(default).cast("date")).alias(c), F.lit(1).alias("__one"))
        return latest(target, "target_date").join(latest(base, "base_date"), "__one").drop("__one")

    def trading_days(self, date: object, n: int = 1, table: str = "quotes_day") -> DataFrame:
        """The n dates of a table strictly before ``date`` (n > 0) or |n| strictly after, ascending."""
        return neighbours(self._known(table), date, n, self.time_col)


def industry_dummies(industry: DataFrame, begin: object, end: object, column: str = "first_industry_code", prefix: str = "ind_", date: str = "date", code: str = "code") -> DataFrame:
    """0/1 columns ``ind_<value>`` for the categories of a range of dates; rows without category are left out."""
    rows = industry.where(F.col(date).between(F.lit(begin), F.lit(end))).where(F.col(column).isNotNull())
    rows = rows.select(date, code, F.concat(F.lit(prefix), F.col(column).cast("string")).alias("__c"))
    return rows.groupBy(date, code).pivot("__c").agg(F.lit(1)).na.fill(0)
