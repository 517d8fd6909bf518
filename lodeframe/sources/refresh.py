"""Refresh of a computed table by what its source has gained: the gap, the reach of its windows and carried values.

A refresh computes the dates of the source that the target lacks, in spans of some dates.
Each span reads only the partitions of its own dates and of the ``reach`` dates before it.
What depends on the whole past (running sums, counts, extremes, last values) is carried from
span to span in a table of one row a code.  A span counts as done once a record of its last
date is written, after its rows and the carried values; a refresh that broke off begins
again after the last record and replaces rows that were already written, so its result
is that of one run over everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.sources.store import FactorStore

#: Running measures by name: the aggregate over new rows, and how it meets the value carried so far.
_MEASURES: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda old, new: F.when(old.isNotNull() | new.isNotNull(), F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))),
    "count": (F.count, lambda old, new: F.coalesce(old, F.lit(0)) + new),
    "min": (F.min, lambda old, new: F.least(old, new)),
    "max": (F.max, lambda old, new: F.greatest(old, new)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda old, new: F.coalesce(new, old)),
}


@dataclass(frozen=True)
class Carry:
    """A running measure of a source column per code: sum, count, min, max or last, missing values skipped."""

    column: str
    how: str = "sum"

    def __post_init__(self) -> None:
        if self.how not in _MEASURES:
            raise ValueError(f"a carried measure is one of {sorted(_MEASURES)}, not {self.how!r}")


def _progress(target: str) -> str:
    return f"{target}.progress"


def _carried(target: str) -> str:
    return f"{target}.carried"


def done_until(store: FactorStore, target: str) -> object:
    """The last date of the last finished span, None where there is none."""
    record = store.table(_progress(target))
    return None if record is None else record.agg(F.max(store.time_col)).first()[0]


def open_dates(store: FactorStore, target: str, source: str, reach: int, until: object = None) -> tuple[list, list]:
    """The dates of the source that are not done, and up to ``reach`` dates before them, ascending.

    The dates of a saved source are its partitions, so no data is read.  A calendar has one
    short value a date; it is the only thing that comes to the driver.
    """
    t = F.col(store.time_col)
    dates = store.dates(source)
    if until is not None:
        dates = dates.where(t <= F.lit(until))
    since = done_until(store, target)
    new = dates if since is None else dates.where(t > F.lit(since))
    before = [] if since is None or not reach else [r[0] for r in dates.where(t <= F.lit(since)).orderBy(t.desc()).limit(reach).collect()][::-1]
    return [r[0] for r in new.orderBy(t).collect()], before


def source_rows(store: FactorStore, source: str, first: object, last: object) -> DataFrame:
    """Rows of the source between two dates, of these partitions only."""
    t = F.col(store.time_col)
    return store.table(source).where((t >= F.lit(first)) & (t <= F.lit(last)))


def running(store: FactorStore, rows: DataFrame, carried: DataFrame | None, carry: dict[str, Carry]) -> DataFrame:
    """``rows`` (time, code and the columns of ``carry``) with the running measures, on top of the carried ones."""
    t, c = store.time_col, store.code_col
    so_far = Window.partitionBy(c).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select(t, c, *(_MEASURES[m.how][0](F.col(m.column)).over(so_far).alias(f"__new_{n}") for n, m in carry.items()))
    if carried is None:
        return own.select(t, c, *(F.col(f"__new_{n}").alias(n) for n in carry))
    old = carried.select(F.col(c).alias("__code"), *(F.col(n).alias(f"__old_{n}") for n in carry))
    both = own.join(old, own[c].eqNullSafe(old["__code"]), "left")
    return both.select(t, c, *(_MEASURES[m.how][1](F.col(f"__old_{n}"), F.col(f"__new_{n}")).alias(n) for n, m in carry.items()))


def _carried_on(store: FactorStore, rows: DataFrame, carried: DataFrame | None, carry: dict[str, Carry]) -> DataFrame:
    """``code`` and the measures after ``rows``, of all codes so far."""
    t, c = store.time_col, store.code_col
    latest = lambda m: F.max_by(m.column, F.when(F.col(m.column).isNotNull(), F.col(t)))
    new = rows.groupBy(c).agg(*((latest(m) if m.how == "last" else _MEASURES[m.how][0](F.col(m.column))).alias(f"__new_{n}") for n, m in carry.items()))
    if carried is None:
        return new.select(c, *(F.col(f"__new_{n}").alias(n) for n in carry))
    old = carried.select(F.col(c).alias("__code"), *(F.col(n).alias(f"__old_{n}") for n in carry))
    both = new.join(old, new[c].eqNullSafe(old["__code"]), "full")
    filled = lambda m, n: F.coalesce(F.col(f"__new_{n}"), F.lit(0)) if m.how == "count" else F.col(f"__new_{n}")
    return both.select(F.coalesce(c, "__code").alias(c), *(_MEASURES[m.how][1](F.col(f"__old_{n}"), filled(m, n)).alias(n) for n, m in carry.items()))


def refresh(
    store: FactorStore, target: str, source: str, compute: Callable[[DataFrame], DataFrame] | None = None, *, reach: int = 0, carry: dict[str, Carry] | None = None, span: int | None = None, until: object = None
) -> list[tuple[object, object]]:
    """Bring ``target`` up to the dates of ``source`` (up to ``until``); returns the (first, last) dates of the spans done.

    ``compute`` makes ``time, code, values`` of rows of the source; its windows may look back ``reach``
    dates and no further, and of its result the dates of the span are kept.  ``carry`` adds
    running measures, named by its keys.  ``span`` dates are computed and saved at a time (all by
    default).  Keys of the source are unique; both tables are saved in the store.  A source
    without new dates changes nothing.
    """
    if compute is None and not carry:
        raise ValueError("nothing to compute or carry")
    t, c, carry = store.time_col, store.code_col, carry or {}
    todo, before = open_dates(store, target, source, reach, until)
    known, done = [*before, *todo], []
    for at in range(len(before), len(known), span or max(1, len(todo))):
        dates = known[at : at + (span or len(todo))]
        first, last = dates[0], dates[-1]
        since = known[at - 1] if at else done_until(store, target)
        out = None
        if compute:
            out = compute(source_rows(store, source, known[max(0, at - reach)], last)).where(F.col(t) >= F.lit(first))
        if carry:
            rows = source_rows(store, source, first, last)
            state = None if since is None else store.table(_carried(target)).where(F.col(t) == F.lit(since))
            made = running(store, rows, state, carry)
            out = made if out is None else out.join(made, [t, c], "left")
            on = _carried_on(store, rows, state, carry).withColumn(t, F.lit(last))
            store.replace(_carried(target), on)
        store.upsert(target, out, [t, c])
        # the record comes last: what is before it can be done again
        store.replace(_progress(target), store.spark.range(1).select(F.lit(last).alias(t), F.lit(first).alias("first"), F.lit(len(dates)).alias("n")))
        done.append((first, last))
    return done
