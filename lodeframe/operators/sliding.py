"""Sums over sliding windows in time that does not depend on the window's length.

Positions are cut into blocks as long as the window.  A window then is the end of one block
and the beginning of the next (or one whole block): a running sum to the end of the
first, and a running sum from the beginning of the second.  Every row therefore stands
twice in the table, at its own place and as a probe at the first place of its window;
running sums over the blocks in both directions serve both, and each row takes the
probe's sum from its neighbour.  Nothing is subtracted, so no digits are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shorter windows are summed row by row: up to about here the additions cost less than two more sorts.
LINEAR_FROM = 240


def sliding_sums(df: DataFrame, values: dict[str, Column], window: int, keys: Sequence[str] = ("code",), at: str = "date_idx") -> DataFrame:
    """Adds the sums of ``values`` over the rows whose ``at`` lies in the last ``window`` positions of each group of ``keys``.

    ``at`` counts from 1 and is not repeated in a group; it may have gaps.  A window without present
    values gives NULL.  All sums share one shuffle by the keys.
    """
    if window < 1:
        raise ValueError("a window has one position at least")
    n, names = window, df.columns
    place = F.col(at).cast("long") - 1
    # dealt by the keys once: the windows by block and by key both find their rows together
    rows = df.repartition(*keys).select("*", *(v.alias(f"__v{i}") for i, v in enumerate(values.values())), F.explode(F.array(F.lit(0), F.lit(1))).alias("__probe"))
    # a window that is one whole block, or begins before all positions, needs no probe
    rows = rows.where((F.col("__probe") == 0) | ((place % n != n - 1) & (place >= n - 1)))
    rows = rows.withColumn("__at", place - F.col("__probe") * (n - 1)).withColumn("__block", F.floor(F.col("__at") / n))
    block = Window.partitionBy(*keys, "__block")
    up = block.orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = block.orderBy(F.desc("__at"), "__probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.when(F.col("__probe") == 0, F.col(f"__v{i}")) for i in range(len(values))]
    rows = rows.select(*names, "__probe", *(F.sum(v).over(up).alias(f"__u{i}") for i, v in enumerate(own)), *(F.sum(v).over(down).alias(f"__d{i}") for i, v in enumerate(own)))
    home = Window.partitionBy(*keys).orderBy(at, "__probe")
    probed = F.lead("__probe").over(home) == 1
    before = lambda i: F.when(probed, F.lead(f"__d{i}").over(home))
    rows = rows.select(*names, "__probe", *(F.coalesce(F.col(f"__u{i}") + before(i), F.col(f"__u{i}"), before(i)).alias(name) for i, name in enumerate(values)))
    return rows.where("__probe = 0").drop("__probe")


def rolled(df: DataFrame, x: str, n: int, outs: dict[str, str], min_periods: int | None = None, code: str = "code", linear: bool | None = None) -> DataFrame:
    """Adds sums and means (``outs``: name to ``sum`` or ``mean``) of ``x`` over the last n calendar dates, ``min_periods`` present at least (n by default).

    ``linear`` chooses block sums; by default from :data:`LINEAR_FROM` dates on.  Either way gives the
    same values, but for the order of additions.
    """
    value = F.col(x)
    if n >= LINEAR_FROM if linear is None else linear:
        rows = sliding_sums(df, {"__sum": value, "__n": F.when(value.isNotNull(), F.lit(1))}, n, [code])
        total, count = F.col("__sum"), F.coalesce("__n", F.lit(0))
    else:
        frame = Window.partitionBy(code).orderBy("date_idx").rangeBetween(-(n - 1), 0)
        rows = df.withColumn("__sum", F.sum(value).over(frame)).withColumn("__n", F.count(value).over(frame))
        total, count = F.col("__sum"), F.col("__n")
    enough = (count >= (n if min_periods is None else min_periods)) & (count > 0)
    rows = rows.withColumns({name: F.when(enough, total if how == "sum" else total / count) for name, how in outs.items()})
    return rows.drop("__sum", "__n")
