"""Wide tables of any number of codes: blocks of dense arrays or of columns instead of a column a code.

A dictionary numbers the codes in their order.  A wide row is cut into blocks of so many
codes, each an array (or a row of columns) with one place a code; so the plan does not grow
with the codes, none of them is collected, and no task holds more than blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.session import scratch_path

#: Codes of one block.
BLOCK = 1024

#: Columns of one block of columns.
COLUMNS = 64


def dictionary(rows: DataFrame, code: str = "code") -> DataFrame:
    """``code, place``: the distinct codes that are not NULL, numbered from 0 in their order.

    Numbered inside ranges of codes, which are written to the shared folder first, and then over
    the ranges; so many codes are many tasks, and every reader sees the same numbers.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession)
    codes = rows.select(F.col(code).alias("code")).where("code is not null").distinct()
    codes.repartitionByRange("code").withColumn("part", F.spark_partition_id()).write.parquet(path)
    known = spark.read.parquet(path)
    parts = known.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range of codes
    parts = parts.select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("code")) - 1
    return known.withColumn("inside", inside).join(F.broadcast(parts), "part").select("code", (F.col("before") + F.col("inside")).alias("place"))


def wide_blocks(rows: DataFrame, codes: DataFrame, keys: list[str], code: str = "code", value: str = "value", block: int = BLOCK) -> DataFrame:
    """``keys, block, width, cells`` from long rows: ``cells`` is an array of ``width`` values, NULL where a code has none.

    The code at position i of a block has the place ``block * <block> + i`` in the dictionary.
    Only blocks with a present value have rows; of several values of one code and keys the
    largest is taken; rows without a code are left out.
    """
    total = codes.agg(F.max("place").alias("__last"))
    placed = rows.where(F.col(value).isNotNull()).join(codes.withColumnRenamed("code", "__code"), F.col(code) == F.col("__code"))
    cells = placed.groupBy(*keys, "place").agg(F.max(value).alias("__value"))
    found = cells.groupBy(*keys, F.expr(f"place div {block}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(place % {block} as int)").alias("at"), "__value"))).alias("__cells"))
    # the last block is as wide as there are codes
    found = found.join(F.broadcast(total)).withColumn("width", F.least(F.lit(block), F.col("__last") + 1 - F.col("block") * block).cast("int"))
    return found.select(*keys, "block", "width", F.expr("transform(sequence(0, width - 1), i -> try_element_at(__cells, i))").alias("cells"), F.lit(block).alias("step"))


def stacked(wide: DataFrame, codes: DataFrame, keys: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """``keys, code, value`` from blocks; absent cells drop out."""
    cells = wide.select(*keys, "block", "step", F.posexplode("cells").alias("__at", value)).where(F.col(value).isNotNull())
    cells = cells.withColumn("place", F.col("block") * F.col("step") + F.col("__at"))
    return cells.join(codes, "place").select(*keys, F.col("code").alias(code), value)


def wide_columns(rows: DataFrame, codes: DataFrame, keys: list[str], code: str = "code", value: str = "value", block: int = COLUMNS) -> DataFrame:
    """``keys, block, c0, c1, ...`` from long rows: one column a code of the block, NULL where it has no value.

    Column ``c<i>`` of a block is the code with the place ``block * <block> + i``.  Absent values, several
    of one code and keys, and rows without a code are treated as in :func:`wide_blocks`.
    """
    placed = rows.where(F.col(value).isNotNull()).join(codes.withColumnRenamed("code", "__code"), F.col(code) == F.col("__code"))
    placed = placed.withColumn("__block", F.expr(f"place div {block}")).withColumn("__at", F.expr(f"cast(place % {block} as int)"))
    # plain aggregates of a fixed number of places: nothing is collected to name them
    return placed.groupBy(*keys, F.col("__block").alias("block")).agg(*(F.max(F.when(F.col("__at") == i, F.col(value))).alias(f"c{i}") for i in range(block)))


def columns_stacked(wide: DataFrame, codes: DataFrame, keys: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """``keys, code, value`` from blocks of columns; absent cells drop out."""
    names = [c for c in wide.columns if c not in (*keys, "block")]
    cells = wide.withColumnsRenamed({c: str(i) for i, c in enumerate(names)}).unpivot([*keys, "block"], [str(i) for i in range(len(names))], "__at", value).where(F.col(value).isNotNull())
    cells = cells.withColumn("place", F.col("block") * len(names) + F.col("__at").cast("long"))
    return cells.join(codes, "place").select(*keys, F.col("code").alias(code), value)
