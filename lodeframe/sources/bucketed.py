"""Tables whose rows lie in buckets by key, so that joins on the key need no shuffle.

The files carry their bucket in their names; a small record beside them holds the number of
buckets, the keys and the columns.  A session that has not seen the table makes it known to
its catalog from that record.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _name(path: str) -> str:
    return f"lodeframe_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _record(spark: SparkSession, path: str) -> tuple[int, list[str], str] | None:
    try:
        row = spark.read.schema("buckets int, keys array<string>, columns string").parquet(f"{path}.buckets").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (row.buckets, list(row["keys"]), row["columns"])


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """Number of buckets of the table in a folder, None for other tables."""
    found = _record(spark, path)
    return None if found is None else found[0]


def write(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write ``df`` into ``buckets`` buckets by its keys, which are unique and not NULL, one file a bucket; replaces the folder."""
    if buckets < 1:
        raise ValueError("a table has one bucket at least")
    spark = df.sparkSession
    # dealt once: the check of the keys and the write both find the rows where they belong
    dealt = df.repartition(buckets, *keys)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    wrong = dealt.groupBy(*keys).agg(F.count("*").alias("n"), F.max(missing).alias("missing")).where("n > 1 or missing")
    if not wrong.isEmpty():
        raise ValueError(f"keys {keys} of a bucketed table are unique and not NULL")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    record = spark.createDataFrame([(buckets, keys, df.schema.json())], "buckets int, keys array<string>, columns string")
    record.coalesce(1).write.mode("overwrite").parquet(f"{path}.buckets")


def opened(spark: SparkSession, path: str) -> DataFrame | None:
    """The bucketed table in a folder, known to this session's catalog from now on; None for other tables."""
    found = _record(spark, path)
    if found is None:
        return None
    if not spark.catalog.tableExists(_name(path)):
        buckets, keys, columns = found
        named = lambda c: "`" + c.replace("`", "``") + "`"
        fields = ", ".join(f"{named(f.name)} {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(columns)).fields)
        by = ", ".join(map(named, keys))
        spark.sql(f"CREATE TABLE {_name(path)} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def spine(keys: list[DataFrame]) -> DataFrame:
    """The distinct keys of several tables; where these are bucketed alike, without a shuffle."""
    return reduce(DataFrame.unionByName, keys).distinct()
