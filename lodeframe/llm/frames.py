"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: A list is broadcast up to this size; beyond it, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Most bytes of one Arrow batch: a task holds one on either side of the Python border.
BATCH_BYTES = 4 << 20

#: Spark's setting to remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Batches = Iterator[pa.RecordBatch]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in local
    mode, as in tests, a temporary folder of this machine is taken and remembered
    in the session; elsewhere it would not be seen by all executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodeframe.scratch.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-lodeframe-")
        spark.conf.set("lodeframe.scratch.dir", path)
    return path.rstrip("/")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, whatever the case, for columns added beside a user's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks of the running stage,
    and what follows may read the rows several times without computing them anew.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodeframe-{uuid.uuid4().hex}"
    # the written rows stand for the plan from here on: its shuffle files go when the write ends
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete stored tables that nothing reads any more, and the shuffle files of steps that have ended.

    Spark removes shuffle files once the driver has collected the plans that made them.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def _width(field) -> Column:
    """Bytes of a column's values in memory, about."""
    c = F.col(field.name)
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(field.dataType, ArrayType):
        return F.coalesce(F.octet_length(F.array_join(c.cast("array<string>"), "")) + 24 * F.size(c), F.lit(0)) + 24
    return F.lit(16)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast while it takes no more bytes than ``most``."""
    df = stored(df)
    total = df.agg(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long"))).first()[0] or 0
    if total > most:
        return df
    out = F.broadcast(df)
    out.stored_path = df.stored_path
    return out


def pick(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``doc_id`` is listed; ids travel to the texts while their size is bounded."""
    return texts.join(sized(ids.distinct()), "doc_id", "left_semi")


def _trimmed(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            # workers live on: what a task took goes back to the system
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mapped(df: DataFrame, function: Callable[[Batches], Batches], schema: object) -> DataFrame:
    """``df.mapInArrow`` in batches of a few MB; sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_trimmed(function), schema)
