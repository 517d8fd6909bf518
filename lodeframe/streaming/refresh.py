"""Incremental refresh: a stream of factor rows upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe.operators.transforms import Processor, process
from lodeframe.sources.store import FactorStore


def upsert_stream(stream: DataFrame, store: FactorStore, table: str, checkpoint: str, order: str | None = None, processors: list[Processor] | None = None) -> StreamingQuery:
    """Starts a query that upserts every micro-batch into a table of the store.

    Within a batch the row with the largest ``order`` value of each key wins (any one
    without it).  A batch that runs again after a failure replaces its own rows, so the
    table ends up the same.
    """
    keys = [store.time_col, store.code_col]

    def write(batch: DataFrame, _: int) -> None:
        if order:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
            batch = batch.withColumn("__place", place).where("__place = 1").drop("__place")
        else:
            batch = batch.dropDuplicates(keys)
        values = [c for c in batch.columns if c not in keys]
        store.upsert(table, process(batch, values, processors or []), keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
