"""Tables of date partitions that a small record makes visible: a write is seen as a whole or not at all.

Every write puts its dates, each as a whole partition, into a folder of its own and then adds
one record (a single file) with the folder, the dates and the columns.  A date is read
from the last folder that a record names for it.  So a write that was killed leaves what was there
before, a frame that is being read keeps its files while others write, and dates and columns are
known from the records alone.  Records hold one short value a date.  One writer at a time.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructType

_RECORD = "seq long, folder string, dates array<date>, columns string"
_MISSING = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Version:
    """What the records say: the folder of every date, the dates of every folder, the columns and the number of the last record."""

    seq: int
    places: dict[datetime.date | None, str]
    folders: dict[str, frozenset]
    columns: StructType

    def dates(self) -> list[datetime.date]:
        return sorted(d for d in self.places if d is not None)


def _rows(path: str) -> str:
    return f"{path}.rows"


def _records(path: str) -> str:
    return f"{path}.commits"


def latest(spark: SparkSession, path: str) -> Version | None:
    """The state of a table after its last record; None where there is none."""
    try:
        found = sorted(spark.read.schema(_RECORD).parquet(_records(path)).collect(), key=lambda r: r.seq)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not found:
        return None
    places = {d: r.folder for r in found for d in r.dates}
    return Version(found[-1].seq, places, {r.folder: frozenset(r.dates) for r in found}, StructType.fromJson(json.loads(found[-1]["columns"])))


def read(spark: SparkSession, path: str, version: Version, only: set | None = None) -> DataFrame:
    """The rows of a version, of the dates in ``only`` where given; a folder whose dates are all asked for is one path."""
    wanted: dict[str, set] = {}
    for d, folder in version.places.items():
        if only is None or d in only:
            wanted.setdefault(folder, set()).add(d)
    paths = []
    for folder, dates in wanted.items():
        home = f"{_rows(path)}/folder={folder}"
        paths += [home] if dates == version.folders[folder] else [f"{home}/date={_MISSING if d is None else d}" for d in sorted(dates, key=str)]
    if not paths:
        return spark.createDataFrame([], version.columns)
    schema = StructType([*version.columns.fields]).add("folder", StringType())
    return spark.read.schema(schema).option("basePath", _rows(path)).parquet(*paths).drop("folder")


def write(rows: DataFrame, path: str, before: Version | None) -> None:
    """Write ``rows`` with the column ``date`` in place of the partitions of its dates; visible once the record is there.

    Columns that only the table has so far stay its columns.  No rows change nothing.
    """
    if "folder" in rows.columns:
        raise ValueError("a saved table has no column 'folder'")
    spark, folder = rows.sparkSession, f"w{uuid.uuid4().hex}"
    home = f"{_rows(path)}/folder={folder}"
    rows.write.partitionBy("date").parquet(home)
    files = [unquote(f) for f in spark.read.schema(rows.schema).parquet(home).inputFiles()]
    named = {re.search(r"/date=([^/]*)/[^/]*$", f)[1] for f in files}
    if not named:
        return
    dates = [None if d == _MISSING else datetime.date.fromisoformat(d) for d in sorted(named)]
    columns = StructType([*rows.schema.fields, *(f for f in (before.columns if before else []) if f.name not in rows.columns)])
    record = spark.createDataFrame([((before.seq if before else 0) + 1, folder, dates, columns.json())], _RECORD)
    # one task and one file, renamed into place at the end: the record is there or it is not
    record.coalesce(1).write.mode("append").parquet(_records(path))


def vacuum(spark: SparkSession, path: str, version: Version) -> list[str]:
    """Delete partitions that a later record replaced and folders of writes that never ended; returns their names.

    Then the records become one file.  Not while a write runs or a table is opened, nor while a frame that
    was opened before the last write is still read.
    """
    home = spark._jvm.org.apache.hadoop.fs.Path(_rows(path))
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for entry in files.listStatus(home):
        folder = entry.getPath().getName().removeprefix("folder=")
        kept = {_MISSING if d is None else str(d) for d, f in version.places.items() if f == folder}
        if not kept:
            files.delete(entry.getPath(), True)
            gone.append(folder)
            continue
        for part in files.listStatus(entry.getPath()):
            name = part.getPath().getName()
            if name.startswith("date=") and name.removeprefix("date=") not in kept:
                files.delete(part.getPath(), True)
                gone.append(f"{folder}/{name}")
    _merge_records(spark, path, version)
    return gone


def _merge_records(spark: SparkSession, path: str, version: Version) -> None:
    """One file of records, each with the dates that it still holds, in place of a file a write.

    Merged and older records side by side, as a killed run leaves them, tell the same state once
    replaced partitions are gone.
    """
    home = spark._jvm.org.apache.hadoop.fs.Path(_records(path))
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(home) if f.getPath().getName().endswith(".parquet")]
    if len(old) < 2:
        return
    merged = {}
    for r in spark.read.schema(_RECORD).parquet(_records(path)).collect():
        if dates := [d for d in r.dates if version.places[d] == r.folder]:
            merged[r.folder] = (r.seq, r.folder, dates, r["columns"])
    spark.createDataFrame([*merged.values()], _RECORD).coalesce(1).write.mode("append").parquet(_records(path))
    for file in old:
        files.delete(file, False)
