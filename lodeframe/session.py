"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lodeframe_shipped", False):
        return
    home = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-lodeframe-")) / "lodeframe.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(home.rglob("*.py")):
            archive.write(path, path.relative_to(home.parent))
    context.addPyFile(str(target))
    context._lodeframe_shipped = True


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-lodeframe-")
    return f"{base.rstrip('/')}/lodeframe-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what is read many times is computed once."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
