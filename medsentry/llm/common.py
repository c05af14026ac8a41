"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space. bytes.split() with no argument cuts at
#: exactly these six bytes, and bytes.lower() changes exactly A-Z.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and all tasks run in this process (tests), a temporary folder is made and set
    for the session; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = f"file://{at}"
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df``, written once as a Parquet table in the shared folder and read back.

    It cuts the lineage: what follows survives the loss of executors without computing ``df``
    again, and no stage computes it twice. ``by``: a column of few values to partition the table by.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``stored`` made of ``df``; nothing that reads it may be used any more."""
    spark, files = df.sparkSession, df.inputFiles()
    for at in [m for m in _made if files and f"/{m[1].rsplit('/', 1)[1]}/" in files[0]]:
        _made.remove(at)
        delete(spark, at[1])


def id_crc(column: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit("")).cast("binary"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict[str, list]]]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """Apply ``make()`` once per task and its result to every Arrow batch.

    The inner function yields dicts of column lists; each becomes one batch of the output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                for columns in each(batch):
                    yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, spark_schema)

