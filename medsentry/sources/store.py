"""Stored datasets: quarter-partitioned Parquet, replaced by quarter; the ingest manifest; JSON records."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IngestError
from ..storage import exists, read_text, write_text
from .schema import DATASETS


def write_quarter(df: DataFrame, root: str, name: str, quarter: str) -> None:
    """Replace one quarter's partition of a dataset; others stay. Doing it twice changes nothing."""
    own = [f.name for f in DATASETS[name] if f.name != "quarter"]
    df.select(*own).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/quarter={quarter}")


def replace_quarters(df: DataFrame, root: str, name: str) -> None:
    """Replace the partitions of all quarters that ``df`` (with its column ``quarter``) has, in one job; others stay.

    Rows are dealt by quarter, and large quarters are split by their size, so a quarter becomes a few files.
    New partitions take the place of the old ones when the whole job has succeeded.
    """
    own = [f.name for f in DATASETS[name] if f.name != "quarter"]
    rows = df.select(*own, "quarter").hint("rebalance", "quarter")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("quarter").parquet(f"{root}/{name}")


def read_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A dataset with its declared schema, so columns that old partitions lack are null."""
    if name not in DATASETS:
        raise IngestError(f"no dataset {name}; there are {', '.join(DATASETS)}")
    schema = DATASETS[name]
    if "quarter" not in schema.names:
        schema = type(schema)([*schema.fields]).add("quarter", "string")
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def delete_quarter(spark: SparkSession, root: str, name: str, quarter: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/quarter={quarter}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert(old: DataFrame, new: DataFrame, key: str = "primaryid") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that share their key; of repeated keys in ``new`` the last quarter wins."""
    order = Window.partitionBy(key).orderBy(F.desc("quarter"))
    fresh = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n") if "quarter" in new.columns else new
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def replace_children(old: DataFrame, new: DataFrame, key: str = "primaryid") -> DataFrame:
    """``old`` without any row of the parents in ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def rendered(df: DataFrame) -> DataFrame:
    """Every column as bulk loaders of databases take it: null is ``\\N``, unlike empty text; lists are JSON."""
    shown = lambda c, t: F.to_json(c) if t.startswith("array") else F.col(c).cast("string")
    return df.select(*(F.coalesce(shown(c, t), F.lit(r"\N")).alias(c) for c, t in df.dtypes))


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _move(spark: SparkSession, a: str, b: str) -> None:
    fs, path = _files(spark, a)
    if not fs.rename(path(a), path(b)):
        raise IngestError(f"{a} could not take the place of {b}")


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; one that a rebuild had moved aside when it was ended is moved back."""
    fs, hadoop = _files(spark, path)
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(f"{path}.old")):
        _move(spark, f"{path}.old", path)
    return fs.exists(hadoop(path))


def write_whole(df: DataFrame, path: str) -> None:
    """Rebuild a table: the new one is written beside the old one, which is moved aside and deleted last.

    Whenever this is ended, the old or the new table is whole, at ``path`` or where ``recovered`` finds it.
    """
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(aside)
    fs, hadoop = _files(spark, path)
    if recovered(spark, path):
        fs.delete(hadoop(f"{path}.old"), True)
        _move(spark, path, f"{path}.old")
    _move(spark, aside, path)
    fs.delete(hadoop(f"{path}.old"), True)


class Manifest:
    """What was ingested: one record a quarter, in a JSON file."""

    def __init__(self, path: str | Path):
        self.path = path
        self.rows: dict[str, dict] = json.loads(read_text(path)) if exists(path) else {}

    def _save(self) -> None:
        write_text(self.path, json.dumps(self.rows, indent=1, sort_keys=True, default=str))

    def should_ingest(self, unit: str, checksum: str, force: bool = False) -> bool:
        """Only a completed quarter whose archive hasn't changed is skipped."""
        row = self.rows.get(unit)
        return force or not row or row["status"] != "completed" or row["checksum"] != checksum

    def start(self, unit: str, checksum: str, source: str = "faers", size: int = 0) -> None:
        now = datetime.now(timezone.utc).isoformat()
        self.rows[unit] = {"source": source, "unit": unit, "checksum": checksum, "status": "running", "started_at": now, "finished_at": None, "error": None, "row_count": None, "row_counts": {}, "bytes_downloaded": size, "had_deleted_file": None}
        self._save()

    def complete(self, unit: str, row_counts: dict[str, int], had_deleted_file: bool) -> None:
        self.rows[unit] |= {"status": "completed", "row_counts": row_counts, "row_count": sum(row_counts.values()), "had_deleted_file": had_deleted_file, "finished_at": datetime.now(timezone.utc).isoformat()}
        self._save()

    def fail(self, unit: str, error: str) -> None:
        self.rows[unit] |= {"status": "failed", "error": error, "finished_at": datetime.now(timezone.utc).isoformat()}
        self._save()

    def completed(self, start: str | None = None, end: str | None = None) -> list[str]:
        return sorted(u for u, r in self.rows.items() if r["status"] == "completed" and (not start or u >= start) and (not end or u <= end))


def save_json(path: str | Path, value: dict) -> None:
    write_text(path, json.dumps(value, indent=1, sort_keys=True, default=str) + "\n")


def load_json(path: str | Path, renamed: dict[str, str] | None = None) -> dict:
    """A JSON record; a key under its former name is read as the present one. Keys that are absent stay so: unmeasured isn't zero."""
    value = json.loads(read_text(path))
    for old, new in (renamed or {}).items():
        if old in value and new not in value:
            value[new] = value.pop(old)
    return value
