"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a temporary folder is made if all tasks run in this process; else it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise EngineError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="engine-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; nothing that reads them may be used any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if re.search(r"-[0-9a-f]{32}$", folder):  # a name that ``written`` gave
                delete(folder)


def _session() -> SparkSession | None:
    """The session, also in threads such as those of streams, which have none of their own."""
    return SparkSession.getActiveSession() or SparkSession._instantiatedSession


def _hadoop(path: str | Path):
    """(file system, path) of a path under the session's Hadoop configuration; None without a session."""
    spark = _session()
    if spark is None:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str | Path) -> bool:
    own = _hadoop(path)
    return own[0].exists(own[1]) if own else Path(path).exists()


def names(path: str | Path) -> list[str]:
    """What a folder holds, sorted; nothing if there is no such folder."""
    if not exists(path):
        return []
    own = _hadoop(path)
    return sorted(s.getPath().getName() for s in own[0].listStatus(own[1])) if own else sorted(p.name for p in Path(path).iterdir())


def entries(path: str | Path) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds, sorted; nothing if there is no such folder."""
    own = _hadoop(path)
    if own is None:
        return sorted((p.name, p.is_dir()) for p in Path(path).iterdir()) if Path(path).is_dir() else []
    if not own[0].exists(own[1]):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in own[0].listStatus(own[1]))


def move(a: str | Path, b: str | Path) -> None:
    """Move a file or folder to a place where nothing is; folders above it are made."""
    fs, source = _hadoop(a)
    _, target = _hadoop(b)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise EngineError(f"{a} could not be moved to {b}")


def delete(path: str | Path) -> None:
    """Delete a file or a folder with what it holds, if it is there."""
    own = _hadoop(path)
    if own:
        own[0].delete(own[1], True)
    elif Path(path).is_dir():
        shutil.rmtree(path)
    else:
        Path(path).unlink(missing_ok=True)


def read_text(path: str | Path) -> str:
    """A small UTF-8 file, such as a record of a run."""
    own = _hadoop(path)
    if not own:
        return Path(path).read_text(encoding="utf-8")
    stream = own[0].open(own[1])
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(path: str | Path, value: str) -> None:
    """Replace a small file: it is written beside the old one and takes its place when it is whole."""
    own = _hadoop(path)
    if not own:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        aside = Path(f"{path}.{uuid.uuid4().hex}")
        aside.write_text(value, encoding="utf-8")
        aside.replace(path)
        return
    fs, at = own
    aside = at.suffix(f".{uuid.uuid4().hex}")
    stream = fs.create(aside)
    try:
        stream.write(bytearray(value.encode()))
    finally:
        stream.close()
    spark = _session()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    full = fs.makeQualified(at)
    hadoop.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), full, how)
