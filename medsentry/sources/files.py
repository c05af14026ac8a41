"""Readers of the quarterly extracts: file location, encoding, header check, all-text scan, archives.

Everything goes through the session's file system and is read by executors, so folders, extracts and
archives may lie in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from ..storage import _session, delete, entries, move
from .quarter import Quarter
from .schema import check_header, source_fields

ENCODINGS = ("ascii", "utf-8", "cp1252")
#: Bytes that mean nothing in CP1252.
_HOLES = "".join(chr(b) for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore"))


def _texts(folder: str | Path, part: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the folder has ``part`` (whatever its case), and (name, path) of the .txt files in it; an unpacked file is a folder."""
    at = [f"{folder}/{name}" for name, inner in entries(folder) if inner and name.lower() == part]
    return bool(at), [(name, f"{d}/{name}") for d in at for name, _ in entries(d) if name.lower().endswith(".txt")]


def find_file(folder: str | Path, table: str) -> str:
    """The one .txt file of a table in the ``ascii`` folder, whatever its case."""
    found = [path for name, path in _texts(folder, "ascii")[1] if name.upper().startswith(table)]
    if len(found) != 1:
        raise IngestError(f"{folder}: {len(found)} files for {table}")
    return found[0]


def find_deleted(folder: str | Path) -> str | None:
    """The list of withdrawn cases, if the quarter has one."""
    there, found = _texts(folder, "deleted")
    if len(found) > 1 or (there and not found):
        raise IngestError(f"{folder}: {len(found)} lists of deleted cases")
    return found[0][1] if found else None


def encodings(lines: DataFrame, *by: str) -> DataFrame:
    """The first of the encodings that decodes all lines (value, as the text source reads them) of each group; null if none does.

    A line feed is never part of a longer UTF-8 sequence, so a file is valid exactly if its lines are, and
    lines of one file can be looked at by many tasks. The text source keeps bytes as they are, but takes a
    byte order mark off.
    """
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    fits = {
        "ascii": ~latin.rlike("[\\x80-\\xff]"),
        "utf-8": F.expr("is_valid_utf8(value)"),
        "cp1252": ~latin.rlike(f"[{_HOLES}]"),
    }
    found = lines.groupBy(*by).agg(F.count("*").alias("lines"), *(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in fits.items()))
    return found.select(*by, "lines", F.coalesce(*(F.when(F.col(n), n) for n in ENCODINGS)).alias("encoding"))


def encoding_of(path: str | Path) -> str:
    """The first encoding that decodes the whole file."""
    row = encodings(_session().read.text(str(path))).first()
    if row.encoding is None:
        raise IngestError(f"{path}: not in any of {ENCODINGS}")
    return row.encoding


def _cp1252_letters() -> tuple[str, str]:
    """What the bytes 0x80 to 0x9F mean in Latin-1 and in CP1252; five of them mean nothing in CP1252."""
    pairs = [(chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))]
    return "".join(a for a, _ in pairs), "".join(c for _, c in pairs)


def read_table(spark: SparkSession, path: str | Path, table: str, quarter: Quarter) -> DataFrame:
    """All columns as text under their canonical names; empty fields are null, rows too long are cut.

    The CSV reader knows Latin-1 but not CP1252, which differs in 27 characters: those are exchanged
    afterwards. So files of either encoding are split among tasks and decoded in the JVM.
    """
    encoding = encoding_of(path)
    header = spark.read.text(str(path)).first()
    check_header(table, quarter, (header.value if header else "").rstrip("\r\n").split("$"))
    names = [f.name for f in source_fields(table, quarter)]
    read_as = "ISO-8859-1" if encoding == "cp1252" else "UTF-8"
    df = spark.read.csv(str(path), sep="$", header=True, quote="", inferSchema=False, mode="PERMISSIVE", encoding=read_as, enforceSchema=True, schema=", ".join(f"`{n}` string" for n in names))
    if encoding == "cp1252":
        df = df.select(*(F.translate(n, *_cp1252_letters()).alias(n) for n in names))
    return df.withColumn(names[-1], F.regexp_replace(names[-1], r"\r+$", ""))


def read_deleted(spark: SparkSession, path: str | Path | None) -> DataFrame | None:
    """(caseid) of the withdrawn cases; lines that are no number are skipped. No list gives None."""
    if path is None:
        return None
    own = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(str(path)).select(own.alias("v")).filter(F.col("v").rlike("^[0-9]+$")).select(F.col("v").cast("bigint").alias("caseid")).distinct()


def checksum(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def check_archive(path: str | Path, least: int = 1 << 20, expected: int | None = None) -> str:
    """The checksum of a whole zip archive; raises if it is too small, of another size, or broken."""
    size = Path(path).stat().st_size
    if size < least or (expected is not None and size != expected) or not zipfile.is_zipfile(path):
        raise IngestError(f"{path}: {size} bytes, not a complete archive")
    return checksum(path)


def _opened(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise IngestError("not a zip archive") from e


def inspected(spark: SparkSession, archive: str | Path) -> tuple[int, str, list[str]]:
    """(size, SHA-256, members) of a zip archive of up to 2 GB. A broken one raises, and so does a member whose path leads out."""
    schema = pa.schema([("size", pa.int64()), ("sha256", pa.string()), ("members", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                try:
                    members = [i.filename for i in _opened(content).infolist() if not i.is_dir()]
                except IngestError:
                    members = None
                yield pa.record_batch([[len(content)], [hashlib.sha256(content).hexdigest()], pa.array([members], schema.field("members").type)], schema=schema)

    found = spark.read.format("binaryFile").load(str(archive)).select("content").mapInArrow(run, "size bigint, sha256 string, members array<string>").collect()  # a row an archive
    if len(found) != 1 or found[0].members is None:
        raise IngestError(f"{archive}: not a complete archive")
    for name in found[0].members:
        if posixpath.isabs(name) or "\\" in name or posixpath.normpath(name).split("/")[0] == "..":
            raise IngestError(f"{archive}: {name} leads out of the folder")
    return found[0].size, found[0].sha256, found[0].members


def unpacked(spark: SparkSession, archive: str | Path, at: str) -> str:
    """The text members of a zip archive in a folder of the shared store, each a folder with one text file of its lines.

    One task unpacks an archive, as its streams can't be entered in the middle; what it writes is split among
    tasks again. Bytes stay as they are.
    """
    _, _, members = inspected(spark, archive)
    schema = pa.schema([("member", pa.int32()), ("at", pa.int64()), ("value", pa.binary())])
    wanted = [m for m in members if m.lower().endswith(".txt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with _opened(content) as z:
                    for k, name in enumerate(wanted):
                        with z.open(name) as f:
                            first, rest = 0, b""
                            while block := f.read(1 << 22):
                                *lines, rest = (rest + block).split(b"\n")
                                yield pa.record_batch([pa.array([k] * len(lines), pa.int32()), pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.binary())], schema=schema)
                                first += len(lines)
                            if rest:
                                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([rest], pa.binary())], schema=schema)

    lines = spark.read.format("binaryFile").load(str(archive)).select("content").mapInArrow(run, "member int, at bigint, value binary")
    aside = f"{at}.members"
    lines.sortWithinPartitions("member", "at").select("member", F.col("value").cast("string").alias("value")).write.partitionBy("member").text(aside)
    written = {name for name, inner in entries(aside) if inner}
    for k, name in enumerate(wanted):
        if f"member={k}" in written:
            move(f"{aside}/member={k}", f"{at}/{posixpath.normpath(name)}")
    delete(aside)
    return at
