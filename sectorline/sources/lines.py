"""Lines of text files in their order, plain or from zip archives."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that a batch from an archive holds.
BATCH = 10_000


def read(spark: SparkSession, path: str, include: str = "*", exclude: tuple[str, ...] = (), encoding: str = "utf-8") -> DataFrame:
    """(file, block, line, value) of a file, a folder or zip archives: (block, line) is in order within a file.

    include is a pattern of file names; names that contain one of exclude, whatever the case, are left out. Of archives the
    members on top count.
    """
    if path.lower().endswith(".zip"):
        return _zipped(spark, path, include, exclude, encoding)
    text = spark.read.option("encoding", encoding).text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    rows = rows.filter(name.rlike(fnmatch.translate(include.lower()).replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$"))) if include != "*" else rows
    for part in exclude:
        rows = rows.filter(~F.contains(name, F.lit(part.lower())))
    return rows


def _zipped(spark: SparkSession, path: str, include: str, exclude: tuple[str, ...], encoding: str) -> DataFrame:
    names = ["file", "block", "line", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(archive.namelist(), key=str.lower):
                        wanted = "/" not in member and fnmatch.fnmatch(member.lower(), include.lower())
                        if not wanted or any(x.lower() in member.lower() for x in exclude):
                            continue
                        held: list[str] = []
                        first = 0
                        for text in io.TextIOWrapper(archive.open(member), encoding, "replace"):
                            held.append(text.rstrip("\r\n"))
                            if len(held) == BATCH:
                                yield _rows(posixpath.join(at, member), first, held)
                                first, held = first + len(held), []
                        yield _rows(posixpath.join(at, member), first, held)

    def _rows(file: str, first: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, line long, value string")


def first_file(rows: DataFrame) -> str | None:
    """The first file by name, whatever the case."""
    found = rows.select("file").distinct().orderBy(F.lower("file"), "file").first()
    return found[0] if found else None


def head(rows: DataFrame, n: int, file: str | None = None) -> list[str]:
    """The first n lines of a file, by default of the first one."""
    file = file or first_file(rows)
    found = rows.filter((F.col("file") == file) & (F.col("block") == 0)).orderBy("line").limit(n) if file else None
    return [r["value"] for r in found.collect()] if found is not None else []


def after(rows: DataFrame, marker: str) -> DataFrame:
    """The lines of each file that come after its first line that starts with the marker; of files without one, none."""
    at = rows.filter(F.startswith("value", F.lit(marker))).groupBy("file").agg(F.min(F.struct("block", "line")).alias("marker"))
    return rows.join(at, "file").filter(F.struct("block", "line") > F.col("marker")).drop("marker")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, md5) of each file: lower-case hex of its bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.md5("content").alias("md5"))
