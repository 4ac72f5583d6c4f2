"""The native delimited format: header lines, event lines and data lines of epoch ms and channel values; plain or zipped."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt
from . import lines

#: How files begin, what ends the name of an archive's entry, and the channels of a file that is told none.
HEADER, ENTRY = "#Format=", ".lz"
DEFAULT = ("Latitude", "Longitude", "Speed", "Accuracy")
#: Lines that may stand above the fields, and that a reader sniffs at.
FIELDS_WITHIN, SNIFFED = 200, 5


@dataclass(frozen=True)
class Native:
    """What a file holds. fixes: ts, lat, lon, alt, speed, accuracy, data."""

    channels: list[str]
    circuit_code: str | None
    events: DataFrame
    data: DataFrame
    fixes: DataFrame


def entry_name(container: str | None, original: str | None = None) -> str:
    """The name of an archive's entry: that of the container, or of the original file, or `data`."""
    base = posixpath.basename(container or "") or posixpath.basename(original or "") or "data"
    return (base.rsplit(".", 1)[0] or base) + ENTRY


def event_order() -> list[Column]:
    """Laps in order, in each its sectors by number and then the others."""
    sector = F.col("type") == "Sector"
    return [F.col("lap").cast("long"), F.when(sector, 0).otherwise(1), F.when(sector, F.col("sector").cast("int")).otherwise(2**31 - 1)]


def session_lines(events: DataFrame, data: DataFrame, channels: list[str], circuit_code: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(part, a, b, c, line) of one session: headers, events (ts, type, lap, sector, time_ticks) and data (ts, data) in order."""
    head = ["#Format=Native Delimited Data", "#Version=1"]
    head += [f"#CircuitCode={circuit_code}"] if circuit_code else []
    head += [f"#{x.lstrip('#')}" for x in more] + ["#Fields=" + ",".join(channels)]
    top = events.sparkSession.createDataFrame([(0, i, 0, 0, x) for i, x in enumerate(head)], "part int, a long, b int, c int, line string")
    a, b, c = event_order()
    line = fmt.event_line(F.col("ts"), F.col("type"), F.col("lap"), F.col("sector"), F.col("time_ticks"))
    e = events.select(F.lit(1).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), line.alias("line"))
    line = fmt.data_line(F.col("ts"), F.col("data"), len(channels))
    d = data.select(F.lit(2).alias("part"), F.unix_micros("ts").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), line.alias("line"))
    return top.unionByName(e).unionByName(d)


def write(events: DataFrame, data: DataFrame, channels: list[str], path: str, circuit_code: str | None = None, mode: str = "errorifexists", more: tuple[str, ...] = ()) -> None:
    """One session as a text file in the folder `path`; mode as Spark's writers have it (append adds lines in a file of its own).

    A file of this format is one session, so its lines go to one task, in order.
    """
    rows = session_lines(events, data, channels or list(DEFAULT), circuit_code, more)
    rows.coalesce(1).sortWithinPartitions("part", "a", "b", "c").select("line").write.mode(mode).text(path)


def pack(events: DataFrame, data: DataFrame, channels: list[str], container: str, circuit_code: str | None = None) -> DataFrame:
    """(name, content): the session as a zip archive of one entry, made by one task line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(entry_name(container), "w") as entry:
            n = 0
            for b in batches:
                n += b.num_rows
                entry.write("".join(f"{x}\n" for x in b.column("line").to_pylist()).encode())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([container]), pa.array([held.getvalue()], pa.binary())], ["name", "content"])

    rows = session_lines(events, data, channels or list(DEFAULT), circuit_code)
    return rows.coalesce(1).sortWithinPartitions("part", "a", "b", "c").select("line").mapInArrow(run, "name string, content binary")


def is_native(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the first entry of an archive, begins like this format."""
    return any(x.startswith(HEADER) for x in lines.head(_lines(spark, path), SNIFFED))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a plain file, or of the first entry of an archive; an archive without entries is an error."""
    magic = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("m")).first()
    if magic is None or bytes(magic["m"] or b"") != b"PK\x03\x04":
        if magic is not None and bytes(magic["m"] or b"") == b"PK\x05\x06":
            raise ValueError("the archive is empty")
        return lines.read(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    held = [x.rstrip("\r\n") for x in io.TextIOWrapper(archive.open(archive.namelist()[0]), "utf-8", "replace")]
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(held, pa.string())], ["file", "block", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, line long, value string")


def read_all(spark: SparkSession, path: str) -> Native:
    """A file's content. Malformed event and data lines are dropped; values that are no numbers are null; data above the fields
    does not count; rows are padded or cut to the channels."""
    rows = _lines(spark, path)
    head = lines.head(rows, FIELDS_WITHIN)
    top = next((x for x in head if x.startswith("#Fields=")), None)
    names = [c.strip() for c in top[len("#Fields=") :].split(",") if c.strip()] if top else []
    code = rows.filter(F.startswith("value", F.lit("#CircuitCode="))).orderBy("file", "block", "line").first()
    e = rows.filter(F.startswith("value", F.lit("#Event="))).select(F.split(F.expr("substring(value, 8)"), ",").alias("p"), "file", "block", "line")
    part = lambda i: F.get("p", F.lit(i))
    e = e.select(
        F.timestamp_millis(part(0).try_cast("long")).alias("ts"), F.initcap(F.trim(part(1))).alias("type"), part(2).try_cast("int").alias("lap"),
        part(3).try_cast("int").alias("sector"), part(4).try_cast("long").alias("time_ticks"),
    ).dropna()
    d = lines.after(rows, "#Fields=").filter(~F.startswith("value", F.lit("#"))).select(F.split("value", ",").alias("p"))
    values = F.transform(F.sequence(F.lit(1), F.lit(max(len(names), 1))), lambda i: F.get("p", i).try_cast("double"))
    d = d.select(F.timestamp_millis(part(0).try_cast("long")).alias("ts"), values.alias("data")).filter("ts is not null")
    d = d if names else d.limit(0)
    channel = lambda n: F.get("data", F.lit(names.index(n))) if n in names else F.lit(None).cast("double")
    fixes = d.select(
        "ts", F.coalesce(channel("Latitude"), F.lit(0.0)).alias("lat"), F.coalesce(channel("Longitude"), F.lit(0.0)).alias("lon"),
        F.coalesce(channel("Altitude"), F.lit(0.0)).alias("alt"), channel("Speed").alias("speed"), channel("Accuracy").alias("accuracy"), "data",
    )
    return Native(names, code["value"][len("#CircuitCode=") :].strip() if code else None, e, d, fixes)


def read(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, DataFrame]:
    """(channels, events, data)."""
    found = read_all(spark, path)
    return found.channels, found.events, found.data
