"""Delimited telemetry files as fixes."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lines

HEAD = 25
COMMON = ("Time", "Latitude", "Longitude", "Altitude", "Speed")


@dataclass(frozen=True)
class DelimitedOptions:
    """How a format's files are read. names: the format's name of a common channel; channels_signature: how its header line
    begins; file_signature: how one of a file's first two lines begins; data_starts_after: the line before its data;
    not_data: beginnings of lines that are no data; resolution: fixes a second where there is no time; iso: times are
    ISO 8601 text; seed_us: the time before the first synthesised one."""

    delimiter: str = ","
    names: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    speed_factor: float = 1.0
    channels_signature: str = ""
    file_signature: str = ""
    data_starts_after: str = ""
    not_data: tuple[str, ...] = ()
    resolution: float = 50.0
    iso: bool = False
    include: str = "*"
    exclude: tuple[str, ...] = ()
    encoding: str = "utf-8"
    seed_us: int = 0
    device: str = "TextFile"

    def name(self, common: str) -> str:
        return self.names.get(common, common)


def split(line: str, delimiter: str) -> list[str]:
    """The fields of a line: quotes protect delimiters, two of them are one, blanks around are cut."""
    found = next(csv.reader([line], delimiter=delimiter, skipinitialspace=True), [])
    return [x.strip() for x in found]


def instant(text: Column) -> Column:
    """Epoch milliseconds from 1e11 on, else epoch seconds, with fractions; other text as ISO 8601."""
    return F.coalesce(epoch(text.try_cast("double")), F.try_to_timestamp(text))


def epoch(n: Column) -> Column:
    return F.timestamp_micros(F.when(n >= 1e11, F.round(n * 1e3)).otherwise(F.round(n * 1e6)).cast("long"))


def timed(rows: DataFrame, raw: Column, keys: list[str], order: list[str], resolution: float, seed_us: int, name: str = "at") -> DataFrame:
    """rows with their time: epoch of raw, and where that is null 1 / resolution seconds after the synthesised time before it
    (0.02 s for a resolution of 0 or less), the first one after seed_us."""
    step = 1_000_000 / resolution if resolution > 0 else 20_000
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = F.timestamp_micros((F.lit(seed_us) + F.count(F.when(raw.isNull(), 1)).over(w) * step).cast("long"))
    return rows.withColumn(name, F.coalesce(epoch(raw), made))


def aligned(rows: DataFrame, keys: list[str], order: list[str], fix_ts: str, ts: str) -> DataFrame:
    """rows whose `ts` is that of the last fix before them, where there is one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(ts, F.coalesce(F.last(fix_ts, ignorenulls=True).over(w), F.col(ts)))


def header(rows: DataFrame, o: DelimitedOptions) -> tuple[list[str], str]:
    """(channels, header line) of the first file: the first line that begins with the signature, or else has both coordinates."""
    for line in lines.head(rows, HEAD):
        names = split(line, o.delimiter) if line else []
        if line.startswith(o.channels_signature) if o.channels_signature and line else {o.name("Latitude"), o.name("Longitude")} <= set(names):
            return names, line
    raise ValueError(f"no header within {HEAD} lines")


def is_compatible(spark: SparkSession, path: str, o: DelimitedOptions) -> bool:
    """Whether one of the first two lines of the first file begins with the format's signature."""
    rows = lines.read(spark, path, o.include, o.exclude, o.encoding)
    return bool(o.file_signature) and any(x.startswith(o.file_signature) for x in lines.head(rows, 2))


def channels(spark: SparkSession, path: str, options: DelimitedOptions | None = None) -> list[str]:
    o = options or DelimitedOptions()
    names, _ = header(lines.read(spark, path, o.include, o.exclude, o.encoding), o)
    return [n for n in names if n not in o.ignored]


def read(spark: SparkSession, path: str, options: DelimitedOptions | None = None, event: Callable[[Column], Column] | None = None) -> DataFrame:
    """file, block, line, ts, lat, lon, alt, speed, data (map of the other kept channels) of rows with latitude and longitude.

    The header of the first file holds for all. Header and signature lines, lines that begin with '#' or one of not_data,
    and what does not come after data_starts_after are left out, and so are lines that `event` takes (see events). Numbers
    may have thousands separators; what is no number is null; short rows lack their last channels.
    """
    o = options or DelimitedOptions()
    rows = lines.read(spark, path, o.include, o.exclude, o.encoding)
    schema, head = header(rows, o)
    rows = lines.after(rows, o.data_starts_after) if o.data_starts_after else rows
    value = F.col("value")
    rows = rows.filter((value != head) & (F.trim(value) != ""))
    for prefix in filter(None, ("#", o.channels_signature, o.file_signature, *o.not_data)):
        rows = rows.filter(~F.startswith(value, F.lit(prefix)))
    if event is not None:
        rows = rows.filter(event(value).isNull())
    kind = ", ".join(f"c{i} string" for i in range(len(schema)))
    how = {"sep": o.delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    rows = rows.withColumn("r", F.from_csv("value", kind, how))

    def text(common: str) -> Column:
        return F.col(f"r.c{schema.index(o.name(common))}") if o.name(common) in schema else F.lit(None).cast("string")

    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    used = {o.name(c) for c in COMMON} | set(o.ignored)
    pairs = [x for i, n in enumerate(schema) if n not in used for x in (F.lit(n), number(F.col(f"r.c{i}")))]
    data = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    fixes = rows.withColumn("lat", number(text("Latitude"))).withColumn("lon", number(text("Longitude")))
    fixes = fixes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    stamp = F.coalesce(F.try_to_timestamp(text("Time")), instant(text("Time"))) if o.iso else instant(text("Time"))
    if o.name("Time") in schema:
        fixes = fixes.withColumn("known", stamp)
        micros = F.unix_micros("known") / 1e3
    else:
        micros = F.lit(None).cast("double")
    fixes = timed(fixes, micros, ["file"], ["block", "line"], o.resolution, o.seed_us, "made")
    ts = F.coalesce("known", "made") if o.name("Time") in schema else F.col("made")
    return fixes.select(
        "file", "block", "line", ts.alias("ts"), "lat", "lon", number(text("Altitude")).alias("alt"), (number(text("Speed")) * o.speed_factor).alias("speed"), data.alias("data")
    )


def events(spark: SparkSession, path: str, event: Callable[[Column], Column], options: DelimitedOptions | None = None) -> DataFrame:
    """The lines that `event` (a struct of a line, null for lines that are no events) takes, each with the time of the fix
    before it as ts, null without one."""
    o = options or DelimitedOptions()
    rows = lines.read(spark, path, o.include, o.exclude, o.encoding)
    rows = lines.after(rows, o.data_starts_after) if o.data_starts_after else rows
    found = rows.withColumn("event", event(F.col("value"))).filter("event is not null")
    fixes = read(spark, path, o, event).select("file", "block", "line", F.col("ts").alias("fix_ts"), F.lit(None).alias("event"))
    both = found.select("file", "block", "line", F.lit(None).cast("timestamp").alias("fix_ts"), "event").unionByName(fixes)
    both = both.withColumn("ts", F.lit(None).cast("timestamp"))
    return aligned(both, ["file"], ["block", "line"], "fix_ts", "ts").filter("event is not null").select("file", "block", "line", "ts", "event.*")


def max_speed(fixes: DataFrame) -> float:
    """The highest positive speed of the last file by name, 0 if there is none."""
    last = fixes.groupBy("file").agg(F.max("speed").alias("most")).orderBy(F.desc(F.lower("file"))).first()
    return max(0.0, last["most"] or 0.0) if last else 0.0
