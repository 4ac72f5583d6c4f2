"""Laps with their sectors and telemetry as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import in_window


def span_text(ticks: Column) -> Column:
    """hh:mm:ss, and seven decimals where there is a fraction of a second; days and signs in front."""
    t = F.abs(ticks)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    days = F.floor(t / 864_000_000_000)
    clock = F.concat_ws(":", pad(F.floor(t / 36_000_000_000) % 24, 2), pad(F.floor(t / 600_000_000) % 60, 2), pad(F.floor(t / 10_000_000) % 60, 2))
    rest = F.when(t % 10_000_000 == 0, "").otherwise(F.concat(F.lit("."), pad(t % 10_000_000, 7)))
    return F.concat(F.when(ticks < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), clock, rest)


def number_text(x: Column) -> Column:
    """Up to five decimals without trailing zeros, and without a zero before the point; zero and null are empty."""
    text = F.format_string("%.5f", F.coalesce(x, F.lit(0.0)))
    return F.regexp_replace(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")), r"^(-?)0(?=\.)|^-?0$", "$1")


def export(events: DataFrame, fixes: DataFrame, channels: list[str], title: str = "# Lap data v1.0") -> DataFrame:
    """(device_id, lap_ord, part, place, line): sorted by these, the lines of each device's laps.

    Of each lap its time, the times of its sectors in order of arrival, and the fixes (arrival_ord, ts, data) of its time.
    """
    c, at = F.col, ["lap_ord", "part", "place"]
    head = F.array(F.lit(title), F.lit("Timestamp," + ",".join(channels)))
    top = events.select("device_id").distinct().select("device_id", F.lit(-1).cast("long").alias("lap_ord"), F.lit(0).alias("part"), F.posexplode(head).alias("place", "line"))
    top = top.withColumn("place", c("place").cast("long"))
    # Sectors find the laps of their number in a window over both, so that the events are read and numbered once.
    is_lap = c("type") == "Lap"
    sector = F.when(is_lap, "").otherwise(F.concat(F.lit(" Sector "), c("sector").cast("string")))
    line = F.concat(F.lit("#Lap "), c("lap").cast("string"), sector, F.lit(" "), span_text(c("time_ticks")))
    marks = events.filter("type in ('Lap', 'Sector')").select("device_id", "lap", "ord", is_lap.alias("is_lap"), line.alias("line"))
    marks = marks.withColumn("laps", F.collect_list(F.when(c("is_lap"), F.struct("ord"))).over(Window.partitionBy("device_id", "lap")))
    own = F.array(F.struct(c("ord").alias("lap_ord"), F.lit(1).alias("part")))
    theirs = F.when(c("device_id").isNotNull() & c("lap").isNotNull(), F.transform("laps", lambda x: F.struct(x["ord"].alias("lap_ord"), F.lit(2).alias("part"))))
    marks = marks.select("device_id", c("ord").alias("place"), "line", F.inline(F.when(c("is_lap"), own).otherwise(theirs)))
    # The text of a fix is made once, before it meets its laps, and in as many tasks as there are partitions, however few read it.
    cells = F.array_join(F.transform("data", number_text), ",", "")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    told = fixes.repartition("device_id", "arrival_ord").select("device_id", "arrival_ord", "ts", F.concat(stamp, F.lit(","), cells).alias("line"))
    hits = in_window(events.filter(is_lap).select("device_id", "ord", "ts", "time_ticks"), told)
    three = hits.select("device_id", c("ord").alias("lap_ord"), F.lit(3).alias("part"), c("arrival_ord").alias("place"), "line")
    return top.unionByName(marks.select("device_id", *at, "line")).unionByName(three)
