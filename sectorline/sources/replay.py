"""Recorded sessions as if they happened now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import delimited, lines


def session(fixes: DataFrame, now_us: Column, skip: int = 0, zero_is_missing: bool = True) -> DataFrame:
    """fixes of each device moved so that its first is at now_us, one of every skip + 1 kept; those at latitude 0 are missing.

    What is skipped is counted among the fixes that are not missing.
    """
    w = Window.partitionBy("device_id")
    here = fixes.filter("lat <> 0") if zero_is_missing else fixes
    first = F.first(F.unix_micros("ts")).over(w.orderBy("arrival_ord"))
    moved = here.withColumn("__n", F.row_number().over(w.orderBy("arrival_ord"))).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - first + now_us))
    return moved.filter((F.col("__n") - 1) % (skip + 1) == 0).drop("__n").withColumn("provider", F.lit("Sim"))


def recorded(spark: SparkSession, path: str, skip: int = 0, guard: bool = True) -> DataFrame:
    """line, lat, lon, speed (from km/h to m/s), distance (from the row before, 0 for the first) of a comma-separated recording.

    Its header is the first line that begins with a quote or a T; columns are found whatever their case. '#' lines, the
    first `skip` rows and, as `guard`, rows whose second column begins with 0 are left out.
    """
    rows = lines.read(spark, path).filter("trim(value) <> '' and not startswith(value, '#')")
    top = next((x for x in lines.head(rows, 200) if x[:1] in ('"', "T")), None)
    if top is None:
        raise ValueError("no header")
    names = [n.lower() for n in delimited.split(top, ",")]
    kind = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = rows.filter(F.col("value") != top).withColumn("r", F.from_csv("value", kind, {"ignoreLeadingWhiteSpace": "true"}))
    rows = rows.filter(~F.startswith(F.coalesce("r.c1", F.lit("")), F.lit("0"))) if guard and len(names) > 1 else rows
    number = lambda n: F.col(f"r.c{names.index(n)}").try_cast("double") if n in names else F.lit(None).cast("double")
    w = Window.partitionBy("file").orderBy("block", "line")
    rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") > skip)
    distance = number("distance")
    return rows.select("line", number("latitude").alias("lat"), number("longitude").alias("lon"), (number("speed") / 3.6).alias("speed"), F.coalesce(distance - F.lag(distance).over(w), F.lit(0.0)).alias("distance"))


def golden(spark: SparkSession, path: str, base_us: int = 0) -> DataFrame:
    """Timing events of a semicolon-separated file of several devices, and the flags that it expects: offsets in ms from
    base_us, times in ticks."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    rows = rows.withColumn("ord", F.monotonically_increasing_id())
    first = F.min("ord").over(Window.partitionBy("DeviceId"))
    flag = lambda c: F.lower(F.trim(c)) == "true"
    return rows.select(
        F.lit(1).alias("session_id"), F.col("DeviceId").alias("device_id"), first.alias("device_ord"), "ord",
        F.timestamp_micros(F.lit(base_us) + F.col("Timestamp").cast("long") * 1000).alias("ts"), F.col("Type").alias("type"),
        F.col("LapNumber").cast("int").alias("lap"), F.col("SectorNumber").cast("int").alias("sector"), F.col("TimeFull").cast("long").alias("time_ticks"),
        F.lit(False).alias("deleted"), flag("IsPersonnalBest").alias("expected_personal"), flag("IsBestOverall").alias("expected_overall"),
    )
