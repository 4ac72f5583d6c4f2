"""Statistics of timing events per device and session. Of ties the first event (lowest ord) wins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before

DEVICE = ["session_id", "device_id"]


def _least(e: DataFrame, keys: list[str], value: str, *columns: str) -> DataFrame:
    one = e.groupBy(*keys).agg(F.min(F.struct(value, "ord", *columns)).alias("s"))
    return one.select(*keys, f"s.{value}", "s.ord", *[f"s.{c}" for c in columns])


def _greatest(e: DataFrame, order: list[Column], *columns: str) -> DataFrame:
    key = [c.alias(f"k{i}") for i, c in enumerate([*order, -F.col("ord")])]
    one = e.groupBy(*DEVICE).agg(F.max(F.struct(*key, *columns, "ord")).alias("s"))
    return one.select(*DEVICE, "s.ord", *[f"s.{c}" for c in columns])


def last_event(e: DataFrame) -> DataFrame:
    return e.groupBy(*DEVICE).agg(F.max(F.struct("ord", "type", "time_ticks")).alias("s")).select(*DEVICE, "s.*")


def last_lap(e: DataFrame) -> DataFrame:
    return _greatest(e.filter("type = 'Lap'"), [F.col("lap")], "lap", "time_ticks")


def best_lap(e: DataFrame) -> DataFrame:
    """Zero times count, laps from number 1."""
    return _least(e.filter("type = 'Lap' and lap > 0"), DEVICE, "time_ticks", "lap")


def last_sector(e: DataFrame) -> DataFrame:
    s = e.filter("type = 'Sector' and time_ticks > 0")
    return _greatest(s, [F.col("lap"), F.col("sector")], "lap", "sector", "time_ticks")


def best_sectors(e: DataFrame) -> DataFrame:
    return _least(e.filter("type = 'Sector' and time_ticks > 0"), [*DEVICE, "sector"], "time_ticks", "lap")


def theoretical_best(e: DataFrame) -> DataFrame:
    best = e.filter("type = 'Sector' and time_ticks > 0 and lap > 0").groupBy(*DEVICE, "sector").agg(F.min("time_ticks").alias("t"))
    return best.groupBy(*DEVICE).agg(F.sum("t").alias("theoretical_ticks"))


def rolling_best(e: DataFrame) -> DataFrame:
    """Least sum over as many consecutive sectors as the highest sector number; prefix sums, no data-sized frame."""
    s = e.filter("type = 'Sector'").withColumn("n", F.max("sector").over(Window.partitionBy(*DEVICE)))
    s = s.filter("lap > 0 and n > 0")
    w = Window.partitionBy(*DEVICE).orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(*DEVICE, "n", F.row_number().over(w.orderBy("ts", "ord")).alias("i"), F.sum("time_ticks").over(w).alias("total"))
    before = s.select(*DEVICE, (F.col("i") + F.col("n")).alias("i"), F.col("total").alias("before"))
    sums = s.join(before, [*DEVICE, "i"], "left").filter("i >= n")
    return sums.groupBy(*DEVICE).agg(F.min(F.col("total") - F.coalesce("before", F.lit(0))).alias("rolling_ticks"))


def session_best_lap(e: DataFrame) -> DataFrame:
    """Least of the devices' best laps; a device whose best is not positive drops out."""
    best = best_lap(e).filter("time_ticks > 0")
    return _least(best, ["session_id"], "time_ticks", "device_id")


def session_best_sectors(e: DataFrame) -> DataFrame:
    return best_sectors(e).groupBy("session_id", "sector").agg(F.min("time_ticks").alias("time_ticks"))


def event_telemetry(events: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per event of a device with fixes in (ts - time, ts]: their number, least and greatest latitude."""
    hits = in_window(events.select("device_id", "ord", "ts", "time_ticks"), fixes.select("device_id", "ts", "lat"), 86_400_000_000)
    return hits.groupBy("device_id", "ord").agg(F.count(F.lit(1)).alias("n_fixes"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))


def current_lap_time(e: DataFrame, as_of_us: Column) -> DataFrame:
    """Ticks since a device's last lap (by number), else since its last event."""
    lap = F.max(F.when(F.col("type") == "Lap", F.struct("lap", -F.col("ord"), F.unix_micros("ts").alias("us"))))["us"]
    last = F.max(F.struct("ord", F.unix_micros("ts").alias("us")))["us"]
    one = e.groupBy(*DEVICE).agg(F.coalesce(lap, last).alias("us"))
    return one.select(*DEVICE, ((as_of_us - F.col("us")) * 10).alias("current_ticks"))


def best_sector_flags(e: DataFrame) -> DataFrame:
    """is_best_sector of each sector event at its arrival: a positive time that no earlier one of the device's sector beats."""
    s = e.filter("type = 'Sector'")
    timed = F.when(F.col("time_ticks") > 0, F.col("time_ticks"))
    out = before(s, [*DEVICE, "sector"], ["ord"], F.floor(F.col("ord") / (1 << 20)), timed, F.min, "best")
    flag = (F.col("time_ticks") > 0) & (F.col("best").isNull() | (F.col("time_ticks") <= F.col("best")))
    return out.select(*DEVICE, "ord", "sector", flag.alias("is_best_sector"))


def max_speed(fixes: DataFrame, key: str = "device_id") -> DataFrame:
    """The highest positive speed of each device, 0 if there is none."""
    return fixes.groupBy(key).agg(F.greatest(F.coalesce(F.max("speed"), F.lit(0.0)), F.lit(0.0)).alias("max_speed"))


def event_vector(kind: Column, lap: Column, sector: Column, ticks: Column, first: tuple[Column, Column], second: tuple[Column, Column], factor: Column) -> Column:
    """[type, lap, sector, time in ms, first lat, lon, second lat, lon, factor] as doubles; missing coordinates are 0."""
    number = F.when(kind == "Lap", 0).when(kind == "Sector", 1).when(kind == "Start", 2).when(kind == "Position", 3).otherwise(4)
    cells = [number, lap, sector, ticks / 10_000, *[F.coalesce(c, F.lit(0.0)) for c in (*first, *second)], factor]
    return F.array(*[c.cast("double") for c in cells])


#: Times that a slice is as wide as one of the level below, and slices of its level that a window covers, but for its ends.
FINER, COVERED = 16, 4


def in_window(events: DataFrame, fixes: DataFrame, width_us: int = 600_000_000) -> DataFrame:
    """Pairs of an event (device_id, ord, ts, time_ticks) and the fixes of its device in (ts - time, ts].

    Both sides meet by device and by a slice of time, so that a long-lived device is the work of many tasks and an event meets
    the fixes of its window's slices alone. Slices are width_us wide, or FINER times as wide for each further level: an event
    is filed at the first level where its window is COVERED slices at most, whatever its length, and the fixes at each level
    that events use. No job runs before the one that takes the pairs.
    """
    end = F.unix_micros("ts")
    e = events.filter("time_ticks > 0 and ts is not null").withColumn("__end", end).withColumn("__begin", end - F.col("time_ticks") / 10)
    length = F.col("time_ticks") / 10
    level = F.greatest(F.lit(0), F.ceil(F.log(length / (width_us * COVERED)) / math.log(FINER)).cast("int"))
    wide = F.pow(F.lit(float(FINER)), F.col("__level")) * width_us
    slice_of = lambda us: F.floor(us / wide)
    e = e.withColumn("__level", level)
    used = F.broadcast(e.select("__level").distinct())
    e = e.withColumn("__slice", F.explode(F.sequence(slice_of(F.col("__begin")), slice_of(F.col("__end")))))
    f = fixes.withColumn("__us", F.unix_micros("ts")).drop("ts")
    f = f.crossJoin(used).withColumn("__slice", slice_of(F.col("__us")))
    hits = e.join(f, ["device_id", "__level", "__slice"]).filter("__us > __begin and __us <= __end")
    return hits.drop("__level", "__slice", "__begin", "__end")


def channel_ranges(events: DataFrame, fixes: DataFrame, channel: str = "data") -> DataFrame:
    """Per event and place in the channel vector, the least and greatest value of the fixes of its window; nulls do not count."""
    hits = in_window(events.select("device_id", "ord", "ts", "time_ticks"), fixes.select("device_id", "ts", channel))
    cells = hits.select("device_id", "ord", F.posexplode(channel).alias("channel", "value"))
    return cells.groupBy("device_id", "ord", "channel").agg(F.min("value").alias("data_min"), F.max("value").alias("data_max"))
