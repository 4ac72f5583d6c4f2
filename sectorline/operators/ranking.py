"""The ranking of a session, its display and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt
from .board import DEVICE

#: Sectors of a table that neither is told their number nor has any best sector.
SECTORS = 3


def ranking(e: DataFrame, kind: str = "qualifying") -> DataFrame:
    """A row for each device of a session by best valid lap, none last; gap to the first, interval to the one before.

    kind (qualifying, practice, race) makes no difference.
    """
    lap = (F.col("type") == "Lap") & ~F.col("deleted") & (F.col("time_ticks") > 0)
    rows = e.groupBy(*DEVICE).agg(
        F.min("device_ord").alias("device_ord"),
        F.min(F.when(lap, F.col("time_ticks"))).alias("best_ticks"),
        F.count(F.when(lap, 1)).alias("n_laps"),
    )
    w = Window.partitionBy("session_id").orderBy(F.col("best_ticks").asc_nulls_last(), "device_ord")
    return rows.select(
        *DEVICE,
        "best_ticks",
        "n_laps",
        F.row_number().over(w).alias("rank"),
        (F.col("best_ticks") - F.min("best_ticks").over(Window.partitionBy("session_id"))).alias("gap_ticks"),
        (F.col("best_ticks") - F.lag("best_ticks").over(w)).alias("interval_ticks"),
    )


def rank_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """ranking() rows with the change against an earlier ranking; 0 for devices it did not have."""
    old = before.select(*DEVICE, F.col("rank").alias("previous_rank"))
    joined = now.join(old, DEVICE, "left")
    previous = F.coalesce("previous_rank", "rank")
    return joined.select(
        *DEVICE, "rank", previous.alias("previous_rank"), (previous - F.col("rank")).alias("change"), (previous != F.col("rank")).alias("has_changed")
    )


def last_laps(e: DataFrame) -> DataFrame:
    """Per device: last_lap and last_ticks of the latest lap (zero times too; null without one), and completed: the number of
    the latest lap with a positive time, else 0."""
    lap = (F.col("type") == "Lap") & ~F.col("deleted")
    place = F.struct(F.unix_micros("ts").alias("us"), (-F.col("ord")).alias("o"), "lap", "time_ticks")
    one = e.groupBy(*DEVICE).agg(F.max(F.when(lap, place)).alias("s"), F.max(F.when(lap & (F.col("time_ticks") > 0), place)).alias("c"))
    return one.select(
        *DEVICE, F.col("s.lap").alias("last_lap"), F.col("s.time_ticks").alias("last_ticks"), F.coalesce("c.lap", F.lit(0)).alias("completed")
    )


def lap_sectors(e: DataFrame) -> DataFrame:
    """The sectors of positive time of each lap that is not deleted: the latest event of a sector counts."""
    timed = e.filter("type = 'Sector' and not deleted and time_ticks > 0")
    one = timed.groupBy(*DEVICE, "lap", "sector").agg(F.max(F.struct("ts", "ord", "time_ticks")).alias("s"))
    return one.select(*DEVICE, "lap", "sector", "s.ord", "s.time_ticks")


def sector_count(e: DataFrame, sectors: int | None = None) -> DataFrame:
    """(session_id, sectors): as told, else the highest sector with a best, else SECTORS."""
    sessions = e.groupBy("session_id").agg(F.max(F.when(~F.col("deleted") & (F.col("time_ticks") != 0) & (F.col("type") == "Sector"), F.col("sector"))).alias("most"))
    return sessions.select("session_id", F.coalesce(F.lit(sectors), "most", F.lit(SECTORS)).cast("int").alias("sectors"))


def shown_sectors(e: DataFrame, sectors: int | None = None) -> DataFrame:
    """(session_id, device_id, sector, shown_ord, shown_ticks): a row for each sector of the table.

    Once a sector of the current lap is passed, only those of the current lap are shown, else all of the last completed one;
    what is not shown is null.
    """
    at = last_laps(e).select(*DEVICE, "completed")
    near = lap_sectors(e).join(at, DEVICE).withColumn("current", F.col("lap") == F.col("completed") + 1)
    near = near.filter("current or (lap = completed and completed > 0)")
    has = near.groupBy(*DEVICE).agg(F.max("current").alias("has_current"))
    shown = near.join(has, DEVICE).filter("current = has_current").select(*DEVICE, "sector", F.col("ord").alias("shown_ord"), F.col("time_ticks").alias("shown_ticks"))
    every = at.join(sector_count(e, sectors), "session_id").select(*DEVICE, F.explode(F.expr("sequence(1, greatest(sectors, 1))")).alias("sector"), "sectors")
    return every.filter("sectors >= 1").drop("sectors").join(shown, [*DEVICE, "sector"], "left")


def table(e: DataFrame, devices: DataFrame, sectors: int | None = None) -> DataFrame:
    """The ranking as shown: names, texts of laps, and the sectors as an array of texts in order.

    devices (session_id, device_id, device_ord, display_name, deleted); deleted ones are left out.
    """
    there = devices.filter("not deleted").select(*DEVICE, "display_name")
    live = active_devices(e, devices)
    cells = shown_sectors(live, sectors).groupBy(*DEVICE).agg(F.array_sort(F.collect_list(F.struct("sector", fmt.cell_text(F.col("shown_ticks")).alias("text")))).alias("cells"))
    rows = ranking(live).join(last_laps(live), DEVICE).join(cells, DEVICE).join(there, DEVICE)
    return rows.select(
        *DEVICE, "rank", fmt.display_name(F.col("display_name"), F.col("device_id")).alias("name"), fmt.short_id(F.col("device_id")).alias("short_id"),
        F.coalesce(F.col("last_lap").cast("string"), F.lit("")).alias("laps"), fmt.cell_text(F.col("last_ticks")).alias("last_lap"),
        fmt.cell_text(F.col("best_ticks")).alias("best_lap"), F.col("cells.text").alias("sectors"),
    )


def active_devices(e: DataFrame, devices: DataFrame) -> DataFrame:
    return e.join(devices.filter("not deleted").select(*DEVICE), DEVICE, "left_semi")


def changed_rows(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of table() that differ from the table before in name, laps or sectors; ranks and gaps do not count."""
    seen = [c for c in now.columns if c not in ("rank", "short_id")]
    same = [now[c].eqNullSafe(before[c]) for c in seen]
    return now.join(before, [*same], "left_anti")

