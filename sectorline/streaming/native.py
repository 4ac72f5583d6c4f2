"""The native format written line by line, as events and fixes come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..sources.native import DEFAULT


def lines(events: DataFrame, data: DataFrame, channels: tuple[str, ...] = DEFAULT) -> DataFrame:
    """A stream of events (ts, type, lap, sector, time_ticks) and one of data (ts, data) as one stream of lines."""
    e = events.select(fmt.event_line(F.col("ts"), F.col("type"), F.col("lap"), F.col("sector"), F.col("time_ticks")).alias("value"))
    return e.unionByName(data.select(fmt.data_line(F.col("ts"), F.col("data"), len(channels)).alias("value")))


def run(rows: DataFrame, path: str, checkpoint: str, channels: tuple[str, ...] = DEFAULT) -> None:
    """Writes lines() to the folder `path` until the input ends, each trigger's lines in files of their own below the headers,
    which every file has: a reader may start with any of them. Repeated triggers replace their files."""
    head = ["#Format=Native Delimited Data", "#Version=1", "#Fields=" + ",".join(channels)]

    def step(batch: DataFrame, number: int) -> None:
        top = batch.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1)
        body = batch.coalesce(1)
        top.unionByName(body).coalesce(1).write.mode("overwrite").text(f"{path}/trigger={number}")

    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
