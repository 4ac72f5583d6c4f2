"""The board over a stream of messages: each trigger's messages join the log, and the sessions they touch are ranked anew.

Late events and deletions change what stands before them, so that a session is recomputed from its log with the batch
operators; there is no watermark and nothing is dropped. Every step may be repeated: messages are written under the
number of their trigger, and a session's ranking under that of the trigger that made it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import board, ranking

MESSAGES = (
    "session_id long, device_id long, arrival long, id long, ts timestamp, type string, lap long, sector long, time_ticks long, deleted_at timestamp, display_name string, category string"
)


def messages(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` of them at a time."""
    reader = spark.readStream.schema(MESSAGES)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def envelopes(stream: DataFrame) -> DataFrame:
    """Messages of devices' envelopes: session_id, device_id, display_name, category, events (array of the event columns of MESSAGES)."""
    return stream.select("session_id", "device_id", "display_name", "category", F.explode("events").alias("e")).select("session_id", "device_id", "display_name", "category", "e.*")


def rank(log: DataFrame) -> DataFrame:
    """The ranking of the sessions of a log of messages; devices are in order of their first arrival."""
    places = board.devices(log).select(*board.DEVICE, "device_ord")
    return ranking.ranking(board.apply(log).join(places, board.DEVICE))


def _step(path: str, told: Callable[[DataFrame, int], None] | None) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/trigger={number}")
        log = spark.read.schema(f"{MESSAGES}, trigger int").option("basePath", f"{path}/log").parquet(f"{path}/log").filter(F.col("trigger") <= number)
        touched = log.filter(F.col("trigger") == number).select("session_id").distinct()
        now = rank(log.join(touched, "session_id", "left_semi"))
        now.write.mode("overwrite").parquet(f"{path}/ranking/trigger={number}")
        if told is not None:
            told(spark.read.parquet(f"{path}/ranking/trigger={number}"), number)

    return run


def run(stream: DataFrame, path: str, checkpoint: str, told: Callable[[DataFrame, int], None] | None = None) -> None:
    """Ranks a stream of messages until its input ends; started again it goes on from the checkpoint. told(rows, trigger) gets
    each trigger's rankings and may get them again."""
    query = stream.writeStream.foreachBatch(_step(path, told)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The ranking of each session as its last trigger left it."""
    rows = spark.read.option("basePath", f"{path}/ranking").parquet(f"{path}/ranking")
    last = rows.groupBy("session_id").agg(F.max("trigger").alias("trigger"))
    return rows.join(last, ["session_id", "trigger"], "left_semi").drop("trigger")
