"""Events on their way to a hub: in order for each device, at least once, under ids that let the hub drop repeats."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt

Send = Callable[[str, list[dict]], None]


def wire(events: DataFrame) -> DataFrame:
    """Timing events (session_id, device_id, ord, ts, type, lap, sector, time_ticks) as the hub takes them: laps stay laps, all else
    becomes a sector, and each has an id that follows from its session, device and place."""
    ident = F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.col("device_id").cast("string"), F.col("ord").cast("string")), 256)
    return events.select(
        F.substring(ident, 1, 32).alias("id"), "session_id", "device_id", "ord", F.unix_millis("ts").alias("ms"), fmt.wire_type(F.col("type")).alias("type"), "lap", "sector", "time_ticks"
    )


def deliver(stream: DataFrame, send: Send, checkpoint: str, attempts: int | None = None, pause_s: float = 1.0) -> None:
    """Sends a stream of wire() rows until its input ends: send(device, rows in order), again every pause_s until it succeeds
    (or, with `attempts`, raises after so many). Started again it goes on from the checkpoint; a trigger that was cut
    short is sent once more. Each device's rows are sent by one executor task.
    """

    def partition(rows) -> None:
        now, held = None, []
        for r in rows:
            if now is not None and r["device_id"] != now:
                _send(send, str(now), held, attempts, pause_s)
                held = []
            now = r["device_id"]
            held.append(r.asDict())
        if held:
            _send(send, str(now), held, attempts, pause_s)

    def step(batch: DataFrame, _: int) -> None:
        placed = batch.repartition("device_id").sortWithinPartitions("device_id", "ord")
        placed.foreachPartition(partition)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _send(send: Send, device: str, rows: list[dict], attempts: int | None, pause_s: float) -> None:
    tried = 0
    while True:
        try:
            return send(device, rows)
        except OSError:
            tried += 1
            if attempts is not None and tried >= attempts:
                raise
            time.sleep(pause_s)


def backoff(tried: int, most: float = 10.0) -> float:
    """Seconds before the next attempt to connect: one more each time."""
    return min(most, float(tried))


def reconnects(n: int = 5) -> list[float]:
    """Seconds before each attempt to come back after a connection was lost."""
    return [float(2**i) for i in range(1, n + 1)]
