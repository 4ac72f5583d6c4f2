"""Device sessions: who drove what, and the control of a running timer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from .crossings import Dense, TimerConfig

KINDS = ("Lap", "Sector")


def route(events: DataFrame) -> DataFrame:
    """The events that count for a session: laps and sectors. Raises on a blank device id when it is run."""
    device = F.when(F.trim(F.coalesce(F.col("device_id").cast("string"), F.lit(""))) == "", F.raise_error(F.lit("a device id is blank"))).otherwise(F.col("device_id"))
    return events.filter(F.col("type").isin(*KINDS)).withColumn("device_id", device)


def device_sessions(events: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """A row for each device of a session that has events, made at its first one: session_id, device_id, driver_id, driver_name,
    driver_number, circuit_code. drivers: (device_id, driver), others drive under their device's id."""
    first = F.min(F.struct("ord", "circuit_code"))["circuit_code"]
    rows = route(events).groupBy("session_id", "device_id").agg(first.alias("circuit_code"))
    named = rows.join(drivers, "device_id", "left") if drivers is not None else rows.withColumn("driver", F.lit(None).cast("string"))
    who = fmt.identity(F.col("driver"), F.col("device_id").cast("string"))
    return named.select("session_id", "device_id", *[c.alias(n) for n, c in who.items()], "circuit_code")


class Control(Dense):
    """A timer that is told about circuits, pauses and sessions between its fixes."""

    def __init__(self, config: TimerConfig):
        super().__init__(config)
        self.circuit: str | None = None
        self.paused = not config.auto_start

    def set_circuit(self, code: str | None) -> None:
        """Ends the session and what is known of the way."""
        self.close()
        self.circuit = code

    def create(self) -> None:
        """Begins a session, and detection; ValueError without a circuit."""
        if self.circuit is None:
            raise ValueError("a circuit has to be set before a session begins")
        self._begin()
        self.paused = False

    def close(self) -> None:
        self.session, self.previous = None, False

    def pause(self) -> None:
        self.paused = True

    def start(self) -> None:
        self.paused = False

    def feed(self, ts: int, hits: list[tuple[int, int, int]], n: int, timeout: int = 0) -> list[tuple]:
        """As Dense.feed; without a circuit, and while paused, fixes do not count and are not kept."""
        return [] if self.circuit is None or self.paused else super().feed(ts, hits, n, timeout)
