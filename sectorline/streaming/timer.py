"""The timer over a stream of fixes: state per device, events as they happen."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crossings import EVENT, Dense, TimerConfig

FIXES = "device_id long, arrival_ord long, ts timestamp, lat double, lon double"


def fixes(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, `files` of them at a time."""
    reader = spark.readStream.schema(FIXES)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def meet(gate: tuple[float, ...], line: tuple[float, ...], toward: bool) -> tuple[float, float] | None:
    """The point where a way crosses a gate, as functions.geo.intersection has it."""
    (a1, o1, a2, o2), (a3, o3, a4, o4) = gate, line
    dx, dy, ex, ey = a2 - a1, o2 - o1, a4 - a3, o4 - o3
    den = dy * ex - dx * ey
    if den == 0 or (toward and den < 0):
        return None
    t, u = ((a1 - a3) * ey + (o3 - o1) * ex) / den, ((a3 - a1) * dy + (o1 - o3) * dx) / -den
    return (a1 + (a2 - a1) * t, o1 + (o2 - o1) * t) if 0 <= t <= 1 and 0 <= u <= 1 else None


def _arc(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    return math.acos(max(-1.0, min(1.0, math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(lon1 - lon2)))))


def share(line: tuple[float, ...], point: tuple[float, float], interpolation: str) -> float:
    """How far along its way a crossing is stamped, as functions.geo has the two factors."""
    a1, o1, a2, o2 = line
    if interpolation == "center":
        d1, d2 = _arc(a1, o1, *point), _arc(a2, o2, *point)
        return 0.0 if d1 + d2 <= 0 else max(0.0, min(1.0, 1 - abs(d1 - d2) / (d1 + d2)))
    dx, dy = a2 - a1, o2 - o1
    square = dx * dx + dy * dy
    return max(0.0, min(1.0, ((point[0] - a1) * dx + (point[1] - o1) * dy) / square)) if square else 0.0


def events(stream: DataFrame, gates: list[tuple], config: TimerConfig, toward: bool = True, interpolation: str = "center", sector_timeout: int = 0) -> DataFrame:
    """A stream of fixes (FIXES) -> a stream of timing events. gates: (number, lat1, lon1, lat2, lon2), in order, of one circuit.

    Fixes of a device count in the order in which they arrive, within a trigger by arrival_ord; their times may be in
    any order, and there is no watermark: nothing is dropped. The state of a device is its last fix and its running
    session. Sessions end as the batch timer ends them, when a fix comes after the idle time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        timer, last = pickle.loads(state.get[0]) if state.exists else (Dense(config), None)
        rows = pd.concat(list(batches)).sort_values("arrival_ord", kind="stable")
        micros = rows["ts"].astype("datetime64[us, UTC]" if rows["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
        out = []
        for us, lat, lon in zip(micros.tolist(), rows["lat"].tolist(), rows["lon"].tolist(), strict=True):
            hits = []
            if last is not None:
                line = (last[1], last[2], lat, lon)
                for number, *gate in gates:
                    point = meet(tuple(gate), line, toward)
                    if point is not None:
                        at = last[0] + math.floor((us - last[0]) * share(line, point, interpolation))
                        hits.append((at, len(gates) if number == 1 else number - 1, len(gates)))
            out += [(key[0], *e) for e in timer.feed(us, hits, len(gates), sector_timeout)]
            last = (us, lat, lon)
        state.update((pickle.dumps((timer, last)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])

    return stream.groupBy("device_id").applyInPandasWithState(run, EVENT, "state binary", "append", GroupStateTimeout.NoTimeout)


def run(found: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream of events to `path` until its input ends; started again it goes on from the checkpoint."""
    query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
