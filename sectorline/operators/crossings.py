"""From fixes to timing events: trajectories, gate crossings, and the fold that applies cooldown and idle time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import circuits

#: Gates that are broadcast, at most; Spark chooses how to join more.
MOST_GATES = 10_000


@dataclass(frozen=True)
class TimerConfig:
    """cooldown_us: least time between events, unless the circuit has a sector timeout; idle_us: time without events that
    ends a session; retention: fixes kept (the last two are used); device_id: a new random one if blank."""

    cooldown_us: int = 5_000_000
    idle_us: int = 900_000_000
    closed: bool = True
    retention: int = 5
    track_position: bool = False
    auto_start: bool = False
    device_id: str = ""
    user_id: str | None = None

    def __post_init__(self) -> None:
        if self.cooldown_us < 0 or self.idle_us <= 0:
            raise ValueError("cooldown has to be 0 or more and the idle time positive")
        if self.retention < 2:
            raise ValueError("two fixes have to be kept at least")
        if not self.device_id.strip():
            object.__setattr__(self, "device_id", str(uuid.uuid4()))

    @classmethod
    def of(cls, cooldown: float = 5.0, idle: float = 900.0, **more) -> TimerConfig:
        """Times in seconds; a cooldown counts in whole seconds."""
        return cls(int(cooldown) * 1_000_000, round(idle * 1e6), **more)

    def blocked_us(self, sector_timeout: int | None) -> int:
        return sector_timeout * 1_000_000 if sector_timeout and sector_timeout > 0 else self.cooldown_us


def stamped(events: DataFrame, config: TimerConfig) -> DataFrame:
    """Events with the configured device and user where they name none."""
    own = F.coalesce(F.when(F.trim(F.col("device").cast("string")) != "", F.col("device").cast("string")), F.lit(config.device_id))
    return events.withColumn("device", own).withColumn("user_id", F.lit(config.user_id).cast("string"))


def trajectories(fixes: DataFrame) -> DataFrame:
    """Each fix with its predecessor of the same device (null for the first) and the time of the one before that."""
    w = Window.partitionBy("device_id").orderBy("arrival_ord")
    ts = F.unix_micros("ts")
    return fixes.select(
        "device_id", "arrival_ord", "ts", "lat", "lon", *[c for c in fixes.columns if c == "circuit_code"],
        F.row_number().over(w).alias("idx"), F.lag("lat").over(w).alias("prev_lat"), F.lag("lon").over(w).alias("prev_lon"),
        ts.alias("ts_us"), F.lag(ts).over(w).alias("prev_us"), F.lag(ts, 2).over(w).alias("prev2_us"),
    )


def _circuits(gates: DataFrame) -> DataFrame:
    """gates with circuit_code, use_direction and sector_timeout, which they may lack, and n_gates of their circuit."""
    have = gates.columns
    for name, value in (("circuit_code", F.lit("")), ("use_direction", F.lit(None).cast("boolean")), ("sector_timeout", F.lit(0))):
        gates = gates if name in have else gates.withColumn(name, value)
    return gates.join(gates.groupBy("circuit_code").agg(F.count(F.lit(1)).cast("int").alias("n_gates")), "circuit_code")


def candidates(fixes: DataFrame, gates: DataFrame, direction: str = "toward", interpolation: str = "center", named: bool = False) -> DataFrame:
    """A row for each trajectory that meets a gate, with the sector it ends and the time it is stamped with.

    With a circuit_code, fixes meet the gates of their circuit. use_direction of a gate tells whether it counts toward
    the apex only; `direction` holds where that is null. Trajectories are taken within a device. With `named`, fixes meet the
    gates of all circuits, and rows have their circuit_code.
    """
    path = trajectories(fixes).filter(F.col("prev_lat").isNotNull())
    table = _circuits(gates)
    small = table.limit(MOST_GATES + 1).count() <= MOST_GATES
    own = "circuit_code" in fixes.columns
    gate = tuple(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
    line = tuple(F.col(c) for c in ("prev_lat", "prev_lon", "lat", "lon"))
    ways = {d: geo.intersection(gate, line, d) for d in {direction, "toward", "any"}}
    point = F.when(F.col("use_direction").isNull(), ways[direction]).when(F.col("use_direction"), ways["toward"]).otherwise(ways["any"])
    right = (F.broadcast(table) if small else table).withColumnRenamed("circuit_code", "gate_circuit")
    meets = (F.col("circuit_code") == F.col("gate_circuit")) & point.isNotNull() if own else point.isNotNull()
    hit = path.join(right, meets).withColumn("point", point)
    factor = {"center": geo.center_factor, "projection": geo.projection_factor}[interpolation]
    at = factor(*line, F.col("point.lat"), F.col("point.lon"))
    return hit.select(
        "device_id", "arrival_ord", "idx", "ts_us", "prev_us", "prev2_us", "number", *([F.col("gate_circuit").alias("circuit_code")] if own or named else []),
        F.when(F.col("number") == 1, F.col("n_gates")).otherwise(F.col("number") - 1).cast("int").alias("sector"),
        F.col("n_gates").cast("int").alias("n_gates"), F.col("sector_timeout").cast("int").alias("sector_timeout"),
        (F.col("prev_us") + F.floor((F.col("ts_us") - F.col("prev_us")) * at)).cast("long").alias("cross_us"),
        F.round("point.lat", 9).alias("lat"), F.round("point.lon", 9).alias("lon"),
    )


class Session:
    """The events of one running session, as far as later ones depend on them."""

    def __init__(self, number: int, at: int | None = None):
        self.number, self.count, self.created = number, 0, at
        self.last: int | None = None
        self.lap: int | None = None
        self.lap_at: int | None = None
        self.start_at: int | None = None
        self.best_lap: int | None = None
        self.best: dict[int, int] = {}

    def _event(self, *fields) -> tuple:
        self.count += 1
        return (self.number, self.count - 1, *fields)

    def register(self, kind: str, sector: int, at: int, n: int, closed: bool) -> list[tuple]:
        """The event and the lap that it may complete: (session, ord, type, lap, sector, at, time, is_best)."""
        number = 0 if self.lap is None else self.lap + 1
        time = 0 if self.last is None else at - self.last
        best = time > 0 and (sector not in self.best or time <= self.best[sector])
        out = [self._event(kind, number, sector, at, time, best)]
        self.last = at
        if kind == "Sector" and time > 0:
            self.best[sector] = min(time, self.best.get(sector, time))
        if sector == n:
            self.start_at = at
        if sector == (n if closed else n - 1):
            since = self.lap_at if closed else (self.start_at if self.start_at is not None else at)
            taken = 0 if self.lap is None else at - since
            if taken:
                best = self.best_lap is None or self.best_lap >= taken
            out.append(self._event("Lap", number, 0, at, taken, best))
            if number > 0:
                self.best_lap = taken if self.best_lap is None else min(self.best_lap, taken)
            self.lap, self.lap_at = number, at
        return out


class Sparse:
    """The timer over the candidates of one device alone: fixes without a crossing need not be fed."""

    def __init__(self, config: TimerConfig):
        self.config, self.sessions = config, 0
        self.session: Session | None = None
        self.pending: int | None = None

    def feed(self, idx: int, ts: int, prev: int | None, prev2: int | None, hits: list[tuple[int, int, int]], timeout: int = 0) -> list[tuple]:
        """hits: (cross, sector, n_gates) of a fix, in order of the gates."""
        config, cool = self.config, self.config.blocked_us(timeout)
        if self.session is not None:
            last = self.session.last
            over = lambda t: t is not None and t > last + config.idle_us and t >= last + cool
            if self.pending is not None or over(prev):
                cleared = self.pending == idx - 1 if self.pending is not None else not over(prev2)
                self.session = self.pending = None
                if cleared:
                    return []
            elif last + cool > ts:
                return []
        if self.session is None:
            self.sessions += 1
            self.session = Session(self.sessions)
        out = [e for cross, sector, n in hits for e in self.session.register("Sector", sector, cross, n, config.closed)]
        if self.session.last + config.idle_us < ts:
            self.pending = idx
        return out


class Dense:
    """The timer fed with every fix of one device, in order of arrival, whatever their times."""

    def __init__(self, config: TimerConfig):
        self.config, self.sessions, self.previous = config, 0, False
        self.session: Session | None = None

    def feed(self, ts: int, hits: list[tuple[int, int, int]], n: int, timeout: int = 0) -> list[tuple]:
        """hits: (cross, sector, n_gates) of the way from the fix before."""
        config, had, out = self.config, self.previous, []
        self.previous = True
        if not had or (self.session is not None and self.session.last is not None and self.session.last + config.blocked_us(timeout) > ts):
            return out
        marks = [("Sector", s, at, k) for at, s, k in hits] + ([("Position", 0, ts, n)] if config.track_position else [])
        for kind, sector, at, k in marks:
            if self.session is None:
                self._begin()
            out += self.session.register(kind, sector, at, k, config.closed)
        if self.session is not None and self.session.last is not None and self.session.last + config.idle_us < ts:
            self.session, self.previous = None, False
        return out


    def _begin(self) -> None:
        self.sessions += 1
        self.session = Session(self.sessions)


class Automatic:
    """Sessions that follow the circuit a device is on: looked up every check_us, the first gate of a way only, no best flags."""

    def __init__(self, config: TimerConfig, check_us: int = 2_000_000):
        self.config, self.check_us, self.sessions = config, check_us, 0
        self.session: Session | None = None
        self.circuit: str | None = None
        self.checked: int | None = None
        self.previous: int | None = None

    def feed(self, ts: int, found: str | None, hits: dict[str, list[tuple[int, int, int]]], n: dict[str, int]) -> list[tuple]:
        """found: the circuit at the fix; hits by circuit: (cross, sector, n_gates), in order of the gates."""
        before, self.previous = self.previous, ts
        if self.circuit is None or self.checked + self.check_us <= ts:
            self.checked = ts
            if found is not None and found != self.circuit:
                self.circuit = found
                self._open(ts)
        if self.circuit is None:
            return []
        out, config, session = [], self.config, self.session
        free = session is None or session.last is None or session.last + config.cooldown_us <= ts
        if before is not None and free:
            mine = hits.get(self.circuit, [])
            if mine:
                at, sector, k = mine[0]
                if self.session is None:
                    self._open(at)
                out = self.session.register("Sector", sector, at, k, config.closed)
            elif config.track_position and session is not None and (session.seen is None or session.seen + 1_000_000 < ts):
                out = session.register("Position", 0, ts, n.get(self.circuit, 0), config.closed)
        if self.session is not None:
            self.session.seen = ts
            since = self.session.last if self.session.last is not None else self.session.created
            if since + config.idle_us < ts:
                self.session = None
        return [(*e[:-1], None) for e in out]

    def _open(self, at: int) -> None:
        self.sessions += 1
        self.session = Session(self.sessions, at)
        self.session.seen = None


EVENT = "device_id long, session_no int, ord int, type string, lap int, sector int, event_us long, time_us long, is_best boolean"
_KINDS = pa.schema(
    [("device_id", pa.int64()), ("session_no", pa.int32()), ("ord", pa.int32()), ("type", pa.string()), ("lap", pa.int32()), ("sector", pa.int32()), ("event_us", pa.int64()), ("time_us", pa.int64()), ("is_best", pa.bool_())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KINDS)], schema=_KINDS)


def fold(rows: list[tuple], config: TimerConfig) -> list[tuple]:
    """Timing events of one device from its candidates (idx, ts, prev, prev2, cross, sector, n_gates), in order."""
    timer, out, i = Sparse(config), [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        out += timer.feed(*rows[i][:4], [r[4:7] for r in rows[i:j]])
        i = j
    return out


def timing(found: DataFrame, config: TimerConfig) -> DataFrame:
    """candidates() -> timing events. Candidates are sparse; those of a device stream through one fold, in order of arrival.

    Assumes that a device's times do not fall along its arrivals; `dense` does not.
    """
    names = ["device_id", "idx", "ts_us", "prev_us", "prev2_us", "cross_us", "sector", "n_gates", "sector_timeout"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, timer, held, hits = None, None, None, []
        for b in batches:
            out = []
            for d, idx, ts, prev, prev2, cross, sector, n, timeout in zip(*[b.column(c).to_pylist() for c in names], strict=True):
                if (d, idx) != (device, held and held[0]):
                    if held:
                        out += [(device, *e) for e in timer.feed(*held[:4], hits, held[4])]
                    if timer is None or d != device:
                        device, timer = d, Sparse(config)
                    held, hits = (idx, ts, prev, prev2, timeout), []
                hits.append((cross, sector, n))
            yield _batch(out)
        if held:
            yield _batch([(device, *e) for e in timer.feed(*held[:4], hits, held[4])])

    placed = found.select(*names, "number").repartition("device_id").sortWithinPartitions("device_id", "idx", "number")
    return placed.mapInArrow(run, EVENT)


def _ways(fixes: DataFrame, found: DataFrame) -> DataFrame:
    """Every fix in order, with the crossings of the way to it: (circuit_code, cross_us, sector, n_gates)."""
    code = F.col("circuit_code") if "circuit_code" in found.columns else F.lit("")
    hits = found.groupBy("device_id", "idx").agg(
        F.array_sort(F.collect_list(F.struct("number", code.alias("circuit"), "cross_us", "sector", "n_gates"))).alias("hits")
    )
    return trajectories(fixes).select("device_id", "idx", "ts_us", "lat", "lon").join(hits, ["device_id", "idx"], "left")


def dense(fixes: DataFrame, found: DataFrame, config: TimerConfig, n_gates: int, sector_timeout: int = 0) -> DataFrame:
    """As timing(), with every fix fed: for position events, and for arrivals out of order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, timer = None, None
        for b in batches:
            out = []
            for d, ts, hits in zip(*[b.column(c).to_pylist() for c in ("device_id", "ts_us", "hits")], strict=True):
                if timer is None or d != device:
                    device, timer = d, Dense(config)
                out += [(d, *e) for e in timer.feed(ts, [(h["cross_us"], h["sector"], h["n_gates"]) for h in hits or []], n_gates, sector_timeout)]
            yield _batch(out)

    placed = _ways(fixes, found).repartition("device_id").sortWithinPartitions("device_id", "idx")
    return placed.mapInArrow(run, EVENT)


def automatic(fixes: DataFrame, gates: DataFrame, circuits_: DataFrame, config: TimerConfig, interpolation: str = "center") -> DataFrame:
    """Events of sessions that start and end as devices come to circuits: gates with their circuit_code, circuits as for detect()."""
    sizes = {r["circuit_code"]: r["n"] for r in gates.groupBy("circuit_code").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = candidates(fixes.drop("circuit_code"), gates, interpolation=interpolation, named=True)
    here = circuits.detect(fixes.drop("circuit_code"), circuits_).select("device_id", "arrival_ord", F.col("circuit_code").alias("here"))
    w = Window.partitionBy("device_id").orderBy("arrival_ord")
    here = here.withColumn("idx", F.row_number().over(w)).drop("arrival_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, timer = None, None
        for b in batches:
            out = []
            for d, ts, hits, at in zip(*[b.column(c).to_pylist() for c in ("device_id", "ts_us", "hits", "here")], strict=True):
                if timer is None or d != device:
                    device, timer = d, Automatic(config)
                by: dict[str, list] = {}
                for h in hits or []:
                    by.setdefault(h["circuit"], []).append((h["cross_us"], h["sector"], h["n_gates"]))
                out += [(d, *e) for e in timer.feed(ts, at, by, sizes)]
            yield _batch(out)

    placed = _ways(fixes, every).join(here, ["device_id", "idx"]).repartition("device_id").sortWithinPartitions("device_id", "idx")
    return placed.mapInArrow(run, EVENT)


def retained(fixes: DataFrame, events: DataFrame, dedupe: bool = False) -> DataFrame:
    """The fixes that a session keeps: (device_id, session_no, arrival_ord) of those from a session's first event to its last, and
    each once more for every crossing of its way, unless `dedupe`. events need session_no, event_us and arrival_ord."""
    spans = events.groupBy("device_id", "session_no").agg(F.min("arrival_ord").alias("first"), F.max("arrival_ord").alias("last"))
    kept = fixes.select("device_id", "arrival_ord").join(spans, "device_id").filter("arrival_ord > first and arrival_ord <= last").select("device_id", "session_no", "arrival_ord")
    crossed = events.filter("type = 'Sector'").select("device_id", "session_no", "arrival_ord")
    both = kept.unionByName(crossed)
    return both.distinct() if dedupe else both
