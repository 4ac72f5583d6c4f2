"""The live board: messages applied to events and devices, flags of personal and overall bests, and lookups.

Events (session_id, device_id, device_ord, ord, ts, type, sector, lap, time_ticks, deleted) come in order of ord. The
board is recomputed from its events, so that late events and deletions need no state of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before

DEVICE = ["session_id", "device_id"]
#: Arrivals, and time, that one task orders for a running best.
ARRIVALS, BUCKET_US = 1 << 20, 86_400_000_000


def _bucket(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / BUCKET_US)


def apply(messages: DataFrame) -> DataFrame:
    """messages (session_id, device_id, arrival, id, ts, type, lap, sector, time_ticks, deleted_at) -> the events that they
    leave: their columns, ord, removed_at and deleted.

    The first message with an id is an event, even if it asks for deletion; later ones with deleted_at mark that first
    event, once, and others are events of their own. Laps stay laps, all else becomes a sector.
    """
    w = Window.partitionBy(*DEVICE, "id")
    asks = F.col("deleted_at").isNotNull()
    nth = messages.withColumn("nth", F.row_number().over(w.orderBy("arrival")))
    removed = F.min(F.when((F.col("nth") > 1) & asks, F.struct("arrival", "deleted_at"))).over(w)["deleted_at"]
    out = nth.withColumn("removed_at", F.when(F.col("nth") == 1, removed)).filter((F.col("nth") == 1) | ~asks)
    kind = F.when(F.col("type") == "Lap", "Lap").otherwise("Sector")
    return out.withColumn("type", kind).withColumn("ord", F.col("arrival")).withColumn("deleted", F.col("removed_at").isNotNull()).drop("nth", "deleted_at")


def devices(messages: DataFrame) -> DataFrame:
    """A row for each device: its first arrival as device_ord, and the last display name and category that are not blank; those
    of its first message count even if blank."""
    given = lambda c: F.max(F.when(F.trim(c) != "", F.struct("arrival", c)))[c]
    first = lambda c: F.min(F.struct("arrival", c))[c]
    return messages.groupBy(*DEVICE).agg(
        F.min("arrival").alias("device_ord"),
        F.coalesce(given("display_name"), first("display_name")).alias("display_name"),
        F.coalesce(given("category"), first("category")).alias("category"),
    )


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of `changes` in place of the ones with the same keys, nulls included."""
    return rows.join(changes, keys, "left_anti").unionByName(changes)


def without_devices(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The events of devices that are not in `gone` (session_id, device_id)."""
    return e.join(gone, DEVICE, "left_anti")


def snapshot(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, devices array<struct<device_id, events array<struct>>>) -> events with device_ord and ord by place."""
    d = sessions.select("session_id", F.posexplode("devices").alias("device_ord", "d"))
    return d.select("session_id", "d.device_id", "device_ord", F.posexplode("d.events").alias("ord", "x")).select("session_id", "device_id", "device_ord", "ord", "x.*")


def active(e: DataFrame) -> DataFrame:
    return e.filter("not deleted and time_ticks <> 0 and type in ('Lap', 'Sector')")


def best_flags(e: DataFrame) -> DataFrame:
    """was_personal_best and was_overall_best at the time of each live event; ties take over and are flagged."""
    order, bucket, value = ["ts", "device_ord", "ord"], _bucket("ts"), F.col("time_ticks")
    own = before(active(e), [*DEVICE, "type", "sector"], order, bucket, value, F.min, "own")
    both = before(own, ["session_id", "type", "sector"], order, bucket, value, F.min, "overall")
    flag = lambda c: F.coalesce(F.col(c) >= value, F.lit(True))
    return both.select(
        "session_id", "device_id", "ord", "type", "sector", "time_ticks", flag("own").alias("was_personal_best"), flag("overall").alias("was_overall_best")
    )


def bests(e: DataFrame, keys: list[str]) -> DataFrame:
    """The best event of each type and sector; of ties the last in time."""
    place = F.struct("time_ticks", (-F.unix_micros("ts")).alias("late"), (-F.col("device_ord")).alias("d"), (-F.col("ord")).alias("o"))
    one = active(e).groupBy(*keys, "type", "sector").agg(F.min(place).alias("s"))
    return one.select(*keys, "type", "sector", "s.time_ticks", (-F.col("s.o")).alias("ord"))


def best_of(e: DataFrame, session, kind: str = "Lap", sector: int = 0) -> DataFrame:
    """The best lap, or best sector, of a session; no row if there is none."""
    found = bests(e.filter(F.col("session_id") == session), ["session_id"]).filter(F.col("type") == kind)
    return found if kind == "Lap" else found.filter(F.col("sector") == sector)


def current_flags(e: DataFrame) -> DataFrame:
    """is_personal_best and is_best_overall of each event against the bests there are now.

    Zero times are neither; without a best of its kind an event is the overall best (and null as to the personal one).
    """
    kinds = e.filter("type in ('Lap', 'Sector')").withColumn("slot", F.when(F.col("type") == "Lap", 0).otherwise(F.col("sector")))
    best = lambda keys, name: active(e).groupBy(*keys, "type", F.when(F.col("type") == "Lap", 0).otherwise(F.col("sector")).alias("slot")).agg(F.min("time_ticks").alias(name))
    out = kinds.join(best(DEVICE, "own"), [*DEVICE, "type", "slot"], "left").join(best(["session_id"], "overall"), ["session_id", "type", "slot"], "left")
    flag = lambda c: F.when(F.col("time_ticks") == 0, F.lit(False)).otherwise(c)
    return out.select(
        "session_id", "device_id", "ord", flag(F.col("time_ticks") <= F.col("own")).alias("is_personal_best"),
        flag(F.coalesce(F.col("time_ticks") <= F.col("overall"), F.lit(True))).alias("is_best_overall"),
    )


def latest(e: DataFrame) -> DataFrame:
    """The last event and the last lap of each device by time; of ties the first to arrive."""
    place = F.struct(F.unix_micros("ts").alias("us"), (-F.col("ord")).alias("o"))
    one = e.groupBy(*DEVICE).agg(F.max(place).alias("s"), F.max(F.when(F.col("type") == "Lap", place)).alias("l"))
    return one.select(*DEVICE, (-F.col("s.o")).alias("last_event_ord"), (-F.col("l.o")).alias("last_lap_ord"))


def late_events(e: DataFrame) -> DataFrame:
    """Events older than one that arrived before in their session."""
    marked = before(e, ["session_id"], ["ord"], F.floor(F.col("ord") / ARRIVALS), F.unix_micros("ts"), F.max, "latest")
    return marked.filter(F.unix_micros("ts") < F.col("latest")).select("session_id", "device_id", "ord")


def rebuilds(messages: DataFrame) -> DataFrame:
    """(session_id, arrival, reason) of the messages after which the board is built anew: the session's first, late events, and
    the first deletion of an event."""
    kept = apply(messages)
    late = late_events(kept).select("session_id", F.col("ord").alias("arrival"), F.lit("late").alias("reason"))
    w = Window.partitionBy(*DEVICE, "id")
    nth = messages.withColumn("nth", F.row_number().over(w.orderBy("arrival")))
    gone = nth.filter("nth > 1 and deleted_at is not null").groupBy(*DEVICE, "id").agg(F.min("arrival").alias("arrival"))
    gone = gone.select("session_id", "arrival", F.lit("deleted").alias("reason"))
    first = messages.groupBy("session_id").agg(F.min("arrival").alias("arrival")).select("session_id", "arrival", F.lit("first").alias("reason"))
    return first.unionByName(late).unionByName(gone)


def colours(e: DataFrame) -> DataFrame:
    """Purple for what still is the session's best, Green if it was the device's, else Goldenrod; a missing event is Black."""
    flags = best_flags(e).join(current_flags(e).select("session_id", "ord", "is_best_overall"), ["session_id", "ord"])
    colour = F.when(F.col("is_best_overall"), "Purple").when(F.col("was_personal_best"), "Green").otherwise("Goldenrod")
    return flags.select("session_id", "ord", colour.alias("colour"))


def tail(e: DataFrame, n: int = 5) -> DataFrame:
    """The last n events of each session to arrive."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ord"))
    return e.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def strict_bests(e: DataFrame) -> DataFrame:
    """Events of positive time that improve on all of their type and sector that arrived before in their session; ties do not."""
    timed = e.filter("time_ticks > 0 and type in ('Lap', 'Sector')")
    out = before(timed, ["session_id", "type", "sector"], ["ord"], F.floor(F.col("ord") / ARRIVALS), F.col("time_ticks"), F.min, "best")
    return out.filter("best is null or time_ticks < best").select("session_id", "ord", "type", "sector", "time_ticks")


def replay_plan(e: DataFrame, gap_us: int = 5_000_000) -> DataFrame:
    """(session_id, device_id, ord, due_us): when to send each event after the start of a replay of its session, each device
    gap_us after the one before it in order of their ids."""
    start = e.groupBy("session_id").agg(F.min(F.unix_micros("ts")).alias("start"))
    places = e.select(*DEVICE).distinct().withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("device_id")) - 1)
    due = F.unix_micros("ts") - F.col("start") + F.col("place").cast("long") * gap_us
    return e.join(start, "session_id").join(places, DEVICE).select(*DEVICE, "ord", due.alias("due_us"))
