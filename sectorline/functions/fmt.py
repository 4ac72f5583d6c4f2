"""Text forms of times (ticks of 100 ns) and events."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_time(ticks: Column, default: str = "-", sign: bool = False) -> Column:
    """m:ss.fff from a minute, ss.fff from ten seconds, else s.fff; cut to ms, hours and minutes of negatives lost.

    With sign, values above and below zero get + and -; zero gets none.
    """
    ms = F.floor(F.abs(ticks) / 10_000)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    minutes, seconds = F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    tail = F.concat(F.lit("."), pad(ms % 1000, 3))
    text = (
        F.when(ticks >= 600_000_000, F.concat(minutes.cast("string"), F.lit(":"), pad(seconds, 2), tail))
        .when(ticks >= 100_000_000, F.concat(pad(seconds, 2), tail))
        .otherwise(F.concat(seconds.cast("string"), tail))
    )
    mark = F.when(ticks < 0, "-").when(ticks > 0, "+").otherwise("") if sign else F.lit("")
    return F.when(ticks.isNull(), default).otherwise(F.concat(mark, text))


def minutes_text(ticks: Column) -> Column:
    """mm:ss.fff of a time's parts, without its sign and hours."""
    ms = F.floor(F.abs(ticks) / 10_000)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(F.floor(ms / 60_000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def event_text(ts: Column, user: Column, kind: Column, lap: Column, sector: Column, place: Column, ticks: Column, device: Column, session: Column) -> Column:
    """A line for logs: `ts: user> type info - (mm:ss.fff) [device] {session}`; info is the lap, lap.sector, or the place."""
    info = F.when(kind == "Lap", lap.cast("string")).when(kind == "Sector", F.concat_ws(".", lap.cast("string"), sector.cast("string")))
    info = info.when(kind == "Position", F.coalesce(place, F.lit(""))).otherwise("")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    when = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.concat(when, F.lit(": "), text(user), F.lit("> "), kind, F.lit(" "), info, F.lit(" - ("), minutes_text(ticks), F.lit(") ["), text(device), F.lit("] {"), text(session), F.lit("}"))


def clock(ticks: Column) -> Column:
    """m:ss.fff of a time's parts, without its sign and hours."""
    return F.regexp_replace(minutes_text(ticks), "^0([0-9]:)", "$1")


def wire_text(kind: Column, lap: Column, sector: Column, ticks: Column) -> Column:
    """An event on the wire: `type > Lap n / Sector s : m:ss.fff`."""
    return F.concat(kind, F.lit(" > Lap "), lap.cast("string"), F.lit(" / Sector "), sector.cast("string"), F.lit(" : "), clock(ticks))


def cell_text(ticks: Column) -> Column:
    """A cell of the ranking: m:ss.fff, empty without a positive time."""
    return F.when(ticks > 0, clock(ticks)).otherwise("")


def wire_type(kind: Column) -> Column:
    """The type of an event on the wire: laps stay laps, all else becomes a sector."""
    return F.when(kind == "Lap", "Lap").otherwise("Sector")


def coordinates_text(lat: Column, lon: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, lat.cast("string"), lon.cast("string"))


def driver_text(name: Column, number: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit("-"), F.coalesce(number, F.lit("")))


def error_text(code: Column, message: Column, state: Column) -> Column:
    return F.concat(F.lit("["), code, F.lit("] "), message, F.lit(" (State: "), state, F.lit(")"))


def short_id(device: Column) -> Column:
    return F.substring(device.cast("string"), 1, 8)


def display_name(name: Column, device: Column) -> Column:
    return F.coalesce(F.when(F.trim(name) != "", name), short_id(device))


def share_id() -> Column:
    """Eight characters of a new random id: differs from run to run."""
    return F.substring(F.uuid(), 1, 8)


def identity(driver: Column, device: Column) -> dict[str, Column]:
    """Defaults of a session's driver: id and name are the driver's or else the device's, the number is unknown."""
    who = F.coalesce(F.when(F.trim(driver) != "", driver), device)
    return {"driver_id": who, "driver_name": who, "driver_number": F.lit("Unknown")}


def arguments(line: str) -> list[str]:
    """A command line's arguments: split at blanks, which double quotes protect; a closing quote ends an argument."""
    found = re.findall(r'[^" ]*"[^"]*(?:"|$)|[^" ]+', line)
    return [m.replace('"', "") for m in found if m.strip('"') or m.count('"') == 2]


def event_line(ts: Column, kind: Column, lap: Column, sector: Column, ticks: Column) -> Column:
    """A native-format event line: epoch ms, type, lap, sector, ticks."""
    parts = [F.unix_millis(ts), kind, lap, sector, ticks]
    return F.concat(F.lit("#Event="), F.concat_ws(",", *[p.cast("string") for p in parts]))


def data_line(ts: Column, values: Column, channels: int) -> Column:
    """A native-format data line, null as empty, padded or cut to the number of channels."""
    index = F.sequence(F.lit(0), F.lit(channels - 1))
    cells = F.transform(index, lambda i: F.coalesce(F.get(values, i).cast("string"), F.lit("")))
    return F.concat(F.unix_millis(ts).cast("string"), F.lit(","), F.array_join(cells, ","))
