"""The registered queries of the timing operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt, geo
from ..operators import board, circuits, crossings, ranking, stats
from . import adapters, timer_sql

HOUR = 3_600_000_000
CONFIG = crossings.TimerConfig(cooldown_us=12 * HOUR, idle_us=24 * HOUR)
LINE = (50.002, 5.001, 50.008, 5.009)


def _events(use: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use(adapters.timing_events(spark, sf_dir))


def _messages(use: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use(adapters.messages(spark, sf_dir))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, p = [F.lit(x) for x in LINE], [F.col("lat"), F.col("lon")]
    return adapters.fixes(spark, sf_dir).select(
        "arrival_ord",
        F.round(geo.midpoint(F.lit(LINE[0]), F.col("lat")), 9).alias("mid_lat"),
        geo.within_box(*line, *p).alias("in_box"),
        F.round(geo.projection_factor(*line, *p), 9).alias("projection"),
        (F.round(geo.signed_area(*line, *p) * 1e6, 6) + F.lit(0.0)).alias("area"),
        F.round(geo.distance(F.lit(48.0), F.lit(2.0), *p), 4).alias("km"),
        F.round(geo.distance(F.lit(48.0), F.lit(2.0), *p, "N"), 4).alias("nautical"),
        F.round(geo.center_factor(F.lit(48.0), F.lit(2.0), F.lit(52.0), F.lit(9.0), *p), 4).alias("center"),
    )


def _crossings(direction: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = crossings.candidates(adapters.fixes(spark, sf_dir), adapters.gates(spark), direction)
        return found.select("device_id", "arrival_ord", "number", "sector", "lat", "lon")

    return run


def _timer(closed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = crossings.candidates(adapters.fixes(spark, sf_dir), adapters.gates(spark), "toward", "projection")
        return crossings.timing(found, crossings.TimerConfig(CONFIG.cooldown_us, CONFIG.idle_us, closed))

    return run


def _rank_change(e: DataFrame) -> DataFrame:
    return ranking.rank_changes(ranking.ranking(e), ranking.ranking(e.filter("ord % 2 = 0")))


def _times(e: DataFrame) -> DataFrame:
    ticks = F.when(F.col("deleted"), -F.col("time_ticks")).otherwise(F.col("time_ticks"))
    ticks = F.when(F.col("ord") % 43 == 0, F.lit(None)).otherwise(ticks)
    return e.select("ord", fmt.format_time(ticks).alias("time_text"), fmt.format_time(ticks, sign=True).alias("signed_text"))


def _lines(e: DataFrame) -> DataFrame:
    return e.select("ord", fmt.event_line(F.col("ts"), F.col("type"), F.col("lap"), F.col("sector"), F.col("time_ticks")).alias("line"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ranking": _events(ranking.ranking),
        "ranking_rank_change": _events(_rank_change),
        "board_best_flags": _events(board.best_flags),
        "board_colours": _events(board.colours),
        "late_events": _messages(lambda m: board.late_events(board.apply(m))),
        "last_event": _events(stats.last_event),
        "last_lap": _events(stats.last_lap),
        "best_lap": _events(stats.best_lap),
        "last_sector": _events(stats.last_sector),
        "best_sectors": _events(stats.best_sectors),
        "theoretical_best": _events(stats.theoretical_best),
        "rolling_best": _events(stats.rolling_best),
        "session_best_lap": _events(stats.session_best_lap),
        "session_best_sectors": _events(stats.session_best_sectors),
        "event_telemetry": lambda s, d: stats.event_telemetry(adapters.timing_events(s, d).withColumn("time_ticks", F.col("time_ticks") * 10000), adapters.fixes(s, d)),
        "geometry": _geometry,
        "circuit_index": lambda s, d: circuits.index(adapters.circuits(s)).select("code_key", "name", "ord"),
        "circuit_detect": lambda s, d: circuits.detect(adapters.fixes(s, d).select("arrival_ord", "lat", "lon"), adapters.circuits(s)).select("arrival_ord", "circuit_code"),
        "crossings_any": _crossings("any"),
        "crossings_toward": _crossings("toward"),
        "crossings_away": _crossings("away"),
        "timer_closed": _timer(True),
        "timer_open": _timer(False),
        "format_time": _events(_times),
        "native_event_lines": _events(_lines),
    }


def _sql_text(ticks: str) -> str:
    ms = f"(abs({ticks}) // 10000)"
    tail = f"'.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"
    s = f"({ms} // 1000 % 60)"
    return f"CASE WHEN {ticks} IS NULL THEN NULL WHEN {ticks} >= 600000000 THEN ({ms} // 60000 % 60) || ':' || lpad(CAST({s} AS VARCHAR), 2, '0') || {tail} WHEN {ticks} >= 100000000 THEN lpad(CAST({s} AS VARCHAR), 2, '0') || {tail} ELSE CAST({s} AS VARCHAR) || {tail} END"


def _km(a: str, b: str) -> str:
    c = f"sin(radians({a}))*sin(radians(lat)) + cos(radians({a}))*cos(radians(lat))*cos(radians({b}-lon))"
    return f"degrees(acos(greatest(-1.0, least(1.0, {c})))) * 60 * 1.1515 * 1.609344"


def oracle_sql() -> dict[str, str]:
    te = "WITH " + adapters.EVENTS_SQL
    live = "live AS (SELECT * FROM te WHERE NOT deleted AND time_ticks <> 0 AND type IN ('Lap', 'Sector'))"
    before = "ORDER BY ts, device_ord, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    flags = f"""flags AS (SELECT session_id, device_id, ord, type, sector, time_ticks,
  coalesce(min(time_ticks) OVER (PARTITION BY session_id, device_id, type, sector {before}) >= time_ticks, true) AS was_personal_best,
  coalesce(min(time_ticks) OVER (PARTITION BY session_id, type, sector {before}) >= time_ticks, true) AS was_overall_best FROM live)"""

    def ranks(name: str, where: str) -> str:
        return f"""{name}_d AS (SELECT session_id, device_id, min(device_ord) AS device_ord,
  min(CASE WHEN type = 'Lap' AND NOT deleted AND time_ticks > 0 THEN time_ticks END) AS best_ticks,
  count(CASE WHEN type = 'Lap' AND NOT deleted AND time_ticks > 0 THEN 1 END) AS n_laps FROM te WHERE {where} GROUP BY 1, 2),
{name} AS (SELECT session_id, device_id, best_ticks, n_laps, CAST(row_number() OVER w AS INTEGER) AS rank,
  best_ticks - min(best_ticks) OVER (PARTITION BY session_id) AS gap_ticks, best_ticks - lag(best_ticks) OVER w AS interval_ticks
  FROM {name}_d WINDOW w AS (PARTITION BY session_id ORDER BY best_ticks NULLS LAST, device_ord))"""

    def top(order: str, columns: str, where: str, keys: str = "session_id, device_id") -> str:
        return f"{te} SELECT {keys}, ord, {columns} FROM te WHERE {where} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"

    best = "session_id, device_id, sector, time_ticks, ord, lap FROM te WHERE type = 'Sector' AND time_ticks > 0"
    first_lap = "SELECT session_id, device_id, ord, time_ticks FROM te WHERE type = 'Lap' AND lap > 0 QUALIFY row_number() OVER (PARTITION BY session_id, device_id ORDER BY time_ticks, ord) = 1"
    a1, o1, a2, o2 = (f"{x}::DOUBLE" for x in LINE)
    dx, dy = f"({a2} - {a1})", f"({o2} - {o1})"
    ends = (_km("48.0::DOUBLE", "2.0::DOUBLE"), _km("52.0::DOUBLE", "9.0::DOUBLE"))
    out = {
        "ranking": f"{te}, {ranks('r', 'true')} SELECT * FROM r",
        "ranking_rank_change": f"""{te}, {ranks("r", "true")}, {ranks("o", "ord % 2 = 0")}
SELECT r.session_id, r.device_id, r.rank, coalesce(o.rank, r.rank) AS previous_rank, coalesce(o.rank, r.rank) - r.rank AS change,
  coalesce(o.rank, r.rank) <> r.rank AS has_changed FROM r LEFT JOIN o USING (session_id, device_id)""",
        "board_best_flags": f"{te}, {live}, {flags} SELECT * FROM flags",
        "board_colours": f"""{te}, {live}, {flags} SELECT session_id, ord, CASE WHEN time_ticks <= min(time_ticks) OVER (PARTITION BY session_id, type, CASE WHEN type = 'Lap' THEN 0 ELSE sector END) THEN 'Purple' WHEN was_personal_best THEN 'Green' ELSE 'Goldenrod' END AS colour FROM flags""",
        "late_events": f"""{te}, {adapters.MESSAGES_SQL} SELECT session_id, device_id, ord FROM ev
QUALIFY ts < max(ts) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "last_event": top("ord DESC", "type, time_ticks", "true"),
        "last_lap": top("lap DESC, ord", "lap, time_ticks", "type = 'Lap'"),
        "best_lap": top("time_ticks, ord", "time_ticks, lap", "type = 'Lap' AND lap > 0"),
        "last_sector": top("lap DESC, sector DESC, ord", "lap, sector, time_ticks", "type = 'Sector' AND time_ticks > 0"),
        "best_sectors": f"{te} SELECT {best} QUALIFY row_number() OVER (PARTITION BY session_id, device_id, sector ORDER BY time_ticks, ord) = 1",
        "theoretical_best": f"""{te}, b AS (SELECT session_id, device_id, sector, min(time_ticks) AS t FROM te WHERE type = 'Sector' AND time_ticks > 0 AND lap > 0 GROUP BY 1, 2, 3)
SELECT session_id, device_id, CAST(sum(t) AS BIGINT) AS theoretical_ticks FROM b GROUP BY 1, 2""",
        "rolling_best": f"""{te}, s AS (SELECT *, max(sector) OVER (PARTITION BY session_id, device_id) AS n FROM te WHERE type = 'Sector'),
q AS (SELECT *, row_number() OVER (PARTITION BY session_id, device_id ORDER BY ts, ord) AS i FROM s WHERE lap > 0 AND n > 0),
w AS (SELECT a.session_id, a.device_id, a.i, sum(b.time_ticks) AS t FROM q a JOIN q b ON a.session_id = b.session_id AND a.device_id = b.device_id AND b.i <= a.i AND b.i > a.i - a.n WHERE a.i >= a.n GROUP BY 1, 2, 3)
SELECT session_id, device_id, CAST(min(t) AS BIGINT) AS rolling_ticks FROM w GROUP BY 1, 2""",
        "session_best_lap": f"{te}, b AS ({first_lap}) SELECT session_id, time_ticks, ord, device_id FROM b WHERE time_ticks > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY time_ticks, ord) = 1",
        "session_best_sectors": f"{te} SELECT session_id, sector, min(time_ticks) AS time_ticks FROM te WHERE type = 'Sector' AND time_ticks > 0 GROUP BY 1, 2",
        "event_telemetry": f"""{te}, {adapters.FIXES_SQL} SELECT te.device_id, te.ord, count(*) AS n_fixes, min(lat) AS min_lat, max(lat) AS max_lat
FROM te JOIN fx ON te.device_id = fx.device_id AND epoch_us(fx.ts) > epoch_us(te.ts) - te.time_ticks * 10000 / 10 AND fx.ts <= te.ts GROUP BY 1, 2""",
        "geometry": f"""WITH {adapters.FIXES_SQL} SELECT arrival_ord, round(({a1} + lat) / 2, 9) AS mid_lat,
  lat BETWEEN {a1} AND {a2} AND lon BETWEEN {o1} AND {o2} AS in_box,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lat - {a1}) * {dx} + (lon - {o1}) * {dy}) / ({dx} * {dx} + {dy} * {dy}))), 9) AS projection,
  round(({dx} * (lon - {o1}) - {dy} * (lat - {a1})) * 1000000.0::DOUBLE, 6) + 0.0::DOUBLE AS area, round({ends[0]}, 4) AS km,
  round({ends[0]} / 1.609344 * 0.8684, 4) AS nautical, round(1 - abs({ends[0]} - {ends[1]}) / ({ends[0]} + {ends[1]}), 4) AS center FROM fx""",
        "circuit_index": f"WITH {adapters.CIRCUITS_SQL} SELECT lower(code) AS code_key, name, ord FROM circuits QUALIFY row_number() OVER (PARTITION BY lower(code) ORDER BY ord DESC) = 1",
        "circuit_detect": f"""WITH {adapters.FIXES_SQL}, {adapters.CIRCUITS_SQL} SELECT arrival_ord, code AS circuit_code FROM fx LEFT JOIN circuits ON
  lat BETWEEN least(lat1, lat2) AND greatest(lat1, lat2) AND lon BETWEEN least(lon1, lon2) AND greatest(lon1, lon2)
QUALIFY row_number() OVER (PARTITION BY arrival_ord ORDER BY ord) = 1""",
        "format_time": f"{te}, t AS (SELECT ord, CASE WHEN ord % 43 = 0 THEN NULL WHEN deleted THEN -time_ticks ELSE time_ticks END AS t FROM te) SELECT ord, coalesce({_sql_text('t')}, '-') AS time_text, coalesce(CASE WHEN t < 0 THEN '-' WHEN t > 0 THEN '+' ELSE '' END || {_sql_text('t')}, '-') AS signed_text FROM t",
        "native_event_lines": f"{te} SELECT ord, '#Event=' || (epoch_us(ts) // 1000) || ',' || type || ',' || lap || ',' || sector || ',' || time_ticks AS line FROM te",
    }
    out["timer_closed"] = timer_sql.timer(CONFIG.cooldown_us, CONFIG.idle_us, True)
    out["timer_open"] = timer_sql.timer(CONFIG.cooldown_us, CONFIG.idle_us, False)
    for name, sign in (("any", "true"), ("toward", "den >= 0"), ("away", "den <= 0")):
        out[f"crossings_{name}"] = f"""WITH {adapters.FIXES_SQL}, {adapters.GATES_SQL},
x AS (SELECT *, (lon2 - lon1) * (lat - plat) - (lat2 - lat1) * (lon - plon) AS den FROM tr, gates WHERE plat IS NOT NULL),
y AS (SELECT *, ((lat1 - plat) * (lon - plon) + (plon - lon1) * (lat - plat)) / den AS t,
  ((plat - lat1) * (lon2 - lon1) + (lon1 - plon) * (lat2 - lat1)) / -den AS u FROM x WHERE den <> 0 AND {sign})
SELECT device_id, arrival_ord, number, CASE WHEN number = 1 THEN 3 ELSE number - 1 END AS sector, round(lat1 + (lat2 - lat1) * t, 9) AS lat,
  round(lon1 + (lon2 - lon1) * t, 9) AS lon FROM y WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""
    return out
