"""The timers in SQL: recursion over a device's crossings, or over all its fixes."""

from __future__ import annotations

from . import adapters


def _crossings(direction: str = "den >= 0") -> str:
    return f"""{adapters.FIXES_SQL}, {adapters.GATES_SQL},
path AS (SELECT *, row_number() OVER v AS idx, epoch_us(ts) AS us, epoch_us(lag(ts) OVER v) AS prev, epoch_us(lag(ts, 2) OVER v) AS prev2 FROM tr WINDOW v AS (PARTITION BY device_id ORDER BY arrival_ord)),
x AS (SELECT *, (lon2 - lon1) * (lat - plat) - (lat2 - lat1) * (lon - plon) AS den FROM path, gates WHERE plat IS NOT NULL),
y AS (SELECT *, ((lat1 - plat) * (lon - plon) + (plon - lon1) * (lat - plat)) / den AS t,
  ((plat - lat1) * (lon2 - lon1) + (lon1 - plon) * (lat2 - lat1)) / -den AS u FROM x WHERE den <> 0 AND {direction}),
z AS (SELECT *, lat1 + (lat2 - lat1) * t AS qlat, lon1 + (lon2 - lon1) * t AS qlon, lat - plat AS dx, lon - plon AS dy FROM y WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
c AS (SELECT device_id, idx, us, prev, prev2, CASE WHEN number = 1 THEN 3 ELSE number - 1 END AS sector, number,
  prev + CAST(floor((us - prev) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((qlat - plat) * dx + (qlon - plon) * dy) / (dx * dx + dy * dy)))) AS BIGINT) AS hit FROM z)"""


def timer(cooldown: int, idle: int, closed: bool) -> str:
    """Sector and lap events from the crossings alone."""
    ends = 3 if closed else 2
    since = "s.lap_at" if closed else "CASE WHEN f.sector = 3 THEN f.hit ELSE coalesce(CASE WHEN f.fresh THEN NULL ELSE s.start_at END, f.hit) END"
    return f"""WITH RECURSIVE {_crossings()},
q AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY idx, number) AS seq FROM c),
st AS (
  SELECT device_id, 0::BIGINT AS seq, NULL::BIGINT AS idx, NULL::BIGINT AS us, NULL::BIGINT AS last, NULL::BIGINT AS lap, NULL::BIGINT AS lap_at, NULL::BIGINT AS start_at,
    0::BIGINT AS session_no, 0::BIGINT AS n, true AS dropped, NULL::INTEGER AS sector, NULL::BIGINT AS hit, NULL::BIGINT AS time_us, NULL::BIGINT AS number, NULL::BIGINT AS lap_us, false AS is_lap,
    NULL::BIGINT AS base FROM (SELECT DISTINCT device_id FROM q)
  UNION ALL
  SELECT r.device_id, r.seq, r.idx, r.us, CASE WHEN r.gone THEN r.kept ELSE r.hit END,
    CASE WHEN r.gone THEN r.lap0 WHEN r.is_lap THEN r.number ELSE r.lap0 END, CASE WHEN NOT r.gone AND r.is_lap THEN r.hit ELSE r.lap_at0 END,
    CASE WHEN NOT r.gone AND r.sector = 3 THEN r.hit ELSE r.start0 END, r.session_no, r.n0 + CASE WHEN r.gone THEN 0 WHEN r.is_lap THEN 2 ELSE 1 END, r.gone, r.sector, r.hit,
    CASE WHEN r.gone THEN NULL WHEN r.fresh THEN 0 ELSE r.hit - r.kept END, CASE WHEN NOT r.gone THEN r.number END,
    CASE WHEN NOT r.gone AND r.is_lap THEN CASE WHEN r.lap0 IS NULL THEN 0 ELSE r.hit - r.since END END, NOT r.gone AND r.is_lap, r.n0
  FROM (
    SELECT f.*, CASE WHEN f.lap0 IS NULL THEN 0 ELSE f.lap0 + 1 END AS number, f.sector = {ends} AS is_lap, {since.replace("s.lap_at", "f.lap_at0").replace("s.start_at", "f.start0")} AS since
    FROM (
      SELECT e.*, NOT e.gone AND e.kept IS NULL AS fresh, e.session0 + CASE WHEN NOT e.gone AND e.kept IS NULL THEN 1 ELSE 0 END AS session_no,
        CASE WHEN NOT e.gone AND e.kept IS NULL THEN NULL ELSE e.s_lap END AS lap0, CASE WHEN NOT e.gone AND e.kept IS NULL THEN NULL ELSE e.s_lap_at END AS lap_at0,
        CASE WHEN NOT e.gone AND e.kept IS NULL THEN NULL ELSE e.s_start END AS start0, CASE WHEN NOT e.gone AND e.kept IS NULL THEN 0 ELSE e.s_n END AS n0
      FROM (
        SELECT d.*, CASE WHEN d.same THEN d.s_dropped WHEN d.shut THEN d.cleared ELSE d.s_last IS NOT NULL AND d.s_last + {cooldown} > d.us END AS gone,
          CASE WHEN NOT d.same AND d.shut THEN NULL ELSE d.s_last END AS kept
        FROM (
          SELECT a.device_id, a.seq, a.idx, a.us, a.sector, a.hit, s.last AS s_last, s.lap AS s_lap, s.lap_at AS s_lap_at, s.start_at AS s_start, s.session_no AS session0, s.n AS s_n, s.dropped AS s_dropped,
            coalesce(a.idx = s.idx, false) AS same,
            s.last IS NOT NULL AND ((NOT s.dropped AND s.last + {idle} < s.us) OR coalesce(a.prev > s.last + {idle} AND a.prev >= s.last + {cooldown}, false)) AS shut,
            CASE WHEN NOT s.dropped AND s.last + {idle} < s.us THEN s.idx = a.idx - 1
              ELSE NOT coalesce(a.prev2 > s.last + {idle} AND a.prev2 >= s.last + {cooldown}, false) END AS cleared
          FROM st s JOIN q a ON a.device_id = s.device_id AND a.seq = s.seq + 1) d) e) f) r),
ev AS (SELECT device_id, session_no, base AS ord, 'Sector' AS type, number AS lap, sector, hit AS event_us, time_us FROM st WHERE seq > 0 AND NOT dropped
  UNION ALL SELECT device_id, session_no, base + 1, 'Lap', number, 0, hit, lap_us FROM st WHERE is_lap),
sb AS (SELECT *, min(CASE WHEN type = 'Sector' AND time_us > 0 THEN time_us END) OVER (PARTITION BY device_id, session_no, CASE WHEN type = 'Lap' THEN -1 ELSE sector END ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  min(CASE WHEN type = 'Lap' AND lap > 0 THEN time_us END) OVER (PARTITION BY device_id, session_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM ev),
sf AS (SELECT *, time_us > 0 AND (b IS NULL OR time_us <= b) AS flag FROM sb),
fl AS (SELECT *, lag(flag) OVER (PARTITION BY device_id, session_no ORDER BY ord) AS sector_flag FROM sf)
SELECT device_id, CAST(session_no AS INTEGER) AS session_no, CAST(ord AS INTEGER) AS ord, type, CAST(lap AS INTEGER) AS lap, CAST(sector AS INTEGER) AS sector, event_us, time_us,
  CASE WHEN type = 'Sector' THEN flag WHEN time_us = 0 THEN sector_flag ELSE lb IS NULL OR lb >= time_us END AS is_best FROM fl"""
