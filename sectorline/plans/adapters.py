"""The driver's tables in terms of this domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ord, code, name, lat1, lon1, lat2, lon2: boxes overlap on purpose, and one code comes twice.
CIRCUITS = [
    (0, "alpha", "Alpha", 50.000, 5.000, 50.004, 5.004),
    (1, "beta", "Beta", 50.008, 5.008, 50.002, 5.002),
    (2, "gamma", "Gamma", 50.006, 5.000, 50.010, 5.010),
    (3, "ALPHA", "Alpha renewed", 50.000, 5.000, 50.003, 5.003),
]
#: number, lat1, lon1, lat2, lon2.
GATES = [(1, 50.000, 5.003, 50.010, 5.003), (2, 50.000, 5.006, 50.010, 5.006), (3, 50.004, 5.000, 50.004, 5.010)]

EVENTS_SQL = """
te AS (SELECT user_id % 10 AS session_id, user_id AS device_id, user_id AS device_ord, event_id AS ord, ts,
  CASE event_type WHEN 'purchase' THEN 'Lap' WHEN 'error' THEN 'Position' ELSE 'Sector' END AS type,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS sector,
  CASE WHEN event_id % 41 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) * 100000 END AS time_ticks,
  CAST(1 + count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS lap,
  event_id % 37 = 0 AS deleted FROM events)"""
MESSAGES_SQL = """
msg AS (SELECT session_id, device_id, ord AS arrival, CASE WHEN ord % 17 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts, type, lap, sector, time_ticks,
  CASE WHEN ord % 29 = 0 THEN coalesce(lag(ord) OVER (PARTITION BY device_id ORDER BY ord), ord) ELSE ord END AS id,
  CASE WHEN ord % 29 = 0 THEN ts END AS deleted_at,
  CASE ord % 5 WHEN 0 THEN 'Name ' || (ord % 3) WHEN 1 THEN '  ' END AS display_name,
  CASE WHEN ord % 7 = 0 THEN 'C' || (ord % 2) END AS category FROM te),
nth AS (SELECT *, row_number() OVER (PARTITION BY session_id, device_id, id ORDER BY arrival) AS nth FROM msg),
gone AS (SELECT session_id, device_id, id, min(arrival) AS arrival FROM nth WHERE nth > 1 AND deleted_at IS NOT NULL GROUP BY 1, 2, 3),
ev AS (SELECT n.session_id, n.device_id, n.device_id AS device_ord, n.arrival AS ord, n.ts, CASE WHEN n.type = 'Lap' THEN 'Lap' ELSE 'Sector' END AS type,
  n.lap, n.sector, n.time_ticks, n.id, n.nth = 1 AND g.arrival IS NOT NULL AS deleted, g.arrival AS removed_by
  FROM nth n LEFT JOIN gone g ON n.session_id = g.session_id AND n.device_id = g.device_id AND n.id = g.id AND n.nth = 1 WHERE n.nth = 1 OR n.deleted_at IS NULL)"""
FIXES_SQL = """
fx AS (SELECT user_id AS device_id, event_id AS arrival_ord, ts, 50.0::DOUBLE + ((event_id * 7919) % 1000)::DOUBLE / 100000.0::DOUBLE AS lat,
  5.0::DOUBLE + ((event_id * 104729) % 1000)::DOUBLE / 100000.0::DOUBLE AS lon FROM events),
tr AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fx WINDOW w AS (PARTITION BY device_id ORDER BY arrival_ord))"""


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


CIRCUITS_SQL = "circuits AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{c}', '{n}', " + ", ".join(map(_d, b)) + ")" for o, c, n, *b in CIRCUITS) + ") t(ord, code, name, lat1, lon1, lat2, lon2))"
GATES_SQL = "gates AS (SELECT * FROM (VALUES " + ", ".join(f"({g[0]}, " + ", ".join(map(_d, g[1:])) + ")" for g in GATES) + ") t(number, lat1, lon1, lat2, lon2))"


def timing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    laps = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") % 10).alias("session_id"),
        F.col("user_id").alias("device_id"),
        F.col("user_id").alias("device_ord"),
        F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "Lap").when(kind == "error", "Position").otherwise("Sector").alias("type"),
        F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 3).otherwise(0).alias("sector"),
        F.when(F.col("event_id") % 41 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("long") * 100000).alias("time_ticks"),
        (1 + F.count(F.when(kind == "purchase", 1)).over(laps)).alias("lap"),
        (F.col("event_id") % 37 == 0).alias("deleted"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda base, by: F.lit(base) + ((F.col("event_id") * by) % 1000).cast("double") / F.lit(100000.0)
    return e.select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("arrival_ord"), F.col("ts").cast("timestamp").alias("ts"),
        at(50.0, 7919).alias("lat"), at(5.0, 104729).alias("lon"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live messages: some arrive late, some ask for the deletion of their device's event before, names come and go."""
    e, o = timing_events(spark, sf_dir), F.col("ord")
    w = Window.partitionBy("device_id").orderBy("ord")
    return e.select(
        "session_id", "device_id", o.alias("arrival"), F.when(o % 17 == 0, F.col("ts") - F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")).alias("ts"), "type", "lap", "sector", "time_ticks",
        F.when(o % 29 == 0, F.coalesce(F.lag("ord").over(w), o)).otherwise(o).alias("id"), F.when(o % 29 == 0, F.col("ts")).alias("deleted_at"),
        F.when(o % 5 == 0, F.concat(F.lit("Name "), (o % 3).cast("string"))).when(o % 5 == 1, "  ").alias("display_name"),
        F.when(o % 7 == 0, F.concat(F.lit("C"), (o % 2).cast("string"))).alias("category"),
    )


def circuits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CIRCUITS, "ord int, code string, name string, lat1 double, lon1 double, lat2 double, lon2 double")


def gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATES, "number int, lat1 double, lon1 double, lat2 double, lon2 double")
