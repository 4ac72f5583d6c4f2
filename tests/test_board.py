import datetime
import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sectorline.functions import fmt
from sectorline.operators import board, circuits, ranking, stats
from sectorline.plans import board_queries
from sectorline.sources import laps_csv

SF = "/root/testdata/sf0.001"
EVENT = "session_id int, device_id string, device_ord int, ord long, ts timestamp, type string, lap int, sector int, time_ticks long, deleted boolean"
T = [datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=i) for i in range(60)]


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted([repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in plain.values.tolist()])


@pytest.mark.parametrize("name", sorted(board_queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as from '{SF}/events.parquet'")
    mine = board_queries.queries()[name](spark, SF).toPandas()
    theirs = con.sql(board_queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine)
    assert rows(mine) == rows(theirs)


def events(spark, *found):
    return spark.createDataFrame([(1, d, i, o, T[t], kind, lap, sector, ticks, gone) for d, i, o, t, kind, lap, sector, ticks, gone in found], EVENT)


def test_sectors_shown(spark):
    first = [("a", 0, 0, 1, "Sector", 1, 1, 10, False), ("a", 0, 1, 2, "Sector", 1, 2, 20, False), ("a", 0, 2, 2, "Lap", 1, 0, 30, False)]
    cells = lambda e: {r["sector"]: r["shown_ticks"] for r in ranking.shown_sectors(e).collect()}
    assert cells(events(spark, *first)) == {1: 10, 2: 20}
    assert cells(events(spark, *first, ("a", 0, 3, 5, "Sector", 2, 1, 15, False))) == {1: 15, 2: None}
    assert cells(events(spark, *first, ("a", 0, 3, 5, "Sector", 2, 1, 15, False), ("a", 0, 4, 6, "Sector", 2, 1, 16, False))) == {1: 16, 2: None}
    assert cells(events(spark, *first, ("a", 0, 3, 5, "Sector", 2, 1, 15, True))) == {1: 10, 2: 20}
    assert cells(events(spark, ("a", 0, 0, 1, "Lap", 0, 0, 0, False))) == {1: None, 2: None, 3: None}


def test_ranking_of_three_and_a_jump(spark):
    laps = [("A", 0, 0, 1, "Lap", 1, 0, 305, False), ("B", 1, 1, 1, "Lap", 1, 0, 299, False), ("C", 2, 2, 1, "Lap", 1, 0, 310, False)]
    old = ranking.ranking(events(spark, *laps))
    got = {r["device_id"]: (r["rank"], r["gap_ticks"], r["interval_ticks"]) for r in old.collect()}
    assert got == {"B": (1, 0, None), "A": (2, 6, 6), "C": (3, 11, 5)}
    new = ranking.ranking(events(spark, *laps, ("C", 2, 3, 9, "Lap", 2, 0, 297, False)))
    jump = {r["device_id"]: (r["rank"], r["previous_rank"], r["change"], r["has_changed"]) for r in ranking.rank_changes(new, old).collect()}
    assert jump["C"] == (1, 3, 2, True) and jump["A"] == (3, 2, -1, True)


def test_messages(spark):
    kind = "session_id int, device_id string, arrival long, id string, ts timestamp, type string, lap int, sector int, time_ticks long, deleted_at timestamp, display_name string, category string"
    m = [("a", 0, "x", 1, "Lap", None, "Ann", None), ("a", 1, "x", 2, "Other", None, None, "GT"), ("a", 2, "x", 3, "Lap", T[9], " ", None), ("a", 3, "x", 3, "Lap", T[10], "Bob", ""), ("b", 4, "y", 0, "Lap", T[9], None, None), ("b", 5, "y", 9, "Lap", T[11], None, None)]
    m = spark.createDataFrame([(1, d, o, i, T[t], k, 1, 0, 5, g, n, c) for d, o, i, t, k, g, n, c in m], kind)
    left = {r["ord"]: (r["type"], r["removed_at"]) for r in board.apply(m).collect()}
    assert left == {0: ("Lap", T[9]), 1: ("Sector", None), 4: ("Lap", T[11])}
    info = {r["device_id"]: (r["device_ord"], r["display_name"], r["category"]) for r in board.devices(m).collect()}
    assert info == {"a": (0, "Bob", "GT"), "b": (4, None, None)}
    assert {(r["arrival"], r["reason"]) for r in board.rebuilds(m).collect()} == {(0, "first"), (2, "deleted"), (4, "late"), (5, "deleted")}


def test_running_bests_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(board, "BUCKET_US", 5_000_000)
    monkeypatch.setattr(board, "ARRIVALS", 7)
    rng = random.Random(1)
    found = [(rng.choice("ab"), 0, i, rng.randrange(60), rng.choice(["Lap", "Sector"]), 1, rng.randrange(3), rng.randrange(1, 9), False) for i in range(200)]
    e = events(spark, *found)
    order = sorted(found, key=lambda r: (r[3], r[1], r[2]))
    want = {r[2]: all(x[7] >= r[7] for x in order[:k] if (x[4], x[6]) == (r[4], r[6])) for k, r in enumerate(order)}
    assert {r["ord"]: r["was_overall_best"] for r in board.best_flags(e).collect()} == want
    late = {r[2] for k, r in enumerate(found) if any(x[3] > r[3] for x in found[:k])}
    assert {r["ord"] for r in board.late_events(e).collect()} == late


def test_upsert_and_snapshot(spark):
    old = spark.createDataFrame([(1, "a", "Ann"), (1, "b", "Bob")], "session_id int, device_id string, name string")
    new = spark.createDataFrame([(1, "b", None), (1, "c", "Cid")], "session_id int, device_id string, name string")
    assert {tuple(r)[1:] for r in board.upsert(old, new, ["session_id", "device_id"]).collect()} == {("a", "Ann"), ("b", None), ("c", "Cid")}


def test_equal_fixes_stay_apart(spark):
    fixes = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (9.0, 9.0)], "lat double, lon double")
    boxes = spark.createDataFrame([(2, "late", "L", 0.0, 0.0, 2.0, 2.0), (1, "first", "F", 2.0, 2.0, 0.0, 0.0), (0, "none", "N", None, 0.0, 2.0, 2.0)], "ord int, code string, name string, lat1 double, lon1 double, lat2 double, lon2 double")
    assert [r["circuit_code"] for r in circuits.detect(fixes, boxes).collect()] == ["first", "first", None]


def same_as_sql(spark, folder, name, select):
    """Whether the query equals its SQL on `select` of the events."""
    con = duckdb.connect()
    con.sql(f"copy (select {select} from '{SF}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as from '{folder}/events.parquet'")
    mine = board_queries.queries()[name](spark, str(folder)).toPandas()
    return rows(mine) == rows(con.sql(board_queries.oracle_sql()[name]).df()) and len(mine) > 0


def test_circuits_of_fixes_close_in_time(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "circuit_change_sessions", "* replace (ts - to_milliseconds(event_id * 2_500_000) as ts)")


@pytest.mark.parametrize("name", ["csv_export_lines", "channel_min_max"])
def test_windows_of_years_match_sql(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name, "* replace (value * 100_000 as value)")


def test_lap_lines_are_made_once(spark):
    """Nothing runs while the query is built, the laps are numbered once, and a fix gets its text before it meets its laps."""
    e = spark.createDataFrame([], "device_id long, ord long, ts timestamp, type string, lap long, sector int, time_ticks long")
    e = e.withColumn("lap", F.count("ord").over(Window.partitionBy("device_id").orderBy("ord")))
    fixes = spark.createDataFrame([], "device_id long, arrival_ord long, ts timestamp, data array<double>")
    spark.sparkContext.setJobGroup("lap lines", "")
    try:
        lines = laps_csv.export(e, fixes, ["A"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lap lines")
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda word: [re.search(r"\w", x).start() for x in plan if re.search(word, x)]
    assert len(depth(r"Window \[count")) == 1
    assert min(depth("format_string")) > max(depth(r"Join Inner, .*__slice"))


def test_lap_lines_of_odd_events(spark):
    found = [(1, 5, T[30], "Lap", 1, 0, 100_000_000), (1, 1, T[9], "Sector", 1, 1, 12_340_000), (1, 9, T[40], "Lap", 1, 0, 20_000_000), (1, 2, T[9], "Position", 1, 1, 5), (1, 3, T[9], "Sector", 2, 1, 0)]
    found += [(None, 11, T[30], "Lap", 1, 0, 100_000_000), (None, 12, T[30], "Sector", 1, 2, 0), (2, 13, T[30], "Lap", None, 0, 0), (2, 14, T[30], "Sector", None, 1, 0), (1, None, T[30], "Lap", 2, 0, 0), (3, 15, T[1], "Position", 1, 0, 0)]
    e = spark.createDataFrame(found, "device_id long, ord long, ts timestamp, type string, lap long, sector int, time_ticks long")
    fixes = spark.createDataFrame([(1, 20, T[20], [0.5, None]), (1, 21, T[25], [-0.25, 12.0]), (1, 22, T[39], None), (1, 23, T[40], [100.0]), (2, 24, T[30], [1.0]), (None, 25, T[30], [1.0])], "device_id long, arrival_ord long, ts timestamp, data array<double>")
    second = lambda k: T[k].strftime("%Y-%m-%dT%H:%M:%S+00:00,")
    want = [(d, -1, 0, k, x) for d in (1, 2, 3, None) for k, x in enumerate(("title", "Timestamp,A,B"))]
    want += [(1, 5, 1, 5, "#Lap 1 00:00:10"), (1, 9, 1, 9, "#Lap 1 00:00:02"), (1, None, 1, None, "#Lap 2 00:00:00"), (None, 11, 1, 11, "#Lap 1 00:00:10"), (2, 13, 1, 13, None)]
    want += [(1, 5, 2, 1, "#Lap 1 Sector 1 00:00:01.2340000"), (1, 9, 2, 1, "#Lap 1 Sector 1 00:00:01.2340000"), (1, None, 2, 3, "#Lap 2 Sector 1 00:00:00")]
    want += [(1, 5, 3, 21, second(25) + "-.25,12"), (1, 9, 3, 22, None), (1, 9, 3, 23, second(40) + "100")]
    got = laps_csv.export(e, fixes, ["A", "B"], "title").select("device_id", "lap_ord", "part", "place", "line").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_text_of_odd_numbers(spark):
    values = [float("nan"), float("inf"), -float("inf"), -0.0, -0.000001, 0.000005, 10.0, 100.5, -0.5, 1e20, -10.0, 0.1, 1000000.0]
    got = spark.range(1).select(*[laps_csv.number_text(F.lit(x)).alias(f"c{k}") for k, x in enumerate(values)]).first()
    assert list(got) == ["NaN", "Infinity", "-Infinity", "", "", ".00001", "10", "100.5", "-.5", "1" + "0" * 20, "-10", ".1", "1000000"]


def test_replay_of_many_devices(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "replay_plan", "* replace (event_id * 10 as user_id)")  # 1000 in a session: over 2^31 us


def test_circuits_looked_up_at_each_fix(spark):
    rows = [(1, 0, T[0], 1.0), (1, 1, T[1], 5.0), (1, 2, T[30], 9.0), (1, 3, T[29], 5.0), (1, 4, T[2], 1.0), (2, 5, T[2], 1.0)]
    fixes = spark.createDataFrame(rows, "device_id long, arrival_ord long, ts timestamp, lat double").withColumn("lon", F.lit(1.0))
    boxes = spark.createDataFrame([(0, "a", "A", 0.0, 0.0, 2.0, 2.0), (1, "b", "B", 4.0, 0.0, 6.0, 2.0)], "ord int, code string, name string, lat1 double, lon1 double, lat2 double, lon2 double")
    found = lambda every: sorted(map(tuple, circuits.changes(fixes, boxes, every).collect()))
    assert found(0) == [(1, 0, "a"), (1, 1, "b"), (1, 4, "a"), (2, 5, "a")]
    assert found(2_000_000) == [(1, 0, "a"), (2, 5, "a")]  # the second comes too early, those after the third are older


def test_windows_over_slices(spark):
    e = spark.createDataFrame([(1, 1, T[50], 400_000_000), (1, 2, T[50], 0)], "device_id long, ord long, ts timestamp, time_ticks long")
    f = spark.createDataFrame([(1, i, T[i]) for i in range(60)], "device_id long, arrival_ord long, ts timestamp")
    assert sorted(r["arrival_ord"] for r in stats.in_window(e, f, 7_000_000).collect()) == list(range(11, 51))


def test_windows_of_any_length(spark):
    rng = random.Random(5)
    seconds = [0.000001, 0.5, 3.0, 40.0, 3600.0, 1e6, 9e9]  # slices of 1 us: beyond an array for the long ones, were they of one width
    e = [(d, i, T[rng.randrange(60)], int(rng.choice(seconds) * 1e7)) for d in (1, 2) for i in range(60)] + [(1, 99, None, 5)]
    f = [(d, i, T[rng.randrange(60)] + datetime.timedelta(microseconds=rng.randrange(3))) for d in (1, 3) for i in range(50)] + [(1, 98, None)]
    want = sorted((d, n, i) for d, n, t, k in e for o, i, u in f if d == o and t and u and 0 <= (t - u) / datetime.timedelta(microseconds=1) < k / 10)
    events = spark.createDataFrame(e, "device_id long, ord long, ts timestamp, time_ticks long")
    fixes = spark.createDataFrame(f, "device_id long, arrival_ord long, ts timestamp")
    for width in (1, 600_000_000):
        got = stats.in_window(events, fixes, width)
        assert sorted(map(tuple, got.select("device_id", "ord", "arrival_ord").collect())) == want
    assert stats.in_window(events.limit(0), fixes).count() == 0


def test_text_forms(spark):
    one = spark.range(1)
    got = one.select(fmt.clock(F.lit(-612_340_000)), fmt.cell_text(F.lit(0)), fmt.coordinates_text(F.lit(1.5), F.lit(2.0)), fmt.share_id()).first()
    assert tuple(got)[:3] == ("1:01.234", "", "1.5, 2.0") and len(got[3]) == 8
    assert fmt.arguments('run --input "a b.csv"  x "" y"z w" "open end') == ["run", "--input", "a b.csv", "x", "", "yz w", "open end"]
    assert fmt.arguments("  ") == []
