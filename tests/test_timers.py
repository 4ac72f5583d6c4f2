
import pandas as pd
import pytest

from sectorline.operators import crossings
from sectorline.operators.crossings import Automatic, Dense, TimerConfig
from sectorline.plans import adapters, board_queries
from sectorline.plans import queries as timing
from sectorline.streaming import board as board_stream
from sectorline.streaming import timer as timer_stream

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def test_config():
    assert TimerConfig.of(7.9, 10).cooldown_us == 7_000_000 and TimerConfig().device_id != TimerConfig().device_id
    assert TimerConfig(device_id="d").device_id == "d" and TimerConfig().blocked_us(3) == 3_000_000 and TimerConfig().blocked_us(0) == 5_000_000
    for wrong in ({"cooldown_us": -1}, {"idle_us": 0}, {"retention": 1}):
        with pytest.raises(ValueError):
            TimerConfig(**wrong)


def test_first_crossing_is_a_sector_and_a_lap():
    got = Dense(TimerConfig(5, 20))
    assert got.feed(0, [], 1) == []
    assert got.feed(10, [(7, 1, 1)], 1) == [(1, 0, "Sector", 0, 1, 7, 0, False), (1, 1, "Lap", 0, 0, 7, 0, False)]
    assert got.feed(11, [(11, 1, 1)], 1) == []  # cooldown
    assert got.feed(17, [(15, 1, 1)], 1) == [(1, 2, "Sector", 1, 1, 15, 8, True), (1, 3, "Lap", 1, 0, 15, 8, True)]
    assert got.feed(40, [], 1) == [] and got.session is None  # idle
    assert got.feed(41, [(41, 1, 1)], 1) == []  # the history went with the session
    assert got.feed(42, [(42, 1, 1)], 1)[0][0] == 2


def test_breadcrumbs_and_open_circuits():
    got = Dense(TimerConfig(0, 100, closed=False, track_position=True))
    got.feed(0, [], 3)
    assert [e[2] for e in got.feed(1, [(1, 3, 3)], 3)] == ["Sector", "Position"]
    assert [e[2] for e in got.feed(9, [(5, 2, 3)], 3)] == ["Sector", "Lap", "Position"]
    assert [(e[2], e[6]) for e in got.feed(20, [(12, 3, 3), (19, 2, 3)], 3)] == [("Sector", 3), ("Sector", 7), ("Lap", 7), ("Position", 1)]


def test_automatic_sessions():
    got = Automatic(TimerConfig(0, 100), 10)
    assert got.feed(0, None, {"a": [(0, 1, 1)]}, {}) == []
    assert got.feed(5, "a", {"a": [(4, 1, 1), (5, 1, 1)]}, {}) == [(1, 0, "Sector", 0, 1, 4, 0, None), (1, 1, "Lap", 0, 0, 4, 0, None)]
    assert got.feed(8, "b", {"b": [(8, 1, 1)]}, {}) == []  # not looked up again before 15
    assert got.feed(15, "b", {"a": [(15, 1, 1)], "b": [(14, 2, 2)]}, {})[0][:5] == (2, 0, "Sector", 0, 2)
    assert got.feed(200, None, {}, {}) == [] and got.session is None and got.circuit == "b"


def test_whole_tables_of_the_other_modes(spark):
    """position_breadcrumbs and automatic_sessions against loops over each device's fixes."""
    found = crossings.candidates(adapters.fixes(spark, SF), adapters.gates(spark), "toward", "projection").toPandas()
    fixes = adapters.fixes(spark, SF).toPandas().sort_values(["device_id", "arrival_ord"])
    by = {k: [(int(r.cross_us), int(r.sector), 3) for r in g.sort_values("number").itertuples()] for k, g in found.groupby(["device_id", "arrival_ord"])}
    want, config = [], TimerConfig(12 * HOUR, 24 * HOUR, track_position=True)
    for d, g in fixes.groupby("device_id"):
        last = session = None
        number = n = lap = lap_at = 0
        before = False
        for r in g.itertuples():
            ts = r.ts.value // 1000
            free = last is None or session is None or last + config.cooldown_us <= ts
            if before and free:
                for kind, s, at in [("Sector", s, at) for at, s, _ in by.get((d, r.arrival_ord), [])] + [("Position", 0, ts)]:
                    if session is None:
                        session, number, n, lap, last = object(), number + 1, 0, None, None
                    k = 0 if lap is None else lap + 1
                    want.append((d, number, n, kind, k, s, at, 0 if last is None else at - last))
                    n, last = n + 1, at
                    if kind == "Sector" and s == 3:
                        want.append((d, number, n, "Lap", k, 0, at, 0 if lap is None else at - lap_at))
                        n, lap, lap_at = n + 1, k, at
            before = True
            if free and session is not None and last + config.idle_us < ts:
                session, before = None, False
    got = [tuple(r)[:-1] for r in board_queries.queries()["position_breadcrumbs"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_automatic_sessions_of_whole_tables(spark):
    """automatic_sessions against a loop over each device's fixes and all circuits' boxes and gates."""
    every = {"alpha": adapters.GATES, "gamma": adapters.GATES[:2], "beta": []}
    boxes = [(c, min(a, x), max(a, x), min(b, y), max(b, y)) for _, c, _, a, b, x, y in adapters.CIRCUITS if c != "ALPHA"]
    want, day = [], 24 * HOUR
    for d, g in adapters.fixes(spark, SF).toPandas().sort_values("arrival_ord").groupby("device_id"):
        prev = circuit = checked = run = None
        number = 0
        for r in g.itertuples():
            ts = r.ts.value // 1000
            if circuit is None or checked + 2_000_000 <= ts:
                checked = ts
                code = next((c for c, s, n, w, e in boxes if s <= r.lat <= n and w <= r.lon <= e), None)
                if code not in (None, circuit):
                    circuit, number = code, number + 1
                    run = {"last": None, "lap": None, "lap_at": None, "n": 0, "since": ts, "seen": None}
            if circuit is not None:
                kind = None
                if prev and (run is None or run["last"] is None or run["last"] + 12 * HOUR <= ts):
                    for k, *gate in every[circuit]:
                        point = timer_stream.meet(tuple(gate), (prev[1], prev[2], r.lat, r.lon), True)
                        if point:
                            at = prev[0] + int((ts - prev[0]) * timer_stream.share((prev[1], prev[2], r.lat, r.lon), point, "projection"))
                            kind, sector = "Sector", len(every[circuit]) if k == 1 else k - 1
                            break
                    else:
                        if run is not None and (run["seen"] is None or run["seen"] + 1_000_000 < ts):
                            kind, sector, at = "Position", 0, ts
                if kind:
                    if run is None:
                        number += 1
                        run = {"last": None, "lap": None, "lap_at": None, "n": 0, "since": at, "seen": None}
                    lap = 0 if run["lap"] is None else run["lap"] + 1
                    want.append((d, number, run["n"], kind, lap, sector, at, 0 if run["last"] is None else at - run["last"]))
                    run["n"], run["last"] = run["n"] + 1, at
                    if sector == len(every[circuit]):
                        want.append((d, number, run["n"], "Lap", lap, 0, at, 0 if run["lap"] is None else at - run["lap_at"]))
                        run["n"], run["lap"], run["lap_at"] = run["n"] + 1, lap, at
                if run is not None:
                    run["seen"] = ts
                    if (run["since"] if run["last"] is None else run["last"]) + day < ts:
                        run = None
            prev = (ts, r.lat, r.lon)
    got = [tuple(r) for r in board_queries.queries()["automatic_sessions"](spark, SF).collect()]
    assert all(r[-1] is None for r in got) and sorted(r[:-1] for r in got) == sorted(want)


def test_timeouts_of_circuits(spark):
    gates = adapters.gates(spark).selectExpr("*", "10 as sector_timeout")
    found = crossings.candidates(adapters.fixes(spark, SF), gates, "toward", "projection")
    a = crossings.timing(found, TimerConfig(0, 24 * HOUR))
    b = crossings.timing(crossings.candidates(adapters.fixes(spark, SF), adapters.gates(spark), "toward", "projection"), TimerConfig(10_000_000, 24 * HOUR))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stamps_and_retention(spark):
    e = spark.createDataFrame([("",), ("x",), (None,)], "device string")
    assert [tuple(r) for r in crossings.stamped(e, TimerConfig(device_id="own", user_id="u")).collect()] == [("own", "u"), ("x", "u"), ("own", "u")]
    fixes = spark.createDataFrame([(1, i) for i in range(6)], "device_id long, arrival_ord long")
    events = spark.createDataFrame([(1, 1, "Sector", 1), (1, 1, "Lap", 1), (1, 1, "Sector", 4)], "device_id long, session_no int, type string, arrival_ord long")
    kept = sorted(r["arrival_ord"] for r in crossings.retained(fixes, events).collect())
    assert kept == [1, 2, 3, 4, 4] and crossings.retained(fixes, events, True).count() == 4


def test_timer_stream_equals_batch(spark, tmp_path):
    fixes = adapters.fixes(spark, SF).select("device_id", "arrival_ord", "ts", "lat", "lon").toPandas().sort_values("arrival_ord")
    want = {tuple(r) for r in timing.queries()["timer_closed"](spark, SF).collect()}
    gates, config = adapters.GATES, TimerConfig(12 * HOUR, 24 * HOUR)
    for i, part in enumerate((fixes[:300], fixes[300:310], fixes[310:])):
        # Parts come in runs of their own: state outlives a run.
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = timer_stream.events(timer_stream.fixes(spark, str(tmp_path / "in"), 1), gates, config, interpolation="projection")
        timer_stream.run(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        assert i < 3
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_timer_stream_by_centre(spark, tmp_path):
    fixes = adapters.fixes(spark, SF).select("device_id", "arrival_ord", "ts", "lat", "lon")
    fixes.coalesce(1).write.parquet(str(tmp_path / "in"))
    config = TimerConfig(12 * HOUR, 24 * HOUR)
    timer_stream.run(timer_stream.events(timer_stream.fixes(spark, str(tmp_path / "in")), adapters.GATES, config), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    want = crossings.timing(crossings.candidates(adapters.fixes(spark, SF), adapters.gates(spark)), config).toPandas()
    both = got.merge(want, on=["device_id", "session_no", "ord", "type", "lap", "sector"])
    # Sines and cosines of the two may differ in their last bit: a microsecond or so in hours.
    assert len(both) == len(got) == len(want) and (both.event_us_x - both.event_us_y).abs().max() <= 1000


def test_board_stream_equals_batch(spark, tmp_path):
    m = adapters.messages(spark, SF).select(*[c.split()[0] for c in board_stream.MESSAGES.split(", ")]).toPandas().sort_values("arrival")
    told = []
    for part in (m[:400], m[400:700], m[700:]):
        kind = ", ".join(board_stream.MESSAGES.split(", "))
        frame = spark.createDataFrame([tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in part.itertuples(index=False)], kind)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        board_stream.run(board_stream.messages(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check"), lambda rows, n: told.append((n, rows.count())))
    got = {tuple(r) for r in board_stream.current(spark, str(tmp_path / "out")).collect()}
    log = spark.read.parquet(str(tmp_path / "in"))
    assert got == {tuple(r) for r in board_stream.rank(log).collect()} and [n for n, _ in told] == [0, 1, 2]
    nested = spark.createDataFrame([(1, 2, "n", None, [(5, 6)])], "session_id long, device_id long, display_name string, category string, events array<struct<arrival: long, id: long>>")
    assert tuple(board_stream.envelopes(nested).first()) == (1, 2, "n", None, 5, 6)
