import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sectorline.functions import fmt, geo
from sectorline.operators import board, crossings
from sectorline.plans import queries as timing

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted([repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in plain.values.tolist()])


@pytest.mark.parametrize("name", sorted(timing.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as from '{SF}/events.parquet'")
    mine = timing.queries()[name](spark, SF).toPandas()
    theirs = con.sql(timing.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_intersection(spark):
    line, other = tuple(map(F.lit, (0.0, 0.0, 1.0, 0.0))), tuple(map(F.lit, (0.5, -1.0, 0.5, 1.0)))
    got = spark.range(1).select(*[geo.intersection(line, other, d).alias(d) for d in ("any", "toward", "away")]).first()
    assert tuple(got["any"]) == (0.5, 0.0)
    assert (got["toward"] is None) != (got["away"] is None)
    parallel = spark.range(1).select(geo.intersection(line, tuple(map(F.lit, (0.0, 1.0, 1.0, 1.0))))).first()[0]
    assert parallel is None


def test_format_time(spark):
    ticks = [None, 0, 15_000_000, 123_456_789, 612_340_000, -612_340_000]
    df = spark.createDataFrame([(t,) for t in ticks], "t long").select(fmt.format_time(F.col("t"), "-"))
    assert [r[0] for r in df.collect()] == ["-", "0.000", "1.500", "12.345", "1:01.234", "1.234"]


def test_ties_take_over_a_best(spark):
    columns = "session_id int, device_id int, device_ord int, ord int, ts int, type string, sector int, time_ticks long, lap int, deleted boolean"
    data = [(1, 1, 1, 1, 1, "Lap", 0, 50, 1, False), (1, 2, 2, 2, 2, "Lap", 0, 50, 1, False), (1, 2, 2, 3, 3, "Lap", 0, 60, 2, False)]
    got = {r["ord"]: r for r in board.best_flags(spark.createDataFrame(data, columns)).collect()}
    assert got[2]["was_overall_best"] and not got[3]["was_personal_best"]


def dense(fixes, cooldown, idle, n):
    """The same rules, fix by fix; fixes: (ts, [(cross, sector)])."""
    out, last, prev, session, laps, lap_at, active = [], None, False, 0, 0, None, False
    for ts, hits in fixes:
        if prev and not (active and last is not None and last + cooldown > ts):
            for cross, sector in hits:
                if not active:
                    session, laps, lap_at, active, last = session + 1, 0, None, True, None
                number = 0 if lap_at is None else laps + 1
                out.append((session, "Sector", number, cross, 0 if last is None else cross - last))
                if sector == n:
                    out.append((session, "Lap", number, cross, 0 if lap_at is None else cross - lap_at))
                    laps, lap_at = number, cross
                last = cross
            cleared = active and last + idle < ts
            if cleared:
                active, last = False, None
            prev = not cleared
            continue
        prev = True
    return out


def test_fold_matches_the_loop_over_all_fixes():
    rng = random.Random(3)
    for _ in range(2000):
        cooldown, idle, ts, fixes = rng.randint(0, 6), rng.randint(1, 8), 0, []
        for _ in range(rng.randint(1, 14)):
            gap = rng.randint(0, 7)
            hits = [(ts + rng.randint(0, gap), s) for s in sorted(rng.sample((1, 2, 3), rng.choice((0, 0, 1, 2))))] if fixes else []
            ts += gap
            fixes.append((ts, hits))
        found = [
            (i, t, fixes[i - 1][0], fixes[i - 2][0] if i > 1 else None, cross, s, 3)
            for i, (t, hits) in enumerate(fixes)
            for cross, s in hits
        ]
        got = crossings.fold(found, crossings.TimerConfig(cooldown, idle))
        assert [(e[0], e[2], e[3], e[5], e[6]) for e in got] == dense(fixes, cooldown, idle, 3)
