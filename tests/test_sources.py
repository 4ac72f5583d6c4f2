import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from sectorline.sources import delimited, laps_csv, lines, native, registry, replay

O = delimited.DelimitedOptions  # noqa: E741
START = 1_735_689_600_000_000


def put(path, text):
    path.write_text(text)
    return str(path)


def us(df):
    return [r["us"] for r in df.withColumn("us", F.unix_micros("ts")).orderBy("file", "block", "line").collect()]


def test_delimited(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'Some preamble\n"Time","Lat","Longitude","Vms","Note, With Comma"\n1735689600000.123,50.1,5.1,10,7\n# no\n1735689601.5,50.2,5.2,x,"1,000"\n2025-01-01T00:00:02Z,,5.2,1,1\n2025-01-01T00:00:03Z,50.3,5.3,,\nshort\n')
    o = O(names={"Latitude": "Lat", "Speed": "Vms"}, speed_factor=3.6, ignored=("Nothing",))
    found = delimited.read(spark, path, o)
    rows = found.orderBy("line").collect()
    assert us(found) == [START + 123, START + 1_500_000, START + 3_000_000]
    assert [r["speed"] for r in rows] == [36.0, None, None] and delimited.max_speed(found) == 36.0
    assert rows[1]["data"] == {"Note, With Comma": 1000.0}
    assert delimited.channels(spark, path, o) == ["Time", "Lat", "Longitude", "Vms", "Note, With Comma"]
    with pytest.raises(ValueError):
        delimited.read(spark, put(tmp_path / "none.csv", "a,b\n1,2\n"), o)


def test_markers_signatures_and_prefixes(spark, tmp_path):
    path = put(tmp_path / "a.txt", "MYFMT,1\nhello\nTime;Latitude;Longitude\n1;9;9\nBEGIN\nMETA;1;1\n# x\n1735689600;50;5\n1735689601;51;5\nMYFMT,2\nTime;Latitude;Longitude\n")
    o = O(delimiter=";", file_signature="MYFMT", channels_signature="Time;", data_starts_after="BEGIN", not_data=("META",))
    assert [r["lat"] for r in delimited.read(spark, path, o).orderBy("line").collect()] == [50.0, 51.0]
    assert delimited.is_compatible(spark, path, o) and not delimited.is_compatible(spark, path, O(file_signature="OTHER"))


def test_times(spark, tmp_path):
    path = put(tmp_path / "a.csv", "Latitude,Longitude,Speed\n1,1,1\n2,2,-2\n3,3,\n")
    assert us(delimited.read(spark, path, O(seed_us=START))) == [START + 20_000 * i for i in (1, 2, 3)]
    assert us(delimited.read(spark, path, O(seed_us=START, resolution=10))) == [START + 100_000 * i for i in (1, 2, 3)]
    path = put(tmp_path / "b.csv", "Time,Latitude,Longitude\n2025-01-01T00:00:01.5Z,1,1\n,2,2\n2025-01-01T02:00:02+02:00,3,3\n")
    assert us(delimited.read(spark, path, O(iso=True, seed_us=START))) == [START + 1_500_000, START + 20_000, START + 2_000_000]


def test_event_lines(spark, tmp_path):
    path = put(tmp_path / "a.csv", "Time,Latitude,Longitude\n!early\n1735689600,1,1\n!lap 1\n1735689602,2,2\n1735689603,3,3\n!lap 2\n")
    event = lambda line: F.when(F.startswith(line, F.lit("!")), F.struct(F.substring(line, 2, 20).alias("what")))
    got = delimited.events(spark, path, event).withColumn("us", F.unix_micros("ts")).orderBy("line").collect()
    assert [(r["what"], r["us"]) for r in got] == [("early", None), ("lap 1", START), ("lap 2", START + 3_000_000)]
    assert delimited.read(spark, path, None, event).count() == 3


def test_archives_and_folders(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, lat in (("Data.csv", 50.1), ("ignore_this.csv", 1.0), ("deep/data.csv", 2.0), ("note.txt", 3.0)):
            z.writestr(name, f"Latitude,Longitude\n{lat},5.1\n")
    o = O(include="*.csv", exclude=("IGNORE",))
    assert [(r["lat"], r["lon"]) for r in delimited.read(spark, str(tmp_path / "a.zip"), o).collect()] == [(50.1, 5.1)]
    (tmp_path / "d").mkdir()
    for name, speed in (("b.csv", 3), ("A.csv", 9), ("ignore.csv", 50), ("x.txt", 60)):
        put(tmp_path / "d" / name, f"Latitude,Longitude,Speed\n1,1,{speed}\n")
    found = delimited.read(spark, str(tmp_path / "d"), o)
    assert found.count() == 2 and delimited.max_speed(found) == 3.0
    assert lines.fingerprint(spark, str(tmp_path / "d" / "b.csv")).first()["md5"] == __import__("hashlib").md5(b"Latitude,Longitude,Speed\n1,1,3\n").hexdigest()


@pytest.fixture
def session(spark):
    t = datetime.datetime(2025, 1, 1)
    events = spark.createDataFrame([(t, "Lap", 1, 0, 123), (t, "Sector", 1, 2, 45), (t, "Sector", 1, 1, 44), (t, "Position", 0, 0, 1)], "ts timestamp, type string, lap int, sector int, time_ticks long")
    data = spark.createDataFrame([(t, [1.5, None, 3.0]), (t + datetime.timedelta(milliseconds=20), [2.5])], "ts timestamp, data array<double>")
    return events, data


def test_native_round_trip(spark, tmp_path, session):
    events, data = session
    native.write(events, data, ["Latitude", "Speed"], str(tmp_path / "n"), circuit_code="abc", more=("Note=1",))
    got = native.read_all(spark, str(tmp_path / "n"))
    assert got.channels == ["Latitude", "Speed"] and got.circuit_code == "abc"
    assert got.data.orderBy("ts").collect()[0]["data"] == [1.5, None] and got.data.orderBy("ts").collect()[1]["data"] == [2.5, None]
    assert got.fixes.orderBy("ts").first()["lat"] == 1.5 and got.events.exceptAll(events).isEmpty() and events.exceptAll(got.events).isEmpty()
    text = [x["value"] for x in lines.read(spark, str(tmp_path / "n")).orderBy("line").collect()]
    kinds = [x.split(",")[1:4] for x in text if x.startswith("#Event=")]
    assert kinds == [["Position", "0", "0"], ["Sector", "1", "1"], ["Sector", "1", "2"], ["Lap", "1", "0"]]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        native.write(events, data, [], str(tmp_path / "n"))
    native.write(events, data, ["Latitude", "Speed"], str(tmp_path / "n"), mode="append")
    assert native.read_all(spark, str(tmp_path / "n")).events.count() == 8


def test_native_archives(spark, tmp_path, session):
    row = native.pack(*session, ["Latitude"], "run7.zip").first()
    (tmp_path / row["name"]).write_bytes(row["content"])
    assert zipfile.ZipFile(tmp_path / "run7.zip").namelist() == ["run7.lz"]
    got = native.read_all(spark, str(tmp_path / "run7.zip"))
    assert got.channels == ["Latitude"] and got.events.count() == 4 and got.data.count() == 2
    assert native.is_native(spark, str(tmp_path / "run7.zip")) and not native.is_native(spark, put(tmp_path / "x.txt", "no\n"))
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    with pytest.raises(ValueError):
        native.read_all(spark, str(tmp_path / "empty.zip"))
    assert [native.entry_name(*x) for x in ((None,), ("a/b.c.zip",), (None, "o.csv"))] == ["data.lz", "b.c.lz", "o.lz"]


def test_malformed_native_lines(spark, tmp_path):
    path = put(tmp_path / "n", "#Format=x\n5,1\n#Event=1,lap,1,0,9\n#Event=bad\n#Other\n#Fields=A, B,,C\n1000,1,x\nz,1,2,3\n2000,1,2,3,4\n#Event=2,Sector,1,1,8\n")
    got = native.read_all(spark, path)
    assert got.channels == ["A", "B", "C"] and sorted(r["type"] for r in got.events.collect()) == ["Lap", "Sector"]
    assert [r["data"] for r in got.data.orderBy("ts").collect()] == [[1.0, None, None], [1.0, 2.0, 3.0]]


def test_registry(spark, tmp_path):
    own = registry.standard()
    own.add_format("mine", O(delimiter=";", file_signature="MINE", channels_signature="Lat", names={"Latitude": "Lat", "Longitude": "Lon"}))
    mine = put(tmp_path / "m.txt", "MINE\nLat;Lon\n1;2\n")
    plain = put(tmp_path / "p.csv", "Latitude,Longitude\n3,4\n")
    row = put(tmp_path / "n.txt", "#Format=x\n#Fields=Latitude,Longitude\n1000,5,6\n")
    assert [own.find(spark, p)[0] for p in (mine, plain, row)] == ["mine", "delimited", "native"]
    assert [own.read(spark, p).first()["lat"] for p in (mine, plain, row)] == [1.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        own.find(spark, put(tmp_path / "z.txt", "nothing\n"))


def test_replay(spark, tmp_path):
    path = put(tmp_path / "r.csv", '# x\nTime,LATITUDE,Longitude,Speed,Distance\n1,50,5,36,10\n2,0.5,5,36,11\n3,51,5,72,14\n4,52,5,0,20\n')
    got = replay.recorded(spark, path).orderBy("line").collect()
    assert [(r["lat"], r["speed"], r["distance"]) for r in got] == [(50.0, 10.0, 0.0), (51.0, 20.0, 4.0), (52.0, 0.0, 6.0)]
    assert [r["lat"] for r in replay.recorded(spark, path, skip=1, guard=False).orderBy("line").collect()] == [0.5, 51.0, 52.0]
    path = put(tmp_path / "g.csv", "DeviceId;Timestamp;Type;LapNumber;SectorNumber;TimeFull;Time;IsPersonnalBest;IsBestOverall\nD1;-5;Lap;1;0;647745000;64,77;True;False\n")
    assert tuple(replay.golden(spark, path, 1_000_000).select("device_id", F.unix_micros("ts"), "time_ticks", "expected_personal", "expected_overall").first()) == ("D1", 995_000, 647_745_000, True, False)


def test_texts_of_the_lap_file(spark):
    got = spark.range(1).select(
        *[laps_csv.span_text(F.lit(t).cast("long")) for t in (0, 647_745_000, -36_000_000_000, 900_000_000_000)], *[laps_csv.number_text(F.lit(x)) for x in (0.0, 0.5, -0.25, 12.0, 1.234567, -3.0, 100.0)], laps_csv.number_text(F.lit(None).cast("double"))
    ).first()
    assert tuple(got) == ("00:00:00", "00:01:04.7745000", "-01:00:00", "1.01:00:00", "", ".5", "-.25", "12", "1.23457", "-3", "100", "")
