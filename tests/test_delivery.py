import json

import pytest
from pyspark.sql import functions as F

from sectorline.operators import circuits, sessions
from sectorline.operators.crossings import TimerConfig
from sectorline.plans import adapters
from sectorline.sources import native as source
from sectorline.streaming import delivery
from sectorline.streaming import native as stream

SF = "/root/testdata/sf0.001"


def test_delivery_is_in_order_and_repeats_under_the_same_ids(spark, tmp_path):
    rows = delivery.wire(adapters.timing_events(spark, SF).filter("ord < 200"))
    rows.coalesce(3).write.parquet(str(tmp_path / "in"))
    seen = str(tmp_path / "seen")

    def send(device, found, seen=seen, broken=str(tmp_path / "broken")):
        import os

        if not os.path.exists(broken):
            open(broken, "w").close()
            raise OSError("the hub is away")
        with open(f"{seen}-{device}-{os.getpid()}", "a") as f:
            f.write(json.dumps([[r["id"], r["ord"]] for r in found]) + "\n")

    source_ = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    delivery.deliver(source_, send, str(tmp_path / "check"), pause_s=0.01)
    got = {}
    for p in tmp_path.glob("seen-*"):
        found = [x for line in p.read_text().splitlines() for x in json.loads(line)]
        assert [o for _, o in found] == sorted(o for _, o in found)
        got |= {i: o for i, o in found}
    assert got == {r["id"]: r["ord"] for r in rows.collect()}
    assert delivery.reconnects() == [2.0, 4.0, 8.0, 16.0, 32.0] and delivery.backoff(3) == 3.0 and delivery.backoff(40) == 10.0


def test_failures_are_raised(tmp_path):
    def send(device, rows):
        raise OSError("away")

    with pytest.raises(OSError):
        delivery._send(send, "d", [], 3, 0.0)


def test_lines_as_they_come(spark, tmp_path):
    events = adapters.timing_events(spark, SF).filter("ord < 50").select("ts", "type", F.col("lap").cast("int").alias("lap"), "sector", "time_ticks")
    data = adapters.fixes(spark, SF).filter("arrival_ord < 50").select("ts", F.array("lat", "lon").alias("data"))
    events.write.parquet(str(tmp_path / "e"))
    data.write.parquet(str(tmp_path / "d"))
    both = stream.lines(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), spark.readStream.schema(data.schema).parquet(str(tmp_path / "d")), ("Latitude", "Longitude"))
    stream.run(both, str(tmp_path / "out"), str(tmp_path / "check"), ("Latitude", "Longitude"))
    got = source.read_all(spark, str(tmp_path / "out" / "trigger=0"))
    assert got.channels == ["Latitude", "Longitude"] and got.events.count() == events.count() and got.data.count() == data.count()


def test_control():
    timer = sessions.Control(TimerConfig(0, 100))
    with pytest.raises(ValueError):
        timer.create()
    assert timer.feed(0, [], 1) == []
    timer.set_circuit("a")
    timer.create()
    timer.feed(0, [], 1)
    assert [e[0] for e in timer.feed(2, [(1, 1, 1)], 1)] == [1, 1]
    timer.pause()
    assert timer.feed(4, [(3, 1, 1)], 1) == []
    timer.start()
    assert len(timer.feed(6, [(5, 1, 1)], 1)) == 2
    timer.set_circuit("b")
    assert timer.feed(8, [(7, 1, 1)], 1) == [] and timer.session is None
    assert timer.feed(9, [(9, 1, 1)], 1)[0][0] == 2


def test_blank_devices_are_an_error(spark):
    e = spark.createDataFrame([(1, " ", 1, "Lap", "c")], "session_id int, device_id string, ord int, type string, circuit_code string")
    with pytest.raises(Exception, match="blank"):
        sessions.device_sessions(e).collect()
    e = spark.createDataFrame([(1, "d", 1, "Lap", "c"), (1, "x", 1, "Position", "c")], "session_id int, device_id string, ord int, type string, circuit_code string")
    drivers = spark.createDataFrame([("d", "Ann")], "device_id string, driver string")
    assert [tuple(r) for r in sessions.device_sessions(e, drivers).collect()] == [(1, "d", "Ann", "Ann", "Unknown", "c")]


def test_circuit_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"code": "a", "name": "A"}, {"code": "B", "name": "B"}, {"code": "b", "name": "Later"}, {"code": " ", "name": "x"}]')
    got = {r["code_key"]: r["name"] for r in circuits.index(circuits.load(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {"a": "A", "b": "Later"}
