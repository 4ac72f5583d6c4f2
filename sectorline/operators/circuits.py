"""Circuit lookup and detection. Circuits (ord, code, name, lat1, lon1, lat2, lon2) are the caller's table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Circuits that are compared within a fix's row, and the degrees that a grid cell is wide.
MOST, CELL = 500, 0.05


def index(circuits: DataFrame) -> DataFrame:
    """One circuit for each code without regard to case, the last in order; blank codes are left out."""
    key = F.lower("code")
    w = Window.partitionBy(key).orderBy(F.desc("ord"))
    known = circuits.filter(F.trim("code") != "").withColumn("n", F.row_number().over(w))
    return known.filter("n = 1").drop("n").withColumn("code_key", key)


def load(spark, path: str) -> DataFrame:
    """Circuits of a JSON or Parquet file, with `ord` by their place where the file has none."""
    rows = spark.read.option("multiLine", "true").json(path) if path.endswith(".json") else spark.read.parquet(path)
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())


def by_code(rows: DataFrame, circuits: DataFrame, code: str = "code") -> DataFrame:
    names = index(circuits).select("code_key", F.col("name").alias("circuit_name"))
    return rows.withColumn("code_key", F.lower(code)).join(names, "code_key", "left").drop("code_key")


def detect(fixes: DataFrame, circuits: DataFrame) -> DataFrame:
    """fixes and circuit_code: the first circuit in order whose box holds the fix, null if none. Equal fixes stay apart.

    Up to MOST circuits are compared in each fix's row, without a shuffle; of more, those that can hold a fix are found by the
    cells of a grid that their boxes cover.
    """
    boxes = circuits.filter("lat1 is not null and lon1 is not null and lat2 is not null and lon2 is not null")
    boxes = boxes.select(
        "ord", "code", F.least("lat1", "lat2").alias("s"), F.greatest("lat1", "lat2").alias("n"), F.least("lon1", "lon2").alias("w"), F.greatest("lon1", "lon2").alias("e")
    )
    known = boxes.orderBy("ord").limit(MOST + 1).collect()
    if len(known) <= MOST:
        inside = [(F.col("lat").between(r["s"], r["n"]) & F.col("lon").between(r["w"], r["e"]), F.lit(r["code"])) for r in known]
        code = F.lit(None).cast("string")
        for hit, name in reversed(inside):
            code = F.when(hit, name).otherwise(code)
        return fixes.withColumn("circuit_code", code)
    cell = lambda c: F.floor(c / CELL)
    cover = boxes.withColumn("y", F.explode(F.sequence(cell(F.col("s")), cell(F.col("n"))))).withColumn("x", F.explode(F.sequence(cell(F.col("w")), cell(F.col("e")))))
    by = cover.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "s", "n", "w", "e"))).alias("boxes"))
    placed = fixes.withColumn("y", cell(F.col("lat"))).withColumn("x", cell(F.col("lon"))).join(by, ["y", "x"], "left")
    holds = lambda b: F.col("lat").between(b["s"], b["n"]) & F.col("lon").between(b["w"], b["e"])
    return placed.select(*fixes.columns, F.get(F.filter("boxes", holds), F.lit(0))["code"].alias("circuit_code"))


def first_detected(fixes: DataFrame, circuits: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, circuit_code): the circuit of each session's first fix that is inside one; sessions without one have no row."""
    found = detect(fixes, circuits).filter("circuit_code is not null")
    return found.groupBy(key).agg(F.min(F.struct("arrival_ord", "circuit_code"))["circuit_code"].alias("circuit_code"))


def changes(fixes: DataFrame, circuits: DataFrame, every_us: int = 2_000_000) -> DataFrame:
    """(device_id, arrival_ord, circuit_code) of the fixes at which a device's circuit changes.

    A device without a circuit is looked up at each fix, others when every_us have gone by since the last look; leaving all
    boxes changes nothing. The looks are a fold in order of arrival over a device's fixes. With an every_us of 0 each fix is
    looked up, whatever its time.
    """
    if every_us <= 0:
        inside = detect(fixes, circuits).filter("circuit_code is not null")
        last = F.lag("circuit_code").over(Window.partitionBy("device_id").orderBy("arrival_ord"))
        return inside.withColumn("__last", last).filter(~F.col("circuit_code").eqNullSafe(F.col("__last"))).select("device_id", "arrival_ord", "circuit_code")
    look = detect(fixes, circuits).select("device_id", "arrival_ord", F.unix_micros("ts").alias("us"), "circuit_code")

    def run(batches):
        now, code, seen = object(), None, None
        for b in batches:
            out = []
            for device, ord_, us, found in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if device != now:
                    now, code, seen = device, None, None
                if code is None or seen + every_us <= us:
                    seen = us
                    if found is not None and found != code:
                        code = found
                        out.append((device, ord_, code))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["device_id", "arrival_ord", "circuit_code"])

    placed = look.repartition("device_id").sortWithinPartitions("device_id", "arrival_ord")
    return placed.mapInArrow(run, "device_id long, arrival_ord long, circuit_code string")
