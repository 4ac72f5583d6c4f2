"""What the operators share: the shared folder, checkpoints, connected components, vector hygiene."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links that the driver connects by itself, 4 MB of them; the plans of rounds over a smaller graph take more of its memory.
LINKS = 1 << 18
#: Bytes of a batch of rows that Python workers get.
BATCH = 8 << 20
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Where that is unset, a temporary folder serves if driver and executors are one process (local[n]);
    on a cluster, whose machines would not share it, a ValueError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = "file://" + tempfile.mkdtemp(prefix="shared-")
            _WRITTEN.add(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Holds what Python workers get at once to BATCH bytes, unless the session is set to less: texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if now.isdigit() and int(now) > BATCH:
        spark.conf.set(name, f"{BATCH}b")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is there goes with `discard`, or else when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.saved_at)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_WRITTEN):
            with contextlib.suppress(Exception):  # the driver ends: what cannot go now stays
                remove(spark, path)


def opened(path: str):
    """A file of any store, for reading ranges."""
    from pyarrow import fs

    uri = "file://" + path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path
    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def _connected(star: DataFrame) -> DataFrame:
    """components() of distinct links that fit the driver."""
    table = star.toArrow()
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    p = np.arange(len(nodes))
    while (p[u] != p[v]).any():
        np.minimum.at(p, np.maximum(p[u], p[v]), np.minimum(p[u], p[v]))
        while (p[p] != p).any():
            p = p[p]
    moved = p != np.arange(len(nodes))
    out = pa.table({"node": pa.array(nodes[moved], pa.int64()), "root": pa.array(nodes[p[moved]], pa.int64())})
    return star.sparkSession.createDataFrame(out, "node long, root long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) long pairs -> (node, root): each node that reaches a smaller one, and the smallest that it reaches.

    Alternates the two star operations of Kiveris et al., "Connected Components in MapReduce and
    Beyond"; every round is written to the shared folder. Rounds grow with the logarithm of the longest path. Up to LINKS
    links need no rounds: the driver connects them.
    """
    star = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name
    )
    if star.count() <= LINKS:
        return saved(_connected(star), name)
    state = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        before, star = star, saved(small.filter("a <> b").distinct(), name)
        discard(before)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)


def clean_vectors(embeddings: DataFrame, drop_zero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part in a search.

    Left out: null ids, null or empty vectors, those with null or non-finite components, and zero vectors if
    `drop_zero`.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite
    )
    return out.filter(F.exists("v", lambda x: x != 0)) if drop_zero else out


def by_length(vectors: DataFrame) -> list[DataFrame]:
    """The vectors of each length by themselves: those of different lengths have no inner product."""
    lengths = sorted(r[0] for r in vectors.select(F.size("v")).distinct().collect())
    return [vectors] if len(lengths) == 1 else [vectors.filter(F.size("v") == n) for n in lengths]
