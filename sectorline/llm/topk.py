"""Exact top-k by distributed histogram selection.

Every task holds a tile of candidates of bounded size and reads the queries, a block at a time, from the shared
folder; so one job scores all queries against all candidates, whatever their number. It is done several times: each
pass returns, for a query, the histogram bins from the top down to the tile's own kth value - the global kth value
cannot lie lower - and the summed histogram narrows the query's range until a bin is one integer wide. The last
pass keeps what lies at or above the kth value, and of its ties each tile's k smallest ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_length, clean_vectors, opened, saved

BINS = 4096
#: Candidates of a tile, queries of a block, and scores that a task holds at once.
TILE, BLOCK, SCORES = 65_536, 4096, 1 << 22
EXACT = 2.0**53
OUT = "query_id long, rank int, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as double."""
    return clean_vectors(embeddings, drop_zero=False).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v")
    )


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(object)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, lows) of BLOCK queries at a time, from the Parquet files of a saved table."""
    from pyarrow import parquet

    for name in files:
        with opened(name) as file:
            for b in parquet.ParquetFile(file).iter_batches(BLOCK, columns=["vec_id", "v", "low"]):
                if b.num_rows:
                    yield b.column("vec_id").to_numpy(), _vectors(b.column("v")), b.column("low").to_numpy()


def _over_tiles(candidates: DataFrame, asked: DataFrame, use: Callable, names: list[str]) -> DataFrame:
    """The rows that use(query, low, scores, ids) gives for each query and tile, as columns of longs."""
    files = asked.inputFiles()

    def done(ids: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // len(c))
        for queries, vectors, lows in _blocks(files):
            out: list[tuple] = []
            for i in range(0, len(queries), step):
                for q, low, s in zip(queries[i : i + step].tolist(), lows[i : i + step].tolist(), _scores(vectors[i : i + step], c), strict=True):
                    out += use(q, low, s, ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for i in range(0, b.num_rows, TILE):
                held.append(b.slice(i, TILE))
                if sum(x.num_rows for x in held) >= TILE:
                    yield from done(np.concatenate([x.column("vec_id").to_numpy() for x in held]), np.vstack([_vectors(x.column("v")) for x in held]))
                    held = []
        if sum(x.num_rows for x in held):
            held = [x for x in held if x.num_rows]
            yield from done(np.concatenate([x.column("vec_id").to_numpy() for x in held]), np.vstack([_vectors(x.column("v")) for x in held]))

    return candidates.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _search(candidates: DataFrame, every: int, k: int) -> DataFrame:
    """candidates: vectors of one length -> query_id, rank, vec_id, score."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    norm, most = candidates.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))), F.max(largest)).first()
    top = int(min((norm or 0.0) * (most or 0.0), 2.0**61)) + 1
    width = max(1, -(-(2 * top + 1) // BINS))
    asked = candidates.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    asked = saved(asked.withColumn("low", F.lit(-top).cast("long")), "asked")
    while True:

        def histogram(q: int, low: int, s: np.ndarray, ids: np.ndarray, width=width) -> list[tuple]:
            # Values under the range were ruled out by an earlier pass.
            bins = (s[ids != q] - low) // width
            bins = bins[bins >= 0]
            if len(bins) > k:
                bins = bins[bins >= np.partition(bins, len(bins) - k)[len(bins) - k]]
            found, n = np.unique(bins, return_counts=True)
            return [(q, int(b), int(m)) for b, m in zip(found, n, strict=True)]

        counts = _over_tiles(candidates, asked, histogram, ["query_id", "bin", "n"])
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        reached = counts.withColumn("above", F.sum("n").over(w)).groupBy("query_id")
        kth = reached.agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
        low = F.col("low") + F.coalesce("bin", F.lit(0)) * width
        # The last table stays until the driver ends: a lost task may have to read it again.
        asked = saved(asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", low.alias("low")), "asked")
        if width == 1:
            break
        width = max(1, -(-width // BINS))

    def keep(q: int, low: int, s: np.ndarray, ids: np.ndarray) -> list[tuple]:
        own = np.flatnonzero((s >= low) & (ids != q))
        return [(q, i, -n) for n, i in sorted((-int(s[x]), int(ids[x])) for x in own)[:k]]

    kept = _over_tiles(candidates, asked, keep, ["query_id", "vec_id", "score"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """embeddings (vec_id, embedding) -> (query_id, rank int, vec_id, score): the k highest integer inner products.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of another vec_id. Ties go
    to the smaller vec_id. Rows that clean_vectors leaves out are neither; vectors of different lengths have no
    product, so that each length is searched by itself. vec_ids are taken to be unique - a
    repeated candidate row counts again, a repeated query row is one query. Products outside the long range
    are clipped. Other columns are ignored; an empty table gives no rows.
    """
    table = saved(quantised(embeddings, scale), "quantised")
    found = [_search(v, every, k) for v in by_length(table)]
    return reduce(DataFrame.unionByName, found, embeddings.sparkSession.createDataFrame([], OUT))
