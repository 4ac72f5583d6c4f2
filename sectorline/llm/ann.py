"""Approximate nearest neighbours over learned partitions.

On a bounded sample: the graph of nearest neighbours is cut by recursive spectral bisection into parts of
equal size, and a two-layer network learns which parts hold a vector's neighbours. Every row of the table is
filed under its most probable part; a query visits its most probable parts and is scored exactly there. The
number of parts grows with the table: up to WIDTH parts on one level, and beyond that each part is cut again
by a model of its own, fitted on a bounded sample of that part by one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_length, clean_vectors, saved

#: Queries, and numbers in the vectors of candidates, that one task scores at once; larger parts are cut into several blocks.
QUERIES, NUMBERS = 4096, 1 << 22
#: Scores that a task holds at once.
SCORES = 1 << 22
#: Parts of a table, at least, if its sample has as many; rows of a part, on average, in larger tables; parts of a level at most.
LEAST_PARTS, PART_ROWS, WIDTH = 16, 65536, 256
#: Every so many rows of a sample are kept out of the fit and choose the number of parts to visit.
KEPT_OUT = 5
OUT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    scale: float
    probes: int
    recall: float

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row of x, most probable first."""
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node; sizes differ by one at most on each level (parts: a power of two)."""
    n = len(near)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    label = np.zeros(n, np.int64)
    while label.max() + 1 < parts:
        inside = label[src] == label[dst]
        s, d = src[inside], dst[inside]
        degree = np.maximum(np.bincount(s, minlength=n), 1.0)
        x = rng.standard_normal(n)
        size = np.bincount(label)
        for _ in range(60):
            x = 0.5 * x + 0.5 * np.bincount(s, x[d], n) / degree
            x -= (np.bincount(label, x) / size)[label]
            x /= np.sqrt(np.bincount(label, x * x) / size)[label] + 1e-12
        order = np.lexsort((x, label))
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - begin[label[order]]
        label = 2 * label + (rank >= (size // 2)[label])
    return label


def fit(x: np.ndarray, parts: int, k: int, target: float, seed: int = 7, steps: int = 600) -> Router:
    """x: distinct sample vectors. Probes: the fewest whose parts hold `target` of the k nearest sample
    rows of those sample rows that the model was not fitted on."""
    rng = np.random.default_rng(seed)
    every = x
    out = rng.permutation(len(x))[: len(x) // KEPT_OUT]
    x = np.delete(x, out, axis=0)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    near = neighbours(x, k)
    label = balanced_parts(near, parts, rng)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0 / near.shape[1])
    soft = 0.5 * soft + 0.5 * np.eye(parts)[label]
    z = (x - mean) / scale
    p = [
        rng.standard_normal((x.shape[1], 64)) / np.sqrt(x.shape[1]),
        np.zeros(64),
        rng.standard_normal((64, parts)) / 8,
        np.zeros(parts),
    ]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        i = rng.integers(0, len(x), 256)
        h = np.maximum(z[i] @ p[0] + p[1], 0)
        o = h @ p[2] + p[3]
        e = np.exp(o - o.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - soft[i]) / len(i)
        gh = (g @ p[2].T) * (h > 0)
        for a, d in enumerate((z[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
            m[a] = 0.9 * m[a] + 0.1 * d
            v[a] = 0.999 * v[a] + 0.001 * d * d
            p[a] = p[a] - 0.01 * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-8)
    router = Router(*p, mean, scale, parts, 1.0)
    order = router.order(every)
    held = order[:, 0][neighbours(every, k)[out]]
    place = np.argsort(order[out], axis=1)  # of each part in a row's order
    rank = np.take_along_axis(place, held, axis=1)
    for probes in range(1, parts + 1):
        recall = float((rank < probes).mean())
        if recall >= target:
            break
    return Router(*p, mean, scale, probes, recall)


def single(d: int) -> Router:
    """A router with one part."""
    return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), np.zeros(d), 1.0, 1, 1.0)


def fitted(rows: np.ndarray, n: int, k: int, target: float, least: int = 1) -> Router:
    """The router of a part with n rows, of which `rows` are a sample: `least` parts, or more of PART_ROWS rows, as far as
    the sample tells them apart."""
    x = np.unique(rows, axis=0)
    parts = min(max(least, -(-n // PART_ROWS)), len(x) // (2 * k), WIDTH)
    return fit(x, 1 << (parts.bit_length() - 1), k, target) if parts > 1 else single(x.shape[1])


@dataclass(frozen=True)
class Tree:
    """A router, and one for each of its parts that is cut again."""

    top: Router
    below: dict[int, Router]

    def visits(self, x: np.ndarray, all_parts: bool = False) -> list[list[int]]:
        """The parts that each row of x visits, most probable first; the first one is where it is filed."""
        order = self.top.order(x)
        order = order if all_parts else order[:, : self.top.probes]
        inner: dict[int, np.ndarray] = {p: r.order(x) for p, r in self.below.items() if (order == p).any()}
        out = []
        for i, row in enumerate(order):
            mine = []
            for p in row.tolist():
                r = self.below.get(p)
                some = [0] if r is None else inner[p][i][: None if all_parts else r.probes].tolist()
                mine += [p * WIDTH + s for s in some]
            out.append(mine)
        return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component so that equal vectors score equally everywhere."""
    return np.cumsum(c * q, axis=1)[:, -1]


def grow(vectors: DataFrame, k: int, sample: int, target: float) -> Tree:
    """The model of a table of vectors of one length, saved; at most `sample` rows of each level-1 part reach its fit."""
    spark = vectors.sparkSession
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    top = fitted(np.array([r["v"] for r in rows]), n, k, target, LEAST_PARTS)
    if n <= WIDTH * PART_ROWS:
        return Tree(top, {})
    held = spark.sparkContext.broadcast(top)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=held.value.order(np.stack(b["v"].to_numpy()))[:, 0].astype(np.int32))

    filed = saved(vectors.mapInPandas(first, "vec_id long, v array<double>, part int"), "first-level")
    sizes = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}  # WIDTH rows at most
    w = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = filed.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= sample)

    def second(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        router = fitted(np.stack(group["v"].to_numpy()), sizes[int(key[0])], k, target)
        return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(router)]})

    # A router takes some 200 KB, and there are WIDTH of them at most.
    found = some.groupBy("part").applyInPandas(second, "part int, router binary").collect()
    return Tree(top, {r["part"]: pickle.loads(r["router"]) for r in found})


def search(embeddings: DataFrame, every: int = 20, k: int = 20, sample: int = 8192, target: float = 0.93) -> DataFrame:
    """embeddings (vec_id, embedding) -> (query_id, rank int, vec_id, score double), nearest first.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of another vec_id;
    nearness is the inner product in double precision, ties go to the smaller vec_id. Models are fitted on
    at most `sample` rows, chosen by a hash of their id; every row is filed. A query that finds fewer than k
    candidates in the parts it visits visits all of them. Rows that clean_vectors leaves out (zero vectors
    among them) take no part, and vectors of each length are searched by themselves; repeated query rows are
    one query, repeated candidate rows count each; other columns are ignored; an empty table gives no rows.
    """
    vectors = saved(clean_vectors(embeddings, drop_zero=True), "vectors")
    found = [_search(v, every, k, grow(v, k, sample, target)) for v in by_length(vectors)]
    return reduce(DataFrame.unionByName, found, embeddings.sparkSession.createDataFrame([], OUT))


def _search(vectors: DataFrame, every: int, k: int, tree: Tree) -> DataFrame:
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=[p[0] for p in model.value.visits(np.stack(b["v"].to_numpy()))])

    def visit(whole: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(part=model.value.visits(np.stack(b["v"].to_numpy()), whole)).explode("part").astype({"part": "int64"})

        return run

    kind = "vec_id long, v array<double>, part long"
    index = saved(vectors.mapInPandas(file, kind), "index")
    queries = vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    rows = max(1, NUMBERS // len(tree.top.mean))
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("c_blocks"))

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(cs):
            ids, c = cs["vec_id"].to_numpy(np.int64), np.stack(cs["v"].to_numpy())
            slack = 1e-12 * np.abs(c).sum(axis=1).max()
            tile = max(1, SCORES // len(c))
            for i in range(0, len(qs), tile):
                some = qs.iloc[i : i + tile]
                q = np.stack(some["v"].to_numpy())
                near = q @ c.T
                for j, query in enumerate(some["vec_id"]):
                    s = np.where(ids == query, -np.inf, near[j])
                    least = -np.partition(-s, k - 1)[k - 1] if len(s) > k else -np.inf
                    own = np.flatnonzero((s >= least - slack * np.abs(q[j]).max()) & (ids != query))
                    exact = _exact(q[j], c[own])
                    best = np.lexsort((ids[own], -exact))[:k]
                    rows += [(query, ids[own[b]], exact[b]) for b in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def found_in(asked: DataFrame) -> DataFrame:
        """asked: (vec_id, v, part) -> the best of each block of queries and candidates, then those of all blocks."""
        asked = saved(asked, "asked")
        both = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_blocks")).join(sizes, "part")
        grid = saved(both, "grid")
        block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(grid, "part").withColumn("qb", block("q_blocks")).withColumn("cb", other("c_blocks"))
        c = index.join(grid, "part").withColumn("cb", block("c_blocks")).withColumn("qb", other("q_blocks"))
        key = ["part", "qb", "cb"]
        hits = q.select(*key, "vec_id", "v").groupBy(*key).cogroup(c.select(*key, "vec_id", "v").groupBy(*key))
        hits = hits.applyInPandas(score, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return best.select("query_id", "rank", "vec_id", "score")

    first = saved(found_in(queries.mapInPandas(visit(False), kind)), "found")
    full = first.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = saved(queries.join(full.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return first
    again = found_in(short.mapInPandas(visit(True), kind))
    return first.join(full, "query_id", "left_semi").unionByName(again)
