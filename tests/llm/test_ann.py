import numpy as np
import pytest

from sectorline.llm import ann
from sectorline.llm.common import by_length, clean_vectors, saved

KIND = "vec_id long, embedding array<float>"


def brute(rows, every=20, k=20):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float(np.cumsum(v * w)[-1]), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(by.get(q, set()) & set(w)) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def clustered(n=3000, centres=48, d=24, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d)) * 3
    return (c[rng.integers(0, centres, n)] + 0.5 * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("levels", [1, 2])
def test_few_parts_are_visited_where_vectors_have_structure(spark, monkeypatch, levels):
    monkeypatch.setattr(ann, "PART_ROWS", 100 if levels == 1 else 60)
    monkeypatch.setattr(ann, "WIDTH", 256 if levels == 1 else 8)
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    rows = {i: v.astype(float) for i, v in enumerate(x)}
    vectors = saved(clean_vectors(df, True), "v")
    tree = ann.grow(vectors, 20, 2000, 0.95)
    assert bool(tree.below) == (levels == 2)
    filed = np.array([p[0] for p in tree.visits(x.astype(float))])
    size = dict(zip(*np.unique(filed, return_counts=True), strict=True))
    visits = tree.visits(x[::20].astype(float))
    assert np.mean([sum(size.get(p, 0) for p in v) for v in visits]) < len(x) / 4
    assert recall(ann.search(df, sample=2000).collect(), brute(rows)) >= 0.9


def test_recall_at_a_tenth(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["embedding"] and any(r["embedding"])}
    assert recall(ann.search(df).collect(), brute(rows)) >= 0.9


def test_hygiene(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 5)
    monkeypatch.setattr(ann, "NUMBERS", 16 * 20)
    monkeypatch.setattr(ann, "SCORES", 64)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)] + [(2300, [2.0, 1.0]), (2301, [1.0, -1.0])]
    odd = [(2000, None), (2050, [0.0] * 16), (2100, [None] * 16), (2150, [float("nan")] * 16), (2200, [1.0]), (None, [1.0] * 16), (2400, [])]
    df = spark.createDataFrame(good + odd + [(20, x[20].tolist())], KIND)
    rows = {i: np.array(v, float) for i, v in good} | {2200: np.array([1.0])}
    got = ann.search(df).collect()
    assert recall(got, brute(rows)) >= 0.9
    for r in got:
        assert abs(rows[r["query_id"]] @ rows[r["vec_id"]] - r["score"]) < 1e-9 and r["query_id"] != r["vec_id"]
    assert {r["vec_id"] for r in got if r["query_id"] == 2300} == {2301} and 2200 not in {r["query_id"] for r in got}
    ranks = [(r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == 0]
    assert sorted(ranks) == sorted(ranks, key=lambda r: r[1:]) and [r[0] for r in sorted(ranks)] == list(range(1, 21))
    assert ann.search(df.limit(0)).count() == 0 and len(by_length(clean_vectors(df.limit(0), True))) == 0
