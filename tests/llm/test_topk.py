import numpy as np
import pytest

from sectorline.llm import topk

KIND = "vec_id long, embedding array<float>, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)


def brute(rows, every=50, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in np.array(v, np.float32)]) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        mine = next(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, w, strict=True)), i) for i, w in good if i != q and len(w) == len(mine))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("TILE", 37), ("BLOCK", 2), ("SCORES", 64), ("BINS", 16)):
            monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [None] * 16), (2150, [float("nan")] * 16), (2200, [1.0]), (2300, [2.0, 1.0]), (2301, [1.0, -1.0]), (2301, [1.0, -1.0]), (None, x[0].tolist()), (2**60, x[1].tolist())]
    got = topk.exact_top_k(table(spark, rows))
    assert {tuple(r) for r in got.collect()} == brute(rows) and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(120)] + [(50, [1.0, 1.0])]
    got = {tuple(r) for r in topk.exact_top_k(table(spark, rows)).collect()}
    assert {r[:3] for r in got if r[0] == 50} == {(50, n + 1, n) for n in range(5)}
    assert [r[2] for r in sorted(got) if r[0] == 0] == [1, 2, 3, 4, 5]


def test_wide_integers(spark):
    rows = [(i, [float(2 ** (18 + i % 5)) + i, -float(i)]) for i in range(60)]
    assert {tuple(r) for r in topk.exact_top_k(table(spark, rows)).collect()} == brute(rows)


def test_empty(spark):
    assert topk.exact_top_k(table(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert topk.exact_top_k(table(spark, [(50, [1.0])])).count() == 0
