import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorline.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def solved(_, tokens, p, goal):
    """The solver over an array in place of a table."""
    rows = mixing._Sample(np.array(tokens, float), p)
    reached, done = mixing._descend(rows, goal, mixing.ROUNDS, mixing.GAP)
    assert done and np.abs(mixing._rates(p, rows.steps) - rows.rate).max() < 1e-9
    return mixing.Fit(goal, reached, rows.steps), rows.rate


def least(a, goal):
    """The least objective over r >= 0, by trying every set of rates that are not 0."""
    best = 0.5 * goal @ goal
    for n in range(1, a.shape[1] + 1):
        for some in itertools.combinations(range(a.shape[1]), n):
            r = np.linalg.lstsq(a[:, some], goal, rcond=None)[0]
            if (r >= -1e-12).all():
                best = min(best, 0.5 * ((a[:, some] @ r - goal) ** 2).sum())
    return best


@pytest.mark.parametrize("seed", range(6))
def test_fit_against_enumerated_supports(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    p, tokens = rng.dirichlet([0.7] * 3, 7), rng.integers(0, 50, 7)
    goal = rng.dirichlet([0.3] * 3)
    found, r = solved(monkeypatch, tokens, p, goal)
    a = (p * (tokens / tokens.sum())[:, None]).T
    assert (r >= 0).all() and np.abs(a @ r - found.reached).max() < 1e-9
    assert 0.5 * ((a @ r - goal) ** 2).sum() <= least(a, goal) * (1 + 1.1 * mixing.GAP) + mixing.NEAR


@pytest.mark.parametrize("seed", range(2))
def test_fit_is_optimal_where_rates_reach_zero(monkeypatch, seed):
    rng = np.random.default_rng(10 + seed)
    p, tokens = rng.dirichlet([0.4, 0.5, 0.6, 3.0], 400), rng.integers(1, 2000, 400)
    goal = np.array([0.55, 0.4, 0.05, 0.0])
    found, r = solved(monkeypatch, tokens, p, goal)
    off = (p * (tokens / tokens.sum())[:, None]).T @ r - goal
    # Conditions of a least-squares solution over r >= 0: no rate can gain, and those above 0 are level.
    assert (r == 0).sum() > 100 and (p @ off).min() > -2e-3 and abs(off @ (off + goal)) < 0.02 * off @ off
    assert found.residual == pytest.approx(np.abs(off).max(), abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_reachable_targets_are_met(monkeypatch, seed):
    rng = np.random.default_rng(20 + seed)
    p, tokens = rng.dirichlet([0.3] * 4, 400), rng.integers(1, 2000, 400)
    some = np.where(rng.random(400) < 0.6, 0, rng.random(400) * 3)
    goal = (tokens * some) @ p
    found, r = solved(monkeypatch, tokens, p, goal / goal.sum())
    assert found.residual < 1e-6 and (r >= 0).all() and len(found.steps) < 400


def test_unreachable_targets_tell_their_residual(spark):
    p = np.array([[0.6, 0.4], [0.7, 0.3]])
    table = spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, posterior array<double>")
    goal = np.array([0.0, 1.0])
    found = mixing.fit(table, goal, 10 * p.sum(axis=0))
    assert mixing.fit(table, goal, 10 * p.sum(axis=0), warm=1).residual == pytest.approx(found.residual, rel=0.05)
    r, a = mixing._rates(p, found.steps), (p * 0.5).T
    assert r[1] == 0 and found.residual > 0.3
    assert 0.5 * ((a @ r - goal) ** 2).sum() <= least(a, goal) * (1 + 1.1 * mixing.GAP)


def test_query_meets_its_targets(spark):
    rows = queries.queries()["op4_mixing"](spark, "/root/testdata/sf0.01").collect()
    domains = sorted(rows[0]["posterior"])
    t = np.array([r["tokens"] for r in rows], float)
    p, rate = np.array([[r["posterior"][d] for d in domains] for r in rows]), np.array([r["rate"] for r in rows])
    now = t @ p / t.sum()
    goal = now**0.7 / (now**0.7).sum()
    assert np.abs((t * rate) @ p / t.sum() - goal).max() < 1e-6 and rows[0]["residual"] < 1e-6
    assert len(rows) == 1000 and all(abs(r["copies"] - r["rate"]) < 1 for r in rows)


def test_odd_tables(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kind = "doc_id long, text string, lang string, rate string, tokens int, copies int, posterior int, doc int, residual int"
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 200_000, None), (4, "one two", "b"), (4, "one two", "b"), (None, "three", "b"), (5, "four five", "b")]
    df = spark.createDataFrame([(*r, "kept", 1, 2, 3, 4, 5) for r in rows], kind)
    out = mixing.mixed(df, labels).collect()
    assert len(out) == 7 and all(r["doc"]["rate"] == "kept" and r["doc"]["tokens"] == 1 for r in out)
    by = {r["doc"]["text"]: r for r in out}
    assert by[None]["tokens"] == 0 and by[""]["tokens"] == 0 and len(set(by[""]["posterior"].values())) == 1
    assert mixing.mixed(df.limit(0), labels).count() == 0
    none = mixing.mixed(df, labels.limit(0)).collect()
    assert {r["rate"] for r in none} == {1.0} and {tuple(r["posterior"]) for r in none} == {("all",)}
    goal = mixing.mixed(df, labels, targets={"b": 2.0})
    assert goal.agg(F.max("residual")).first()[0] >= 0
    with pytest.raises(ValueError):
        mixing.mixed(df, labels, targets={"zz": 1.0})
