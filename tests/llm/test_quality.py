import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorline.llm import quality, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, row int, salt int, score int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0, 0) for i, t in rows], DOC)


def enumerated(good, moves):
    """P(good) of each line by summing over all paths."""
    total, out = 0.0, np.zeros(len(good))
    for path in itertools.product((0, 1), repeat=len(good)):
        p = np.exp(sum(g * s for g, s in zip(good, path, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total, out = total + p, out + p * np.array(path)
    return out / total


def test_marginals_against_enumerated_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 10):
        good, moves = rng.standard_normal(n) * 3, rng.standard_normal((2, 2))
        assert np.allclose(quality.marginals(good, moves), enumerated(good, moves))


def test_field_gradient_against_enumerated_likelihood():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 3, 1])
    x, truth = np.zeros((3, 4, 2), np.float32), np.zeros((3, 4), np.int64)
    for k, n in enumerate(sizes):
        x[k, :n], truth[k, :n] = rng.standard_normal((n, 2)), rng.integers(0, 2, n)
    w, moves = quality._field(x, sizes, truth, np.ones(3) / 3, np.zeros(2), np.zeros((2, 2)), 4000, 0.05)

    def loss(w, moves):
        out = 0.025 * (w @ w + (moves**2).sum())
        for k, n in enumerate(sizes):
            score = lambda path, k=k, n=n: sum(x[k, i] @ w * path[i] for i in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
            out -= (score(truth[k, :n].tolist()) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=int(n))))) / 3
        return out

    best = loss(w, moves)
    for _ in range(200):
        assert loss(w + 0.01 * rng.standard_normal(2), moves + 0.01 * rng.standard_normal((2, 2))) > best - 1e-4


def test_line_labels_differ_within_a_document():
    good, n = np.array([0.9, 0.01, 0.8, 0.2]), np.array([50.0, 10.0, 50.0, 50.0])
    assert quality.line_labels(good, n, 1).tolist() == [1, 0, 1, 1]
    assert quality.line_labels(good, n, 0).tolist() == [1, 0, 1, 0]
    assert quality.line_labels(np.array([0.9, 0.95]), np.array([5.0, 5.0]), 0).tolist() == [0, 1]


@pytest.fixture(scope="module")
def trained(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return table, labels, quality.train(table, labels)


def test_held_out_accuracy_and_lines(spark, trained):
    table, labels, model = trained
    scored = quality.score(table, model).join(labels, "doc_id").filter(quality.held_out()).collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in scored]) >= 0.95
    bad = table.join(labels.filter("quality = 0"), "doc_id").select("text").collect()
    fine = table.join(labels.filter("quality = 1"), "doc_id").filter("length(text) > 300").select("text").collect()
    junk, clean = max((r[0] for r in bad), key=lambda t: "|" in t or "%%%" in t).split("\n")[1:3], fine[0][0].split("\n")[:3]
    lines = model.lines(quality.line_features("\n".join([*clean, *junk, *clean]))[0])
    assert lines[: len(clean)].mean() > lines[len(clean) : -len(clean)].mean() + 0.3


def test_query_against_a_plain_loop(spark, trained):
    table, _, model = trained
    rows = queries.queries()["op6_quality"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(rows) == len(texts)
    for r in rows[::7]:
        x, n = quality.line_features(texts[r["doc_id"]] or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if len(x) <= 10:
            p = enumerated((x - model.centre) / model.spread @ model.weights, model.moves)
            z = model.slope * quality.logit(float(p @ n / n.sum()) if n.sum() else p.mean()) + model.offset
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_odd_rows(spark, trained):
    _, labels, model = trained
    odd = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 200_000), (None, "a"), (4, "y"), (2**60 + 1, "z")]
    got = quality.score(docs(spark, odd), model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got) and {r["doc_id"] for r in got} == {i for i, _ in odd}
    assert quality.score(docs(spark, []), model).count() == 0
    assert quality.train(docs(spark, []), labels).score("x") == pytest.approx(0.5)
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    same = spark.createDataFrame([(i, 1) for i in train], "doc_id long, quality int")
    assert quality.train(docs(spark, [(i, "a b") for i in train]), same).score("x") == pytest.approx(1.0, abs=1e-3)
    torn = same.unionByName(spark.createDataFrame([(train[0], 0), (None, 0), (train[1], None)], "doc_id long, quality int"))
    model = quality.train(docs(spark, [(i, "a b") for i in train] + [(train[0], "c")]), torn)
    assert 0 <= model.score("a b") <= 1
    kept = quality.accepted(docs(spark, odd).withColumn("x", F.lit("y")), model)
    assert kept.columns[-1] == "x"
