import random

import pandas as pd
import pytest

from sectorline.llm import queries, simhash
from sectorline.llm.common import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row int, salt int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0) for i, t in enumerate(texts)], DOC)


def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: r for a, r in root.items() if a != r}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in base * 2] + [f ^ 7 for f in base]
    # A dense ball, so that the stars of crowded cells are used.
    fps += [base[0] ^ (1 << i) for i in range(64)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    root = {f: f for f in fps}
    for _ in range(12):
        for a in fps:
            for b in fps:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {f: got.get(f, f) for f in fps} == root


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    plain = lambda d: sorted(repr([None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else x for x in r]) for r in d[cols].astype(object).values.tolist())
    assert cols == sorted(mine.columns) and plain(mine) == plain(theirs)
