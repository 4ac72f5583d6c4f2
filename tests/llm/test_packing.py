import itertools
import random

from pyspark.sql import functions as F

from sectorline.llm import packing, queries

SF = "/root/testdata/sf0.001"
BIG = 2**60


def plain_best_fit(lengths, capacities, overhead):
    """The same rules, by scans over lists."""
    bins, out = [], []  # [capacity, used]
    for at, n in enumerate(lengths):
        open_ = [(c - u, -b) for b, (c, u) in enumerate(bins) if c - u >= n]
        if open_:
            least = min(r for r, _ in open_)
            b = max((last, -b) for (r, b), last in zip(open_, [max((i for i, x in enumerate(out) if x == -b), default=-1) for _, b in open_], strict=True) if r == least)[1]
        else:
            best = None
            for c in capacities:
                if c < n:
                    continue
                rest, full = [x for x in lengths[at + 1 :] if x], n
                for x in sorted(rest, reverse=True):
                    if full + x <= c:
                        full += x
                cost = (next(k for k in capacities if k >= full) + overhead) / max(full, 1)
                if best is None or cost < best[0]:
                    best = cost, c
            b = len(bins)
            bins.append([best[1], 0])
        bins[b][1] += n
        out.append(b)
    return out, [u for _, u in bins]


def cost(used, capacities, overhead):
    return sum(packing.shrunk(u, capacities) + overhead for u in used)


def test_best_fit_against_scans():
    rng = random.Random(1)
    for _ in range(300):
        caps = tuple(sorted(rng.sample(range(4, 40), 3)))
        lengths = sorted((rng.randint(0, caps[-1]) for _ in range(rng.randint(1, 30))), reverse=True)
        got = packing.best_fit(lengths, caps, 2)
        want = plain_best_fit(lengths, caps, 2)
        assert got[0] == want[0] and got[1] == want[1]


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_cost_is_near_the_least_possible():
    rng, ours, best = random.Random(2), 0, 0
    for _ in range(60):
        caps = (8, 12, 20)
        lengths = sorted((rng.randint(1, 20) for _ in range(7)), reverse=True)
        least = min(cost([sum(b) for b in p], caps, 2) for p in partitions(lengths) if all(sum(b) <= 20 for b in p))
        mine = cost(packing.best_fit(lengths, caps, 2)[1], caps, 2)
        assert mine <= 1.35 * least
        ours, best = ours + mine, best + least
    assert ours <= 1.1 * best


def test_sizes_are_chosen_for_each_bin():
    # One bin of 20 for the pair of tens, one of 8 for the eight.
    _, used = packing.best_fit([10, 10, 8], (8, 12, 20), 0)
    assert sorted(used) == [8, 20]


def check(rows, lengths):
    assert sorted(lengths.elements()) == sorted(x for d, k, n in ((r["doc_id"], r["piece"], r["piece_tokens"]) for r in rows) for x in [(d, k, n)])
    for _, b in itertools.groupby(sorted(rows, key=lambda r: (r["bin_id"], r["bin_offset"], r["piece_tokens"])), key=lambda r: r["bin_id"]):
        b, at = list(b), 0
        for r in b:
            assert r["bin_offset"] == at
            at += r["piece_tokens"]
        assert {r["bin_used"] for r in b} == {at} and {r["bin_capacity"] for r in b} == {packing.shrunk(at, packing.CAPACITIES)}


def expected(items):
    from collections import Counter

    top, out = packing.CAPACITIES[-1], Counter()
    for i, n in items:
        n = max(n or 0, 0)
        for k in range(max(1, -(-n // top))):
            out[(i, k, min(top, n - k * top))] += 1
    return out


def test_ids_stay_exact_beside_nulls(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 4)
    items = [(BIG + 1, 5), (BIG + 3, 700), (None, 5), (None, None), (3, 0), (4, -7), (5, 20_000), *[(9, 100)] * 30]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in items], "doc_id long, n_tokens long, piece string, copies int")
    rows = packing.pack(df).collect()
    ids = lambda xs: sorted(xs, key=repr)
    assert ids((r["doc_id"], r["piece"], r["piece_tokens"]) for r in rows) == ids(expected(items).elements())
    assert {BIG + 1, BIG + 3} <= {r["doc_id"] for r in rows}
    assert packing.pack(df.limit(0)).count() == 0


def test_bins_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice([3, 511, 700, 5000])) for i in range(150)] + [(7, 3)] * 9, "doc_id long, n_tokens long")
    a, b = packing.pack(df.repartition(1)), packing.pack(df.repartition(5, "n_tokens"))
    assert a.exceptAll(b).isEmpty() and a.select("bin_id").distinct().count() > 4
    assert a.select(F.split("bin_id", "-")[0]).distinct().count() > 1


def test_query_against_brute_force(spark):
    items = [(r["doc_id"], len((r["text"] or "").split())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.queries()["op3_packing"](spark, SF).collect()
    check(rows, expected(items))
    pieces = sorted(expected(items).elements(), key=lambda x: (-x[2], x[0], x[1]))
    bin_of, used = plain_best_fit([n for _, _, n in pieces], packing.CAPACITIES, packing.OVERHEAD)
    assert sorted((r["doc_id"], r["piece"], r["bin_id"], r["bin_used"]) for r in rows) == sorted((d, k, f"0-{b}", used[b]) for (d, k, _), b in zip(pieces, bin_of, strict=True))
