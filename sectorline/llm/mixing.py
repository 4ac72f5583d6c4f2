"""Mixing documents to target weights under soft domain membership.

A naive Bayes classifier of byte pairs, fitted on labelled rows, gives each document a posterior p over
domains. Document rates r >= 0 are fitted by nonnegative least squares: half the squared distance between
the expected token shares of the domains, A r = sum of r * w * p with w the document's share of all tokens,
and their targets b. The solver is projected gradient in the metric of w: a step moves a document's rate by
p . (A r - b) / L and cuts it off at 0, L being the largest eigenvalue of sum of w * p * p', which ensures
descent; Nesterov's extrapolation, dropped whenever the objective rises, makes it fast. A document's rate
follows from its posterior and the list of steps, so that a round sums one number for each domain. The first
steps are found on a bounded sample of rows, so that few rounds over the table are left.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .packing import words

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 2000
#: Rows that each domain is fitted on, as far as it has them.
LEAST = 20
#: Rows that the first steps are found on, at most.
WARM = 32_768
#: The fit ends when every domain is this near its target (as a share of all tokens), or when the duality gap shows
#: that the objective is above the least possible by no more than this share of it, or by no more than NEAR (shares
#: within 1e-3 of the best) while ten rounds gain less than a tenth. It raises after ROUNDS.
ERROR, GAP, NEAR, ROUNDS = 5e-7, 0.01, 5e-7, 3000
PAIRS = 65536


def pairs(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8).astype(np.int64)
    return b[:-1] * 256 + b[1:]


def classifier(docs: DataFrame, labels: DataFrame, domain: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(domains, log odds of each byte pair by domain): all domains of docs, fitted on labelled rows.

    At most `sample` labelled ids are chosen by a hash. Of a domain with fewer than LEAST of them, LEAST
    rows of its own are taken besides, labelled ones first; without labelled rows there is the one domain "all".
    Of rows that repeat an id in a domain the least text counts. Pairs are counted where the texts are.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"), "text")
    known = labels.select("doc_id").filter("doc_id is not null").distinct()
    named = rows.select("doc_id").join(known, "doc_id", "left_semi").distinct()
    ids = [(r["doc_id"],) for r in named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return ["all"], np.zeros((PAIRS, 1))
    # At most `sample` ids go to all executors.
    chosen = rows.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")
    chosen = chosen.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text")
    have = Counter({r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()})
    domains = sorted(r[0] for r in rows.select("domain").distinct().collect())
    rare = [d for d in domains if have[d] < LEAST]
    if rare:
        mine = rows.filter(F.col("domain").isin(rare)).join(known.withColumn("labelled", F.lit(1)), "doc_id", "left")
        w = Window.partitionBy("domain").orderBy(F.desc_nulls_last("labelled"), F.xxhash64("doc_id"), "doc_id", "text")
        mine = mine.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= LEAST).select("domain", "text")
        chosen = chosen.filter(~F.col("domain").isin(rare)).unionByName(mine)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for d, text in zip(b.column("domain").to_pylist(), b.column("text"), strict=True):
                seen[d] = seen.get(d, 0) + np.bincount(pairs(text.as_py()), minlength=PAIRS)
        for d, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["domain", "pair", "n"])

    found = chosen.mapInArrow(count, "domain string, pair long, n long").groupBy("domain", "pair").agg(F.sum("n").alias("n"))
    counts = np.full((len(domains), PAIRS), 0.1)
    place = {d: i for i, d in enumerate(domains)}
    for r in found.collect():  # PAIRS rows a domain at most
        counts[place[r["domain"]], r["pair"]] += r["n"]
    return domains, np.log(counts / counts.sum(axis=1, keepdims=True)).T


def memberships(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc, tokens, posterior): the whole row of docs, its words, and its probabilities of the domains.

    Log odds grow with the root of a text's length. Null and empty texts have no tokens and a uniform posterior.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def posterior(texts: pa.Array) -> pa.Array:
        out = np.empty((len(texts), held.value.shape[1]))
        for i, t in enumerate(texts):
            p = pairs(t.as_py())
            score = np.zeros(held.value.shape[1])
            for k in range(0, len(p), PAIRS):
                score += held.value[p[k : k + PAIRS]].sum(axis=0)
            e = np.exp((score - score.max()) / math.sqrt(max(len(p), 1)))
            out[i] = e / e.sum()
        ends = np.arange(len(texts) + 1, dtype=np.int32) * held.value.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words().alias("tokens"), posterior("text").alias("posterior"))


@dataclass
class Fit:
    """Rates as a list of steps (gradient over L, and extrapolation before it), and the shares that they reach."""

    targets: np.ndarray
    reached: np.ndarray
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)

    @property
    def residual(self) -> float:
        """The largest distance of a domain from its target, as a share of all tokens."""
        return float(np.abs(self.reached - self.targets).max()) if len(self.targets) else 0.0


def _rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The rate of each row of posteriors after the steps, all rates being 1 before them."""
    rate = before = np.ones(len(p))
    for g, beta in steps:
        ahead = rate + beta * (rate - before) if beta else rate
        before, rate = rate, np.maximum(ahead - p @ g, 0.0)
    return rate


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _sums(members: DataFrame, k: int, use) -> np.ndarray:
    """use(tokens, posteriors) gives k numbers of some rows: all but the last are summed over the table, of the last
    the largest is taken (-inf without rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.append(np.zeros(k - 1), -np.inf)
        for b in batches:
            if b.num_rows:
                some = use(b.column("tokens").to_numpy(zero_copy_only=False).astype(float), _matrix(b.column("posterior")))
                total = np.append(total[:-1] + some[:-1], max(total[-1], some[-1]))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

    names = [f"c{i}" for i in range(k)]
    out = members.select("tokens", "posterior").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    found = out.agg(*[F.sum(c) for c in names[:-1]], F.max(names[-1])).first()
    return np.array([0.0 if x is None else x for x in found])


class _Sample:
    """Projected gradient over an array of rows, whose rates are kept."""

    def __init__(self, tokens: np.ndarray, p: np.ndarray):
        self.w, self.p, self.steps = tokens / tokens.sum(), p, []
        self.rate = self.before = np.ones(len(p))

    def gram(self) -> np.ndarray:
        return self.p.T @ (self.p * self.w[:, None])

    def reached(self) -> np.ndarray:
        return (self.w * self.rate) @ self.p

    def step(self, g: np.ndarray, beta: float, short: np.ndarray) -> tuple[np.ndarray, float]:
        """The shares after a step g from the rates extrapolated by beta, and the largest product of `short` and a posterior."""
        self.next = np.maximum(self.rate + beta * (self.rate - self.before) - self.p @ g, 0.0)
        return (self.w * self.next) @ self.p, float((self.p @ short).max())

    def keep(self, g: np.ndarray, beta: float) -> None:
        self.before, self.rate = self.rate, self.next
        self.steps.append((g, beta))


class _Table:
    """The same over a distributed table, whose rates follow from the steps."""

    def __init__(self, members: DataFrame, k: int, total: float, steps: list[tuple[np.ndarray, float]]):
        self.members, self.k, self.total, self.steps = members, k, total, list(steps)

    def gram(self) -> np.ndarray:
        k, total = self.k, self.total
        return _sums(self.members, k * k + 1, lambda t, p: np.append((p.T @ (p * (t / total)[:, None])).ravel(), 0.0))[:-1].reshape(k, k)

    def reached(self) -> np.ndarray:
        total, steps = self.total, list(self.steps)
        return _sums(self.members, self.k + 1, lambda t, p: np.append(((t / total) * _rates(p, steps)) @ p, 0.0))[:-1]

    def step(self, g: np.ndarray, beta: float, short: np.ndarray) -> tuple[np.ndarray, float]:
        total, steps = self.total, [*self.steps, (g, beta)]
        found = _sums(self.members, self.k + 1, lambda t, p: np.append(((t / total) * _rates(p, steps)) @ p, (p @ short)[t > 0].max(initial=-np.inf)))
        return found[:-1], float(found[-1])

    def keep(self, g: np.ndarray, beta: float) -> None:
        self.steps.append((g, beta))


def _descend(rows: _Sample | _Table, targets: np.ndarray, rounds: int, gap: float) -> tuple[np.ndarray, bool]:
    """The shares reached, and whether that is shown to be the best possible; rows.steps are the steps to it."""
    length = 1 / float(np.linalg.eigvalsh(rows.gram())[-1])
    now = before = rows.reached()
    cost, momentum, beta = 0.5 * float(((now - targets) ** 2).sum()), 1.0, 0.0
    costs = [cost]
    for _ in range(rounds):
        short = targets - now
        if np.abs(short).max() <= ERROR:
            return now, True
        g = length * (now + beta * (now - before) - targets)
        after, peak = rows.step(g, beta, short)
        # `short` less its largest product with a posterior (which sum to 1) is a point of the dual problem.
        y = short - max(0.0, peak)
        above = cost - (y @ targets - 0.5 * y @ y)
        if above <= gap * cost or (above <= NEAR and len(costs) > 10 and cost > 0.9 * costs[-11]):
            return now, True
        less = 0.5 * float(((after - targets) ** 2).sum())
        if less > cost and beta:
            # The extrapolation led uphill: take a plain step from the last rates instead.
            momentum, beta = 1.0, 0.0
            continue
        rows.keep(g, beta)
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        momentum, beta = following, (momentum - 1) / following
        before, now, cost = now, after, less
        costs.append(cost)
    return now, False


def fit(members: DataFrame, targets: np.ndarray, present: np.ndarray, warm: int = WARM) -> Fit:
    """members (tokens, posterior); targets: shares by domain, of sum 1; present: expected tokens by domain.

    The first steps are found on `warm` rows, chosen by a hash, and hold for every row; rounds over the whole table go on
    from there until they converge to a nonnegative least-squares solution (of which there may be many), or
    raise RuntimeError. Without tokens all rates are 1.
    """
    k, total = len(targets), float(present.sum())
    if not total:
        return Fit(targets, np.zeros(k))
    some = members.select("tokens", "posterior").filter("tokens > 0")
    some = some.orderBy(F.xxhash64("tokens", "posterior")).limit(warm).toArrow().combine_chunks()
    posteriors = some.column("posterior").combine_chunks() if some.num_rows else some.column("posterior")
    first = _Sample(some.column("tokens").to_numpy().astype(float), _matrix(posteriors))
    _descend(first, targets, ROUNDS, GAP / 4)
    table = _Table(members, k, total, first.steps)
    reached, done = _descend(table, targets, ROUNDS, GAP)
    if not done:
        raise RuntimeError(f"rates did not converge in {ROUNDS} rounds; residual {np.abs(reached - targets).max():.2g}")
    return Fit(targets, reached, table.steps)


def mixed(docs: DataFrame, labels: DataFrame, domain: str = "lang", temper: float = 0.7, targets: dict[str, float] | None = None) -> DataFrame:
    """docs -> doc (struct of all its columns), tokens, posterior (map by domain), rate, copies, residual: a row per row of docs.

    targets: weights by domain, made to sum to 1 (domains left out: 0; ValueError for unknown ones); by default
    the present expected shares to the power `temper`, so that small domains gain. copies is the rate rounded up or
    down by a hash of doc_id and text, its expectation the rate. residual, the same in all rows, is how far the
    farthest domain stays from its target, as a share of all tokens: 0 but for rounding where rates can meet the
    targets, else that of the least-squares solution. Null texts are empty: no tokens, a uniform posterior.
    Repeated rows count each. Without labelled rows there is one domain and all rates are 1. Columns of docs may have any
    names; an empty table gives no rows.
    """
    domains, weights = classifier(docs, labels, domain)
    if targets is not None and not set(targets) <= set(domains):
        raise ValueError(f"targets for unknown domains: {sorted(set(targets) - set(domains))}")
    members = saved(memberships(docs, weights), "members")
    present = _sums(members, len(domains) + 1, lambda t, p: np.append(t @ p, 0.0))[:-1]
    goal = np.maximum(present, 0) ** temper if targets is None else np.array([float(targets.get(d, 0)) for d in domains])
    found = fit(members, goal / (goal.sum() or 1.0), present)
    held = docs.sparkSession.sparkContext.broadcast(found.steps)

    @F.arrow_udf("double")
    def rate(posteriors: pa.Array) -> pa.Array:
        return pa.array(_rates(_matrix(posteriors), held.value))

    out = members.withColumn("rate", rate("posterior"))
    return out.select(
        "doc", "tokens", F.map_from_arrays(F.array(*map(F.lit, domains)), "posterior").alias("posterior"), "rate", _copies(F.col("rate")).alias("copies"), F.lit(found.residual).alias("residual")
    )


def _copies(rate: Column) -> Column:
    chance = F.pmod(F.xxhash64("doc.doc_id", "doc.text"), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
