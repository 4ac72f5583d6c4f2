"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own statistics and those of the lines around it. Only documents
are labelled, so line labels are found by turns: a line model, then the field itself, tells which lines of a
document labelled bad look bad (the worst ones at least) and which of one labelled good do by a wide margin, and
the field is fitted to these labels, which can differ within a document. Forward-backward gives each line's
marginal, whose mean weighted by line length is the document's share of good text; a logistic fit on the training
documents turns the share into a score. No row's labels, lang, source or doc_id enter a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Labelled documents that a model is fitted on, at most, and lines of a training chain.
SAMPLE, CHAIN = 3000, 256
THRESHOLD = 0.3
#: P(good) below which a line of a document labelled good counts as bad; share of a bad document's text that does at least.
CLEARLY, LEAST_BAD = 0.05, 0.34
UPPER, LOWER, DIGIT, SPACE, SYMBOL, STOP, OTHER = range(7)


def _classes() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s.isupper():
            table[c] = UPPER
        elif s.isalpha():
            table[c] = LOWER
        elif s.isdigit():
            table[c] = DIGIT
        elif s.isspace():
            table[c] = SPACE
    table[[ord(c) for c in "!#$%&*+<=>@\\^_`{|}~/[]"]] = SYMBOL
    table[[ord(c) for c in ".,;:?'\"()-"]] = STOP
    return table


CLASSES = _classes()
OWN = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours and a constant, weight of each line)."""
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "replace"), np.uint32)
    kinds = np.where(codes < len(CLASSES), CLASSES[np.minimum(codes, len(CLASSES) - 1)], OTHER)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = np.maximum(ends - starts, 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), starts) / n

    same = np.concatenate([[False], codes[1:] == codes[:-1]])
    begins = np.concatenate([[True], kinds[:-1] == SPACE]) & (kinds != SPACE)
    x = np.zeros((len(lines), OWN))
    for k in (UPPER, DIGIT, SYMBOL, STOP, OTHER):
        x[:, (UPPER, DIGIT, SYMBOL, STOP, OTHER).index(k)] = share(kinds == k)
    x[:, 5] = share(same & (kinds == SYMBOL))
    x[:, 6] = share(same & (kinds == LOWER))
    x[:, 7] = np.log1p(ends - starts) / 5
    count = np.add.reduceat(begins.astype(np.int64), starts)
    x[:, 8] = np.minimum(share(kinds != SPACE) * n / np.maximum(count, 1) / 10, 3)
    times = Counter(lines)
    for i, line in enumerate(lines):
        words = line.split()
        x[i, 9] = len(set(words)) / len(words) if words else 1
        x[i, 10] = math.log(times[line]) if words else 0
        x[i, 11] = line.rstrip()[-1:] in ".?!:"
        x[i, 12] = not words
    x[:, 13] = x[:, 9] * x[:, 7]
    none = np.zeros((1, OWN))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), np.ones((len(x), 1))]), (ends - starts).astype(float)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    slope: float
    offset: float

    def lines(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line by its features."""
        return marginals((x - self.centre) / self.spread @ self.weights, self.moves)

    def share(self, x: np.ndarray, n: np.ndarray) -> float:
        p = self.lines(x)
        return float(p @ n / n.sum()) if n.sum() else float(p.mean())

    def good(self, text: str | None) -> float:
        """The share of good text, by the lines' marginals; of a text without any character, its one line's."""
        return self.share(*line_features(text or ""))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit(self.good(text)) + self.offset, -30, 30))))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def marginals(good: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line; good: log odds of each line alone, moves: log potentials [from][to]."""
    (a, b), (c, d) = np.exp(moves).tolist()
    odds = np.exp(np.clip(good, -30, 30)).tolist()
    forward, f0, f1 = [], 1.0, 1.0
    for i, o in enumerate(odds):
        if i:
            f0, f1 = f0 * a + f1 * c, f0 * b + f1 * d
        f1 *= o
        t = f0 + f1
        f0, f1 = f0 / t, f1 / t
        forward.append((f0, f1))
    out, b0, b1 = np.empty(len(odds)), 1.0, 1.0
    for i in range(len(odds) - 1, -1, -1):
        f0, f1 = forward[i]
        out[i] = f1 * b1 / (f0 * b0 + f1 * b1)
        g1 = b1 * odds[i]
        b0, b1 = a * b0 + b * g1, c * b0 + d * g1
        t = b0 + b1
        b0, b1 = b0 / t, b1 / t
    return out


def line_labels(good: np.ndarray, length: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines from P(good) of each: those of a good document are bad only if clearly so, and never
    most of its text; of a bad document the worst lines, a third of its text or more, are bad."""
    order, length = np.argsort(good, kind="stable"), length + 1.0
    held = np.cumsum(length[order]) / length.sum()
    out = np.ones(len(good), np.int64)
    if label:
        out[order[(good[order] < CLEARLY) & (held < 0.5)]] = 0
    else:
        out[order[(good[order] < 0.5) | (held - length[order] / length.sum() < LEAST_BAD)]] = 0
    return out


def _adam(start: list[np.ndarray], gradients, rounds: int, rate: float) -> list[np.ndarray]:
    p = [a.copy() for a in start]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        for k, g in enumerate(gradients(*p)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def _field(x: np.ndarray, size: np.ndarray, truth: np.ndarray, weight: np.ndarray, w: np.ndarray, moves: np.ndarray, rounds: int, ridge: float) -> list[np.ndarray]:
    """Maximum likelihood of padded chains (longest first) with line labels `truth`, by Adam."""
    width = x.shape[1]
    live = np.arange(width)[None, :] < size[:, None]
    seen = np.zeros((2, 2))
    pairs = live[:, 1:]
    np.add.at(seen, (truth[:, :-1][pairs], truth[:, 1:][pairs]), np.repeat(weight[:, None], width - 1, axis=1)[pairs])

    def gradients(w: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.zeros((len(x), width, 2))
        e[:, :, 1] = np.clip(x @ w.astype(np.float32), -30, 30)
        pot, trans = np.exp(e), np.exp(moves)
        f, back = np.zeros_like(e), np.ones_like(e)
        for i in range(width):
            k = int((size > i).sum())
            step = pot[:k, i] * (f[:k, i - 1] @ trans if i else 1.0)
            f[:k, i] = step / step.sum(axis=1, keepdims=True)
        both = np.zeros((2, 2))
        for i in range(width - 2, -1, -1):
            k = int((size > i + 1).sum())
            g = pot[:k, i + 1] * back[:k, i + 1]
            pair = f[:k, i, :, None] * trans * g[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            both += np.einsum("n,nij->ij", weight[:k], pair)
            step = g @ trans.T
            back[:k, i] = step / step.sum(axis=1, keepdims=True)
        p = f * back
        p = p[:, :, 1] / np.maximum(p.sum(axis=2), 1e-300)
        off = (p - truth) * live * weight[:, None]
        return np.einsum("nl,nlf->f", off, x) + ridge * w, both - seen + ridge * moves

    return _adam([w, moves], gradients, rounds, 0.05)


def fit(texts: list[str], labels: list[int], rounds: int = 120, turns: int = 2, ridge: float = 1e-3) -> Model:
    """A line model, then `turns` times line labels and the field fitted to them; then the logistic fit of the
    documents' shares."""
    y = np.array(labels, float)
    found = [line_features(t or "") for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(f) for f, _ in found])])
    rows, lengths = np.vstack([f for f, _ in found]), np.concatenate([n for _, n in found])
    centre, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    centre[-1], spread[-1] = 0, 1
    rows = ((rows - centre) / spread).astype(np.float32)
    share = y.mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)

    # The line model: lines take their document's label, and all lines of a document weigh as much as it.
    owner = np.repeat(np.arange(len(y)), np.diff(begin))
    own = (balance / np.diff(begin))[owner]

    def line(w: np.ndarray) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(rows @ w.astype(np.float32), -30, 30)))
        return [((p - y[owner]) * own) @ rows + ridge * w]

    (w,) = _adam([np.zeros(rows.shape[1])], line, 2 * rounds, 0.05)
    moves = np.zeros((2, 2))
    chains = [(i, a, min(a + CHAIN, begin[i + 1])) for i in range(len(y)) for a in range(begin[i], begin[i + 1], CHAIN)]
    chains.sort(key=lambda c: c[1] - c[2])
    size = np.array([b - a for _, a, b in chains])
    x = np.zeros((len(chains), size.max(), rows.shape[1]), np.float32)
    weight = np.array([own[a] for _, a, _ in chains])
    for k, (_, a, b) in enumerate(chains):
        x[k, : b - a] = rows[a:b]
    for _ in range(turns):
        odds = rows @ w
        good = [marginals(odds[a:b], moves) for a, b in zip(begin, begin[1:], strict=False)]
        told = np.concatenate([line_labels(g, lengths[a:b], int(k)) for g, a, b, k in zip(good, begin, begin[1:], y, strict=False)])
        truth = np.zeros(x.shape[:2], np.int64)
        for k, (_, a, b) in enumerate(chains):
            truth[k, : b - a] = told[a:b]
        w, moves = _field(x, size, truth, weight, w, moves, rounds, ridge)
    plain = Model(w, moves, centre, spread, 1.0, 0.0)
    z = np.array([logit(plain.share(f, n)) for f, n in found])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        h = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 1e-2 * (slope - 1), (p - y).sum() + 1e-2 * offset])
        a = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(a, g)
    return Model(w, moves, centre, spread, float(slope), float(offset))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality, from at most `sample` labelled rows that are not held out, chosen by a hash.

    With no such rows, or all of one class, scores are constant: that class's share, 0.5 without rows.
    Conflicting repeated labels count as their smallest value; of rows that repeat a doc_id the least text counts.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    quality = {r["doc_id"]: r["quality"] for r in rows}
    share = sum(quality.values()) / len(quality) if quality else 0.5
    if share in (0.0, 1.0) or not quality:
        width = 3 * OWN + 1
        return Model(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0, logit(share))
    # At most `sample` ids go to all executors.
    few = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")
    texts = docs.join(F.broadcast(few), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = sorted((r["doc_id"], r["text"] or "") for r in texts.collect())
    return fit([t for _, t in texts], [quality[i] for i, _ in texts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs; null texts count as empty, repeated rows stay."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([held.value.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([held.value.score(t.as_py()) >= threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
