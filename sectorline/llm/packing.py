"""Variable-capacity best-fit packing.

Items are dealt over tasks by a hash, so that no length and no source lands in one task. Each task packs its
items longest first: into the open bin with the least room that still fits, else into a new one. The size of
a new bin is chosen among all permitted lengths for that bin alone: each is filled on trial with the longest
of the items still left that fit, shrunk to its contents, and that with the least cost for a token is
opened. In the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Items of a task, on average.
ITEMS = 50_000
#: Equal rows that one task writes out, before they are dealt to others.
COPIES = 10_000
#: Cost of a bin beside its capacity: what each sequence takes whatever its length.
OVERHEAD = 16
KIND = "doc_id long, piece long, piece_tokens long, bin_id string, bin_offset long, bin_used long, bin_capacity long"


def shrunk(used: int, capacities: tuple[int, ...]) -> int:
    return next(c for c in capacities if c >= used)


class _Left:
    """Lengths not yet packed: their counts, and a bit for each."""

    def __init__(self, lengths: list[int]):
        self.counts = Counter(n for n in lengths if n)
        self.mask = sum(1 << n for n in self.counts)

    def take(self, n: int) -> None:
        if n:
            self.counts[n] -= 1
            if not self.counts[n]:
                self.mask &= ~(1 << n)

    def filled(self, room: int) -> int:
        """How much of `room` the longest lengths that fit would fill, one after the other."""
        mask, start = self.mask, room
        while room > 0:
            fits = mask & ((2 << room) - 1)
            if not fits:
                break
            n = fits.bit_length() - 1
            room -= n * min(self.counts[n], room // n)
            mask = fits & ~(1 << n)
        return start - room


def best_fit(lengths: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int]]:
    """lengths, longest first, capacities ascending -> the bin of each item, and what is used of each bin."""
    room: dict[int, list[int]] = {}
    mask, bin_of, used, left = 0, [], [], _Left(lengths)
    for n in lengths:
        left.take(n)
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, least = len(used), None
            for c in capacities:
                if c >= n:
                    full = n + left.filled(c - n)
                    cost = (shrunk(full, capacities) + overhead) / max(full, 1)
                    if least is None or cost < least:
                        least, r = cost, c
            used.append(0)
        used[b] += n
        r -= n
        room.setdefault(r, []).append(b)
        mask |= 1 << r
        bin_of.append(b)
    return bin_of, used


def pack(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """items (doc_id, n_tokens) -> a row for each piece: doc_id, piece, piece_tokens, bin_id, bin_offset,
    bin_used, bin_capacity.

    Items longer than the largest capacity are cut into pieces of that capacity and a rest; nothing is
    dropped. Null and zero lengths become one empty piece, which takes no room. Repeated rows are packed each
    by itself, null ids like others; other columns are ignored. Ties go by doc_id (null first) and piece, so that bins do
    not depend on how the table is laid out. An empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    pieces = items.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / top) - 1)))
    )
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("piece_tokens"))
    # Equal rows are counted and dealt out by their number: any one of them is as good as the others.
    pieces = saved(pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies")), "pieces")
    total, most = pieces.agg(F.sum("copies"), F.max("copies")).first()
    groups = max(1, -(-(total or 0) // ITEMS))
    first = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    dealt = pieces.withColumn("from", F.explode(first))
    if (most or 0) > COPIES:
        dealt = dealt.repartition("doc_id", "piece", "from")
    copy = F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "copies") - 1))
    dealt = dealt.withColumn("copy", copy)
    grp = F.pmod(F.xxhash64("doc_id", "piece", "piece_tokens") + F.col("copy"), F.lit(groups))
    dealt = dealt.select(grp.cast("int").alias("grp"), "doc_id", "piece", "piece_tokens")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = [("piece_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        g = group.sort_by(order).select(["doc_id", "piece", "piece_tokens"])
        lengths = g.column("piece_tokens").to_pylist()
        bin_of, used = best_fit(lengths, capacities, overhead)
        at, offsets = [0] * len(used), []
        for b, k in zip(bin_of, lengths, strict=True):
            offsets.append(at[b])
            at[b] += k
        g = g.append_column("bin_id", pa.array([f"{key[0].as_py()}-{b}" for b in bin_of], pa.string()))
        g = g.append_column("bin_offset", pa.array(offsets, pa.int64()))
        g = g.append_column("bin_used", pa.array([used[b] for b in bin_of], pa.int64()))
        return g.append_column("bin_capacity", pa.array([shrunk(used[b], capacities) for b in bin_of], pa.int64()))

    return dealt.groupBy("grp").applyInArrow(run, KIND)


def words(text: str = "text") -> F.Column:
    """Number of words of a text; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\s]+"), lambda w: w != "")).cast("long")
