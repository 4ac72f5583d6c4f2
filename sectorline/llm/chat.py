"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted text of all turns before it and its own,
of which only its reply is trainable. A conversation is cut into blocks of BLOCK turns, over as many tasks as
its turns fill, and a block's examples put its conversation's earlier blocks before their own turns; so no
task has to hold more than one example's text. Turns after the last reply are kept by an example without
target. Examples are written in order, with each text stored as what it adds to the one before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, saved

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Turns of a block, and characters of examples that a task hands on at once.
BLOCK, CHARS = 256, 1 << 22


def escaped(c: F.Column) -> F.Column:
    r"""Puts a backslash before the bar of every '<', backslashes, '|': no text has '<|' left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def segments(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, turn, segment, mask_start, mask_chars.

    The mask, in code points of the segment, covers an assistant's text and is null for other roles. Null
    role and text are empty. In a role, backslash and line feed are written with a backslash. Repeated rows are
    turns of their own; other columns are ignored.
    """
    role = F.coalesce("role", F.lit(""))
    line = escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), line, F.lit("\n"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(head, text, F.lit(END + "\n")).alias("segment"),
        F.when(role == "assistant", F.char_length(head)).cast("long").alias("mask_start"),
        F.when(role == "assistant", F.char_length(text)).cast("long").alias("mask_chars"),
    )


BLOCKS = "conv_id long, block long, text string, turns array<struct<n: long, start: long, chars: long>>"
EXAMPLES = "conv_id long, example long, text string, target_start long, target_end long, final boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def blocks(segs: DataFrame) -> DataFrame:
    """The columns of BLOCKS and key, part: up to BLOCK turns in a row, with the lengths and masks of their segments.

    Turns are in order of turn (null first), ties by the segment; (part, block) orders the blocks of a conversation.
    """
    turn = pa.struct([("n", pa.int64()), ("start", pa.int64()), ("chars", pa.int64())])
    kind = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("turns", pa.list_(turn))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, texts, turns = object(), 0, [], []

        def row() -> dict:
            return {"conv_id": now, "block": block, "text": "".join(texts), "turns": turns}

        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("conv_id", "segment", "mask_start", "mask_chars")]
            for conv, segment, start, chars in zip(*columns, strict=True):
                if turns and (conv != now or len(turns) == BLOCK):
                    out.append(row())
                    block, texts, turns = block + 1, [], []
                if conv != now:
                    now, block = conv, 0
                texts.append(segment)
                turns.append({"n": len(segment), "start": start, "chars": chars})
            yield pa.RecordBatch.from_pylist(out, kind)
        if turns:
            yield pa.RecordBatch.from_pylist([row()], kind)

    order = ["conv_id", "turn", "segment"]
    made = segs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)
    return made.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("key"), F.spark_partition_id().alias("part"))


def _with_prefixes(made: DataFrame) -> DataFrame:
    """blocks() with `before` (turns) and `prefix` of the conversation's earlier blocks, and whether it is the last."""
    light = made.select("key", "part", "block", F.size("turns").alias("n"))
    several = light.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1")
    w = Window.partitionBy("key").orderBy("part", "block")
    at = light.join(several, "key").select(
        "key", "part", "block", "blocks", F.row_number().over(w).alias("at"), (F.sum("n").over(w) - F.col("n")).alias("before")
    )
    cut = saved(made.join(at, ["key", "part", "block"]), "cut")
    earlier = cut.select("key", F.col("at").alias("from"), F.col("text").alias("piece"))
    pairs = cut.select("key", "at").join(earlier, "key").filter(F.col("from") < F.col("at"))
    pieces = F.array_sort(F.collect_list(F.struct("from", "piece")))
    prefix = pairs.groupBy("key", "at").agg(F.array_join(pieces["piece"], "").alias("prefix"))
    columns = ["conv_id", "text", "turns"]
    long = cut.join(prefix, ["key", "at"], "left").select(
        *columns, "before", F.coalesce("prefix", F.lit("")).alias("prefix"), (F.col("at") == F.col("blocks")).alias("last")
    )
    short = made.join(several, "key", "left_anti").select(
        *columns, F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix"), F.lit(True).alias("last")
    )
    return short.unionByName(long)


def examples(segs: DataFrame) -> DataFrame:
    """segments -> conv_id, example, text, target_start, target_end, final: one row for every assistant turn.

    text is the conversation up to and with that turn, trainable from target_start to target_end (code points
    of text); example is its number of turns. Turns after the last assistant turn add a row without target.
    final marks the row whose text is the whole conversation. An empty table gives no rows.
    """
    kind = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("target_start", pa.int64()), ("target_end", pa.int64()), ("final", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            columns = [b.column(c) for c in ("conv_id", "text", "turns", "before", "prefix", "last")]
            for i in range(b.num_rows):
                conv, text, turns, before, prefix, last = (c[i].as_py() for c in columns)
                whole, at = prefix + text, len(prefix)
                for k, t in enumerate(turns):
                    end, final = at + t["n"], last and k == len(turns) - 1
                    target = t["start"] is not None
                    if target or final:
                        start = at + t["start"] if target else None
                        out.append({"conv_id": conv, "example": before + k + 1, "text": whole[:end], "target_start": start, "target_end": start + t["chars"] if target else None, "final": final})
                        held += end
                    at = end
                    if held > CHARS:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, kind)

    bounded_batches(segs.sparkSession)
    return _with_prefixes(saved(blocks(segs), "blocks")).mapInArrow(run, EXAMPLES)


def write(rows: DataFrame, path: str) -> None:
    """examples() as Parquet; each text is stored as the length it shares with the one before and its rest."""
    front = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}
    rows.write.options(**front).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLES).parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """examples, as read -> per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are read from the final example, the loss from each example's target; formatted_chars counts the texts
    of all examples of a conversation.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            losses, counts, hashes = [], [], []
            for loss, whole in zip(b.column("loss"), b.column("whole"), strict=True):
                losses.append(unescaped(loss.as_py() or ""))
                text, n, digest, at = whole.as_py(), 0, hashlib.sha256(), 0
                for m in SEGMENT.finditer(text or ""):
                    if m.start() != at:
                        raise ValueError(f"unmarked text at {at} of a conversation")
                    n, at = n + 1, m.end()
                    digest.update(f"{unescaped_role(m[1])}\n{unescaped(m[2])}\n".encode())
                if at != len(text or ""):
                    raise ValueError(f"unmarked text at {at} of a conversation")
                counts.append(n if text else None)
                hashes.append(digest.hexdigest() if text else None)
            kept = [b.column(c) for c in ("conv_id", "example", "chars")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(losses, pa.string()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "example", "chars", "loss", "n", "sha"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        kind = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])

        def done() -> dict:
            return dict(zip(kind.names, (now, state[0], state[1], state[2], state[3].hexdigest(), state[4]), strict=True))

        for b in batches:
            out = []
            for conv, chars, loss, n, sha in zip(*[b.column(c).to_pylist() for c in ("conv_id", "chars", "loss", "n", "sha")], strict=True):
                if conv != now:
                    if state:
                        out.append(done())
                    now, state = conv, [None, None, 0, hashlib.sha256(), 0]
                if n is not None:
                    state[:2] = n, sha
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            yield pa.RecordBatch.from_pylist(out, kind)
        if state:
            yield pa.RecordBatch.from_pylist([done()], kind)

    loss = F.substring(F.col("text"), F.col("target_start").cast("int") + 1, (F.col("target_end") - F.col("target_start")).cast("int"))
    light = rows.select("conv_id", "example", F.char_length("text").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("final"), F.col("text")).alias("whole"))
    bounded_batches(rows.sparkSession)
    found = light.mapInArrow(turns, "conv_id long, example long, chars long, loss string, n long, sha string")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(sums, DIGESTS)
