"""WARC archives with a two-level capture index.

Archives are WARC 1.1 files in the shared folder, a gzip member for each record, written by Spark's text
writer, so that any store will do and lost tasks leave nothing. The index has compressed blocks of captures sorted by
reversed-host URL key, and a sparse directory with the first key of each block, in parts that are in order too.
Look-ups are routed by bisecting the parts' first keys; each part's task bisects its directory, then the blocks
it finds, and the captures found are read by ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, opened, saved

LEAST = 1000
BLOCK_LINES = 500
#: Captures of an index part, on average, until there are MOST_PARTS parts: their first keys are held by every task.
PART_CAPTURES, MOST_PARTS = 10_000, 20_000
#: Bytes that a scan reads at once.
CHUNK = 1 << 20
#: Records of an archive file.
RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4
GZIP = zlib.MAX_WBITS | 16
CAPTURE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def url_key(url: str | None) -> str:
    """Reversed-host sort key: http://www.Example.com/a?b -> com,example,www)/a?b; '' for none."""
    if not (url or "").strip():
        return ""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return (url or "").strip()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return key + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def target(url: str) -> F.Column:
    """A url as records have it: blanks and control characters as %20."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def _records(pages: DataFrame) -> DataFrame:
    """The record of each page, as a string `value`."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        target("url").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    p = p.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long"))
    groups = p.filter(F.col("n") >= LEAST).groupBy("digest", "n").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    # A payload of many copies is a skewed key of this join, which Spark splits.
    p = p.join(groups.filter("copies > 1").drop("copies"), ["digest", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name("page_id"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("first"))
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return p.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("value"))


def member(record: bytes) -> bytes:
    """A record as gzip whose last byte is zero, as that of a length under 16 MiB is; longer ones get an empty member."""
    out = gzip.compress(record, LEVEL, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", LEVEL, mtime=0)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The writer's separator gives the last zero of each member back.
    for b in batches:
        for i in range(0, b.num_rows, 256):
            out = [member(x.as_buffer().to_pybytes())[:-1] for x in b.column(0).slice(i, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """A record for each row of pages (page_id, url, html), in WARC files of RECORDS records at most.

    Of records with equal payloads of LEAST bytes or more, that with the largest page_id is the response and
    the others revisit it (rows that repeat this page_id are responses too; a null page_id never is preferred).
    Null html is an empty payload; null or empty url has no target line; blanks and control characters of a
    url are written as %20. An empty table writes an archive without records.
    """
    bounded_batches(pages.sparkSession)
    (
        _records(pages)
        .select(F.col("value").cast("binary").alias("value"))
        .mapInArrow(_compressed, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", RECORDS)
        .option("compression", "none")
        .text(path)
    )


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def scan(archive) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header) of each record of an archive, a binary file that is read in order; of a record no more
    than its header is held."""
    at, end, left = 0, 0, b""
    while True:
        z, head, size = zlib.decompressobj(GZIP), b"", 0
        while not z.eof:
            data = left or archive.read(CHUNK)
            if not data:
                if end == at and not size:
                    return
                raise ValueError("archive ends within a record")
            plain, left = z.decompress(data), b""
            size, end = size + len(plain), end + len(data)
            if b"\r\n\r\n" not in head:
                head += plain
        left = z.unused_data
        end -= len(left)
        if size:
            yield at, end - at, _header(head[: head.index(b"\r\n\r\n")])
        at = end


def parse(record: bytes) -> tuple:
    """The fields of CAPTURE from the gzip member of a record."""
    record = zlib.decompressobj(GZIP).decompress(record)
    end = record.index(b"\r\n\r\n")
    header = _header(record[:end])
    body = record[end + 4 : end + 4 + int(header["content-length"])]
    cut = body.index(b"\r\n\r\n")
    payload = body[cut + 4 :]
    page, first = (header.get(k, "")[len("<urn:x-page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
    kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
    size = int(_header(body[:cut])["content-length"])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record of page {page} differs from its digest")
    return (int(page) if page else None, header.get("warc-target-uri"), kind, int(first) if first else None, size, digest, None if kind == "revisit" else payload)


BLOCKS = "part int, block int, first_key string, data binary"


def build_index(spark: SparkSession, archives: str, path: str) -> None:
    """Writes `path`/blocks (compressed captures, sorted by key) and `path`/directory (first key of each block)."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                with opened(name) as archive:
                    rows = [(url_key(h.get("warc-target-uri")), name, at, n) for at, n, h in scan(archive)]
                yield pd.DataFrame(rows, columns=["key", "path", "at", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(archives).select("path", "length")
    found = saved(files.mapInPandas(entries, "key string, path string, at long, n long"), "entries")
    parts = max(1, min(-(-found.count() // PART_CAPTURES), MOST_PARTS))
    order = ["key", "path", "at"]
    placed = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, lines = TaskContext.get().partitionId(), 0, []

        def block() -> pd.DataFrame:
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            return pd.DataFrame({"part": [part], "block": [k], "first_key": [lines[0][0]], "data": [data]})

        for b in batches:
            for row in b.itertuples(index=False):
                lines.append((row.key, row.path, int(row.at), int(row.n)))
                if len(lines) == BLOCK_LINES:
                    yield block()
                    k, lines = k + 1, []
        if lines:
            yield block()

    placed.mapInPandas(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    discard(found)
    spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("data").write.parquet(f"{path}/directory")


def find(keys: list[str], directory: list[tuple[str, bytes]]) -> Iterator[tuple[str, str, int, int]]:
    """The captures (key, path, at, n) of `keys`, ascending, in a part: bisects its directory (first key and block, in
    order), then the block, and goes on to the next one where a key runs over its end."""
    firsts, held, lines = [f for f, _ in directory], None, []
    for key in keys:
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(firsts) and firsts[i] <= key:
            if held != i:
                held, lines = i, [json.loads(x) for x in zlib.decompress(directory[i][1]).decode().split("\n")]
            j = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while j < len(lines) and lines[j][0] == key:
                yield tuple(lines[j])
                j += 1
            if j < len(lines):
                break
            i += 1


def lookup(urls: DataFrame, index: str) -> DataFrame:
    """urls (url) -> the captures of all of them, with the columns of CAPTURE, each capture once; payload is null for revisits.

    Urls without a capture give no rows; null and blank urls find the captures without target.
    """
    spark = urls.sparkSession

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": [url_key(u) for u in b["url"]]})

    asked = urls.select("url").distinct().mapInPandas(keys, "key string").distinct()
    directory = spark.read.schema("part int, block int, first_key string").parquet(f"{index}/directory")
    firsts = sorted((r["first"], r["part"]) for r in directory.groupBy("part").agg(F.min("first_key").alias("first")).collect())  # MOST_PARTS rows at most

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f for f, _ in firsts]
        for b in batches:
            # From the last part that begins before the key to the last that begins with it.
            rows = [(k, firsts[i][1]) for k in b["key"] for i in range(max(0, bisect.bisect_left(names, k) - 1), bisect.bisect_right(names, k))]
            yield pd.DataFrame(rows, columns=["key", "part"])

    def search(key: tuple, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        found = find(sorted(asked["key"]), list(zip(blocks["first_key"], blocks["data"], strict=True)))
        return pd.DataFrame([x[1:] for x in found], columns=["path", "at", "n"])

    routed = asked.mapInPandas(route, "key string, part int")
    blocks = spark.read.schema(BLOCKS).parquet(f"{index}/blocks")
    found = routed.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(search, "path string, at long, n long")
    found = saved(found, "found")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, names = Ranges(), [x.split()[0] for x in CAPTURE.split(", ")]
        for b in batches:
            for i in range(0, len(b), 50):
                rows = [parse(ranges.read(r.path, r.at, r.n)) for r in b.iloc[i : i + 50].itertuples(index=False)]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    # Captures are named by little data but stand for much more: a number of tasks that Spark does not merge by size.
    tasks = max(1, min(-(-found.count() // PART_CAPTURES), MOST_PARTS))
    return found.repartition(tasks, "path", "at").mapInPandas(run, CAPTURE)


class Ranges:
    """Reads ranges of files of any store; keeps a few of them open."""

    def __init__(self, most: int = 32):
        self.open, self.most = OrderedDict(), most

    def read(self, path: str, at: int, n: int) -> bytes:
        if path not in self.open:
            self.open[path] = opened(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.open[path].read_at(n, at)
