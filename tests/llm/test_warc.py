import gzip
import hashlib
import io
import json
import zlib

import pytest

from sectorline.llm import warc
from sectorline.llm.common import new_path

PAGES = "page_id long, url string, html string, first int, digest int, n int"


def archived(spark, rows):
    path = new_path(spark, "test")
    warc.write_archives(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], PAGES), f"{path}/a")
    warc.build_index(spark, f"{path}/a", f"{path}/i")
    return f"{path}/i"


def lookup(spark, index, *urls):
    return warc.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), index).collect()


PAGE = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 90


def test_round_trip_and_lookup(spark):
    big = 2**60
    rows = [(1, "http://a.example/x", PAGE), (9, "http://b.example/", PAGE), (3, None, None), (4, "http://a.example/x", ""), (5, "bad url\r\n:x", "short"), (None, "http://c.example", PAGE)]
    rows += [(big + 1, "http://d.example/", "x" * 3000), (big + 3, "http://d.example/", "x" * 3000), (7, " ", "y" * 999), (8, "http://e.example", "y" * 999), (7, " ", "y" * 999)]
    index = archived(spark, rows)
    urls = [spark.createDataFrame([(r[1],) for r in rows], "url string").select(warc.target("url").alias("url"))]
    got = warc.lookup(urls[0], index).collect()
    assert sorted((r["page_id"] or -1) for r in got) == sorted((r[0] or -1) for r in rows)
    by = {r["page_id"]: r for r in got}
    assert bytes(by[9]["payload"]).decode() == PAGE and (by[1]["record_type"], by[1]["refers_to"]) == ("revisit", 9)
    assert by[None]["refers_to"] == 9 and by[3]["payload_bytes"] == 0 and by[5]["record_type"] == "response"
    assert by[1]["payload_digest"] == hashlib.sha1(PAGE.encode()).hexdigest()
    assert by[big + 1]["refers_to"] == big + 3 and by[big + 3]["record_type"] == "response" and by[7]["record_type"] == "response"
    assert sorted(r["page_id"] for r in lookup(spark, index, "http://a.example/x", "http://nobody.example")) == [1, 4]
    assert lookup(spark, index, "http://nobody.example") == []
    assert [r["page_id"] for r in lookup(spark, index, None)] == [3] and warc.url_key(None) == ""


def test_many_parts_and_a_hot_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_CAPTURES", 20)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 7}.example/{i}" if i % 3 else "http://hot.example/", f"page {i}") for i in range(300)]
    index = archived(spark, rows)
    assert spark.read.parquet(f"{index}/directory").select("part").distinct().count() > 5
    assert sorted(r["page_id"] for r in lookup(spark, index, *{r[1] for r in rows})) == list(range(300))
    assert sorted(r["page_id"] for r in lookup(spark, index, "http://hot.example/")) == list(range(0, 300, 3))


def test_find_bisects():
    class Counted(bytes):
        pass

    entries = sorted((f"k{i // 5:03d}", "p", i, 1) for i in range(500))
    read = []

    class Directory(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    directory = Directory((entries[i][0], zlib.compress("\n".join(json.dumps(x) for x in entries[i : i + 7]).encode())) for i in range(0, 500, 7))
    for key in ("k000", "k050", "k099", "zzz", "a"):
        read.clear()
        assert list(warc.find([key], directory)) == [e for e in entries if e[0] == key]
        assert len(read) <= 3
    assert list(warc.find(sorted({e[0] for e in entries}), directory)) == entries


def test_scan_reads_in_pieces(monkeypatch):
    first, empty = warc.member(b"WARC/1.1\r\nA: b\r\n\r\n" + bytes(range(256)) * 40), gzip.compress(b"", mtime=0)
    assert first[-1] == 0 and gzip.decompress(first).startswith(b"WARC/1.1")
    content = first + empty + first  # a long record is followed by an empty member
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [(at, n, h) for at, n, h in warc.scan(io.BytesIO(content))] == [(0, len(first), {"a": "b"}), (len(first) + len(empty), len(first), {"a": "b"})]
        with pytest.raises(ValueError):
            list(warc.scan(io.BytesIO(content[:-3])))


def test_empty_table(spark):
    assert lookup(spark, archived(spark, []), "http://a.example/") == []
