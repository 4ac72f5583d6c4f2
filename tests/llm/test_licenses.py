import hashlib
import os
import re
import unicodedata

import pytest

from sectorline.llm import licenses

DOC = "doc_id long, text string, digest string, found int, lines int"
TEXT = dict(reversed([k for k in licenses.KNOWN if "\n" in k[1]]))
OWNER = "Copyright (c) 2020 Some Body\n\n"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOC)


def wrapped(text, width=70):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}" if line else w
    return "\n".join([*out, line])


CASES = [
    ("MIT", "MIT License\n\n" + OWNER + TEXT["MIT"]),
    ("MIT", "The MIT License (MIT)\r\n\r\n" + OWNER.replace("\n", "\r\n") + wrapped(TEXT["MIT"]).replace("\n", "\r\n")),
    ("MIT", "/*\n * MIT License\n *\n * Copyright © 2021 X\n *\n" + "\n".join(" * " + x for x in wrapped(TEXT["MIT"]).split("\n")) + "\n */"),
    ("MIT", OWNER + TEXT["MIT"].replace('"', "“", 1).replace("sublicense", "sub-license").replace(" ", " ").upper()),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + wrapped(TEXT["BSD-3-Clause"])),
    ("BSD-2-Clause", "Copyright 2020, X\nAll rights reserved.\n\n" + TEXT["BSD-2-Clause"].replace("\n\n2. R", "\n* R").replace("\n\n1. R", "\n* R").replace("* R", "2. R", 2).replace("2. R", "1. R", 1)),
    ("ISC", "ISC License\n\n" + OWNER + wrapped(TEXT["ISC"])),
    ("Zlib", OWNER + TEXT["Zlib"].replace("acknowledgment", "acknowledgement")),
]


def test_ordinary_files_are_found(spark):
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(CASES)]), licenses.known(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(CASES)}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_licences_are_found(spark):
    rows = [(i, open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read()) for i, n in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"))]
    rows.append((6, rows[0][1][: rows[0][1].index("APPENDIX")]))
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(docs(spark, rows), licenses.known(spark)).collect()}
    assert got == dict(enumerate(["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0", "Apache-2.0"]))


def plain(text):
    """The canonical form by loops over lines and characters."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    kept = [x for x in low.split("\n") if not re.match(licenses.COPYRIGHT.removeprefix("(?m)"), x)]
    words = "".join(" " if unicodedata.category(c)[0] in "PSZ" or unicodedata.category(c) in ("Cc", "Cf") else c for c in "\n".join(kept)).split()
    out = " " + "  ".join(words) + " "
    for a, b in licenses.SPELLINGS:
        out = out.replace(" " + a.replace(" ", "  ") + " ", f" {b} ")
    return " ".join(out.split())


ODD = ["", None, " \n\t", "Released under the MIT Licence!\nmore", "x\n  released under the mit license \ny\nReleased, under: the MIT License.", "Licensed under CC BY 4.0.​\nLicensed under the Apache License, v 2.0.", "©\n(c) 2020\ncopyright law is long", "All rights reserved.\nAll rights reserved by none", "ŁÓDŹ — “quoted”", "line\r\nReleased under the MIT License.\r\n", "Licensed under CC BY 4.0 " * 20_000]


@pytest.mark.parametrize("small", [1000, 0])
def test_lines_and_odd_rows_against_loops(spark, monkeypatch, small):
    monkeypatch.setattr(licenses, "SMALL", small)
    rows = list(enumerate(ODD)) + [(None, ODD[3]), (3, ODD[3])] + [(100 + i, t) for i, (_, t) in enumerate(CASES)]
    book = licenses.known(spark)
    ids = {r["digest"]: r["license_id"] for r in book.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, sha(plain(t)), ids.get(sha(plain(t))), sorted({ids[d] for x in (t or "").split("\n") if (d := sha(plain(x))) in ids})) for i, t in rows]
    got = [(r["doc_id"], r["digest"], r["text_license"], r["line_licenses"]) for r in licenses.scan(docs(spark, rows), book).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.scan(docs(spark, []), book).count() == 0
    assert licenses.scan(docs(spark, rows), licenses.known(spark, [])).filter("text_license is not null or size(line_licenses) > 0").count() == 0
