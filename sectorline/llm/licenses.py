"""Licence scan by digests of canonical text.

A text is canonical in lower case, without copyright lines, punctuation, symbols and control characters of any
script, with one spelling of words that licences spell in several ways and single blanks. The digest of an
entire text - a document, or one of its lines - is looked up among those of known licences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and short licence texts by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Titles that a licence's text may have above it.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Digest and length of the canonical texts of long licences, entire and up to the end of their terms.
DIGESTS = [
    ("Apache-2.0", 9881, "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", 8865, "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", 8837, "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", 6697, "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("GFDL-1.2-only", 19584, "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", 22020, "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", 9415, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", 9387, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0-only", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", 14455, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0-only", 33409, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-only", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0-only", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0-only", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", 22249, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1-only", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0-only", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22468, "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", 14353, "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
]
# Spelling, and that used instead.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("organisation", "organization"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("merchantibility", "merchantability"), ("v", "version"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only names who holds the rights.
COPYRIGHT = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved[.]?[ \t\r]*$)[^\n]*"
#: Whatever is no letter, mark on a letter, or number; the first ranges are for speed.
MARKS = r"[^a-z0-9\p{L}\p{M}\p{N}]+"
#: Licences that are looked up without a shuffle, at most; a larger book is joined.
SMALL = 1000


def unowned(c: F.Column) -> F.Column:
    """The text in small letters (of ASCII), without lines that only name who holds the rights."""
    low = F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)
    named = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in ("copyright", "(c)", "©", "all rights reserved")])
    return F.transform(F.array(low), lambda x: F.when(named(x), F.regexp_replace(x, COPYRIGHT, "")).otherwise(x))[0]


def _worded(x: F.Column, spellings: list[tuple[str, str]] = SPELLINGS) -> F.Column:
    """x, in which single blanks stand between words, in one spelling."""
    x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word between blanks of its own
    x = reduce(lambda x, s: F.replace(x, F.lit(f" {s[0]} ".replace(" ", "  ")[1:-1]), F.lit(f" {s[1]} ")), spellings, x)
    return F.replace(x, F.lit("  "), F.lit(" "))


def _joined(lines: F.Column) -> F.Column:
    """canonical() of a text from that of its lines: what is spelled in two words may run over the end of one."""
    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.trim(_worded(whole, [s for s in SPELLINGS if " " in s[0]]))


def canonical(c: F.Column) -> F.Column:
    # Marks that are no blank are rare; matching every blank would cost most of the time.
    words = F.regexp_replace(unowned(c), MARKS.replace("[^", "[^ "), " ")
    return F.trim(_worded(F.trim(F.regexp_replace(words, "  +", " "))))


def _canonical_lines(low: F.Column) -> F.Column:
    """canonical() of each line of an unowned() text, in one pass."""
    words = F.regexp_replace(low, MARKS.replace("[^", "[^ \n"), " ")
    words = F.regexp_replace(words, "  +", " ")
    return F.transform(F.split(_worded(F.replace(words, F.lit("\n"), F.lit(" \n "))), "\n"), lambda x: F.trim(x))


def entries() -> list[tuple[str, str]]:
    """The licences known by their text: notices, and whole texts with and without a title."""
    return KNOWN + [(i, f"{title}\n\n{text}") for i, text in KNOWN if "\n" in text for title in TITLES.get(i, [])]


def known(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, chars, license_id) of licence texts; a digest with several ids keeps the first in order, blank texts are
    left out. By default all licences of this module."""
    table = spark.createDataFrame(entries() if rows is None else rows, "license_id string, text string")
    table = table.select("license_id", canonical(F.col("text")).alias("text")).filter("text <> ''")
    table = table.select(F.sha2("text", 256).alias("digest"), F.char_length("text").alias("chars"), "license_id")
    if rows is None and DIGESTS:
        table = table.unionByName(spark.createDataFrame([(d, n, i) for i, n, d in DIGESTS], "digest string, chars int, license_id string"))
    return table.groupBy("digest").agg(F.first("chars").alias("chars"), F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """docs (doc_id, text), licenses from known() -> one row per row of docs: doc_id, digest, text_license
    (of the entire text, else null), line_licenses (of its lines, distinct and sorted; empty if none).

    Null text counts as empty; texts that are blank after normalising match nothing. Repeated rows and null
    ids stay; other columns are ignored. An empty table gives no rows. A book of SMALL licences or fewer is broadcast
    and lines are looked up within their row; a larger one is joined.
    """
    size, lengths = licenses.agg(F.count(F.lit(1)), F.collect_set("chars")).first()
    lengths = [int(n) for n in lengths]
    book = licenses.select("digest", F.col("license_id").alias("text_license"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _canonical_lines(unowned(F.col("text"))).alias("all"))
    lines = F.filter("all", lambda x: F.char_length(x).isin(lengths) if lengths else F.lit(False))
    found = F.array_distinct(F.transform(lines, lambda x: F.sha2(x, 256)))
    d = docs.select("doc_id", F.sha2(_joined(F.col("all")), 256).alias("digest"), found.alias("found"))
    none = F.array().cast("array<string>")
    if size <= SMALL:
        ids = {r["digest"]: r["text_license"] for r in book.collect()}
        if ids:
            by = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
            hits = F.transform(F.filter("found", lambda x: x.isin(list(ids))), lambda x: by[x])
        else:
            hits = none
        out = d.join(F.broadcast(book), "digest", "left")
        return out.select("doc_id", "digest", "text_license", F.array_sort(F.array_distinct(hits)).alias("line_licenses"))
    d = d.withColumn("lines", F.sha2(F.array_join("found", ","), 256))
    hits = d.filter(F.size("found") > 0).select("lines", F.explode("found").alias("digest")).distinct().join(book, "digest")
    hits = hits.groupBy("lines").agg(F.array_sort(F.collect_set("text_license")).alias("line_licenses"))
    out = d.drop("found").join(hits, "lines", "left").join(book, "digest", "left")
    return out.select("doc_id", "digest", "text_license", F.coalesce("line_licenses", none).alias("line_licenses"))
