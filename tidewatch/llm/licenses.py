"""License scan by canonical digest: whole texts, normalised, are looked up among the digests of known license texts.

Normalisation makes what licenses' own matching rules call equal the same: case, copyright lines, punctuation and white
space, and equivalent spellings. The digest of the result is joined with the known digests by hash. A text is a whole
document, or a whole line of one (notices such as "Released under the MIT License." are texts of their own).

Only DataFrame functions; a scan and one aggregation per document that holds a notice. The table of known texts is a
parameter. Null texts count as empty and match nothing; null ids are allowed; rows that repeat are told apart by nothing
and get the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import pick, row_key

# Spellings that license matching treats as equal.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"),
             ("copyright owner", "copyright holder"), ("authorised", "authorized"), ("organisation", "organization"), ("favour", "favor"),
             ("behaviour", "behavior"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("http:", "https:"))
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
# A line that begins so and names a year, or that says nothing else.
STATEMENT = (r"(?m)^[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^\n]*(?:(?:19|20)\d\d|\[yyyy\]|<year>|\[year\])[^\n]*"
             r"|copyright[ \t]*(?:\(c\)|©)[^\n]*|all rights reserved[^a-z0-9\n]*$)")
NOT_WORD = r"[^\p{L}\p{N}]+"

# License texts and notices.
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
          "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
              "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
              "the documentation and/or other materials provided with the distribution.\n")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEXTS = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
     "to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the Software.\n\n" + _AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     'that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
     "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
     "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)
#: Further usual wordings of notices, each a line of its own.
MORE_NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "Released under the Unlicense."),
)
#: Digests (by ``match_digest``) of longer license texts as Debian's base-files gives them, with and without their appendix.
DIGESTS = (
    ("Apache-2.0", "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
)
#: Identifiers of an SPDX line; what else an expression holds are its operators.
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+()\- \t]+)"
SPDX_OPERATORS = ("and", "or", "with")
#: What every notice contains in any of its spellings; lines without it cannot match.
NOTICE_CORE = "licen"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def match_digest(text: Column) -> Column:
    """The digest that texts are looked up by: only lines that state a copyright go, and spellings do not depend on line breaks."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), STATEMENT, " ")
    out = F.regexp_replace(out, r"\s+", " ")
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.sha2(F.trim(F.regexp_replace(out, NOT_WORD, " ")), 256)


def known(spark: SparkSession, rows: tuple[tuple[str, str], ...], digests: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Digests of known texts (license, digest), by both forms; a fixed small table."""
    table = spark.createDataFrame(list(rows), "license string, text string")
    table = table.select("license", F.explode(F.array(digest(F.col("text")), match_digest(F.col("text")))).alias("digest"))
    return table.unionByName(spark.createDataFrame(list(digests), "license string, digest string")).distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: tuple = TEXTS + NOTICES + MORE_NOTICES, notices: tuple = NOTICES + MORE_NOTICES,
         digests: tuple = DIGESTS) -> DataFrame:
    """One row per document: __id, __raw, license (of the whole text, else null), notices (sorted ids of its lines that are notices), sha.

    ``sha`` is the digest of the plain canonical form; texts are looked up by it and by ``match_digest``.
    """
    assert all(NOTICE_CORE in t.lower() for _, t in notices)
    spark = docs.sparkSession
    rows = pick(docs, id=doc_id, text=text)
    line = F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit(NOTICE_CORE)))))
    # The known digests are tables of constants; they may be broadcast.
    lines = rows.select(F.col("id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__raw"), line.alias("line"))
    stated = F.filter(F.regexp_extract_all("line", F.lit(SPDX), 1), lambda x: F.length(F.trim(x)) > 0)
    ids = F.filter(F.split(F.trim(F.regexp_replace(F.concat_ws(" ", stated), r"[()\s]+", " ")), " "), lambda x: (x != "") & ~F.lower(x).isin(*SPDX_OPERATORS))
    plain = lines.withColumn("digest", F.explode(F.array_distinct(F.array(digest(F.col("line")), match_digest(F.col("line"))))))
    plain = plain.join(F.broadcast(known(spark, notices)), "digest").select("__id", "__raw", "license")
    lines = plain.unionByName(lines.select("__id", "__raw", F.explode(ids).alias("license")))
    found = F.array_join(F.array_sort(F.collect_set("license")), ",")
    lines = lines.groupBy("__id", "__raw").agg(found.alias("notices"))
    lines = lines.select(F.col("__id").alias("i"), F.col("__raw").alias("r"), "notices")
    table = known(spark, whole, digests)
    texts = rows.select(*row_key(F.col("id"), F.col("text")), digest(F.col("text")).alias("digest"), match_digest(F.col("text")).alias("match"))
    texts = texts.join(F.broadcast(table.withColumnRenamed("license", "plain")), "digest", "left")
    texts = texts.join(F.broadcast(table.withColumnRenamed("digest", "match")), "match", "left").withColumn("license", F.coalesce("plain", "license"))
    out = texts.join(lines, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__raw") == F.col("r")), "left")
    return out.select("__id", "__raw", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.col("digest").alias("sha"))
