"""Licence scan by canonical digests (DataFrame functions only).

A text is put into a canonical form: lower case, copyright lines removed, punctuation and white
space reduced to single spaces, equivalent spellings unified.  The SHA-256 of the whole form is
hash-joined to the digests of known licence texts.  Each line is also taken as the entire text
of a one-line notice and looked up among the digests of known notices.

Defined results: null, empty and punctuation-only texts have the digest of the empty form and no
licence.  One row out for each row in, repeated rows too; nothing is shuffled.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table

#: Spellings that count as equal.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("per cent", "percent"), ("https", "http"), ("copyright owner", "copyright holder"),
]

#: Licence names as notices spell them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
#: The ways a notice names a licence.
FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "SPDX-License-Identifier: {}"]

#: Whole licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT],
    "ISC": [_ISC, "ISC License\n\n" + _ISC],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_END, "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END],
    "BSD-3-Clause": [_BSD_HEAD + _BSD_NAME + _BSD_END, "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_END],
}
#: Whole texts that are too long for this file: Apache-2.0, GPL, LGPL, MPL-2.0 and CC0-1.0, as /usr/share/common-licenses has them.
TEXTS |= {f.stem: [f.read_text("utf-8")] for f in sorted((Path(__file__).parent / "texts").glob("*.txt"))}
#: The instructions after this line are often left out.
_LAST_LINE = "END OF TERMS AND CONDITIONS"
TEXTS |= {k: [*texts, texts[0].split(_LAST_LINE)[0] + _LAST_LINE, texts[0].split(_LAST_LINE)[0]] for k, texts in TEXTS.items() if _LAST_LINE in texts[0]}

#: A line that begins as a copyright notice does.  "(c)" alone may head a list item, so a year or its placeholder must
#: follow it; "all rights reserved" must be all the line says.
COPYRIGHT_LINES = r"(?m)^[ \t*#/;-]*(?:(?:copyright[ \t]*(?:\(c\)|©|<|\[|[0-9]{4})|\(c\)[ \t]*(?:copyright|<|\[|[0-9]{4})|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the canonical form under ``name``, line ends still in place.

    Only texts with one of the spellings go through their replacements.
    """
    c = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(COPYRIGHT_LINES), F.lit(""))
    bare = rows.withColumn(name, F.regexp_replace(c, F.lit(PUNCTUATION), F.lit(" ")))
    c = F.col(name)
    for spelt, meant in SPELLINGS:
        c = F.regexp_replace(c, F.lit(rf"\b{spelt}\b"), F.lit(meant))
    some = F.col(name).rlike(rf"\b(?:{'|'.join(spelt for spelt, _ in SPELLINGS)})\b")
    return bare.withColumn(name, F.when(some, c).otherwise(F.col(name)))


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, F.lit(r"[ \n]+"), F.lit(" ")))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every entry: whole texts, and one-line notices made by FORMS from NAMES."""
    notices = [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FORMS]
    return [(k, t) for k, texts in TEXTS.items() for t in texts] + notices


def known(spark: SparkSession) -> DataFrame:
    """(digest, license): one row a digest, a constant table of a few hundred rows."""
    rows = spark.createDataFrame(known_texts(), "license string, body string")
    return canonical_lines(rows, "body", "lines").groupBy(F.sha2(whole(F.col("lines")), 256).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, digest, license (of the whole text, or null), notices (sorted licences named by lines), n_notices."""
    spark = docs.sparkSession
    pairs = {r["digest"]: r["license"] for r in known(spark).collect()}  # a constant of the module, not of the data
    table_ = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license")) for d, k in sorted(pairs.items())))))
    by_line = F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))
    forms = canonical_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "lines")
    # only lines with these words can be notices: every known notice has one of them
    hinted = F.filter(F.split("lines", "\n"), lambda x: x.rlike("licensed|released under|spdx"))
    named = F.filter(F.transform(hinted, lambda x: F.try_element_at(by_line, F.sha2(F.trim(F.regexp_replace(x, " +", " ")), 256))), lambda x: x.isNotNull())
    looked = forms.select("doc_id", F.sha2(whole(F.col("lines")), 256).alias("digest"), F.array_sort(F.array_distinct(named)).alias("notices"), F.size(named).cast("bigint").alias("n_notices"))
    return looked.join(F.broadcast(table_), "digest", "left").select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"), "n_notices")


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _canonical_sql(text: str) -> str:
    c = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINES}', '', 'g')"
    c = f"regexp_replace({c}, '{PUNCTUATION}', ' ', 'g')"
    for spelt, meant in SPELLINGS:
        c = rf"regexp_replace({c}, '\b{spelt}\b', '{meant}', 'g')"
    return c


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH known AS (
  SELECT sha256(trim(regexp_replace({_canonical_sql("body")}, '[ \\n]+', ' ', 'g'))) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known_texts())}) v(license, body) GROUP BY 1),
forms AS (SELECT row_number() OVER () AS rid, doc_id, {_canonical_sql("text")} AS lines FROM documents),
hits AS (
  SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
  FROM (SELECT rid, unnest(string_split(lines, chr(10))) AS line FROM forms) JOIN known ON known.digest = sha256(trim(regexp_replace(line, ' +', ' ', 'g')))
  GROUP BY rid),
hashed AS (SELECT *, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS digest FROM forms)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM hashed LEFT JOIN known USING (digest) LEFT JOIN hits USING (rid)
"""
