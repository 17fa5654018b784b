"""Licence scans by canonical digests, in SQL functions only.

A text is put into canonical form: lower case, equivalent spellings made one, lines of copyright notices dropped, every
run of other characters than letters and digits (of any script) one space. Its SHA-256 is joined with the digests of known
licences in the same form. Entire texts are looked up, and each line of a text as a text of its own, since
one-line licence notices are entire texts in this sense. Comment marks and line ends are such other characters, so a licence in a comment, or wrapped anew, keeps its digest.

The known texts are a table that the caller gives, or by default the notices in KNOWN and the texts in licence_texts/. They are a fixed
few, so their digests are broadcast, and no text or line is shuffled.

Defined results: null and empty texts, and those with no letter or digit, have the digest of the empty text and no licence;
repeated rows have equal results; very long texts are looked up whole; an empty table gives no rows; only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("merchantibility", "merchantability"),
    ("https://", "http://"),
]
#: A line that states a copyright, with its year or holder in brackets, or that all rights are reserved; comment marks may come first. Dropped whole.
COPYRIGHT_LINE = r"^[ \t#*/;%!>-]*(?:(?:copyright|\(c\)|©)[ \t]*(?:copyright|\(c\)|©)?[ \t:,]*(?:[0-9]{4}|[<\[{]|the[ \t]+regents|\(c\)|$)|all[ \t]+rights[ \t]+reserved\.?[ \t]*$)"
NOT_CANONICAL = r"[^\p{L}\p{N}]+"
TEXTS = Path(__file__).resolve().parent / "licence_texts"

# Licence notices and licence texts by their public identifiers.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def default_licences() -> list[tuple[str, str]]:
    """Names and texts: the notices above, and one file for each text, named by its identifier."""
    return [*KNOWN, *((p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt")))]


def canonical_line(line: Column) -> Column:
    """Canonical form of one line in lower case."""
    x = line
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(F.trim(F.regexp_replace(x, NOT_CANONICAL, " ")))


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), canonical_line), lambda x: x != "")


def known(spark: SparkSession, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and licence of each known text; a canonical text that stands under two names takes the first in order."""
    rows = spark.createDataFrame(licences or default_licences(), "license string, body string")
    return rows.select(F.sha2(F.array_join(canonical_lines(F.col("body")), " "), 256).alias("known"), "license").groupBy("known").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, digest, license (of the entire text, else null), notices (sorted licences of its lines, may be empty).

    The known digests are a table of a few rows that the caller gives; they are collected once and looked up among the
    digests of a text's lines, so lines need no shuffle. Entire texts are joined with the table.
    """
    names = known(docs.sparkSession, licences)
    rows = names.orderBy("known").collect()
    digests, of = F.array(*[F.lit(r["known"]) for r in rows]), F.create_map(*[F.lit(v) for r in rows for v in r])
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    each = F.array_intersect(F.transform("lines", lambda x: F.sha2(x, 256)), digests)
    notices = F.array_sort(F.array_distinct(F.transform(each, lambda d: F.element_at(of, d))))
    whole = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), notices.alias("notices"))
    return whole.join(F.broadcast(names), F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license", "notices")


def oracle_sql(licences: list[tuple[str, str]] | None = None) -> str:
    """The same rows in DuckDB's SQL; notices as one comma-separated text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    x = "l"
    for a, b in SPELLINGS:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    line = f"CASE WHEN regexp_matches(l, {quoted(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace({x}, {quoted(NOT_CANONICAL)}, ' ', 'g')) END"
    lines = lambda c: f"list_filter(list_transform(string_split(lower(coalesce({c}, '')), chr(10)), lambda l: {line}), lambda l: l <> '')"
    body = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licences or default_licences())
    return f"""
    WITH listed(license, body) AS (VALUES {body}),
    known AS (SELECT sha256(array_to_string({lines("body")}, ' ')) AS known, min(license) AS license FROM listed GROUP BY 1),
    each AS (SELECT row_number() OVER () AS r, doc_id, {lines("text")} AS lines FROM documents),
    hits AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, sha256(unnest(lines)) AS known FROM each) JOIN known USING (known) GROUP BY r)
    SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest, license, coalesce(notices, '') AS notices
    FROM each LEFT JOIN known ON known = sha256(array_to_string(lines, ' ')) LEFT JOIN hits USING (r)
    """
