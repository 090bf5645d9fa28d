"""Licence scans by canonical digests.

A text in canonical form has lower case, equivalent spellings made one, no copyright lines and
no punctuation, and single spaces. Two texts are the same licence if the digests of their
canonical forms are equal. Each document is looked up as a whole, and so is each of its
paragraphs (between blank lines), runs of consecutive paragraphs, and lines: a licence or a
notice inside a longer file has to match entirely as well, never by parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveyloom.llm.arrays import blocks, cut, let, running_sum
from surveyloom.llm.license_texts import full_texts
from surveyloom.operators.lookup import attach

# The wording of licences and of the notices that name them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
)
# Spellings that licence matching treats as equal, found and replaced in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("whilst", "while"),
)
COPYRIGHT_LINE = "^[ \\t]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"
# comment marks before such a line, and wrapped lines of licences that only begin like one
_MARKS = "(?m)^[ \\t#*/;%!<|-]+(?=copyright|\\(c\\)|©|all rights reserved)"
_WRAPPED = (
    "(?m)^(?=copyright (?:holders?|notices?|licenses?|laws?|statements?|disclaimers?|on the program|and related)\\b"
    "|\\(c\\) (?:you must|under patent))"
)
#: Characters of a run's first paragraph, and as many at its end, that have to be those of a known text.
OPENING = 8


def canonical(text: Column) -> Column:
    """The canonical form of each line; line breaks stay, so that lines can be told apart."""
    out = F.regexp_replace(F.lower(text), "\\r\\n?", "\n")
    for found, made in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(made))
    # a full stop keeps the line, and goes with the other punctuation
    out = F.regexp_replace(F.regexp_replace(out, _MARKS, ""), _WRAPPED, ". ")
    # the ranges are those of ASCII letters and digits, and all characters beyond ASCII
    out = F.regexp_replace(out, f"(?m){COPYRIGHT_LINE}", "")
    out = F.regexp_replace(out, "[\\x00-\\x09\\x0b-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")
    return F.regexp_replace(out, " ?\\n ?", "\n")


def joined(text: Column) -> Column:
    """A canonical form of several lines as one line."""
    return F.trim(F.regexp_replace(text, "[ \\n]+", " "))


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """``digest``, ``license``, ``length``, ``opening`` and ``closing`` of known texts; the first name of a text counts.

    By default these are ``KNOWN`` and the full texts and headers of ``license_texts``.
    """
    known = [*KNOWN, *full_texts(KNOWN[-2:])] if known is None else known
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(known)], "n int, license string, text string")
    made = rows.select("n", "license", joined(canonical(F.col("text"))).alias("form"))
    made = made.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min_by("license", "n").alias("license"), F.min("form").alias("form"))
    ends = [F.left("form", F.lit(OPENING)).alias("opening"), F.right("form", F.lit(OPENING)).alias("closing")]
    return made.select("digest", "license", F.char_length("form").alias("length"), *ends)


def _runs(paragraphs: Column, told: list) -> Column:
    """Runs of two or more paragraphs that begin and end like a known text and are as long as one.

    The paragraphs are joined once. For each that begins like known texts, and each of those, only
    the place where the run would end is looked at, and the run itself if a paragraph ends there.
    """
    if not told:
        return F.array().cast("array<struct<unit:string,line:int,form:string>>")
    known = F.array(
        *[
            F.struct(*[F.lit(r[c]).alias(c) for c in ("length", "opening", "closing")])
            for r in sorted(told, key=lambda r: (r["length"], r["opening"], r["closing"]))
        ]
    )
    # a line break ends each paragraph, and takes the place of the space that follows it in a run
    text = F.concat(F.array_join(F.transform(paragraphs, lambda p: p["form"]), "\n"), F.lit("\n"))
    places = running_sum(F.transform(paragraphs, lambda p: F.char_length(p["form"]) + 1))
    placed = F.zip_with(
        paragraphs, places, lambda p, at: F.struct(at.alias("at"), p["line"].alias("line"), F.left(p["form"], F.lit(OPENING)).alias("opening"))
    )
    openings = sorted({r["opening"] for r in told})
    first = F.filter(placed, lambda p: p["opening"].isin(openings))
    begun = F.exists(paragraphs, lambda p: F.left(p["form"], F.lit(OPENING)).isin(openings))

    def of_start(pieces: Column, p: Column) -> Column:
        def ends(k: Column) -> Column:
            end = p["at"] + k["length"]
            return (k["opening"] == p["opening"]) & (
                F.translate(cut(pieces, end - OPENING, end + 1), "\n", " ") == F.concat(k["closing"], F.lit(" "))
            ) & (cut(pieces, end, end + 1) == "\n")

        run = F.transform(F.filter(known, ends), lambda k: cut(pieces, p["at"], p["at"] + k["length"]))
        return F.transform(
            F.filter(F.array_distinct(run), lambda x: x.contains("\n")),
            lambda x: F.struct(F.lit("n_paragraphs").alias("unit"), p["line"].alias("line"), F.translate(x, "\n", " ").alias("form")),
        )

    runs = let(blocks(text), lambda pieces: F.flatten(F.transform(first, lambda p: of_start(pieces, p))))
    return F.when(begun, runs).otherwise(F.array().cast("array<struct<unit:string,line:int,form:string>>"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences that entire texts, paragraphs or lines of the documents are.

    One row per id and licence with ``n_whole``, ``n_paragraphs`` and ``n_lines``, the numbers of
    units that match, and ``first_line`` (from 1) of the first one. A text of one line counts as
    whole, paragraph and line. A run of consecutive paragraphs that is a known text counts among
    the paragraphs, unless it is all of the document. Null and empty texts have no units; repeated rows and ids add up,
    null ids too; other columns are left out; an empty table gives no rows. Without known
    licences nothing is found.

    Rows do not move until they have matched; the known digests are joined by hash, and
    broadcast only after their size was measured.
    """
    # lines have single spaces between words only, but for the ends of the text
    form = F.trim(canonical(F.col(text)))
    lines = docs.select(F.col(id_column), form.alias("form")).filter(F.col("form").isNotNull())
    lines = lines.withColumn("lines", F.split("form", "\n"))
    # a paragraph starts at a line with words after one without
    starts = F.filter(
        F.sequence(F.lit(1), F.size("lines")),
        lambda i: (F.element_at("lines", i) != "") & ((i == 1) | (F.element_at("lines", F.greatest(i - 1, F.lit(1))) == "")),
    )
    numbered = F.transform("lines", lambda x, i: F.struct(F.lit("n_lines").alias("unit"), (i + 1).alias("line"), x.alias("form")))
    # what lines without words set apart, in the order of their first lines
    parts = F.filter(
        F.transform(F.split("form", "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " "))), lambda x: x != ""
    )
    paragraphs = F.zip_with(
        starts,
        parts,
        lambda s, x: F.struct(F.lit("n_paragraphs").alias("unit"), s.alias("line"), x.alias("form")),
    )
    whole = F.array(
        F.struct(
            F.lit("n_whole").alias("unit"),
            F.coalesce(F.get(starts, F.lit(0)), F.lit(1)).alias("line"),
            F.array_join(F.filter("lines", lambda x: x != ""), " ").alias("form"),
        )
    )
    told = known.select("length", "opening", "closing").distinct().collect()  # a few for each known licence
    lines = lines.withColumn("paragraphs", paragraphs)
    runs = F.filter(_runs(F.col("paragraphs"), told), lambda u: u["form"] != whole[0]["form"])
    units = lines.select(id_column, F.explode(F.concat(whole, F.col("paragraphs"), runs, numbered)).alias("u"))
    digests = units.filter("u.form != ''").select(
        id_column, "u.unit", "u.line", F.sha2("u.form", 256).alias("digest")
    )
    hits = attach(digests, known.select("digest", "license"), "digest", how="inner")
    counts = [F.count(F.when(F.col("unit") == n, 1)).alias(n) for n in ("n_whole", "n_paragraphs", "n_lines")]
    return hits.groupBy(id_column, "license").agg(*counts, F.min("line").cast("long").alias("first_line"))
