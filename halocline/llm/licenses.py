"""Licence scan by canonical digest.

A text is brought to a canonical form (case, copyright lines, punctuation, white space, equivalent spellings) and
hashed; the digest of the whole text is looked up among those of known licences, once without its copyright notices and
once, if there are any, with all its words. So are the digests of all its lines, which finds one-line notices in longer
texts.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm.groups import join_spread
from halocline.llm.workspace import Workspace

# Spellings that count as one, the first written for the second.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("recognised", "recognized"), ("while", "whilst"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("https", "http"), ("v2 0", "version 2 0"), ("v3", "version 3"),
]
COPYRIGHT_MARKS = ["copyright", "(c)", "©", "all rights reserved"]
#: A line is a notice by a year, (c), © or the reserved rights, not by the word alone: wrapped sentences begin with that.
COPYRIGHT_LINE = r"(^|\n)[\t *#/;-]*(?:copyright\b[^\n]*(?:\(c\)|©|\b[12][0-9]{3}\b|\[yyyy\]|<year>)|\(c\) *(?:copyright|[12][0-9]{3}|<year>)|©|all rights reserved[^a-z\n]*(?=\n|$))[^\n]*"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’–—•]+"

# Texts of short licences, and one-line notices.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
}

_CLAUSE_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
#: Licences without a title of their own, and the titles that stand before them where they are published.
SHORT = {k: LICENSES[k] for k in ("MIT", "ISC", "BSD-2-Clause")} | {"BSD-3-Clause": LICENSES["BSD-2-Clause"].replace("THIS SOFTWARE IS", _CLAUSE_3 + "THIS SOFTWARE IS", 1)}
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'],
}
END = "END OF TERMS AND CONDITIONS"  # what follows it says how to apply the licence, and may be left out


def published() -> list[tuple[str, str]]:
    """Id and text of licences as they are published: with a title, conditions numbered or not, and long ones with and
    without what follows the terms."""
    out = []
    for k, text in SHORT.items():
        for form in dict.fromkeys([text, re.sub(r"(?m)^[0-9]\. ", "", text)]):
            out += [(k, form), *[(k, f"{title}\n{form}") for title in TITLES[k]]]
    for file in sorted(resources.files("halocline.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.partition(END)
        out += [(file.name.removesuffix(".txt"), t) for t in ([text, terms + end, terms] if end else [text])]
    return out


def _words(text: Column, ends: bool) -> Column:
    """Words of lower-case ``text`` with spellings made equal, two spaces or more between them; ``ends``: line ends stay."""
    t = F.concat(F.lit(" "), F.regexp_replace(text, SEPARATORS.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F") if ends else SEPARATORS, "  "), F.lit(" "))
    t = F.replace(t, F.lit("\n"), F.lit(" \n ")) if ends else t
    # two spaces between words: each has its own, so that of equal words in a row every one is replaced
    for there, instead in SPELLINGS:
        t = F.replace(t, F.lit(f" {there.replace(' ', '  ')} "), F.lit(f" {instead.replace(' ', '  ')} "))
    return t


def _joined(lines: Column) -> Column:
    """The canonical form of lines whose spellings are equal already, those of two words over line ends made so too."""
    t = F.concat(F.lit(" "), F.array_join(F.filter(lines, lambda x: x != ""), "  "), F.lit(" "))
    for there, instead in SPELLINGS:
        if " " in there:
            t = F.replace(t, F.lit(f" {there.replace(' ', '  ')} "), F.lit(f" {instead.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(text: Column, notices: bool = False) -> Column:
    """Words in lower case, one space between them; '' if none is left. ``notices``: with the copyright notices."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.replace(_words(lower if notices else without_notices(lower), False), F.lit("  "), F.lit(" ")))


def without_notices(lower: Column) -> Column:
    return F.when(_marked(lower), F.regexp_replace(lower, COPYRIGHT_LINE, r"$1")).otherwise(lower)


def _marked(lower: Column) -> Column:
    out = F.lit(False)
    for mark in COPYRIGHT_MARKS:
        out = out | lower.contains(mark)
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*LICENSES.items(), *published()], "license_id string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, license_digest, license_id, notices.

    license_id: the known licence whose canonical text the whole text is, without the notices of either or with all words
    of both, else null; of several, the first by id. notices: ids of the known licences that stand as lines of the text,
    sorted and comma-joined, '' if none. Null and empty texts have the digest of '' and no licence; known rows that are
    null or canonically empty match nothing. Repeated rows stay. Texts are read whole, whatever their length; an empty
    table gives no rows. Other columns of ``docs`` are left out.

    Up to ``most`` known texts stand in the plan, and rows look their own lines up; more are joined.
    """
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    both = known.select("license_id", F.explode(F.array(canonical(F.col("text")), canonical(F.col("text"), True))).alias("form")).filter("form != '' and license_id is not null")
    digests = both.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.xxhash64(F.first("form")).alias("short"))
    work = Workspace(docs.sparkSession, "licenses")
    digests = work.write(digests, "digests")
    rows = docs.select(F.col(doc_id).alias("doc_id"), lower.alias("lower") if text == "text" else F.lower(F.coalesce(F.col(text), F.lit(""))).alias("lower"))
    rows = rows.withColumn("words", _words(without_notices(F.col("lower")), True))
    full = F.when(_marked(F.col("lower")), F.sha2(F.trim(F.replace(_words(F.col("lower"), False), F.lit("  "), F.lit(" "))), 256))
    rows = rows.withColumn("lines", F.transform(F.split("words", "\n"), lambda x: F.trim(x)))
    lines = F.transform("lines", lambda x: F.replace(x, F.lit("  "), F.lit(" ")))
    rows = rows.select("doc_id", F.sha2(_joined(F.col("lines")), 256).alias("license_digest"), full.alias("full_digest"), lines.alias("lines"))
    few = digests.limit(most + 1).collect()
    if len(few) <= most:
        if not few:
            none = F.lit(None).cast("string")
            return rows.select("doc_id", "license_digest", none.alias("license_id"), F.lit("").alias("notices"))
        of = F.map_from_arrays(F.array(*[F.lit(r["digest"]) for r in few]), F.array(*[F.lit(r["license_id"]) for r in few]))
        short = F.array(*[F.lit(r["short"]) for r in few])
        # a short hash first: hardly any line goes further
        some = F.size(F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), short)) > 0
        ids = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: F.element_at(of, F.sha2(x, 256))), lambda i: i.isNotNull())))
        found = F.coalesce(F.element_at(of, F.col("license_digest")), F.element_at(of, F.col("full_digest")))
        return rows.select("doc_id", "license_digest", found.alias("license_id"), F.when(some, F.array_join(ids, ",")).otherwise(F.lit("")).alias("notices"))
    rows = work.write(rows.withColumn("row", F.expr("uuid()")), "rows")
    told = digests.select("digest", "license_id")
    line = rows.select("row", F.explode("lines").alias("line")).select("row", F.sha2("line", 256).alias("digest"))
    notices = join_spread(line, told, ["digest"], "inner").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    whole = join_spread(rows.drop("lines"), told.withColumnRenamed("digest", "license_digest"), ["license_digest"])
    whole = join_spread(whole, told.select(F.col("digest").alias("full_digest"), F.col("license_id").alias("full_id")), ["full_digest"])
    whole = whole.join(notices.hint("merge"), "row", "left")
    return whole.select("doc_id", "license_digest", F.coalesce("license_id", "full_id").alias("license_id"), F.coalesce("notices", F.lit("")).alias("notices"))
