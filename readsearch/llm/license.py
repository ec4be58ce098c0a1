"""License scans by canonical digests.

A text is reduced to a canonical form: lower case, no copyright notices, no
punctuation, one spelling of words that are written in several ways.  Entire
lines are looked up by digest among the one-line notices; the entire text, as one
line without its title and lines that reserve rights, is joined by digest to the
known licences, however its prose is wrapped.  Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_DISCLAIMER_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""

#: Texts of licences (fixed values).
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _DISCLAIMER_BSD,
    "BSD-3-Clause": _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + _DISCLAIMER_BSD,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

#: One-line notices (fixed values).
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC0 1.0.": "CC0-1.0",
    "All rights reserved.": "proprietary",
}

_SIGN = r"(\(c\)|©|&copy;)"
_YEAR = r"([\[<{(]? ?(19|20)\d\d|[\[<{]|yyyy|year\b)"

#: Pattern and replacement, in order, on lower-cased text whose lines are kept;
#: Java and RE2 read them alike.  ``\\1`` is the first group.  A line is a notice if
#: a sign or a year stands beside its first word; prose that a wrap lets begin with
#: "copyright" stays.
STEPS = (
    (r"[\r\x0B\x0C\t ]+", " "),
    (rf"(^|\n) ?(copyright ?[:,]? ?({_SIGN}|{_YEAR})|{_SIGN} ?(copyright|{_YEAR})|©)[^\n]*", r"\1"),
    (r"licenc(e|ing)", r"licens\1"),
    (r"(acknowledg|judg)ement", r"\1ment"),
    (r"(author|organ|recogn|initial|util|custom)is(e|ing|ation)", r"\1iz\2"),
    (r"(fav|col|behavi|hon)our", r"\1or"),
    (r"sub[- ]licens", "sublicens"),
    (r"non[- ](commercial|infring)", r"non\1"),
    (r"copyright owner", "copyright holder"),
    (r"https?://", ""),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"^ | ?\n ?| $", "\n"),
)
RIGHTS, RESERVED = "all rights reserved", "proprietary"
#: An opening title has one of these words in its first line, at most so many lines of so many words, and a blank line below.
TITLE = r"\b(license|licence|mit|isc|bsd|0bsd|zlib)\b"
TITLE_LINES, TITLE_WORDS = 3, 10
#: Each known text and notice has one of these, and so has any text of the same form.
HINTS = ("licens", "licenc", "permission", "redistribution", "rights reserved")


def canonical(text: Column) -> Column:
    """The canonical form of a text, its lines kept; null counts as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return out


def _from(lines: Column, at: Column) -> Column:
    """The lines from the one at a place counted from 1; none from 0."""
    return F.when(at > 0, F.slice(lines, at, F.size(lines))).otherwise(F.array().cast("array<string>"))


def whole(lines: Column) -> Column:
    """The form of an entire text, as one line, from its canonical lines: without
    lines that reserve all rights, without an opening title, and without the lines
    below it that begin with "copyright"."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (``value`` is computed once)
    short = lambda line: F.size(F.split(line, " ")) <= TITLE_WORDS

    def untitled(x):
        k = F.array_position(x, "").cast("int") - 1
        titled = (k >= 1) & (k <= TITLE_LINES) & F.get(x, F.lit(0)).rlike(TITLE) & F.forall(F.slice(x, F.lit(1), F.greatest(k, F.lit(0))), short)
        titled = titled & F.exists(_from(x, k + 1), lambda y: y != "")  # else it is the text
        return F.when(titled, _from(x, k + 1)).otherwise(x)

    plain = F.transform(lines, lambda x: F.when(x == RIGHTS, "").otherwise(x))
    opened = lambda x: _from(x, F.array_position(F.transform(x, lambda y: (y != "") & ~y.startswith("copyright")), True).cast("int"))
    prose = once(once(once(plain, opened), untitled), opened)
    return F.array_join(F.filter(prose, lambda x: x != ""), " ")


def _hinted(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for word in HINTS:
        out = out | low.contains(word)
    return out


def texts() -> list[tuple[str, str]]:
    """(name, text) of all licences that are known: ``TEXTS`` and the files beside
    this module; those with terms that end are known without their appendix too."""
    out, end = list(TEXTS.items()), "END OF TERMS AND CONDITIONS"
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        head, found, _ = text.partition(end)
        out += [(path.stem, text), *([(path.stem, head + end), (path.stem, head)] if found else [])]
    return out


def known(spark: SparkSession, given: Iterable[tuple[str, str]] | None = None) -> list[tuple[str, str, bool]]:
    """(digest, name, hinted) of the given texts, by default ``texts()``: one per
    form, of several names the first in order; whether the form has a hint."""
    rows = spark.createDataFrame(list(texts() if given is None else given), "license string, text string")
    forms = rows.select("license", whole(F.split(canonical(F.col("text")), "\n")).alias("form"))
    got = forms.where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.first(_hinted(F.col("form"))).alias("hinted"))
    return [tuple(r) for r in got.orderBy("digest").collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, notices, text_digest): one row per row.

    ``license`` names the licence whose entire text the text is, ``notices``
    (array, sorted) those of lines that are one-line notices; a line that reserves
    all rights is none in the text of a licence.  ``table_`` are the (name, text)
    to find, by default ``texts()``.  ``text_digest`` is the digest that is joined;
    texts without a word that every known text has can't be one and have none.  An
    empty, null or unknown text has no licence and no notices; repeated rows
    repeat, a null id stays null, a text may be of any length that a cell holds;
    no rows give none.  Other columns of ``docs`` are never read.
    """
    spark = docs.sparkSession
    found = known(spark, table_)
    lookup = F.create_map(*[x for line, name in NOTICES.items() for x in (F.sha2(F.trim(F.regexp_replace(canonical(F.lit(line)), "\n", "")), 256), F.lit(name))])  # folded to a literal
    hinted = _hinted(F.col(text_col)) if all(h for _, _, h in found) else F.lit(True)
    lines = F.when(hinted, F.split(canonical(F.col(text_col)), "\n"))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("_l"))
    names = F.filter(F.transform("_l", lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>")).alias("_n"), F.when(F.col("_l").isNotNull(), F.sha2(whole(F.col("_l")), 256)).alias("text_digest"))
    if found:  # a row per form of the known texts
        forms = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("_digest"), F.lit(n).alias("license")) for d, n, _ in found])))
        rows = rows.join(F.broadcast(forms), F.col("text_digest") == F.col("_digest"), "left").drop("_digest")
    else:
        rows = rows.withColumn("license", F.lit(None).cast("string"))
    notices = F.when(F.col("license").isNotNull(), F.array_remove("_n", RESERVED)).otherwise(F.col("_n"))
    return rows.select("doc_id", "license", notices.alias("notices"), "text_digest")


def op8_license(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "license", F.array_join("notices", ",").alias("notices"), "text_digest")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        out = f"lower(coalesce({x}, ''))"
        for pattern, by in STEPS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by) if by != chr(10) else 'chr(10)'}, 'g')"
        return f"string_split({out}, chr(10))"

    after = lambda test: f"CASE WHEN list_position(list_transform(l, lambda y: {test}), true) > 0 THEN l[list_position(list_transform(l, lambda y: {test}), true):] ELSE [] END"
    given = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in texts())
    notices = ", ".join(f"({quoted(k)}, {quoted(t)})" for t, k in NOTICES.items())
    hinted = " OR ".join(f"contains(lower(text), {quoted(h)})" for h in HINTS)
    return f"""
WITH x AS (SELECT -1 AS n, k AS name, CAST(NULL AS BIGINT) AS doc_id, {lines("v.x")} AS l FROM (VALUES {given}) v(k, x)
  UNION ALL SELECT 1, NULL, doc_id, {lines("text")} FROM documents WHERE {hinted}),
a AS (SELECT n, name, doc_id, list_transform(l, lambda y: CASE WHEN y = '{RIGHTS}' THEN '' ELSE y END) AS l FROM x),
b AS (SELECT n, name, doc_id, {after("y <> '' AND NOT starts_with(y, 'copyright')")} AS l FROM a),
c AS (SELECT n, name, doc_id, l, coalesce(list_position(l, ''), 0) - 1 AS k FROM b),
d AS (SELECT n, name, doc_id, CASE WHEN k BETWEEN 1 AND {TITLE_LINES} AND regexp_matches(l[1], {quoted(TITLE)})
        AND len(list_filter(l[1:k], lambda y: len(string_split(y, ' ')) > {TITLE_WORDS})) = 0
        AND len(list_filter(l[k + 1:], lambda y: y <> '')) > 0 THEN l[k + 1:] ELSE l END AS l FROM c),
e AS (SELECT n, name, doc_id, {after("y <> '' AND NOT starts_with(y, 'copyright')")} AS l FROM d),
f AS (SELECT n, name, doc_id, sha256(array_to_string(list_filter(l, lambda y: y <> ''), ' ')) AS digest FROM e),
known AS (SELECT digest, min(name) AS license FROM f WHERE n < 0 AND digest <> sha256('') GROUP BY digest),
notes AS (SELECT k AS notice, trim(array_to_string({lines("v.x")}, '')) AS line FROM (VALUES {notices}) v(k, x)),
found AS (SELECT doc_id, license, digest FROM f LEFT JOIN known USING (digest) WHERE n > 0),
per AS (SELECT u.doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices FROM (SELECT doc_id, unnest(l) AS line FROM x WHERE n > 0) u
  JOIN notes USING (line) JOIN found ON u.doc_id = found.doc_id WHERE license IS NULL OR notice <> '{RESERVED}' GROUP BY u.doc_id)
SELECT documents.doc_id, license, coalesce(notices, '') AS notices, digest AS text_digest
FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id LEFT JOIN per ON documents.doc_id = per.doc_id
"""


OP8_SQL = _sql()
