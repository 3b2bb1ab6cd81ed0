"""Licence scans by canonical digests, with built-in functions only.

A text is made canonical: lower case, copyright lines left out, equivalent spellings made one,
everything but letters and digits turned into single spaces. Its SHA-256 is joined with the
digests of known licences. The whole text is looked up so, and also each of its lines, which
finds notices inside other text.

Known licences are a mapping (KNOWN by default) or a table of any size. Up to MANY entries are
held in the plan and looked up without a shuffle; beyond that whole texts and lines are joined
with the table of digests, and of the lines only those that match are put together again.
KNOWN has short licences whole and the usual one-line notices; others need a table.

Null and empty texts, and texts of copyright lines alone, have the digest of the empty string,
which no licence may have. Repeated rows are each judged; ids may be null. `notices` has each
licence once, sorted. Extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANY = 1000

# Spellings that count as equal, wherever they stand.
EQUIVALENT = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("non commerc", "noncommerc"),
    ("merchantib", "merchantab"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https", "http"),
]

# Texts of licences and of usual notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


def by_lines(text: Column) -> Column:
    """The canonical text with its line breaks kept and its spaces not yet made single."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\r\\n?", "\n")
    out = F.regexp_replace(out, "(?dm)^[^\\p{L}\\p{N}\\n]*(?:copyright|©|\\(c\\))(?:[^\\p{L}\\n][^\\n]*)?$", "")
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}\\n]+", " ")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), EQUIVALENT, out)


def digest(canonical: Column) -> Column:
    """SHA-256 of a canonical text or line."""
    return F.sha2(F.btrim(F.regexp_replace(canonical, "[ \\n]+", " ")), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | DataFrame = KNOWN) -> DataFrame:
    """(text_digest, license) of known texts; of equal texts the first name in order."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(sorted(known.items()), "license string, known_text string")
    return rows.groupBy(digest(by_lines(F.col("known_text"))).alias("text_digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: dict[str, str] | DataFrame = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, license, notices) of each row: the licence that the whole text is, else null,
    and those of its lines. known: texts by name, or a table (license, known_text)."""
    rows = docs.select(F.col(id_col), by_lines(F.col(text_col)).alias("_canonical")).withColumn("text_digest", digest(F.col("_canonical")))
    digests = known_digests(docs.sparkSession, known)
    if isinstance(known, DataFrame) or len(known) > MANY:
        return scan_by_joins(rows, digests, id_col)
    rows = rows.join(F.broadcast(digests), "text_digest", "left")
    entries = [(digest(by_lines(F.lit(text))), F.lit(name)) for name, text in sorted(known.items(), reverse=True)]
    digests = F.array_distinct(F.array(*[d for d, _ in entries]))
    named = lambda d: reduce(lambda rest, e: F.when(d == e[0], e[1]).otherwise(rest), entries, F.lit(None).cast("string"))
    held = F.array_intersect(F.transform(F.split("_canonical", "\n"), digest), digests)
    return rows.select(id_col, "text_digest", "license", F.array_join(F.array_sort(F.transform(held, named)), ",").alias("notices"))


def scan_by_joins(rows: DataFrame, digests: DataFrame, id_col: str) -> DataFrame:
    """scan() of (id, _canonical, text_digest) with a table of digests of any size. Rows are numbered
    for the way back, by their place in the input."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    lines = rows.select("_row", F.explode(F.array_distinct(F.transform(F.split("_canonical", "\n"), digest))).alias("text_digest"))
    notices = lines.join(digests, "text_digest").groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    out = rows.drop("_canonical").join(digests, "text_digest", "left").join(notices, "_row", "left")
    return out.select(id_col, "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """The same scan of documents in DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lines = "regexp_replace(lower(coalesce(x, '')), '\\r\\n?', chr(10), 'g')"
    lines = f"regexp_replace({lines}, '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|©|\\(c\\))(?:[^\\p{{L}}\\n][^\\n]*)?$', '', 'g')"
    lines = f"regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    lines = reduce(lambda x, pair: f"replace({x}, {quoted(pair[0])}, {quoted(pair[1])})", EQUIVALENT, lines)
    table = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in sorted(KNOWN.items()))
    hashed = lambda x: f"sha256(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"
    return f"""
WITH src AS (SELECT row_number() OVER () AS n, doc_id, NULL AS name, text AS x FROM documents
  UNION ALL SELECT 0, NULL, name, x FROM (VALUES {table}) v(name, x)),
c AS (SELECT n, doc_id, name, {lines} AS t FROM src),
w AS (SELECT *, {hashed("t")} AS digest FROM c),
names AS (SELECT digest AS d, min(name) AS license FROM w WHERE name IS NOT NULL GROUP BY 1),
u AS (SELECT n, unnest(list_distinct(list_transform(string_split(t, chr(10)), lambda y: {hashed("y")}))) AS d FROM w WHERE name IS NULL),
k AS (SELECT n, string_agg(license, ',' ORDER BY license) AS notices FROM u JOIN names USING (d) GROUP BY n)
SELECT doc_id, digest AS text_digest, names.license AS license, coalesce(k.notices, '') AS notices
FROM w LEFT JOIN k USING (n) LEFT JOIN names ON names.d = w.digest WHERE w.name IS NULL
"""
