"""Licence scans by canonical digest lookup, with SQL functions only.

A text in canonical form is lower case, without copyright lines, with one spelling of
equivalent words and every run of other characters than letters and digits as one
space. Its SHA-256 is joined with the digests of known licence texts. Its lines, in
the same form, are looked up among the known notices (one-line grants).

Null texts, and texts of which nothing is left, have no digest and no licence. Each
row gives one row. The known texts are fixed and few, so their table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, the second one is canonical.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("modelled", "modeled"),
    ("organisation", "organization"),
    ("owner", "holder"),
    ("percent", "per cent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
)

#: Licence texts and grants that stand for a whole text. Copyright lines play no part.
TEXTS = (
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""),
)

#: One-line notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)

#: A line that names a copyright holder, with the comment marks before it.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;%>|-]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line ends; every line has a space at both ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), OTHER, " ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in [*SPELLINGS, *SPELLINGS]:  # again, for a word that stands twice in a row: both share a space
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def one_line(lines: Column) -> Column:
    """The canonical form of lines that have their spaces."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def _known(spark: SparkSession, rows, name: str) -> DataFrame:
    df = spark.createDataFrame(list(rows), f"{name} string, text string")
    return df.select(name, F.sha2(one_line(canonical_lines(F.col("text"))).cast("binary"), 256).alias("known"))


def _sizes(spark: SparkSession, rows):
    n = F.length(F.regexp_replace(canonical_lines(F.col("text")), " +", " "))
    return spark.createDataFrame(list(rows), "license string, text string").agg(F.min(n).alias("least"), (F.max(n) + 4).alias("most")).first()


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts=TEXTS, notices=NOTICES) -> DataFrame:
    """id, canonical_sha256, license (of the entire text, else null), notices (of whole lines, sorted, comma-joined)."""
    spark = docs.sparkSession
    short = _known(spark, notices, "license").distinct().orderBy("known").collect()
    # canonical lines differ from a notice in spaces at both ends only, of which there is one each
    sizes = _sizes(spark, notices)
    shortest, longest = sizes["least"], sizes["most"]
    lookup = F.create_map(*[F.lit(x) for r in short for x in (r["known"], r["license"])])
    lines = F.col("__lines")
    base = docs.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("__lines"))
    candidates = F.filter(F.split(lines, "\n"), lambda x: F.length(x).between(shortest, longest))
    found = F.transform(candidates, lambda x: F.try_element_at(lookup, F.sha2(one_line(x).cast("binary"), 256)))
    base = base.select(id_col, one_line(lines).alias("__text"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ","), F.lit("")).alias("notices"))
    base = base.select(id_col, F.when(F.col("__text") != "", F.sha2(F.col("__text").cast("binary"), 256)).alias("canonical_sha256"), "notices")
    # a one-line text can be a notice as a whole
    whole = F.broadcast(_known(spark, [*texts, *notices], "license").dropDuplicates(["known"]))
    return base.join(whole, base["canonical_sha256"] == whole["known"], "left").select(id_col, "canonical_sha256", "license", "notices")


def scan_sql(texts=TEXTS, notices=NOTICES) -> str:
    """The scan of `documents` in DuckDB's SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({x}), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(OTHER)}, ' ', 'g')"
        out = f"' ' || replace({out}, chr(10), ' ' || chr(10) || ' ') || ' '"
        for old, new in [*SPELLINGS, *SPELLINGS]:
            out = f"replace({out}, {quoted(f' {old} ')}, {quoted(f' {new} ')})"
        return out

    def flat(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    rows = ", ".join(f"({quoted(n)}, {quoted(t)}, {k >= len(texts)})" for k, (n, t) in enumerate([*texts, *notices]))
    return f"""
WITH known AS (SELECT DISTINCT license, notice, {flat(canonical("t"))} AS c FROM (VALUES {rows}) v(license, t, notice)),
d AS (SELECT doc_id, {canonical("text")} AS t FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM (SELECT doc_id, {flat("line")} AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) JOIN known USING (c) WHERE notice GROUP BY doc_id),
w AS (SELECT doc_id, {flat("t")} AS c FROM d)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS canonical_sha256, license, coalesce(notices, '') AS notices
FROM w LEFT JOIN (SELECT DISTINCT license, c FROM known) USING (c) LEFT JOIN n USING (doc_id)
"""
