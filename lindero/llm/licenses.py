"""License scans: the best Dice coefficient of word bigrams between a text's segments and license notices.

A segment is a line, a sentence within a line, a sentence of a paragraph whatever its line breaks and
comment signs, or a window of up to WINDOW paragraphs in a row. The notices, from a sentence to a whole
short license, come as a small fixed table; their number of bigrams bounds the number that a segment
can have at the wanted Dice coefficient, so a hash join on that number keeps every other notice away
from a segment. The same bound tells how many of a notice's bigrams a segment may lack; some words of it
touch more than those, and a segment that has none of these words is out before its bigrams are made,
as is a text. Of the notices that a segment reaches the best counts. All of it is DataFrame functions.

Nulls and edge cases: a null or empty text has no segment and no row; a segment of one word has no
bigram and matches nothing; repeated segments count once; rows that share an id, null included, are
scanned as one document; of notices that tie all are reported; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The notices that licenses and their stewards ask for, and short licenses whole, by SPDX identifier.
NOTICES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-clause license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

#: Words that nearly any English text has, and that so tell nothing.
COMMON = set("a all and any are as at be by can do for from have if in is it may no not of on or that the these this to under use was we will with you".split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as the scan knows it.
_SPACE = "[ \\t\\r\\n]"
#: Paragraphs of a window at most.
WINDOW = 6


def _words(text: str) -> list[str]:
    folded = "".join(c if c in _LOWER or c.isascii() and c.isdigit() else " " for c in (x.lower() if x in _UPPER else x for x in text))
    return folded.split()


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a notice, sorted; the same rule as for segments."""
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})  # noqa: B905


def tell_tale(grams: list[str], threshold: float) -> list[str]:
    """Words, long and less common ones first, that touch more of a notice's bigrams than a segment that reaches the threshold can lack."""
    # Of m bigrams at least s are shared, where 2 s / (s + m) reaches the threshold.
    m = len(grams)
    least = next(s for s in range(1, m + 1) if 2.0 * s / (s + m) >= threshold)
    chosen: list[str] = []
    touched: set[str] = set()
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(touched) > m - least:
            break
        chosen.append(w)
        touched |= {g for g in grams if w in g.split(" ")}
    return chosen


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """id_col, license, dice (best over segments and notices of that license), n_segments (how many reach the threshold)."""
    spark = docs.sparkSession
    #: At best the smaller set of bigrams lies within the larger one.
    most = lambda n, m: 2.0 * min(n, m) / (n + m)
    rows = [(n, name, grams) for name, text in notices if (grams := bigrams(text)) for n in range(1, int(len(grams) * 2 / threshold) + 1) if most(n, len(grams)) >= threshold]
    known = spark.createDataFrame(rows, "n int, license string, wanted array<string>").coalesce(1)
    sizes = sorted({r[0] for r in rows})
    telling = {w for _, notice in notices if len(_words(notice)) > 1 for w in tell_tale(bigrams(notice), threshold)}
    hints = F.array(*map(F.lit, sorted(telling)))
    words_of = lambda x: F.split(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), " ")
    lowered = docs.select(F.col(f"`{id_col}`").alias("id"), F.translate(F.col(f"`{text_col}`").cast("string"), _UPPER, _LOWER).alias("text"))
    # Only texts with a telling word are cut into segments, and only segments with one get bigrams.
    may = lowered.where(F.arrays_overlap(F.split("text", "[^a-z0-9]+"), hints)).select("id", "text", F.split("text", f"\n{_SPACE}*\n").alias("paragraphs"))
    sentences = lambda x: F.split(F.regexp_replace(x, f"([.!?]){_SPACE}+", "$1\n"), "\n")
    folded = F.flatten(F.transform("paragraphs", lambda x: sentences(F.translate(x, "\n", " "))))
    windows = F.expr(f"flatten(transform(sequence(1, least({WINDOW}, size(paragraphs))), w -> transform(sequence(1, size(paragraphs) - w + 1), i -> array_join(slice(paragraphs, i, w), ' '))))")
    parts = F.array_distinct(F.concat(sentences(F.col("text")), F.split("text", "\n"), folded, windows))
    words = may.select("id", F.explode(parts).alias("segment")).select("id", words_of(F.col("segment")).alias("words")).where((F.size("words") > 1) & F.arrays_overlap("words", hints))
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = words.select("id", pairs.alias("grams")).withColumn("n", F.size("grams")).where(F.col("n").between(sizes[0], sizes[-1]))
    both = grams.join(F.broadcast(known), "n")
    scored = both.select("id", "license", "grams", (F.lit(2.0) * F.size(F.array_intersect("grams", "wanted")) / (F.col("n") + F.size("wanted"))).alias("dice")).where(F.col("dice") >= threshold).withColumn("grams", F.sort_array("grams"))
    # A segment's list has at most an entry for each notice.
    best = scored.groupBy("id", "grams").agg(F.max("dice").alias("top"), F.collect_set(F.struct("license", "dice")).alias("all")).select("id", "grams", F.explode(F.filter("all", lambda x: x["dice"] == F.col("top"))).alias("x"))
    return best.groupBy("id", "x.license").agg(F.max("x.dice").alias("dice"), F.count_distinct("grams").alias("n_segments")).withColumnRenamed("id", id_col)


def scan_sql(threshold: float = 0.8, notices: list[tuple[str, str]] = NOTICES) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, [{', '.join(map(quote, grams))}])" for name, text in notices if (grams := bigrams(text)))
    space = "[ \\t\\r\\n]"
    sentences = lambda x: f"string_split(regexp_replace({x}, '([.!?]){space}+', '\\1' || chr(10), 'g'), chr(10))"
    return f"""
    WITH known(license, wanted) AS (VALUES {known}),
    lowered AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS t FROM documents WHERE text IS NOT NULL),
    parted AS (SELECT doc_id, t, string_split_regex(t, '\\n{space}*\\n') AS p FROM lowered),
    segments AS (SELECT doc_id, unnest(list_distinct(flatten([{sentences("t")}, string_split(t, chr(10)), flatten(list_transform(p, lambda x: {sentences("replace(x, chr(10), ' ')")})),
        flatten(list_transform(range(1, least({WINDOW}, len(p)) + 1), lambda w: list_transform(range(1, len(p) - w + 2), lambda i: array_to_string(p[i:i + w - 1], ' '))))]))) AS segment FROM parted),
    words AS (SELECT doc_id, string_split(trim(regexp_replace(segment, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM segments),
    grams AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words WHERE len(w) > 1),
    scored AS (SELECT doc_id, license, g, 2.0::DOUBLE * len(list_intersect(g, wanted)) / (len(g) + len(wanted)) AS dice FROM grams, known
        WHERE 2.0::DOUBLE * least(len(g), len(wanted)) / (len(g) + len(wanted)) >= {threshold}),
    best AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, g) AS top FROM scored WHERE dice >= {threshold})
    SELECT doc_id, license, max(dice) AS dice, count(DISTINCT g) AS n_segments FROM best WHERE dice = top GROUP BY doc_id, license"""
