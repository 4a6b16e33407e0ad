"""Licence scans by canonical digests, in DataFrame operations alone.

A text's canonical form: lower case; without lines that begin with a copyright mark or say that all rights are reserved; its
words (runs of letters and digits) joined by one space, with equivalent spellings made one. Its SHA-256 is hash-joined to the
digests of known licence texts; each line's to those of known one-line notices. The known table holds permissive licences and short
notices; a caller gives further texts, of any length, as a list or as a table of license_id and text.

Null and empty texts have the digest of the empty form and no licence; repeated rows are scanned each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as one word (published matching guidelines).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "wilfull": "willful",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)

# Licence texts, and one-line notices.
TEXTS = [
    ("MIT", _MIT + _AS_IS),
    ("MIT", "MIT License " + _MIT + _AS_IS),
    ("MIT", "The MIT License (MIT) " + _MIT + _AS_IS),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("ISC", "ISC License " + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", _ISC_GRANT + ". " + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_START + _BSD_THIRD + _BSD_END),
    ("Apache-2.0", _APACHE_NOTICE),
]
_ZERO_WARRANTY = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. "
)
TEXTS += [
    ("MIT-0", _MIT.split(", subject to the following conditions:")[0] + ". " + _AS_IS),
    ("MIT-0", "MIT No Attribution " + _MIT.split(", subject to the following conditions:")[0] + ". " + _AS_IS),
    ("BSD-1-Clause", _BSD_START.split("2. Redistributions in binary")[0] + _BSD_END),
    ("BSD-3-Clause-Clear", _BSD_START.replace("are permitted provided", "are permitted (subject to the limitations in the disclaimer below) provided") + _BSD_THIRD + _BSD_END),
    (
        "Zlib",
        _ZERO_WARRANTY + "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + " For more information, please refer to <http://unlicense.org/>",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute verbatim or modified copies of "
        "this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS "
        "FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a "
        'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
        "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
        "such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If "
        "not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

_MARK = r"^\s*((copyright|\(c\)|©)(\W|$)|all rights reserved\W*$)"


def _words(lines: Column) -> Column:
    """Canonical form of some lower-case text."""
    same = lambda w: F.coalesce(*(F.when(w == a, F.lit(b)) for a, b in SPELLINGS.items()), w)
    return F.array_join(F.transform(F.filter(F.split(lines, r"[^\p{L}\p{N}]+"), lambda w: w != ""), same), " ")


def canonical(text: Column) -> Column:
    lines = F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")
    return _words(F.array_join(F.filter(lines, lambda x: ~x.rlike(_MARK)), " "))


def known(spark: SparkSession, rows: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """license_id and digest of known texts, one row for each digest."""
    t = rows.select("license_id", "text") if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "license_id string, text string")
    return t.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def first_words(notices: list[tuple[str, str]]) -> list[str]:
    """The words that a line of one of these notices can begin with: the notice's own first word and all spellings of it."""
    own = {re.findall(r"[^\W_]+", text.lower())[0] for _, text in notices if re.search(r"[^\W_]", text)}
    same = {SPELLINGS.get(w, w).split()[0] for w in own}
    return sorted(own | same | {a for a, b in SPELLINGS.items() if b.split()[0] in same})


def scan(docs: DataFrame, texts: list[tuple[str, str]] | DataFrame | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license_id of the entire text or null, notices: licences whose notice is a line, sorted, comma-joined."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = known(spark, TEXTS if texts is None else texts)
    lines = known(spark, notices or NOTICES)
    named = {r["digest"]: r["license_id"] for r in lines.collect()}  # the given list
    # only lines that begin with the first word of a notice, in any spelling, are compared: their canonical digest decides
    begins = lambda x: F.regexp_extract(F.lower(x), r"[\p{L}\p{N}]+", 0).isin(*first_words(notices or NOTICES))
    hits = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(begins(x), F.sha2(_words(F.lower(x)), 256)))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(hits, lambda h: F.coalesce(*(F.when(h == k, F.lit(v)) for k, v in sorted(named.items())))), lambda v: v.isNotNull())))
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.array_join(found, ",").alias("notices"))
    return rows.join(table if isinstance(texts, DataFrame) else F.broadcast(table), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and notices of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_words(x: str) -> str:
    case = "CASE w " + " ".join(f"WHEN {_lit(a)} THEN {_lit(b)}" for a, b in SPELLINGS.items()) + " ELSE w END"
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {case}), ' ')"


def _sql_canonical(x: str) -> str:
    lines = f"list_filter(string_split(lower(coalesce({x}, '')), chr(10)), lambda l: NOT regexp_matches(l, {_lit(_MARK)}))"
    return _sql_words(f"array_to_string({lines}, ' ')")


OP8_SQL = f"""
WITH texts(license_id, text) AS (VALUES {", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in TEXTS)}),
notices(license_id, text) AS (VALUES {", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in NOTICES)}),
known AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
lines AS (SELECT sha256({_sql_canonical("text")}) AS digest, min(license_id) AS license_id FROM notices GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
marks AS (
  SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT rid, sha256({_sql_words("lower(line)")}) AS digest
        FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
        ) JOIN lines USING (digest)
  GROUP BY rid
)
SELECT d.doc_id, d.digest, k.license_id, coalesce(m.notices, '') AS notices
FROM (SELECT rid, doc_id, sha256({_sql_canonical("text")}) AS digest FROM docs) d
LEFT JOIN known k USING (digest) LEFT JOIN marks m USING (rid)
"""
