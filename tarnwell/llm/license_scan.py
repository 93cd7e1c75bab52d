"""License scans (operator 2) by canonical digest lookup, native.

A text is brought to a canonical form: lower case, no copyright lines (lines that
begin with the word or its sign and hold the sign or a year), no marks of list items,
every run of other characters than letters and digits one space, and then, word by
word so that no line break matters, equivalent spellings made one and the phrase "all
rights reserved" left out. The digest of the entire text is joined to the digests of
known licences (a fixed table of this file, or the caller's, so broadcast). Beside that
each line that speaks of a licence is brought to the same form, and its digest looked
up among known notices.

Defined results: null and empty texts have the digest of the empty string and no
licence; texts are taken whole; equal texts get equal results; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, whole_text

#: Equivalent spellings of whole words and phrases (fixed values), applied in this order to words with single spaces between.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
    ("all rights reserved", ""),
)
#: In text in lower case: a year or its place holder, lines that state a copyright, and marks of list items.
_YEAR = r"((19|20)[0-9][0-9]|[<\[{]y)"
COPYRIGHT_LINE = r"(^|\n)[ \t]*((\(c\)|©)[^\n]*" + _YEAR + r"|copyright[^\n]*(\(c\)|©|" + _YEAR + r"))[^\n]*"
ITEM = r"(^|\n)[ \t]*([0-9]+[.)]|[*-])[ \t]"
SEPARATORS = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Entire texts of licences by SPDX name (fixed values).
LICENSES = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_3}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_3}\n{_BSD_TAIL}"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
)
#: Canonical digests of long licences (fixed values): of the published text, and where it has an appendix on how to apply it, of what ends with "END OF TERMS AND CONDITIONS".
DIGESTS = (
    ("Apache-2.0", "b610aae6b096759844272677f5b976192a700a139cc44d2004d59bea190d05c7"),
    ("Apache-2.0", "f610752a3dafda9c28e5a6b64f7c7a12600f0e8cdec11ddc03c102132021e6e6"),
    ("CC0-1.0", "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a"),
    ("GFDL-1.2", "6b425c0a67e6b748551b88317924ea086929a4b21a9b0791f8352babd645e0c4"),
    ("GFDL-1.3", "9ad82f8a2ded896851802d54f1dfa67116166983cb978bf868a1fec0585ed4cf"),
    ("GPL-1.0", "312ed964c77e540bdb607f644cda48e580b88c9f8d91df1eee77c93245c8493a"),
    ("GPL-1.0", "50af69451b4f4323042be2b48648be1ccf43ac320b71bd83ae265a91b55895f4"),
    ("GPL-2.0", "82a6cca2aba6d89ca2af2de0d09a06af62f784080c8095ea0b6303dfc3c0221a"),
    ("GPL-2.0", "c44c78fe989f55f2781e85f5ea3ad8563febdd7b092943641629c3e204d407f4"),
    ("GPL-3.0", "7def7745ca7d72ed67b7ca260b527e58f2dda1e6d9b026635f99031f2e48136f"),
    ("GPL-3.0", "8b8a15a249d6df90360243b78b2a1a71debdeb809176e7d7441c8949da98a357"),
    ("LGPL-2.0", "ec44c766883b869bef6a328cf51aafbe256ee10744ba67af3472eda9d0446def"),
    ("LGPL-2.0", "1e171ab9f596d207116d86bf27b99c05d8a6f40293600a2db16618fd81e3619d"),
    ("LGPL-2.1", "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9"),
    ("LGPL-2.1", "dfb509c568fdca357b76a1c523438615ce8698edf63076cc8a224aac11a0199a"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("MPL-1.1", "6fb8d28c46d1f9f30824eb88ddce362530e2ff3ed28c74f4e4d5afb3015f4089"),
    ("MPL-2.0", "c72d732662f1062b77b9075836226ca87c674ae131839c5a567b0749ff029ae3"),
)
#: Notices that name a licence in one line (fixed values).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text in lower case."""
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, "\n"), ITEM, "\n")
    words = F.trim(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), SEPARATORS, " "))
    # Every word gets spaces of its own, so that neighbours can both be replaced.
    words = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        words = F.replace(words, F.lit(_spaced(spelling)), F.lit(_spaced(usual)))
    return F.trim(F.regexp_replace(words, " +", " "))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _known(spark: SparkSession, table: tuple) -> DataFrame:
    rows = spark.createDataFrame(list(table), "spdx string, raw string")
    return rows.select("spdx", F.sha2(canonical(F.lower("raw")), 256).alias("digest")).distinct()


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entire_texts: tuple = LICENSES, digests: tuple = DIGESTS) -> DataFrame:
    """One row per row of docs: canon_sha256, license (of the entire text) and notices (names in its lines, in order).

    entire_texts: (spdx, text) of the licences to know by their entire text, and digests:
    (spdx, canonical digest) of those known by that alone; one name for each canonical text.
    """
    spark = docs.sparkSession
    known = _known(spark, entire_texts)
    table = known.unionByName(spark.createDataFrame(list(digests), known.schema)).distinct()
    entire = F.broadcast(table.select(F.col("spdx").alias("license"), F.col("digest").alias("canon_sha256")))
    names = {digest: spdx for spdx, digest in _known(spark, NOTICES).collect()}
    lower = F.lower(whole_text(text_col))
    line_digests = F.transform(F.filter(F.split(lower, "\n"), lambda x: x.contains("licen") | x.contains("cc0")), lambda x: F.sha2(canonical(x), 256))
    found = F.array_intersect(line_digests, F.array(*map(F.lit, names)))
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    notices = F.when(F.size(found) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: F.element_at(name, d)))), ",")).otherwise(F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.sha2(canonical(lower), 256).alias("canon_sha256"), notices.alias("notices"))
    return rows.join(entire, "canon_sha256", "left").select(id_col, "canon_sha256", "license", "notices")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace({text}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{ITEM}', chr(10), 'g')"
    out = f"concat(' ', replace(trim(regexp_replace(replace({out}, '&', ' and '), '{SEPARATORS}', ' ', 'g')), ' ', '  '), ' ')"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, '{_spaced(spelling)}', '{_spaced(usual)}')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _sql_rows(table: tuple) -> str:
    return ", ".join("('{}', '{}')".format(spdx, raw.replace("'", "''")) for spdx, raw in table)


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES = {
    "op2_license_scan": f"""
WITH k AS (SELECT DISTINCT spdx AS license, sha256({_sql_canonical("lower(raw)")}) AS canon_sha256 FROM (VALUES {_sql_rows(LICENSES)}) v(spdx, raw) UNION VALUES {_sql_rows(DIGESTS)}),
m AS (SELECT DISTINCT spdx, sha256({_sql_canonical("lower(raw)")}) AS digest FROM (VALUES {_sql_rows(NOTICES)}) v(spdx, raw)),
d AS (SELECT doc_id, sha256({_sql_canonical("lower(coalesce(text, ''))")}) AS canon_sha256 FROM documents),
l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS notices FROM l JOIN m ON sha256({_sql_canonical("line")}) = digest
      WHERE contains(line, 'licen') OR contains(line, 'cc0') GROUP BY doc_id)
SELECT d.doc_id, d.canon_sha256, k.license, coalesce(n.notices, '') AS notices FROM d LEFT JOIN k USING (canon_sha256) LEFT JOIN n USING (doc_id)
""",
}
