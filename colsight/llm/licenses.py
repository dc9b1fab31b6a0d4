"""Licence texts by canonical digests.

A text is brought to a canonical form: copyright lines go, case, punctuation and white space are evened out, equivalent
spellings become one. Its digest is joined with those of known licences. Whole texts are looked up, and also each line
that names a licence, so that notices inside longer documents are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.llm.shared import cut

# ---- fixed values: equivalent spellings, known notices and short licences (public texts) ----
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "copyrights": "copyright", "sublicence": "sublicense", "sub license": "sublicense",
    "non commercial": "noncommercial", "whilst": "while", "wilful": "willful", "acknowledgement": "acknowledgment", "http": "https",
}
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
}
AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
GRANT_BSD = (
    "Copyright (c) 2000 holder\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n\n"
)
TEXTS = {
    "MIT": "MIT License\n\nCopyright (c) 2000 holder\n\n" + GRANT_MIT + ", subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + AS_IS_MIT,
    "MIT-0": "MIT No Attribution\n\nCopyright 2000 holder\n\n" + GRANT_MIT + ".\n\n" + AS_IS_MIT,
    "ISC": "ISC License\n\nCopyright (c) 2000 holder\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + AS_IS_ISC,
    "0BSD": "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + AS_IS_ISC,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + GRANT_BSD + AS_IS_BSD,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + GRANT_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n" + AS_IS_BSD,
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
    "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked "
    "as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    'software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software "
    "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
    "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    'processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the "
    "author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
    "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law.\n\n" + AS_IS_MIT.replace("COPYRIGHT HOLDERS ", "").replace("AUTHORS OR BE", "AUTHORS BE") + "\n\nFor more information, please refer to <https://unlicense.org/>",
}
# ---- end of fixed values ----

HINTS = ("licen", "copyright", "permission", "spdx")
"""Every known text holds one of these in lower case, as each word of its canonical form is in it: others need no digest."""


def canonical(text: Column) -> Column:
    """The canonical form: words of a-z and 0-9 with single spaces."""
    text = F.regexp_replace(F.lower(text), r"(?m)^[^\S\n]*(?:copyright|\(c\)|©)[^\n]*$", " ")
    text = F.regexp_replace(text, "[^a-z0-9]+", " ")
    for old, new in SPELLINGS.items():
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return F.trim(text)


def known_licenses(spark) -> DataFrame:
    """(digest, license) of the known texts and notices; a few dozen rows."""
    rows = [(k, t) for k, t in TEXTS.items()] + [(k, t) for k, v in NOTICES.items() for t in v]
    table = spark.createDataFrame(rows, "license string, text string")
    return table.select("license", F.md5(canonical(F.col("text"))).alias("digest")).distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``license`` (of the whole text, or null) and ``notices`` (licences named by
    single lines, sorted, comma-joined; empty if none).

    ``known`` has columns ``license`` and ``digest``; of several licences with one digest the first by name counts. Without
    it the built-in texts are looked up, and only texts and lines with one of their ``HINTS`` are digested. Null and empty
    texts match nothing; rows that repeat are reported again; no rows give none. Further columns are ignored.
    """
    own = known is None
    known = known_licenses(docs.sparkSession) if own else known
    known = known.groupBy("digest").agg(F.min("license").alias("license"))

    def digested(part):
        return F.md5(canonical(part))

    hinted = (lambda c: F.lower(c).rlike("|".join(HINTS))) if own else (lambda c: F.lit(True))
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.transform(F.filter(F.split("text", "\n"), hinted), digested)
    # rows are numbered once, in the table that is written; digests are few, and only of texts with a hint
    rows = cut(docs.select("id", F.monotonically_increasing_id().alias("row"), F.when(hinted("text"), digested(F.col("text"))).alias("whole"), F.when(hinted("text"), F.array_distinct(lines)).alias("lines")))
    digests = rows.where("whole IS NOT NULL").select("row", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("whole").alias("digest"))), F.transform("lines", lambda d: F.struct(F.lit(False).alias("whole"), d.alias("digest"))))).alias("d"))
    found = digests.select("row", "d.whole", "d.digest").join(known, "digest").groupBy("row").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices")
    )
    return rows.select("id", "row").join(found, "row", "left").select(F.col("id").alias(id_col), "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _canonical_sql(text: str) -> str:
    text = rf"regexp_replace(lower({text}), '(?m)^[^\S\n]*(?:copyright|\(c\)|©)[^\n]*$', ' ', 'g')"
    text = f"regexp_replace({text}, '[^a-z0-9]+', ' ', 'g')"
    for old, new in SPELLINGS.items():
        text = rf"regexp_replace({text}, '\b{old}\b', '{new}', 'g')"
    return f"trim({text})"


def _known_sql() -> str:
    rows = [(k, t) for k, t in TEXTS.items()] + [(k, t) for k, v in NOTICES.items() for t in v]
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)


LICENSES_SQL = (
    f"WITH known AS (SELECT min(license) AS license, md5({_canonical_sql('t')}) AS digest FROM (VALUES {_known_sql()}) v(license, t) GROUP BY 2), "
    "parts AS (SELECT doc_id, text AS part, true AS whole FROM documents UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), false FROM documents), "
    f"digests AS (SELECT doc_id, whole, md5({_canonical_sql('part')}) AS digest FROM parts), "
    "found AS (SELECT doc_id, min(CASE WHEN whole THEN license END) AS license, string_agg(DISTINCT CASE WHEN NOT whole THEN license END, ',' "
    "ORDER BY CASE WHEN NOT whole THEN license END) AS notices FROM digests JOIN known USING (digest) GROUP BY doc_id) "
    "SELECT doc_id, license, coalesce(notices, '') AS notices FROM documents LEFT JOIN found USING (doc_id)"
)
