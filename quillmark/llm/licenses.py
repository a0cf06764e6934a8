"""License scans by canonical digests, in DataFrame functions only.

A text's canonical form is in lower case, without copyright lines (those about holders, with or without
comment marks before them), with runs of punctuation and blanks as one space, and with equivalent spellings
made one; line breaks don't matter to the whole.  The digest of a whole text is joined to the digests of
known licences, and so are those of the text without its first one and two lines, where these are short and name
a licence, as titles do.  The digests of its short lines are looked up in the row, which finds licence notices of one
line.  The known licences are a fixed list: that is the bound of what is broadcast.

Null and empty texts, and texts of nothing but copyright lines, match nothing.  Each row is judged by itself,
so repeated rows repeat results, and rows with one doc_id or none aren't mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk

# Spellings that count as the same, and wordings of licences and their notices.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("fulfilment", "fulfillment"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("centre", "center"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
    ("creative commons attribution noncommercial", "cc by nc"),
)
KNOWN = (
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Entire licences: name, title line (which a text may lack), text.
TEXTS = (
    (
        "MIT",
        "MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        "BSD Zero Clause License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        "zlib License",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        "BSD 2-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        "BSD 3-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        "The Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)
#: Digests of the canonical forms of long licences, as published.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "9085ee283b8c84517846c5acafee37391c28bb825b7ecec4aaa90768f2f283b0"),
    ("LGPL-2.0", "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
)
_MARK_CHARS = r" \t\x0b\x0c\r!-/:-@\[-`{-~"
_MARKS = f"[{_MARK_CHARS}]+"
#: Words after "copyright" that make a line part of a licence and not a line about holders.
_PROSE = r"copyright(ed|s|[ \t]+(and|act|claim|disclaimer|for|holder|in|interest|is|law|licen[cs]e|license|notice|of|on|or|owner|permission|protection|right|statement|status|terms|to|treat|under))"
_HOLDER = rf"(^|\n)[{_MARK_CHARS}]*((portions|parts|some parts)[ \t]+)?(copyright|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
#: Stands for "copyright" where it is no holder's.
_KEPT = "copyryght"


def canonical(text: Column) -> Column:
    """The canonical form, with its lines kept apart."""
    out = F.lower(F.coalesce(text, F.lit("")))
    said = out.contains("copyright") | out.contains("(c)") | out.contains("©") | out.contains("all rights reserved")
    held = F.replace(F.regexp_replace(F.regexp_replace(out, _PROSE, f"{_KEPT}$1"), _HOLDER, "\n"), F.lit(_KEPT), F.lit("copyright"))
    out = F.regexp_replace(F.when(said, held).otherwise(out), _MARKS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _lines(form: Column) -> Column:
    return F.filter(F.transform(F.split(form, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def identifiers(known=KNOWN, texts=TEXTS, digests=DIGESTS) -> list[str]:
    """The names of all known licences, and of those of the GNU family their two kinds."""
    names = {x[0].removesuffix("-only") for x in (*known, *texts, *digests)}
    return sorted(names | {f"{x}-{kind}" for x in names if "GPL" in x for kind in ("only", "or-later")})


def wordings(known=KNOWN, texts=TEXTS, digests=DIGESTS) -> list[tuple[str, str]]:
    """(license, text) of notices, of identifiers as they stand in sources, and of entire licences with and without their titles."""
    tagged = [(x, f"SPDX-License-Identifier: {x}") for x in identifiers(known, texts, digests)] if known else []
    return list(dict.fromkeys([*known, *tagged, *((k, x) for k, title, text in texts for x in (text, f"{title}\n\n{text}"))]))


#: The most canonical characters of a title line, and the most of such lines.
TITLE, TITLES = 80, 2


def known_digests(spark, known=KNOWN, texts=TEXTS, digests=DIGESTS) -> DataFrame:
    """(digest, license, length): a row for each distinct wording; length is that of its canonical form."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in wordings(known, texts, digests)])).alias("k")
    form = F.array_join(_lines(canonical(F.col("k.text"))), " ")
    out = spark.range(1).select(rows).select(F.sha2(form, 256).alias("digest"), F.col("k.license").alias("license"), F.char_length(form).alias("length"))
    if digests:
        fixed = F.explode(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license"), F.lit(0).alias("length")) for k, d in digests])).alias("k")
        out = out.unionByName(spark.range(1).select(fixed).select("k.*"))
    return out.groupBy("digest").agg(F.min("license").alias("license"), F.max("length").alias("length"))


#: Canonical characters up to which a known wording is a notice.
NOTICE = 200


def scan_licenses(docs: DataFrame, known=KNOWN, texts=TEXTS, digests=DIGESTS) -> DataFrame:
    """(doc_id, license, n_notices, notices) of each row: the licence that its whole text is, the number of its lines
    that are notices, and their licences, sorted and joined by commas."""
    digests_ = known_digests(docs.sparkSession, known, texts, digests)
    listed = {r["digest"]: r["license"] for r in digests_.collect() if 0 < r["length"] <= NOTICE}
    lines = docs.select("doc_id", _lines(canonical(F.col("text"))).alias("lines"))
    short = F.filter("lines", lambda x: F.char_length(x) <= NOTICE)
    found = F.filter(F.transform(short, lambda x: F.sha2(x, 256)), lambda h: h.isin(list(listed))) if listed else F.array().cast("array<string>")
    # the whole, and what follows the first titles
    titled = lambda n: F.forall(F.slice("lines", 1, n), lambda x: (F.char_length(x) <= TITLE) & F.contains(x, F.lit("license"))) & (F.size("lines") > n)
    whole = [F.when(titled(n), F.sha2(F.array_join(F.slice("lines", n + 1, 1 << 30), " "), 256)).alias(f"digest{n}") for n in range(1, TITLES + 1)]
    hashed = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest0"), *whole, found.alias("found"))
    names = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair]) if listed else F.create_map(F.lit(""), F.lit(""))
    notices = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda h: F.element_at(names, h)))), ",")
    out = hashed
    for n in range(TITLES + 1):
        out = out.join(F.broadcast(digests_.select(F.col("digest").alias(f"digest{n}"), F.col("license").alias(f"license{n}"))), f"digest{n}", "left")
    return out.select("doc_id", F.coalesce(*[f"license{n}" for n in range(TITLES + 1)]).alias("license"), F.size("found").cast("long").alias("n_notices"), notices.alias("notices"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(tk.table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2_sql() -> str:
    def pattern(text: str) -> str:
        return _quoted(text).replace("\\n", "' || chr(10) || '")

    def form(column: str) -> str:
        out = f"regexp_replace(lower(coalesce({column}, '')), {pattern(_PROSE)}, '{_KEPT}\\1', 'g')"
        out = f"replace(regexp_replace({out}, {pattern(_HOLDER)}, chr(10), 'g'), '{_KEPT}', 'copyright')"
        out = f"regexp_replace({out}, {_quoted(_MARKS)}, ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in wordings())
    fixed = "".join(f" UNION ALL SELECT '{d}', '{k}', 0" for k, d in DIGESTS)
    return f"""
WITH wording AS (SELECT array_to_string({form("text")}, ' ') AS form, license FROM (VALUES {values}) AS k(license, text)),
known AS (
  SELECT digest, min(license) AS license, max(n) AS n
  FROM (SELECT sha256(form) AS digest, license, length(form) AS n FROM wording{fixed}) GROUP BY 1),
lines AS (SELECT row_number() OVER () AS r, doc_id, {form("text")} AS lines FROM documents),
each AS (SELECT r, unnest(lines) AS line FROM lines),
notices AS (
  SELECT r, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices
  FROM each JOIN known ON sha256(line) = digest AND n BETWEEN 1 AND {NOTICE} GROUP BY r)
SELECT l.doc_id, coalesce(k.license, k1.license, k2.license) AS license, CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
FROM lines l LEFT JOIN known k ON sha256(array_to_string(l.lines, ' ')) = k.digest LEFT JOIN notices n ON n.r = l.r
LEFT JOIN known k1 ON len(l.lines) > 1 AND len(list_filter(l.lines[1:1], lambda x: length(x) <= {TITLE} AND contains(x, 'license'))) = 1 AND sha256(array_to_string(l.lines[2:], ' ')) = k1.digest
LEFT JOIN known k2 ON len(l.lines) > 2 AND len(list_filter(l.lines[1:2], lambda x: length(x) <= {TITLE} AND contains(x, 'license'))) = 2 AND sha256(array_to_string(l.lines[3:], ' ')) = k2.digest
"""
