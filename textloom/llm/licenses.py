"""Licence notices: normalised text against templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, texts

#: The usual notices of common licences, and short licences in full.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalized(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[str]:
    w = normalized(text).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def probes(templates: dict[str, str], least: float) -> list[str]:
    """Bigrams of which any text with a Dice coefficient of `least` to some template has one.

    Such a text shares at least least * n / (2 - least) of a template's n bigrams, so it can't avoid
    all of any n - that + 1 of them; the ones that fewest templates use are taken.
    """
    used = Counter(b for t in templates.values() for b in bigrams(t))
    out: set[str] = set()
    for t in templates.values():
        own = bigrams(t)
        out |= set(sorted(own, key=lambda b: (used[b], -len(b), b))[: len(own) - ceil(least * len(own) / (2 - least) - 1e-9) + 1])
    return sorted(out)


def _alternatives(phrases: list[str]) -> str:
    """Any of the phrases (letters, digits and spaces) between word boundaries: as a tree of their characters, so one look at a character rules out most."""

    def tree(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for p in rest:
            by.setdefault(p[:1], []).append(p[1:])
        if list(by) == [""]:
            return ""
        arms = [r"\b" if not c else c + tree(ends) for c, ends in sorted(by.items())]
        return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"

    return rf"\b{tree(sorted(set(phrases)))}\b"


def _norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, least: float = 0.75, run: int = 6, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, dice, segment, width): the licence notices of every row.

    A text is cut into segments at line breaks and sentence ends; every run of 1 to `run` segments, and the
    whole text, is compared with the templates whose bigram count lies within [n * least / (2 - least), n * (2 - least) / least],
    and belongs to the most alike (then the first by name). For each licence of a row the most alike run
    is reported (then the first, then the shortest). Null, empty and unlicensed texts give no row;
    rows that repeat id and text give one. One scan; only texts with a probe bigram go on, and of those
    only the stretches of `run` segments that hold one: what is dealt out as rows never carries a whole
    text, so a text of any length costs in proportion to its length.
    """
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    grams = {k: bigrams(templates[k]) for k in names}
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, grams[k])).alias("g")) for k in names])
    low, high = min(map(len, grams.values())) * least / (2 - least), max(map(len, grams.values())) * (2 - least) / least
    probe = _alternatives(probes(templates, least))
    some = texts(docs).where(_norm(F.col("text")).rlike(probe))
    cut = F.split(F.regexp_replace("text", r"([.!?;:])\s+", "$1\n"), "\n")
    segments = F.filter(F.transform(cut, _norm), lambda x: x != "")
    rows = some.select("doc_id", F.xxhash64("text").alias("h"), segments.alias("segs"))
    ahead = F.transform("segs", lambda _, i: F.struct(i.alias("segment"), F.lit(0).alias("all"), F.slice("segs", i + 1, F.lit(run)).alias("s")))
    held = F.filter(ahead, lambda x: F.concat_ws(" ", x["s"]).rlike(probe))
    # the whole text of over `run` segments is one more run; each further distinct word brings a new bigram, so many words rule it out
    n_words = F.size(F.array_distinct(F.flatten(F.transform("segs", lambda x: F.split(x, " ")))))
    whole = F.array(F.struct(F.lit(0).alias("segment"), F.size("segs").alias("all"), F.array(F.concat_ws(" ", "segs")).alias("s")))
    stretches = rows.select("doc_id", "h", F.explode(F.when((F.size("segs") > run) & (n_words - 1 <= high), F.concat(held, whole)).otherwise(held)).alias("x"))
    stretches = stretches.select("doc_id", "h", "x.segment", "x.all", "x.s")
    runs = F.transform(F.sequence(F.lit(1), F.size("s")), lambda w: F.struct(F.greatest(w, F.col("all")).alias("width"), F.concat_ws(" ", F.slice("s", 1, w)).alias("t")))
    rows = stretches.select("doc_id", "h", "segment", F.explode(runs).alias("u")).select("doc_id", "h", "segment", "u.width", "u.t").where(F.col("t").rlike(probe))
    rows = rows.select("doc_id", "h", "segment", "width", F.split("t", " ").alias("w")).where(F.size("w") - 1 >= low)
    own = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = rows.select("doc_id", "h", "segment", "width", own.alias("g"))
    rows = Scratch(docs.sparkSession, "licenses").save(rows, "runs").where(F.size("g").between(ceil(low - 1e-9), int(high + 1e-9)))
    n, m = F.size("g"), lambda t: F.size(t["g"])
    fits = F.filter(table, lambda t: (n * (2 - least) >= m(t) * least) & (m(t) * (2 - least) >= n * least))
    pairs = rows.select("doc_id", "h", "segment", "width", "g", F.explode(fits).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("t.g", "g")) / (F.size("t.g") + F.size("g"))
    alike = pairs.select("doc_id", "h", "segment", "width", F.struct((-dice).alias("d"), F.col("t.name").alias("name")).alias("x")).where(F.col("x.d") <= -least)
    best = alike.groupBy("doc_id", "h", "segment", "width").agg(F.min("x").alias("x"))
    top = best.groupBy("doc_id", "h", F.col("x.name").alias("license")).agg(F.min(F.struct("x.d", "segment", "width")).alias("o"))
    return top.select("doc_id", "license", F.round(-F.col("o.d"), 6).alias("dice"), F.col("o.segment").alias("segment"), F.col("o.width").alias("width"))


SQL = """
WITH templates(license, body) AS (VALUES {values}),
tg AS (SELECT license, len(g) AS m, unnest(g) AS b FROM (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
       FROM (SELECT license, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM templates))),
segs AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), chr(10)),
           lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM (SELECT DISTINCT doc_id, text FROM documents)),
starts AS (SELECT doc_id, text, s, unnest(range(0, len(s))) AS segment FROM segs),
units AS (SELECT doc_id, text, segment, width, string_split(array_to_string(s[segment + 1 : segment + width], ' '), ' ') AS w
          FROM (SELECT *, unnest(range(1, least({run}, len(s) - segment) + 1)) AS width FROM starts)
          UNION ALL SELECT doc_id, text, 0, len(s), string_split(array_to_string(s, ' '), ' ') FROM segs WHERE len(s) > {run}),
grams AS (SELECT row_number() OVER () AS u, doc_id, text, segment, width, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM units),
shared AS (SELECT u, license, m, count(*) AS common FROM (SELECT u, unnest(g) AS b FROM grams) JOIN tg USING (b) GROUP BY ALL),
scored AS (SELECT doc_id, text, segment, width, license, 2.0::DOUBLE * common / (len(g) + m) AS dice FROM shared JOIN grams USING (u)),
best AS (SELECT * FROM scored WHERE dice >= {least}
         QUALIFY row_number() OVER (PARTITION BY doc_id, text, segment, width ORDER BY dice DESC, license) = 1)
SELECT doc_id, license, round(dice, 6) AS dice, segment::INTEGER AS segment, width::INTEGER AS width FROM best
QUALIFY row_number() OVER (PARTITION BY doc_id, text, license ORDER BY dice DESC, segment, width) = 1
"""


def sql(least: float = 0.75, run: int = 6) -> str:
    """Every run of every text, and the whole text, against every template: shared bigrams by a plain join."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(TEMPLATES.items()))
    return SQL.format(values=values, least=least, run=run)
