"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder (DataFrame functions only)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(name: str, version: str, date: str, program: str = "program") -> tuple[str, ...]:
    """How files and licence files of the GNU family state it: title, notice, warranty, and the short forms."""
    said = {"2": "either version 2 of the License", "2.1": "either version 2.1 of the License", "3": "either version 3 of the License"}[version]
    free = f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {said}, or (at your option) any later version."
    warranty = f"This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return (
        f"GNU {name} Version {version}, {date}", f"This work is licensed under the GNU {name}, version {version}.", free, f"{free} {warranty}",
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} version {version}",
    )


#: The texts and notices by which files state a licence.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", _APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD} {_BSD_WARRANTY}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD_THIRD, f"{_BSD} {_BSD_THIRD} {_BSD_WARRANTY}", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "GPL-2.0": _gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007"),
    "ISC": ("Licensed under the ISC License.", _ISC, f"{_ISC} {_ISC_WARRANTY}"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999", "library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007", "library"),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_MIT_NOTICE} {_WARRANTY}", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    "Unlicense": (*_UNLICENSE, " ".join(_UNLICENSE)),
}
TERM, THRESHOLD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*", 0.6
#: Terms of less than this share of the files weigh alike; else a name or a year beside a notice would weigh more the larger the table.
RARE = 0.001
FILES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def counted(words: Column) -> Column:
    """The different ``words`` with their numbers (term, tf): where each begins among the sorted ones, and where the next does."""
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    tf = lambda s, at, p, i: (F.coalesce(F.get(at, i + 1), F.size(s) + 1) - p).cast("bigint").alias("tf")
    runs = lambda z: F.transform(z["at"], lambda p, i: F.struct(F.get(z["s"], p - 1).alias("term"), tf(z["s"], z["at"], p, i)))
    let = lambda value, use: F.transform(F.array(value), use)[0]
    return let(F.array_sort(words), lambda s: F.when(F.size(s) > 0, let(F.struct(s.alias("s"), starts(s).alias("at")), runs)))


def any_of(words: list[str]) -> str:
    """A pattern for any of the sorted ``words`` that tries only those with the next letter."""
    rest = [(first, [w[1:] for w in own]) for first, own in groupby(words, key=lambda w: w[:1])]
    made = [re.escape(first) + any_of(tails) if first else "" for first, tails in rest]
    return made[0] if len(made) == 1 else "(?:" + "|".join(sorted(made, key=len, reverse=True)) + ")"


def passages(text: Column) -> Column:
    """What is held against the templates: each line, each two lines in a row, each paragraph, and the whole file."""
    lines = F.filter(F.split(text, r"\R"), lambda x: F.rlike(x, F.lit("[A-Za-z0-9]")))
    pairs = F.zip_with(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(lines, pairs, F.split(text, r"\R\s*\R"), F.array(text)))


def scan(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per path of (path, text): path, own, own_score: the best template of any of its passages, or null.

    Passages (see :func:`passages`) and templates are bags of terms weighted by tf x idf; idf counts the files of every
    term, at least ``RARE`` of all, so at most mean-terms-a-file / ``RARE`` terms need a weight of their own and are
    broadcast.  A passage can only reach ``threshold`` with a key term of some template, as the other terms carry too
    little of its length; so only files that have one are taken apart, and none is lost.  Of equal scores the licence first
    in code-point order counts.  Null and empty texts have no licence; files that repeat a path, or have none, count as
    one with all their passages; extra columns are ignored.
    """
    bags = {(name, i): Counter(re.findall(TERM, t.lower())) for name, many in templates.items() for i, t in enumerate(many)}
    vocabulary = sorted({t for b in bags.values() for t in b})
    files = files.select(F.struct("path").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    # One pass counts the files of each term; only paths that repeat need their terms brought together first.
    held = files.select("file", F.array_distinct(terms(F.col("text"))).alias("terms"))
    n, most = files.groupBy("file").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    held = held.select("file", F.explode("terms").alias("term"))
    held = held if most < 2 else held.distinct()
    floor = RARE * n
    common = cut(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") > floor) | F.col("term").isin(vocabulary)))
    df = {r["term"]: r["df"] for r in common.where(F.col("term").isin(vocabulary)).collect()}  # as many rows as the templates have terms
    unknown = math.log((1 + n) / (1 + floor)) + 1
    idf = {t: math.log((1 + n) / (1 + max(df.get(t, 0), floor))) + 1 for t in vocabulary}
    weights, keys = {t: [None] * len(bags) for t in vocabulary}, set()
    for at, bag in enumerate(bags.values()):
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items()))
        for t, c in bag.items():
            weights[t][at] = c * idf[t] / length
        light = 0.0
        for t in sorted(bag, key=lambda t: (-df.get(t, 0), idf[t] * bag[t], t)):  # the commonest terms that cannot reach the threshold by themselves
            light += (bag[t] * idf[t] / length) ** 2
            if light >= threshold**2 - 1e-9:
                keys.add(t)
    spark = files.sparkSession
    table = spark.createDataFrame(list(weights.items()), "term string, weights array<double>")  # a weight for each template
    weighed = common.select("term", (F.log((1 + n) / (1 + F.greatest("df", F.lit(floor)))) + 1).alias("idf"))
    has_key = lambda x: F.lower(x).rlike(rf"(?<![a-z0-9]){any_of(sorted(keys))}(?![a-z0-9])")
    said = files.where(has_key(F.col("text"))).select("file", F.explode(passages(F.col("text"))).alias("said")).where(has_key(F.col("said")))
    said = said if most < 2 else said.distinct()
    # A passage's terms are counted in its row and added up in its task, so that one row of a passage is shuffled, not its terms.
    bag = said.select("file", F.unhex(F.sha2("said", 256)).alias("said"), F.explode(counted(terms(F.col("said")))).alias("x")).select("file", "said", "x.*")
    bag = bag.join(F.broadcast(weighed), "term", "left").join(F.broadcast(table), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    sums = bag.groupBy("file", "said").agg(F.sum(F.col("x") * F.col("x")).alias("square"), *[F.sum(F.col("x") * F.col("weights")[i]).alias(f"dot{i}") for i in range(len(bags))])
    score = [F.struct(F.round(F.col(f"dot{i}") / F.sqrt("square"), 6).alias("score"), F.lit(name).alias("licence")) for i, (name, _) in enumerate(bags)]
    best = sums.select("file", F.explode(F.filter(F.array(*score), lambda x: x["score"] >= threshold)).alias("x")).select("file", "x.*") if bags else sums.select("file", F.lit(0.0).alias("score"), F.lit("").alias("licence")).limit(0)
    own = best.groupBy("file").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("own"), F.max("score").alias("own_score"))
    return files.select("file").distinct().join(own, "file", "left").select("file.path", "own", "own_score")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def licences(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence, score, how (`header`, `file`, `inherited` or `none`), from_folder.

    A file's own notice comes first.  Else it inherits from the nearest folder above it that has a licence file (LICENSE,
    COPYING or NOTICE) with a recognised notice: folders, not files, are joined with their ancestors, each once.  Of
    several licence files in a folder the best score counts, then the licence first in code-point order.  A null path may
    have a notice of its own, but no folder, and inherits nothing.
    """
    found = cut(scan(files, templates, threshold).withColumn("folder", folder(F.col("path"))))
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILES), F.lit(False))
    best = F.min_by(F.struct("own", "own_score"), F.struct(-F.col("own_score"), F.col("own")))
    given = found.where(named & F.col("own").isNotNull()).groupBy(F.col("folder").alias("giver")).agg(best.alias("g"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k)))
    ways = found.where("folder is not null").select("folder").distinct().select("folder", F.explode(F.array_union(above, F.array(F.lit("")))).alias("giver"))
    nearest = ways.join(given, "giver").groupBy("folder").agg(F.max_by(F.struct("giver", "g"), F.length("giver")).alias("near"))
    out = found.join(nearest, "folder", "left")
    how = F.when(F.col("own").isNotNull(), F.when(named, "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "path", F.coalesce("own", "near.g.own").alias("licence"), F.coalesce("own_score", "near.g.own_score").alias("score"), how.alias("how"),
        F.when(F.col("own").isNull(), F.col("near.giver")).alias("from_folder"),
    )
