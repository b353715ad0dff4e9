"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Native: DataFrame functions only.

A file is cut into pieces at line feeds and after sentences. Runs of pieces (its headers) and the whole file (a licence file)
are compared to templates: notices, SPDX tags, full texts of the short licences and the heads of the long ones. Vectors are
sparse, with sublinear term frequencies and without function words. A template that is near enough counts only if the run
has the words that tell its licence from others (its name, its version, its variant). A file's own licence is
that of its most similar run or whole text; a bare reservation of rights counts only where nothing else is found. A file
that as a whole is a notice, or whose name says so, is its directory's licence file, and files without a licence
of their own inherit from the nearest directory above them that has one. Ancestors are found by joins on directory paths.

Everything about one file is computed within its row, in the scan's own tasks: words become numbers by a table of
buckets, and no table of words is ever exploded or shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, join_counted, let, words

#: Least cosine of a run of pieces, and of a whole file, to a template.
LEAST = 0.6
LEAST_FILE = 0.5
#: Pieces that are joined to a run.
RUNS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 28, 36)
#: Runs begin at most so many pieces before one with a cue word.
LEAD = 2
#: Gives way to any other licence of the same file.
BARE = "Proprietary"
#: Words that any text may have, left out of all vectors.
FUNCTION_WORDS = frozenset("a an and any are as at be by can for from if in is it its may not of on or other out see such than that the this to under use was which will with without you your".split())
#: Spellings of one word.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "v1": "1", "v2": "2", "v3": "3", "v4": "4"}
#: Names of files that hold a directory's licence.
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
#: Ends of pieces.
PIECES = r"\n|(?<=[.!?;])[ \t]+"
#: Words that make a licence another one of its family, and what each that a template asks for and finds adds to its rank.
VARIANTS = frozenset("lesser library affero neither noncommercial nc sharealike sa noderivatives nd".split())
BONUS = 0.05
#: Buckets of the word table.
BUCKETS = 1024
#: Numbers of words that are in no template, and of function words.
UNKNOWN, SKIPPED = -1, -2
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
)
_MIT = (
    f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)
#: GNU licences as (identifier, title, what it covers, version, date and years of the text's head).
_GNU = (
    ("GPL-1.0", "General Public License", "program", "1", "February 1989 Copyright (C) 1989 Free Software Foundation, Inc."),
    ("GPL-2.0", "General Public License", "program", "2", "June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "General Public License", "program", "3", "29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.0", "Library General Public License", "library", "2", "June 1991 Copyright (C) 1991 Free Software Foundation, Inc."),
    ("LGPL-2.1", "Lesser General Public License", "library", "2.1", "February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "Lesser General Public License", "library", "3", "29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "Affero General Public License", "program", "3", "19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
)
#: Creative Commons licences by what their identifiers and names add.
_CREATIVE = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: Other identifiers whose SPDX tags are known.
_TAGS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD MPL-2.0 EPL-2.0 EPL-1.0 CC0-1.0 Unlicense Zlib BSL-1.0 Artistic-2.0".split()


def _gnu(spdx: str, title: str, covered: str, version: str, head: str) -> list[tuple[str, str, str]]:
    """A GNU licence by names and by the notice for source files, which ask for its number, and by the head of its full text."""
    special = title.split()[0].lower() if not title.startswith("General") else ""
    name, number = spdx.split("-")[0].lower(), " ".join(version.split("."))
    # A version 2.1 has the numbers 2 and 1, a 2.0 in an identifier 2 and 0.
    needs = f"{special} public license {number}"
    published = f"it under the terms of the GNU {title} as published by the Free Software Foundation"
    tag = spdx.replace("-", " ").replace(".", " ")
    return [
        (spdx, f"gnu {needs}", f"This work is licensed under the GNU {title}, version {version}."),
        (spdx, needs, f"This {covered} is free software: you can redistribute it and/or modify {published}, either version {version} of the License, or (at your option) any later version."),
        (spdx, needs, f"This {covered} is free software; you can redistribute it and/or modify {published}; version {version} of the License."),
        (spdx, f"gnu {needs} everyone", f"GNU {title} Version {version}, {head} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
        (spdx, f"{name} {number} licensed", f"Licensed under the {name.upper()} {version}."),
        (spdx, f"{name} {number} license", f"License: GNU {name.upper()} version {version}."),
        (spdx, f"{name}v{version} licensed".replace(".", " "), f"Licensed under {name.upper()}v{version}."),
        *((spdx, f"spdx license {name} {number}", f"SPDX-License-Identifier: {tag} {more}") for more in ("", "only", "or later")),
    ]


def _creative(parts: str, title: str) -> list[tuple[str, str, str]]:
    rows = []
    short, long = " ".join(parts.lower().split("-")), " ".join(title.lower().split("-"))
    for version, kind in (("4.0", "International"), ("3.0", "Unported")):
        spdx, number = f"CC-{parts}-{version}", " ".join(version.split("."))
        rows += [
            # CC and the version number are asked for; "by" is a function word.
            (spdx, f"licensed cc {short} {number}", f"Licensed under CC {parts} {version}."),
            (spdx, f"creative commons license {long} {number}", f"This work is licensed under a Creative Commons {title} {version} {kind} License."),
            (spdx, f"spdx license cc {short} {number}", f"SPDX-License-Identifier: CC-{parts}-{version}"),
        ]
    return rows


#: Fixed values: (SPDX identifier, words that a text must have, notice). Full texts of the short licences and heads of the long ones.
TEMPLATES = (
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "mit license", "The MIT License (MIT) Copyright (c)"),
    ("MIT", "mit license licensed", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "mit licensed", "Licensed under MIT."),
    ("MIT", "permission granted charge deal software", f"{_MIT_GRANT}."),
    ("MIT", "permission granted charge deal software", _MIT),
    ("Apache-2.0", "apache license 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2 licensed", "Licensed under Apache 2.0."),
    ("Apache-2.0", "apache license 2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "apache license 2 terms reproduction", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "redistributions source binary disclaimer", _CONDITIONS + _DISCLAIMER),
    ("BSD-2-Clause", "bsd 2 clause license", "BSD 2-Clause License"),
    ("BSD-3-Clause", "redistributions source binary disclaimer neither endorse", _CONDITIONS + _NAME + _DISCLAIMER),
    ("BSD-3-Clause", "redistributions source binary disclaimer neither endorse", _CONDITIONS + _NAME),
    ("BSD-3-Clause", "bsd license", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "bsd 3 clause license", "BSD 3-Clause License"),
    ("ISC", "isc license", "Released under the ISC License."),
    ("ISC", "permission fee granted notice appear copies", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
    ("0BSD", "permission fee granted disclaims", f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"),
    ("MPL-2.0", "mozilla license 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "mozilla license 2", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "mozilla license 2 definitions", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-2.0", "eclipse license 2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "eclipse license 1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "eclipse license 2", "Licensed under the Eclipse Public License, Version 2.0."),
    ("EPL-1.0", "eclipse license 1", "Licensed under the Eclipse Public License, Version 1.0."),
    ("Unlicense", "unencumbered domain", _UNLICENSE),
    ("Zlib", "misrepresented altered restrictions", _ZLIB),
    ("BSL-1.0", "boost license 1", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "permission granted charge organization transmit", _BOOST),
    ("Artistic-2.0", "artistic license 2", "Released under the Artistic License 2.0."),
    ("CC0-1.0", "cc0 1", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "creative cc0 1", "Creative Commons Legal Code CC0 1.0 Universal"),
    (BARE, "rights reserved", "All rights reserved."),
    (BARE, "rights reserved copyright", "Copyright (c) All rights reserved."),
    *(row for gnu in _GNU for row in _gnu(*gnu)),
    *(row for parts in _CREATIVE for row in _creative(*parts)),
    *((spdx, f"spdx license {spdx.lower().replace('-', ' ').replace('.', ' ')}", f"SPDX-License-Identifier: {spdx}") for spdx in _TAGS),
)


class Templates:
    """TF-IDF vectors of the templates, and the numbers of their words.

    idf counts licences, not templates. A word of no template has the idf of a word of one licence; in norms each of its
    places counts for itself.
    """

    def __init__(self, rows: tuple[tuple[str, str, str], ...] = TEMPLATES):
        bags = [Counter(self.terms(text)) for _, _, text in rows]
        spdx = [row[0] for row in rows]
        held: dict[str, set[str]] = {}
        for name, bag in zip(spdx, bags):
            for word in bag:
                held.setdefault(word, set()).add(name)
        licences = len(set(spdx))
        self.idf = {word: math.log((1 + licences) / (1 + len(names))) + 1 for word, names in held.items()}
        self.unknown = math.log((1 + licences) / 2) + 1
        self.spdx = spdx
        self.vectors = [{w: n / math.sqrt(sum(x * x for x in raw.values())) for w, n in raw.items()} for raw in (self.weigh(bag) for bag in bags)]
        self.needs = [frozenset(need.split()) - FUNCTION_WORDS for _, need, _ in rows]
        for need, bag in zip(self.needs, bags):
            if not need or need - bag.keys():
                raise ValueError(f"a template lacks a word that it asks for: {sorted(need - bag.keys())}")
        self.bonus = [BONUS * len(need & VARIANTS) for need in self.needs]
        self.cues = self._cues()
        # Cue words have the first numbers.
        self.numbers = {word: i for i, word in enumerate([*sorted(self.cues), *sorted(held.keys() - self.cues)])}

    @staticmethod
    def terms(text: str) -> list[str]:
        found = (SPELLINGS.get(x, x) for x in re.split(r"[\W_]+", text.lower()) if x)
        return [x for x in found if x not in FUNCTION_WORDS]

    def weigh(self, bag: Counter[str]) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in bag.items()}

    def _cues(self) -> frozenset[str]:
        """Words of which every text that some template accepts has at least one: few, so that few texts have any."""
        left, chosen = list(self.needs), set()
        while left:
            count = Counter(w for need in left for w in need if len(w) > 2)
            best = max(count, key=lambda w: (count[w], w))
            chosen.add(best)
            left = [need for need in left if best not in need]
        return frozenset(chosen)

    # ---- the same as columns; tables are literals, so that tasks need nothing but the plan

    def number(self, word: Column) -> Column:
        """A word's number, UNKNOWN or SKIPPED."""
        table: list[list[tuple[str, int]]] = [[] for _ in range(BUCKETS)]
        other = {**dict.fromkeys(FUNCTION_WORDS, SKIPPED), **{k: self.numbers[v] for k, v in SPELLINGS.items() if v in self.numbers}}
        for w, i in {**self.numbers, **other}.items():
            table[zlib.crc32(w.encode()) % BUCKETS].append((w, i))
        rows = ",".join("array(" + ",".join(f"named_struct('w','{w}','i',{i})" for w, i in row) + ")" if row else "cast(array() as array<struct<w:string,i:int>>)" for row in table)
        bucket = F.get(F.expr(f"array({rows})"), (F.crc32(word.cast("binary")) % BUCKETS).cast("int"))
        return F.coalesce(F.get(F.filter(bucket, lambda x: x["w"] == word), 0)["i"], F.lit(UNKNOWN))

    def best(self, run: Column, least: float) -> Column:
        """struct(bare, rank, less, spdx) of the best template of an array of numbers; null if none is near enough.

        less is minus the cosine; rank breaks near ties between licences of a family in favour of the one whose variant the text names.
        """
        order = sorted(self.numbers, key=self.numbers.__getitem__)
        postings: list[list[str]] = [[] for _ in order]
        for t, vector in enumerate(self.vectors):
            for w, v in vector.items():
                postings[self.numbers[w]].append(f"named_struct('t',{t},'v',{v!r}D)")
        weight_of = F.expr("array(" + ",".join(f"{self.idf[w]!r}D" for w in order) + ")")
        posted = F.expr("array(" + ",".join(f"array({','.join(p)})" for p in postings) + ")")
        # The rarest needed word first: most templates are out after one look.
        needed = F.expr("array(" + ",".join("array(" + ",".join(str(self.numbers[w]) for w in sorted(need, key=lambda w: (-self.idf[w], w))) + ")" for need in self.needs) + ")")
        spdx = F.expr("array(" + ",".join(f"'{s}'" for s in self.spdx) + ")")
        bonus = F.expr("array(" + ",".join(f"{b!r}D" for b in self.bonus) + ")")

        def judge(known: Column) -> Column:
            starts = F.transform(known, lambda x, i: F.when((i == 0) | (F.get(known, i - 1) != x), i))
            return let(F.filter(starts, lambda i: i.isNotNull()), lambda at: let(weighted(known, at), lambda own: let(norm(own), lambda n: near(known, own, n))))

        def weighted(known: Column, at: Column) -> Column:
            count = lambda i, k: F.coalesce(F.get(at, k + 1), F.size(known)) - i
            return F.transform(at, lambda i, k: F.struct(F.get(known, i).alias("id"), ((1 + F.log(count(i, k))) * F.get(weight_of, F.get(known, i))).alias("w")))

        def norm(own: Column) -> Column:
            strange = F.size(F.filter(run, lambda x: x == UNKNOWN))
            return F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["w"] * p["w"]) + strange * F.lit(self.unknown**2))

        def near(known: Column, own: Column, n: Column) -> Column:
            dot = lambda t: F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["w"] * F.coalesce(F.get(F.filter(F.get(posted, p["id"]), lambda q: q["t"] == t), 0)["v"], F.lit(0.0)))
            admitted = F.filter(F.sequence(F.lit(0), F.lit(len(self.spdx) - 1)), lambda t: F.forall(F.get(needed, t), lambda x: F.array_contains(known, x)))
            cosines = F.transform(admitted, lambda t: F.struct(t.alias("t"), F.round(dot(t) / n, 9).alias("cosine")))
            enough = F.filter(cosines, lambda s: s["cosine"] >= least)
            ranked = lambda s: F.struct((F.get(spdx, s["t"]) == BARE).alias("bare"), (-F.round(s["cosine"] + F.get(bonus, s["t"]), 9)).alias("rank"), (-s["cosine"]).alias("less"), F.get(spdx, s["t"]).alias("spdx"))
            return F.array_min(F.transform(enough, ranked))

        return let(F.array_sort(F.filter(run, lambda x: x >= 0)), judge)


def _own(files: DataFrame, templates: Templates, least: float, least_file: float) -> DataFrame:
    """doc_id and own (bare, less, basis, spdx) of every row of ``files`` in which a licence is found, row by row."""
    lower = F.lower(F.col("text"))
    cued = F.reduce(F.array(*[lower.contains(w) for w in sorted(templates.cues | {k for k, v in SPELLINGS.items() if v in templates.cues})]), F.lit(False), lambda a, b: a | b)
    numbered = lambda piece: F.filter(F.transform(words(piece), templates.number), lambda x: x != SKIPPED)
    pieces = F.filter(F.transform(F.split("text", PIECES), numbered), lambda x: F.size(x) > 0)
    # Exploding a single element keeps Spark from computing the pieces once more for every use.
    cut = files.where(cued).select("doc_id", F.explode(F.array(pieces)).alias("pieces"))
    cut = cut.select("doc_id", "pieces", F.explode(F.array(F.transform("pieces", lambda x: F.exists(x, lambda i: (i >= 0) & (i < len(templates.cues)))))).alias("cues"))
    cut = cut.where(F.exists("cues", lambda x: x))
    whole = cut.select("doc_id", F.lit("file").alias("basis"), templates.best(F.flatten("pieces"), least_file).alias("found"))
    lengths = lambda i: F.array_distinct(F.transform(F.array(*map(F.lit, RUNS)), lambda n: F.least(n, F.size("pieces") - i)))
    starts = F.filter(F.transform("cues", lambda _, i: F.when(F.exists(F.slice("cues", i + 1, LEAD + 1), lambda x: x), i)), lambda i: i.isNotNull())
    places = F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.struct(i.alias("i"), n.alias("n")))))
    runs = cut.select("doc_id", "pieces", F.explode(places).alias("at")).select("doc_id", F.explode(F.array(F.flatten(F.slice("pieces", F.col("at.i") + 1, F.col("at.n"))))).alias("run"))
    header = runs.select("doc_id", F.lit("header").alias("basis"), templates.best(F.col("run"), least).alias("found"))
    every = whole.union(header).where("found IS NOT NULL")
    order = F.struct("found.bare", "found.rank", "found.less", "basis", "found.spdx")  # "file" comes before "header"
    return every.groupBy("doc_id").agg(F.min(order).alias("best")).select("doc_id", F.struct("best.spdx", (-F.col("best.less")).alias("similarity"), "best.basis").alias("own"))


def scan(spark: SparkSession, files: DataFrame, path: Column, templates: Templates | None = None, least: float = LEAST, least_file: float = LEAST_FILE) -> DataFrame:
    """doc_id, path, license, basis, similarity and inherited_from of every document of ``files`` (doc_id, text).

    basis is ``header`` (its best run of pieces), ``file`` (its whole text, or its name says so), ``inherited`` (inherited_from is the directory) or ``none``.
    Texts may be null or empty: they have no licence of their own. Rows that share a doc_id are one document; its path is the
    least of theirs. Of equally similar licences the one first in the alphabet is taken, of several licence files of a
    directory the most similar, then the first. A null path has no directory and inherits nothing.
    """
    scratch = Scratch(spark, "licenses")
    listed = scratch.keep(files.groupBy("doc_id").agg(F.min(path).alias("path")), "paths")
    own = scratch.keep(_own(files.select("doc_id", "text"), templates or Templates(), least, least_file), "own")

    known = listed.join(own, listed["doc_id"].eqNullSafe(own["doc_id"]), "left").select(listed["doc_id"], "path", "own", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    known = scratch.keep(known.withColumn("is_file", F.col("own").isNotNull() & ((F.col("own.basis") == "file") | F.coalesce(F.col("path").rlike(NAMES), F.lit(False)))), "known")
    chosen = F.min_by(F.struct("own.spdx", "own.similarity"), F.struct((-F.col("own.similarity")).alias("less"), "own.spdx"))
    licensed = scratch.keep(known.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(chosen.alias("of")).select(F.col("dir").alias("above"), F.col("of.spdx").alias("spdx"), F.col("of.similarity").alias("of_similarity")), "licensed")

    # Each directory once, whatever the number of its files, with all directories above it and the root.
    dirs = known.where("own IS NULL AND dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("files"))
    dirs = scratch.keep(dirs, "dirs")
    steps = F.split("dir", "/")
    above = dirs.select("dir", "files", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("above"))
    nearest = above.join(licensed, "above").groupBy("dir", "files").agg(F.max_by(F.struct("spdx", "of_similarity", "above"), F.length("above")).alias("from"))
    nearest = scratch.keep(nearest, "nearest")
    total = nearest.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]
    heirs = join_counted(known.where("own IS NULL AND dir IS NOT NULL").select("doc_id", "path", "dir"), nearest, ["dir"], "files", total)
    heirs = heirs.select("doc_id", "path", F.col("from.spdx").alias("license"), F.lit("inherited").alias("basis"), F.col("from.of_similarity").alias("similarity"), F.col("from.above").alias("inherited_from"))
    owners = known.where("own IS NOT NULL").select("doc_id", "path", F.col("own.spdx").alias("license"), F.when(F.col("is_file"), "file").otherwise(F.col("own.basis")).alias("basis"), F.col("own.similarity").alias("similarity"), F.lit(None).cast("string").alias("inherited_from"))
    some = scratch.keep(owners.union(heirs), "some")
    none = known.where("own IS NULL").join(some.select(F.col("doc_id").alias("d")), F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
    none = none.select("doc_id", "path", F.lit(None).cast("string").alias("license"), F.lit("none").alias("basis"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("string").alias("inherited_from"))
    return some.union(none)
