"""License scans: sparse TF-IDF cosine of notices, headers and licence files to templates, then inheritance from the nearest ancestor directory.

A file gives several pieces, each a vector of TF-IDF weights over its terms: the whole text, its header (the comment lines that it opens with),
every paragraph, and runs of neighbouring lines or sentences of a paragraph, so that wrapped notices and those with more sentences beside
them are seen. From each line or sentence on, the runs that meet a template are the shortest ones with ``LENGTHS`` times as many terms as the
template, however many lines that takes. Pieces with two or more different terms of a template are compared with it by cosine. Weights come from the templates alone: a term
in none of them has the largest weight, so that words beside a notice lower its cosine. A term's frequency is 1 + ln of its count.

Bounds that lose none leave out what cannot reach the threshold, template by template: a text, a paragraph and a run must hold more than
threshold^2 of the template's squared weight, and so one of its telling terms (the rarest ones that hold more than 1 - threshold^2 of it);
and a whole text or paragraph must not hold too many different terms that no template has. Only runs that are left are exploded to terms.

A licence file's licence holds for its directory. Each distinct directory meets its ancestors in a join on the path, takes the deepest
one's licence, and hands it to the files without one of their own. Only DataFrame functions are used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import written

#: The disclaimers and conditions that several licences share.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_PERMITTED = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: What licence notices, headers and files say, by SPDX name. Long licences stand with their title blocks.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", _MIT_GRANT, f"MIT License {_MIT_GRANT} {_MIT_KEEP} {_AS_IS}"],
    "ISC": ["SPDX-License-Identifier: ISC", _ISC_GRANT, f"ISC License {_ISC_GRANT} {_ISC_END}"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", _GNU_HEADER.format(name="General Public License", version=3), f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_GNU_PERMITTED}", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This program is free software; you can redistribute it under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", _GNU_HEADER.format(name="General Public License", version=2), f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_GNU_PERMITTED}", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": [_GNU_HEADER.format(name="Lesser General Public License", version=3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only"],
    "LGPL-2.1": [_GNU_HEADER.format(name="Lesser General Public License", version="2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": [_GNU_HEADER.format(name="Affero General Public License", version=3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", f"{_BSD_TOP} {_BSD_END}"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", _BSD_THIRD, f"{_BSD_TOP} 3. {_BSD_THIRD} {_BSD_END}"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "LicenseRef-proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."],
}
#: Fixed value: template words that other texts use just as well, taken as telling last.
PLAIN = ["a", "and", "are", "can", "in", "into", "is", "it", "of", "or", "the", "this", "to", "under", "use", "with", "without", "you", "any", "all", "free", "work", "copy", "form", "person", "source", "by", "for", "on", "be", "from", "that", "at", "may", "not", "but", "as", "an", "was", "do", "no", "if", "its", "so", "such", "one", "other", "out", "nor", "either", "must", "way", "whom", "whether", "used", "your", "has", "have", "been", "even", "1", "2", "3"]
#: What separates terms, lines without a term, how comment lines begin, where lines and sentences end.
APART, VOID, COMMENT, ENDS = "\\.*(?:[^a-z0-9.\\-]+|$)", "(?md)^[^A-Za-z0-9\n]+$", "^[ \\t]*(#|//|/\\*|\\*|--|;|<!--|%|\"|$)", "\n|(?<=[.;]) +"
#: How many terms the runs of lines or sentences hold, as shares of the template's.
LENGTHS = (0.65, 0.8, 1.0, 1.25)
#: Different terms of a template that a piece holds at least (or all of them): a lone word, such as a German sentence's "Mit.", is no notice.
TOGETHER = 2
#: A licence that is taken only where nothing else matches: its phrase stands above most other notices.
LAST_RESORT = "LicenseRef-proprietary"
#: A directory with more than this share of all files is handed its licence by broadcast.
HOT = 1e-4


def terms_of(text: Column) -> Column:
    """The runs of letters, digits, dots and hyphens, lower-cased, without a dot at the end."""
    return F.array_remove(F.split(F.lower(text), APART), "")


def template_weights(spark, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(template, licence, term, weight, idf, n, size): unit vectors, terms' counts, squared lengths before; as many rows as the templates have terms."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in templates.items() for t in ts)]
    terms = spark.createDataFrame(rows, "template int, licence string, text string").select("template", "licence", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.countDistinct("template").alias("df"))
    weighted = terms.join(F.broadcast(df), "term").withColumn("idf", F.log((1.0 + len(rows)) / (1.0 + F.col("df"))) + 1).withColumn("w", (F.log("n") + 1) * F.col("idf"))
    size = weighted.groupBy("template").agg(F.sum(F.col("w") * F.col("w")).alias("size"))
    return weighted.join(F.broadcast(size), "template").select("template", "licence", "term", (F.col("w") / F.sqrt("size")).alias("weight"), "idf", "n", "size")


def telling_terms(weights: list, threshold: float) -> dict[int, list[str]]:
    """Of each template the terms without which no text's cosine with it reaches the threshold; the rows of template_weights, a fixed number."""
    telling, held = {}, {}
    for r in sorted(weights, key=lambda r: (r.template, r.term in PLAIN, -r.idf, -r.weight, r.term)):
        # the rest's squared weight is below threshold^2 once more than this is held
        if held.get(r.template, 0.0) <= 1 - threshold * threshold + 1e-6:
            telling.setdefault(r.template, []).append(r.term)
            held[r.template] = held.get(r.template, 0.0) + r.weight * r.weight
    return telling


def holds(text: Column, telling: list[str]) -> Column:
    """Whether one of the telling terms is a term of the text."""
    return F.arrays_overlap(F.split(F.lower(text), APART), F.array(*map(F.lit, telling)))


def once(value: Column, then) -> Column:
    """then(value) where the value is computed once a row: an expression inside a lambda would be computed again in each of its calls."""
    return F.element_at(F.transform(F.array(value), then), 1)


def described(weights: list, telling: dict[int, list[str]]) -> Column:
    """The templates as one constant: number, count of terms, different terms with their squared weights, telling terms."""
    found = [{"template": t, "n": sum(r.n for r in rows), "terms": [{"name": r.term, "square": r.weight * r.weight} for r in rows], "telling": telling[t]} for t in sorted(telling) if (rows := [r for r in weights if r.template == t])]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<template:int,n:int,terms:array<struct<name:string,square:double>>,telling:array<string>>>")


def runs_of(units: Column, t: Column) -> Column:
    """The runs (first from 1, length) of units, arrays of terms, that hold a telling term of the template t and LENGTHS times as many terms as it."""
    reach = F.ceil(t["n"] * max(LENGTHS)).cast("int")  # every unit has a term

    def length(sizes: Column, least: Column) -> Column:
        begin = F.struct(F.lit(0).alias("terms"), F.lit(0).alias("units"))
        return F.aggregate(sizes, begin, lambda a, x: F.when(a["terms"] >= least, a).otherwise(F.struct((a["terms"] + x).alias("terms"), (a["units"] + 1).alias("units"))))["units"]

    def spans(told: Column, sizes: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.array_contains(F.slice(told, i, reach), True))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.array_distinct(F.array(*[length(F.slice(sizes, i, reach), t["n"] * x) for x in LENGTHS])), lambda n: F.struct(i.alias("first"), n.alias("length")))))

    return once(F.transform(units, lambda u: F.arrays_overlap(u, t["telling"])), lambda told: once(F.transform(units, F.size), lambda sizes: spans(told, sizes)))


def pieces(files: DataFrame, weights: list, threshold: float) -> DataFrame:
    """(id, text_hash, kind, block, first, length, template, terms): the pieces of files(id, text) that may reach the threshold with a template.

    kind: 2 the whole text, 1 its header, 0 a run within a paragraph (its number is ``block``; a length of 0: all of it).
    Equal rows give their pieces once.
    """
    per = telling_terms(weights, threshold)
    telling, vocabulary = sorted({x for xs in per.values() for x in xs}), F.array(*map(F.lit, sorted({r.term for r in weights})))
    known, least = described(weights, per), threshold * threshold - 1e-9

    def enough(present: Column, t: Column) -> Column:
        """Whether the terms hold enough of the template's, and so much of its weight that the cosine may reach the threshold."""
        held = F.aggregate(t["terms"], F.lit(0.0), lambda s, x: s + F.when(F.array_contains(present, x["name"]), x["square"]).otherwise(0.0))
        several = F.size(F.array_intersect(F.transform(t["terms"], lambda x: x["name"]), present)) >= F.least(F.size(t["terms"]), F.lit(TOGETHER))
        return F.when(F.arrays_overlap(present, t["telling"]), F.when(several, held >= least).otherwise(False)).otherwise(False)

    def compact(terms: Column, present: Column, t: Column) -> Column:
        """Whether the whole is not ruled out by its different terms that no template has: each has the largest weight, the template's terms together at most as much as when all are equally frequent."""
        d = F.size(t["terms"])
        top = F.pow(F.log(F.greatest(F.size(terms) / d, F.lit(1.0))) + 1, F.lit(2.0)) * d
        return F.size(F.array_distinct(terms)) - F.size(present) <= top * (1 / (threshold * threshold) - 1) + 1e-6

    def possible(text: Column, of: Column) -> Column:
        """Of the templates numbered in ``of`` (places in known): those that the text may match in a run, and whether it may as a whole."""
        def judged(terms: Column, present: Column) -> Column:
            near = F.filter(of, lambda m: enough(present, F.element_at(known, m)))
            return F.transform(near, lambda m: F.struct(m.alias("m"), compact(terms, present, F.element_at(known, m)).alias("whole")))

        return once(terms_of(text), lambda terms: once(F.array_intersect(vocabulary, terms), lambda present: judged(terms, present)))

    def kept(found: Column, then) -> Column:
        """then(found) in an array, empty where nothing is found; taken as a generator's input, so that it is computed once."""
        return F.transform(F.filter(F.array(found), lambda x: F.size(x) > 0), then)

    every = F.sequence(F.lit(1), F.size(known))
    docs = files.where("id is not null").where(holds(F.col("text"), telling))
    docs = docs.select("id", "text", F.explode(kept(possible(F.col("text"), every), lambda x: x)).alias("near"))
    lines = F.split("text", "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False).cast("int")
    header = F.array_join(F.slice(lines, 1, F.greatest(stop - 1, F.lit(0))), "\n")

    def part(kind: int, block: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), block.alias("block"), text.alias("text"))

    blocks = F.transform(F.split(F.ltrim(F.regexp_replace("text", VOID, ""), F.lit("\n")), "\n\n+"), lambda x, i: part(0, i, x))
    parts = docs.select("id", F.xxhash64("text").alias("text_hash"), F.transform("near", lambda x: x["m"]).alias("of"), F.inline(F.concat(F.array(part(2, F.lit(0), F.col("text")), part(1, F.lit(0), header)), blocks)))
    units = F.filter(F.transform(F.when(F.col("kind") > 0, F.array("text")).otherwise(F.split("text", ENDS)), terms_of), lambda u: F.size(u) > 0)
    parts = parts.select("id", "text_hash", "kind", "block", F.inline(kept(possible(F.col("text"), F.col("of")), lambda x: F.struct(x.alias("near"), units.alias("units")))))
    parts = parts.select("id", "text_hash", "kind", "block", "units", F.inline("near"))
    t = F.element_at(known, F.col("m"))
    all_of_it = F.when(F.col("whole"), F.array(F.struct(F.lit(1).alias("first"), F.lit(0).alias("length")))).otherwise(F.array().cast("array<struct<first:int,length:int>>"))
    spans = F.when(F.col("kind") > 0, all_of_it).otherwise(F.concat(runs_of(F.col("units"), t), all_of_it))

    def run(s: Column) -> Column:
        terms = F.flatten(F.when(s["length"] > 0, F.slice("units", s["first"], s["length"])).otherwise(F.col("units")))
        return F.struct((s["first"] - 1).alias("first"), s["length"].alias("length"), terms.alias("terms"))

    runs = F.filter(F.transform(spans, run), lambda r: enough(r["terms"], t))
    key = ["id", "text_hash", "kind", "block", "first", "length", "template"]
    return parts.select("id", "text_hash", "kind", "block", t["template"].alias("template"), F.inline(runs)).dropDuplicates(key).select(*key, "terms")


def own_licences(files: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, licence, score, opens) of the files(id, text) with a piece close enough to a template.

    LAST_RESORT counts after all others. Then the match counts that has most of a template: the template's squared length times
    what the squared cosine is above the squared threshold. Of equal ones a whole text's counts before a header's, and that before a run's;
    then the best score, the first place and the last name.
    ``opens``: the piece begins the text.
    """
    table = written(template_weights(files.sparkSession, templates), "templates")
    weights = table.collect()  # templates' terms, a fixed number, as in the broadcasts
    unseen = F.log(F.lit(1.0 + sum(len(t) for t in templates.values()))) + 1
    piece = ["id", "text_hash", "kind", "block", "first", "length", "template"]
    tf = pieces(files, weights, threshold).select(*piece, F.explode("terms").alias("term")).groupBy(*piece, "term").agg((F.log(F.count("*")) + 1).alias("tf"))
    vectors = tf.join(F.broadcast(table.select("term", "idf").distinct()), "term", "left").join(F.broadcast(table.select("template", "term", "weight")), ["template", "term"], "left")
    w = F.col("tf") * F.coalesce("idf", unseen)
    dots = vectors.groupBy(*piece).agg((F.sum(w * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(w * w))).alias("cosine"))
    scored = dots.withColumn("score", F.round("cosine", 9)).where(F.col("score") >= threshold).join(F.broadcast(table.select("template", "licence", "size").distinct()), "template")
    opens = ((F.col("kind") > 0) | ((F.col("block") == 0) & (F.col("first") == 0))).alias("opens")
    most = F.round(F.col("size") * (F.col("score") * F.col("score") - threshold * threshold), 4)
    best = F.max_by(F.struct("licence", "score", opens), F.struct((F.col("licence") != LAST_RESORT).alias("first_choice"), most.alias("most"), "kind", "score", -F.col("block"), -F.col("first"), "licence", F.col("length")))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.licence", "b.score", "b.opens")


def directory_of(path: Column) -> Column:
    """What stands before a path's last slash; empty for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """(dir, licence, from_dir, n_files): for each directory of files(path, licence, is_licence_file) the licence of its nearest ancestor with a licence file.

    A directory is an ancestor of its own. Of several licence files in one directory the one of the smallest path counts, of one path's the first name.
    """
    declared = files.where("is_licence_file and licence is not null and path is not null").groupBy(directory_of(F.col("path")).alias("from_dir")).agg(F.min_by("licence", F.struct("path", "licence")).alias("licence"))
    dirs = files.where("path is not null").groupBy(directory_of(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"))
    up = dirs.select("dir", "n_files", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")).alias("from_dir")).distinct()
    found = up.join(declared, "from_dir").groupBy("dir", "n_files").agg(F.max_by(F.struct("licence", "from_dir"), F.struct(F.length("from_dir"), "from_dir")).alias("b"))
    return found.select("dir", "b.licence", "b.from_dir", "n_files")


def scan(files: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """files(id, path, text, is_licence_file) with own_licence, own_score, licence and inherited_from (a directory, or null).

    A file without a licence of its own takes its directory's; without that, licence is null. Where is_licence_file is null, a file is a
    licence file if its own licence opens it. Null and empty texts and null ids have no licence of their own, a null path has no ancestors.
    Rows of one id count as one file for their own licence (the best of their texts), and each is returned. Other columns are dropped.
    """
    own = written(own_licences(files, threshold, templates), "own")
    found = own.select("id", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), "opens")
    named = files.select("id", "path", "is_licence_file").join(found, "id", "left").withColumn("is_licence_file", F.coalesce("is_licence_file", "opens", F.lit(False)))
    from_dirs = written(inherited(named.select("path", F.col("own_licence").alias("licence"), "is_licence_file")), "dirs")
    up = from_dirs.select("dir", F.col("licence").alias("_up"), "from_dir", "n_files")
    hot = F.col("n_files") > HOT * files.count()  # so at most 1 / HOT directories are broadcast, and no other key of the join has a larger share
    much = up.where(hot).select("dir", F.struct("_up", "from_dir").alias("_much"))
    rest = up.where(~hot).select(F.col("dir").alias("_dir"), F.struct("_up", "from_dir").alias("_rest"))
    both = named.withColumn("dir", directory_of(F.col("path"))).join(F.broadcast(much), "dir", "left")
    # rows that have theirs, or have no path, are spread by what no key is
    own_key = F.when(F.col("_much").isNull() & F.col("dir").isNotNull(), F.col("dir")).otherwise(F.concat(F.lit("\0"), F.xxhash64("id", "path").cast("string")))
    both = both.join(rest, own_key == F.col("_dir"), "left").withColumn("_b", F.coalesce("_much", "_rest"))
    return both.select("id", "path", "own_licence", "own_score", F.coalesce("own_licence", "_b._up").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("_b.from_dir")).alias("inherited_from"))
