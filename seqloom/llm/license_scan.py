"""License scan: TF-IDF cosine of passages to license templates, and inheritance by directory.

Files are cut into passages: sentences of a line, blocks (lines in a row, comment marks or not, up
to one without a letter or digit, so that a wrapped header is whole), and of license files the whole
text. Templates are statements, headers, heads of license files and whole short licenses. A
passage's terms are weighted by their frequency in it and by their inverse document frequency over
the templates; its best template is that of the highest cosine, if that is at least `threshold`. For
each template some of its longest and less common terms are anchors, so many that the share of its
other terms in its norm is below the threshold; where everyday terms alone have a larger share,
those count together that can't be missed then. By the Cauchy-Schwarz inequality a passage without
an anchor can't reach the threshold, so that only texts and passages with one are compared, and
none is missed; nor can one in whose own norm the templates' terms have too small a share. A passage's terms are counted once, in a sorted row of them.

A file without a license of its own inherits that of its nearest ancestor directory with a
license file. Directories are joined, not files, by the paths of their ancestors, and the few
distinct directories are then joined to the files.

DataFrame functions only. Nulls: a null text has no license of its own; a file with a null
path inherits nothing. Of equal scores the template with the smaller name wins, of several
license files in a directory the one with the highest score, then the smallest path. Repeated rows
each get a row, empty tables give none, and passages may have any length. Other columns are carried
along, but for those that have the names of results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.75
PASSAGE = r"[\r\n]+|(?<=[.;!?])\s+"
BLOCK = r"\n[^\p{L}\p{N}]*\n"
WORD = r"[^a-z0-9+]+"

_GNU = "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation{mark2} either version {n} of the License, or (at your option) any later version."


def _gnu(kind: str, n: str) -> str:
    """The notice by which a file names this GNU license, as the license itself words it."""
    return _GNU.format(kind=kind, n=n, mark=":" if n == "3" else ";", mark2="," if n == "3" else ";")


#: Fixed texts: statements, headers, heads and short licenses by which files say their license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("General Public", "2")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("Lesser General Public", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _gnu("Lesser General Public", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("Affero General Public", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3 Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2 Clause License."),
    ("MPL-2.0", "This source code is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0-only GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only GPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1-only LGPL-2.1-or-later"),
        ("LGPL-3.0", "LGPL-3.0-only LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only AGPL-3.0-or-later"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"),
        ("ISC", "ISC"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ) for tag in tags.split()),
)


#: Terms that nearly any text has; anchors are taken from the others first.
EVERYDAY = frozenset("a all an and any are as at be been but by can do for from has have he her his if in into is it its may met no nor not of on only or she so that the their them they this to under use was we were which who whom will with without you your".split())
#: What rounding may add to a score.
SLACK = 1e-6


def terms(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w]


class Weights:
    """IDF over the templates, their unit vectors, and the terms that no match can do without."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        bags = [Counter(terms(t)) for _, t in templates]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
        self.rare = math.log(1 + len(bags)) + 1
        self.vectors = []
        for bag in bags:
            v = {w: n * self.idf[w] for w, n in bag.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({w: x / norm for w, x in v.items()})
        needed: set[str] = set()
        together: set[frozenset[str]] = set()
        least = (threshold - SLACK) ** 2
        for v in self.vectors:  # the weightiest terms, until the others can't reach the threshold
            left = {t: x * x for t, x in v.items() if t not in needed}
            order = sorted(left, key=lambda t: (t in EVERYDAY, -v[t], t))
            while sum(left.values()) >= least:
                # without any one of these the everyday terms that are left can't reach it either
                whole = frozenset(t for t, x in left.items() if sum(left.values()) - x < least)
                if order[0] in EVERYDAY and whole:
                    together.add(whole)
                    break
                needed.add(order[0])
                del left[order.pop(0)]
        self.anchors = sorted(needed)
        self.together = sorted(sorted(x) for x in together if not any(y < x for y in together))


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _counted(words: Column) -> Column:
    """The different words as (w, n) structs: in a sorted row of all, where each one starts and ends."""

    def of(row: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(row) - 1), lambda i: (i == 0) | (F.get(row, i) != F.get(row, F.greatest(i - 1, F.lit(0)))))
        return _let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(row, i).alias("w"), (F.coalesce(F.get(at, j + 1), F.size(row)) - i).cast("double").alias("n"))))

    empty = F.array().cast("array<struct<w:string,n:double>>")
    return F.when(F.size(words) > 0, _let(F.sort_array(words), of)).otherwise(empty)


def _scored(passage: Column, w: Weights) -> Column:
    """The best (score, name order, name, passage) of a passage as a struct; null where none can reach the threshold.

    A cosine is at most the share that the templates' terms have in the passage's norm.
    """
    words = F.array_remove(F.split(F.lower(passage), WORD), "")
    vocabulary, idf = F.array(*[F.lit(x) for x in sorted(w.idf)]), _map(w.idf)
    names = sorted(set(w.names))

    def of(words: Column) -> Column:
        return _let(F.array_intersect(words, vocabulary), lambda held: _let(_counted(words), lambda terms: of_held(terms, held)))

    def of_held(terms: Column, held: Column) -> Column:
        known = F.transform(F.filter(terms, lambda t: F.array_contains(held, t["w"])), lambda t: F.struct(t["w"].alias("w"), t["n"].alias("n"), F.element_at(idf, t["w"]).alias("idf")))
        return _let(known, lambda k: of_known(terms, k))

    def of_known(terms: Column, known: Column) -> Column:
        # all terms as if none was in a template, and what those that are differ by
        rest = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["n"] * t["n"]) * (w.rare * w.rare)
        square = F.aggregate(known, rest, lambda s, t: s + t["n"] * t["n"] * (t["idf"] * t["idf"] - w.rare * w.rare))
        own = F.aggregate(known, F.lit(0.0), lambda s, t: s + t["n"] * t["n"] * (t["idf"] * t["idf"]))
        enough = lambda x: x["own"] >= x["square"] * (w.threshold - 2 * SLACK) ** 2
        return _let(F.struct(own.alias("own"), square.alias("square")), lambda x: F.when(enough(x), best(known, F.sqrt(x["square"]))))

    def best(known: Column, norm: Column) -> Column:
        found = []
        for name, v in zip(w.names, w.vectors, strict=True):
            weights = _map({x: y * w.idf[x] for x, y in v.items()})
            dot = F.aggregate(known, F.lit(0.0), lambda s, t: s + t["n"] * F.coalesce(F.element_at(weights, t["w"]), F.lit(0.0)))  # noqa: B023
            found.append(F.struct(F.round(dot / norm, 6).alias("score"), F.lit(-names.index(name)).alias("order"), F.lit(name).alias("license"), passage.alias("passage")))
        return F.array_max(F.array(*found))

    return _let(words, of)


def detected(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text[, is_license_file]) with own_license, own_score and own_passage, null where there is none."""
    w = Weights(templates, threshold)
    row = lambda terms: F.array(*[F.lit(t) for t in terms])

    def likely(words: Column) -> Column:
        found = F.arrays_overlap(words, row(w.anchors))
        for terms in w.together:
            found = found | (F.size(F.array_except(row(terms), words)) == 0)
        return found

    anchored = lambda x: _let(F.split(F.lower(x), WORD), likely)
    kind = "array<struct<score:double,order:int,license:string,passage:string>>"
    passages = F.concat(F.split("text", PASSAGE), F.split("text", BLOCK))
    if "is_license_file" in files.columns:
        passages = F.concat(passages, F.when(F.coalesce("is_license_file", F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>")))
    passages = F.filter(F.array_distinct(passages), anchored)
    best = F.when(anchored(F.col("text")), F.array_max(F.transform(passages, lambda p: _scored(p, w)))).otherwise(F.array_max(F.array().cast(kind)))
    out = files.withColumn("__sl_best", best)
    hit = F.col("__sl_best.score") >= threshold
    own = {"own_license": F.when(hit, F.col("__sl_best.license")), "own_score": F.when(hit, F.col("__sl_best.score")), "own_passage": F.when(hit, F.col("__sl_best.passage"))}
    return out.withColumns(own).drop("__sl_best")


def directory(path: Column) -> Column:
    """The path up to its last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, as (depth, name) structs, down from the top, which is the empty name."""
    parts = F.split(folder, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name")))
    top = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("name")))
    return F.when(folder == "", top).otherwise(F.concat(top, below))


def inherited(files: DataFrame) -> DataFrame:
    """files of detected(), with a boolean is_license_file, with license, basis, score and license_dir.

    basis: own, inherited or none. license_dir: the directory that a license is inherited from.
    The files are used again and again, so they are written to shared storage first.
    """
    rows = common.staged(files, "licensed").withColumn("__sl_dir", directory(F.col("path")))
    given = rows.filter("is_license_file AND own_license IS NOT NULL AND __sl_dir IS NOT NULL").groupBy(F.col("__sl_dir").alias("__sl_from"))
    given = given.agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("license"))).alias("__sl_x"))
    given = given.select("__sl_from", F.col("__sl_x.license").alias("__sl_license"), (-F.col("__sl_x.s")).alias("__sl_score"))
    folders = rows.select("__sl_dir").filter("__sl_dir IS NOT NULL").distinct().select("__sl_dir", F.explode(ancestors(F.col("__sl_dir"))).alias("__sl_a"))
    nearest = folders.join(given, F.col("__sl_a.name") == F.col("__sl_from")).groupBy("__sl_dir")
    nearest = nearest.agg(F.max(F.struct(F.col("__sl_a.depth").alias("depth"), "__sl_from", "__sl_license", "__sl_score")).alias("__sl_n"))
    out = rows.join(nearest, "__sl_dir", "left")
    own = F.col("own_license").isNotNull()
    return out.withColumns({
        "license": F.coalesce("own_license", "__sl_n.__sl_license"),
        "basis": F.when(own, "own").when(F.col("__sl_n").isNotNull(), "inherited").otherwise("none"),
        "score": F.when(own, F.col("own_score")).otherwise(F.col("__sl_n.__sl_score")),
        "license_dir": F.when(~own, F.col("__sl_n.__sl_from")),
    }).drop("__sl_dir", "__sl_n")


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text, is_license_file) with what detected() and inherited() add, without text."""
    return inherited(detected(files, templates, threshold).drop("text"))
