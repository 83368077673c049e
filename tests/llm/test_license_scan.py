import math
import re
import textwrap
import time
from collections import Counter

import regex
from oracle import same

from seqloom.llm import license_scan as ls
from seqloom.llm.queries import ORACLE_SQL, QUERIES


def brute_best(text, threshold=ls.THRESHOLD, whole=False):
    """(license, score, passage) by comparing every passage with every template."""
    bags = [Counter(ls.terms(t)) for _, t in ls.TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1
    vec = lambda c: {w: n * idf(w) for w, n in c.items()}
    best = None
    for passage in [*re.split(ls.PASSAGE, text or ""), *regex.split(ls.BLOCK, text or ""), *([text or ""] if whole else [])]:
        v = vec(Counter(ls.terms(passage)))
        norm = math.sqrt(sum(x * x for x in v.values()))
        if not norm:
            continue
        for (name, _), bag in zip(ls.TEMPLATES, bags, strict=True):
            t = vec(bag)
            score = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm / math.sqrt(sum(x * x for x in t.values())), 6)
            if score >= threshold:
                order = -sorted({n for n, _ in ls.TEMPLATES}).index(name)
                best = max(best or (0,), (score, order, name, passage))
    return best and (best[2], best[0], best[3])


def brute_inherit(files):
    """files: path -> (own or None, is_license_file)."""
    out = {}
    for path, (own, _) in files.items():
        if own:
            out[path] = (own[0], "own", own[1], None)
            continue
        out[path] = (None, "none", None, None)
        folder = path.rsplit("/", 1)[0] if path and "/" in path else ""
        while path is not None:
            here = sorted((-o[1], p, o[0]) for p, (o, lic) in files.items() if p is not None and lic and o and (p.rsplit("/", 1)[0] if "/" in p else "") == folder)
            if here:
                out[path] = (here[0][2], "inherited", -here[0][0], folder)
                break
            if not folder:
                break
            folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
    return out


def test_files(spark):
    rows = [
        ("LICENSE", "Licensed under CC BY 4.0.", True),
        ("a/LICENSE", "Some words.\nReleased under the MIT License.", True),
        ("a/COPYING", "Released under the ISC License.", True),
        ("a/b/c/x.py", "nothing here", False),
        ("a/b/c/y.py", "# This work is licensed under the GNU General Public License, version 3. More text", False),
        ("a/b/d/LICENSE", "no known words at all", True),
        ("a/b/d/z", None, False),
        ("ab/q", "", False),
        ("ab/r", "the license of the file under version", False),
        ("top", "all of this is reserved", False),
        ("a/b/e/LICENSE", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", True),
        ("a/b/e/f/long", "word " * 60000, False),
        ("src/İ/LICENSE", "Licensed under CC BY-NC 4.0.", False),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "path string, text string, is_license_file boolean, license string").drop("license")
    got = {r["path"]: (r["license"], r["basis"], r["score"], r["license_dir"]) for r in ls.scan(table).collect()}
    own = {p: (brute_best(t, whole=lic), lic) for p, t, lic in rows}
    want = brute_inherit(own)
    assert {k: (v[0], v[1], v[2] and round(v[2], 5), v[3]) for k, v in got.items()} == {k: (v[0], v[1], v[2] and round(v[2], 5), v[3]) for k, v in want.items()}
    assert got["a/b/c/x.py"][:2] == ("MIT", "inherited") or got["a/b/c/x.py"][:2] == ("ISC", "inherited")
    assert got["ab/q"][0] == "CC-BY-4.0" and got["a/b/e/f/long"][3] == "a/b/e"


def test_null_path_repeats_and_empty(spark):
    kind = "path string, text string, is_license_file boolean"
    table = spark.createDataFrame([(None, None, None), (None, "Released under the MIT License.", True), ("x", "", None), ("x", "", None)], kind)
    got = sorted(((r["path"], r["license"], r["basis"]) for r in ls.scan(table).collect()), key=str)
    assert got == sorted([(None, None, "none"), (None, "MIT", "own"), ("x", None, "none"), ("x", None, "none")], key=str)
    assert ls.scan(spark.createDataFrame([], kind)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    files = {}
    for r in docs:
        best = brute_best(r["text"])
        i = r["doc_id"]
        lic = bool(best) and r["text"].rstrip(" ").endswith(best[2].rstrip(" "))
        files[f"{r['source']}/{i // 256}/{i}" if lic else f"{r['source']}/{i // 256}/{i // 16}/{i}"] = (best, lic)
    want = brute_inherit(files)
    got = {r["path"]: (r["license"], r["basis"], r["score"], r["license_dir"]) for r in QUERIES["op2_licenses"](spark, d).collect()}
    near = lambda v: (v[0], v[1], v[2] and round(v[2], 4), v[3])
    assert {k: near(v) for k, v in got.items()} == {k: near(v) for k, v in want.items()}
    assert sum(v[1] == "own" for v in got.values()) > 10 and sum(v[1] == "inherited" for v in got.values()) > 5


def test_query_equals_sql(spark):
    same(spark, QUERIES["op2_licenses"], ORACLE_SQL["op2_licenses"], "/root/testdata/sf0.01")


def commented(text, width, mark):
    return "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, width))


def test_headers_and_license_files_are_recognised(spark):
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    warranty = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    cases = {
        "BSD-3-Clause": "/*\n * Copyright (c) 2019 A. Person\n *\n" + commented(bsd, 60, " *") + "\n *\n * 1. Redistributions must keep this.\n */\nint main() {}",
        "GPL-3.0": commented(gpl.format(":", "General Public License", ",", 3), 70, "#") + "\n#\n" + commented(warranty, 70, "#") + "\nimport os",
        "GPL-2.0": commented(gpl.format(";", "General Public License", ";", 2), 50, "//") + "\n//\n" + commented(warranty, 50, "//"),
        "LGPL-2.1": commented(gpl.format(";", "Lesser General Public License", ";", "2.1").replace("program", "library"), 60, ";;"),
        "AGPL-3.0": commented(gpl.format(":", "Affero General Public License", ",", 3), 80, " *"),
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
        "MIT": "MIT License\n\nCopyright (c) 2021 B. Person\n\n" + "\n".join(textwrap.wrap(dict(ls.TEMPLATES[3:4])["MIT"], 78)) + "\n\nThe above copyright notice shall be included.",
        "ISC": commented("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 72, " *"),
        "MPL-2.0": commented("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", 66, " *"),
    }
    more = {
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation",
        "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;",
        "Apache-2.0": commented("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", 60, "#"),
        "MIT": "# SPDX-License-Identifier: MIT",
    }
    rows = [(f"{i}", t, False, name) for i, (name, t) in enumerate([*cases.items(), *more.items()])]
    rows += [("prose", "The license of the software may be granted to any person, and a copy of the files is free.", False, None), ("eupl", "SPDX-License-Identifier: EUPL-1.2", False, None)]
    table = spark.createDataFrame([r[:3] for r in rows], "path string, text string, is_license_file boolean")
    got = {r["path"]: (r["own_license"], r["own_score"]) for r in ls.detected(table).collect()}
    assert {p: got[p][0] for p, *_ in rows} == {p: name for p, _, _, name in rows}
    for p, t, lic, _ in rows:
        want = brute_best(t, whole=lic)
        assert got[p] == (want and want[0], want and round(want[1], 6)) or abs(got[p][1] - want[1]) < 2e-6


def test_long_passages_take_little_time(spark):
    text = " ".join(f"w{i % 15000}" for i in range(40_000)) + " sublicense license mozilla redistribution"
    began = time.time()
    found = ls.detected(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert found[0]["own_license"] is None and time.time() - began < 20
