import math
import re
from collections import Counter

from paperloom.llm.licenses import LEAST_COSINE, NOTICE, TEMPLATES, scan_licenses


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "l", "t") for r in rows], "doc_id long, path string, text string, key string, line string, term string")


def terms(text):
    return Counter(re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower()))


def brute(rows):
    said = [(n, terms(x)) for n, (_, _, text) in enumerate(rows) for x in (text or "").split("\n") if re.search(NOTICE, x)]
    df = Counter(t for _, c in said for t in c)
    df.update(t for _, text in TEMPLATES for t in terms(text))
    total = len(said) + len(TEMPLATES)
    vector = lambda c: {t: n * (math.log((total + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for n, c in said:
        v = vector(c)
        for place, (name, text) in enumerate(TEMPLATES):
            w = vector(terms(text))
            score = round(sum(v[t] * w[t] for t in v if t in w) / size(v) / size(w), 6)
            if score >= LEAST_COSINE and (score, -place) > own.get(n, ((0, 0), ""))[0]:
                own[n] = ((score, -place), name)
    out = {}
    for n, (i, path, _) in enumerate(rows):
        if n in own:
            out[i] = (own[n][1], path)
            continue
        out[i] = (None, None)
        parts = (path or "").split("/")
        for depth in range(len(parts) - 1, -1, -1):
            up = "/".join(parts[:depth])
            holders = [(-own[m][0][0], p, j, own[m][1]) for m, (j, p, _) in enumerate(rows) if m in own and p and p.rpartition("/")[0] == up and re.match(r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$", p.rpartition("/")[2])]
            if holders and path is not None:
                best = min(holders)
                out[i] = (best[3], best[1])
                break
    return out


ROWS = [
    (1, "a/LICENSE", "text\nReleased under the MIT License.\nmore"),
    (2, "a/b/x.py", "nothing"),
    (3, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d/y.py", "no notice"),
    (5, "a/b/c/z.py", "# This work is licensed under the GNU General Public License, version 3."),
    (6, "q/y.py", None),
    (7, "a/b2/y.py", "the licence of this long sentence has nothing to do with any known one of the templates at all"),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, None, "none"),
    (10, "a/NOTICE.txt", "license"),
    (11, "top.txt", "Licensed under CC BY 4.0.\nReleased under the MIT License."),
    (12, "LICENSE", "All rights reserved"),
    (13, "w/deep/er/x", ""),
]


def test_matches_and_inheritance(spark):
    got = {r.doc_id: (r.license, r.origin) for r in scan_licenses(table(spark, ROWS)).collect()}
    assert got == brute(ROWS)
    assert got[2] == ("MIT", "a/LICENSE") and got[4] == ("Apache-2.0", "a/b/c/COPYING") and got[5][0] == "GPL-3.0-only" and got[9] == (None, None)


def test_repeated_rows_ties_and_empty(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (1, "a/LICENSE", mit), (2, "a/COPYING", mit), (3, "a/x", "x"), (3, "a/x", "x"), (4, "a/y", "word " * 100_000 + "\n" + mit)]
    got = sorted((r.doc_id, r.license, r.origin) for r in scan_licenses(table(spark, rows)).collect())
    assert got == [(1, "MIT", "a/LICENSE")] * 2 + [(2, "MIT", "a/COPYING")] + [(3, "MIT", "a/COPYING")] * 2 + [(4, "MIT", "a/y")]
    assert scan_licenses(table(spark, [])).count() == 0


GNU = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NEITHER = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def commented(text, mark):
    return "".join(f"{mark} {line}\n" for line in text.split("\n")) + "import os\nprint(os.name)\n" * 20


def test_standard_wordings(spark):
    rows = [
        (1, "g2/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n"),
        (2, "g2/x.c", "int main;"),
        (3, "s/g2.py", commented(GNU.format(2), "#")),
        (4, "s/g3.c", commented(GNU.format(3), " *")),
        (5, "b3/LICENSE", BSD.format(NEITHER)),
        (6, "s/b3.py", commented(BSD.format(NEITHER), "#")),
        (7, "b2/LICENSE", BSD.format("")),
        (8, "s/b2.c", commented(BSD.format(""), "//")),
        (9, "s/apache.py", commented(APACHE, "#")),
        (10, "s/mit.py", "# SPDX-License-Identifier: MIT\nimport os\n"),
        (11, "s/zlib.c", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR Zlib */\n"),
    ]
    got = {r.doc_id: r.license for r in scan_licenses(table(spark, rows)).collect()}
    assert got == {
        1: "GPL-2.0-only", 2: "GPL-2.0-only", 3: "GPL-2.0-or-later", 4: "GPL-3.0-or-later", 5: "BSD-3-Clause", 6: "BSD-3-Clause",
        7: "BSD-2-Clause", 8: "BSD-2-Clause", 9: "Apache-2.0", 10: "MIT", 11: "(GPL-2.0-only WITH Linux-syscall-note) OR Zlib",
    }


ZLIB = """Copyright (c) 2020 Somebody

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT.
"""
EPL = """/*******************************************************************************
 * Copyright (c) 2020 Somebody
 *
 * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/
 ******************************************************************************/
class X {}
"""
CC0 = """CC0 1.0 Universal

Statement of Purpose

The laws of most jurisdictions throughout the world automatically confer
exclusive Copyright and Related Rights (defined below) upon the creator and
subsequent owner(s) (each and all, an "owner") of an original work of
authorship and/or a database (each, a "Work").
"""


def test_further_licences_and_false_ones(spark):
    rows = [
        (1, "z/LICENSE", ZLIB), (2, "z/x.c", "int x;"), (3, "s/z.c", "/*\n" + "".join(f" * {x}\n" for x in ZLIB.split("\n")) + " */\nint y;\n"), (4, "u/UNLICENSE.md", UNLICENSE), (5, "u/LICENSE", UNLICENSE),
        (6, "b/LICENSE_1_0.txt", BOOST), (7, "b2/LICENSE", BOOST), (8, "e/X.java", EPL), (9, "e/LICENSE", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE\n"),
        (10, "c/LICENSE", CC0), (11, "p/a.c", "// Use of this source code is governed by a BSD-style license. All rights reserved.\n"), (12, "p/b.c", "// Copyright 2020 Somebody. All rights reserved.\n"),
        (13, "p/c.c", "// SPDX-License-Identifier: not-a-license\n"), (14, "p/d.py", "# Files start with SPDX-License-Identifier: MIT as a rule.\n\n" + commented(APACHE, "#")), (15, "p/e.html", "<!-- SPDX-License-Identifier: Apache-2.0 OR MIT -->\n"),
    ]
    got = {r.doc_id: r.license for r in scan_licenses(table(spark, rows)).collect()}
    assert got == {
        1: "Zlib", 2: "Zlib", 3: "Zlib", 4: "Unlicense", 5: "Unlicense", 6: "BSL-1.0", 7: "BSL-1.0", 8: "EPL-2.0", 9: "EPL-2.0", 10: "CC0-1.0", 11: None, 12: "Proprietary", 13: None, 14: "Apache-2.0", 15: "Apache-2.0 OR MIT",
    }
