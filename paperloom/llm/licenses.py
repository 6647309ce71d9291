"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance along paths.

Lines of a file that speak of a licence are its notices; so are the paragraphs and header
blocks around such a line, as wrapped headers need, and the whole text of a licence file. A
notice is a sparse vector of
the templates' terms, weighted by how rare a term is among the notices of all files and by
the notice's own length; its cosine to each template decides. A file without a licence of
its own takes the one of the nearest directory above it that holds a licence file: paths
are joined with the directories on their way up. DataFrame expressions throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

# Notices as they are commonly written, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
_GNU = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{1} either version {3} of the License, or (at your option) any later version."
_GNU_ONLY = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} {2} as published by the Free Software Foundation."
_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
    "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
    "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
    "derivative works are solely in the form of machine-executable object code generated by a source language processor."
)
_BOOST_REST = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE '
    "AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
    "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
    "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
_CC0 = (
    "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and "
    'subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work"). Certain owners wish to permanently relinquish those rights to a Work for '
    'the purpose of contributing to a commons of creative, cultural and scientific works ("Commons") that the public can reliably and without fear of later claims of infringement build upon, '
    "modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes."
)
# Standard source headers, headings of the long licence files and the short full texts.
STANDARD = (
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0-only", _GNU_ONLY.format("This program", "General Public License", "version 2")),
    ("GPL-3.0-only", _GNU_ONLY.format("This program", "General Public License", "version 3")),
    ("GPL-2.0-or-later", _GNU.format("This program", ";", "General Public License", "2")),
    ("GPL-3.0-or-later", _GNU.format("This program", ":", "General Public License", "3")),
    ("LGPL-2.1-or-later", _GNU.format("This library", ";", "Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _GNU.format("This library", ":", "Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", _GNU.format("This program", ":", "Affero General Public License", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("BSD-3-Clause", _BSD + "3. " + _NEITHER + " " + _WARRANTY),
    ("BSD-3-Clause", _NEITHER),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST + _BOOST_REST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", _CC0),
    ("CC0-1.0", "CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", 'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.'),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
# A line or paragraph with none of these is no notice; a licence file is compared as a whole in any case.
NOTICE = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|permission is (?:hereby )?granted|redistribut|public domain|as-is|free of charge|cc0|this software is provided"
# The expression of an SPDX line, one level of brackets deep. The line has it alone, but for marks of a comment.
SPDX = r"(?im)^[ \t]*(?:(?:#|//|/\*+|\*|--|;|%|<!--|\(\*|\.\.|\"|')+[ \t]*)?SPDX-License-Identifier:[ \t]*((?-i)\(?[A-Za-z0-9.+-]*[A-Za-z0-9+]\)?(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(?[A-Za-z0-9.+-]*[A-Za-z0-9+]\)?){0,20})[ \t]*(?:\*+/|-->|\*\))?[ \t\r]*$"
# Identifiers and exceptions that SPDX lines may name, besides those of the templates.
SPDX_IDS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Artistic-1.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-4-Clause", "bzip2-1.0.6", "CC-BY-3.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "Classpath-exception-2.0", "CPL-1.0", "curl", "ECL-2.0", "EPL-1.0", "EUPL-1.1", "EUPL-1.2", "FSFAP", "FTL",
    "GCC-exception-3.1", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+", "HPND", "ICU", "IJG", "JSON", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1", "LGPL-2.1+", "LGPL-3.0", "LGPL-3.0+", "Libpng", "Linux-syscall-note", "LLVM-exception", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "OFL-1.1",
    "OpenSSL", "OSL-3.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "SSPL-1.0", "TCL", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1",
)
# A notice with one of these speaks of a licence, so it doesn't just reserve all rights.
LICENSED = ("license", "licence", "licensed", "licenses", "licences", "bsd", "mit", "gpl", "lgpl", "agpl", "gnu", "apache", "mozilla", "mpl", "boost", "zlib", "isc", "eclipse", "creative", "cc", "cc0", "unlicense", "permission", "redistribution")
# Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"
LEAST_COSINE = 0.6
#: The template that is no licence.
RESERVED = "Proprietary"
_TERM = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def template_terms(spark: SparkSession) -> DataFrame:
    """(template, license, term, tf): a few rows per template."""
    rows = []
    for n, (name, text) in enumerate((*TEMPLATES, *STANDARD)):
        words = _terms(text)
        rows += [(n, name, term, float(words.count(term))) for term in sorted(set(words))]
    return spark.createDataFrame(rows, "template int, license string, term string, tf double")


def notices(files: DataFrame) -> DataFrame:
    """(key, line, term, tf) of the notices of (key, text, whole); all terms, template or not.

    ``line`` counts lines from 0; paragraphs and header blocks, which end where comment
    lines do, count downwards from -2, and -1 is the text of a licence file (``whole``).
    """
    some = files.filter(F.col("whole") | F.rlike("text", F.lit(NOTICE)))
    # Lines without a letter or digit end a paragraph; so does the last comment line before other text.
    blocks = F.split(F.regexp_replace("text", r"(?m)^([ \t]*(?:#|//|/\*|\*|--|;|%)[^\n]*)\n(?=[ \t]*[^\s#/*;%-])", "$1\n\u0000"), "\u0000", -1)
    broken = F.transform("blocks", lambda b: F.split(F.regexp_replace(b, r"(?m)^[^\p{L}\p{N}\n]*+$", ""), "\n{2,}", -1))
    apart = some.select("key", "text", "whole", blocks.alias("blocks")).select("key", "text", "whole", F.array_distinct(F.concat("blocks", F.flatten(broken))).alias("wide"))
    # One line alone is there as a line.
    wide = F.filter("wide", lambda b: F.contains(F.trim(b, F.lit("\n")), F.lit("\n")))
    units = F.concat(
        F.transform(F.split("text", "\n", -1), lambda x, n: F.struct(n.alias("line"), x.alias("said"))),
        F.transform(wide, lambda x, n: F.struct((-n - 2).alias("line"), x.alias("said"))),
        F.when(F.col("whole"), F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("said")))).otherwise(F.expr("CAST(array() AS array<struct<line:int,said:string>>)")),
    )
    lines = apart.select("key", F.explode(units).alias("u")).select("key", "u.line", "u.said").filter((F.col("line") == -1) | F.rlike("said", F.lit(NOTICE)))
    words = lines.select("key", "line", F.explode(F.regexp_extract_all(F.lower("said"), F.lit(_TERM), F.lit(0))).alias("term"))
    return words.groupBy("key", "line", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def own_licenses(files: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(key, license, cosine): the best match of the notices of (key, text, whole); ties go to the earlier template.

    An SPDX line of its own, all of whose identifiers are known, names its licence: its
    expression counts as it is, with a cosine of 1 (of several the greatest by letters). A notice's vector has all its terms, so words that no template has only lengthen it.
    """
    found = stored(notices(files), "notices")
    wanted = template_terms(files.sparkSession)
    # Rarity over the notices of all files, each template being one more, so no term is without.
    n_notices = found.select("key", "line").distinct().count() + len(TEMPLATES) + len(STANDARD)
    held = found.select("term").unionByName(wanted.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stored(held.select("term", (F.log((F.lit(n_notices) + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")

    aims = wanted.join(idf, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("aim"))
    norms = aims.groupBy("template").agg(F.sqrt(F.sum(F.col("aim") * F.col("aim"))).alias("template_norm"))
    aims = aims.join(norms, "template")
    weighted = found.join(idf, "term").select("key", "line", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    lengths = weighted.groupBy("key", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.bool_or(F.col("term").isin(*LICENSED)).alias("licensed"))
    dots = (
        weighted.join(F.broadcast(aims), "term")  # bounded: a row per term of the templates
        .groupBy("key", "line", "template", "license", "template_norm")
        .agg(F.sum(F.col("weight") * F.col("aim")).alias("dot"))
    )
    # All rights are reserved only where no licence is spoken of.
    scored = dots.join(lengths, ["key", "line"]).filter((F.col("license") != RESERVED) | ~F.col("licensed")).select(
        "key", "license", "template", F.round(F.col("dot") / F.col("norm") / F.col("template_norm"), 6).alias("cosine")
    )
    scored = scored.filter(F.col("cosine") >= least_cosine).select("key", "license", "template", "cosine")
    said = files.select("key", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("license"))
    named = F.filter(F.split("license", r"[ \t()]+"), lambda x: (x != "") & ~x.isin("OR", "AND", "WITH"))
    known = {name for name, _ in (*TEMPLATES, *STANDARD)} | set(SPDX_IDS)
    spdx = said.filter(F.forall(named, lambda x: x.isin(*sorted(known)))).select("key", "license", F.lit(-1).alias("template"), F.lit(1.0).alias("cosine"))
    best = scored.unionByName(spdx).groupBy("key").agg(F.max(F.struct("cosine", (-F.col("template")).alias("order"), "license")).alias("best"))
    return best.select("key", "best.license", "best.cosine")


def scan_licenses(files: DataFrame, id_column: str = "doc_id", least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(id, path, license, cosine, origin): the licence of each of (id, path, text).

    ``origin`` is the file's own path, or that of the licence file it inherits from: the
    nearest directory upwards that holds a licence file with a licence (of several the
    best match, ties by path and id). Without any, license, cosine and origin are null.
    Null texts are empty, null paths inherit nothing, repeated rows are kept as they are;
    an empty table gives no rows; other columns are not read.
    """
    slim = files.select(F.col(id_column).alias("id"), "path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = slim.select("id", "path", "text", F.xxhash64("id", "path", "text").alias("key"))
    own = stored(own_licenses(keyed.select("key", "text", F.coalesce(F.rlike(F.element_at(F.split("path", "/", -1), -1), F.lit(LICENSE_FILE)), F.lit(False)).alias("whole")).filter(F.col("whole") | F.rlike("text", F.lit(NOTICE))).dropDuplicates(["key"]), least_cosine), "own")
    known = stored(keyed.select("id", "path", "key").join(own, "key", "left").drop("key"), "known")

    parts = F.split("path", "/", -1)
    upwards = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    named = known.withColumn("parts", parts)
    holders = named.filter(F.rlike(F.element_at("parts", -1), F.lit(LICENSE_FILE)) & F.col("license").isNotNull())
    holders = holders.withColumn("directory", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/"))
    directories = holders.groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("order"), "path", "id", "license")).alias("held")
    ).select("directory", F.col("held.license").alias("license"), (-F.col("held.order")).alias("cosine"), F.col("held.path").alias("origin"))

    bare = named.filter("license IS NULL AND path IS NOT NULL").select("path", "parts").distinct()
    steps = bare.select("path", F.posexplode(upwards).alias("depth", "directory"))
    nearest = steps.join(broadcast_if_small(stored(directories, "directories")), "directory").groupBy("path").agg(
        F.max_by(F.struct("license", "cosine", "origin"), "depth").alias("up")
    )
    joined = known.filter("license IS NULL").join(nearest, "path", "left").select("id", "path", "up.license", "up.cosine", "up.origin")
    mine = known.filter("license IS NOT NULL").select("id", "path", "license", "cosine", F.col("path").alias("origin"))
    return mine.unionByName(joined).withColumnRenamed("id", id_column)
