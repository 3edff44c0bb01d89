"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory that has one.

A file's own licence is what it states as an SPDX expression, or that of its best segment: a line,
a paragraph or a run of paragraphs that speaks of a licence, or a whole licence file. Terms are
weighed by the templates' document frequencies, so a score does not depend on the other files. The terms of the
templates are a table of fixed size, so it is broadcast; texts are cut and counted where they lie,
and directories meet files by joins on paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Short licences as a whole, and the headers and opening words of long ones, as their publishers word them.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_ONLY = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} version {2} as published by the Free Software Foundation."
_GNU = [("GPL-2.0", "program", "General Public License", "2", "Version 2, June 1991"), ("GPL-3.0", "program", "General Public License", "3", "Version 3, 29 June 2007"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1", "Version 2.1, February 1999"), ("LGPL-3.0", "library", "Lesser General Public License", "3", "Version 3, 29 June 2007"), ("AGPL-3.0", "program", "Affero General Public License", "3", "Version 3, 19 November 2007")]
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", _MIT),
    ("MIT", " ".join(["MIT License", _MIT, _MIT_KEEP, _AS_IS])),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("ISC", " ".join(["ISC License", _ISC, _ISC_AS_IS])),
    ("0BSD", _0BSD),
    ("0BSD", " ".join(["BSD Zero Clause License", _0BSD, _ISC_AS_IS])),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    *((name, template.format(work, title, version)) for name, work, title, version, _ in _GNU for template in (_FREE, f"{_FREE} {_HOPE}", _ONLY)),
    *((name, f"GNU {title.upper()} {dated} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.") for name, _, title, _, dated in _GNU),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", " ".join(["BSD 2-Clause License", _BSD, _BSD_2, _BSD_AS_IS])),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", " ".join(["BSD 3-Clause License", _BSD, _BSD_2, _BSD_3, _BSD_AS_IS])),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]
#: Least cosine of a match.
LEAST = 0.6
#: A line is looked at if it has one of these; a fixed list.
CUES = r"(?i)licen[sc]|copyright|redistribut|permission (?:is|to use)|public domain|all rights reserved|mozilla public|creative commons|free software|cc0|as.is"
#: What starts a line of a comment, and ends it.
MARK = r"^[ \t]*(?://+!?|#+!?|/\*+!?|\*+|--+|;+|%+|<!--+|dnl\b|REM\b|\.\.)?[ \t]*|[ \t]*(?:\*+/|--+>|\*+)?[ \t]*$"
#: A licence expression of SPDX: identifiers, joined by and, or and with.
SPDX = r"SPDX-License-Identifier:\s*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:\s+(?:AND|OR|WITH|and|or|with)\s+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]es?|copying|unlicense|notice)([.-][a-z0-9]+)?$"


def terms(text: Column) -> Column:
    """Lower-case words and version numbers."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])"), lambda w: w != "")


def template_terms(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(template, licence, term, weight, norm)`` of the templates."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, text string")
    tf = rows.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + len(templates)) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    weighed = tf.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norm, "template").select("template", "licence", "term", "idf", "weight", "norm")


def segments(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to ``(path, segment)``: what speaks of a licence.

    Comment marks are taken off each line. Segments are the lines with a cue, the paragraphs with
    one, which put wrapped headers together, runs of paragraphs as far as comment or text lasts
    (up to two empty lines), and whole texts of licence files.
    """
    bare = F.transform(F.split("text", r"\r\n|\r|\n"), lambda line: F.regexp_replace(line, MARK, ""))
    body = F.array_join(F.transform(bare, lambda line: F.regexp_replace(line, r"\s+", " ")), "\n")
    files = files.where("path is not null and text is not null").where(F.col("text").rlike(CUES)).select("path", body.alias("body"))
    cue = lambda parts: F.filter(parts, lambda part: part.rlike(CUES))
    flat = lambda parts: F.transform(parts, lambda part: F.trim(F.replace(part, F.lit("\n"), F.lit(" "))))
    lines, paragraphs, blocks = (cue(F.split("body", cut)) for cut in (r"\n", r"\n\s*\n", r"\n\s*\n\s*\n"))
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array("body")).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.explode(F.array_distinct(flat(F.concat(lines, paragraphs, blocks, whole)))).alias("segment"))


def stated(files: DataFrame) -> DataFrame:
    """``files(path, text)`` to ``(path, licence)``: the first SPDX expression of each text."""
    found = F.regexp_extract("text", SPDX, 1)
    found = F.regexp_replace(F.regexp_replace(found, r"\s+", " "), r"(?i) (and|or|with) ", " $1 ")
    for word in ("AND", "OR", "WITH"):
        found = F.regexp_replace(found, f"(?i) {word} ", f" {word} ")
    return files.where("path is not null").select("path", found.alias("licence")).where("licence <> ''")


def own_licences(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """``files(path, text)`` to ``(path, licence, score)`` of the files that state a licence or whose best segment is near a template.

    An SPDX expression counts before all templates, with score 1. Equal scores go to the licence
    first by name.
    """
    spark = files.sparkSession
    known = template_terms(spark, templates)
    # Dealt once by path: the steps below keep to it, so that terms and products stay where the segments are.
    cut = segments(files).repartition("path").dropDuplicates(["path", "segment"]).select("path", "segment", F.xxhash64("segment").alias("s"))
    counted = cut.select("path", "s", F.explode(terms(F.col("segment"))).alias("term")).groupBy("path", "s", "term").agg(F.count("*").alias("tf"))
    # Terms that no template has weigh in the segment's length as the rarest.
    rare = float(spark.range(1).select(F.log(F.lit(1.0 + len(templates)) / 2.0) + 1.0).first()[0])
    idf = F.broadcast(known.select("term", "idf").distinct())
    weighed = counted.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    weighed = weighed.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("path", "s"))))
    dots = weighed.join(F.broadcast(known.select("template", "licence", "term", "weight", "norm")), "term").groupBy("path", "s", "length", "template", "licence", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / (F.col("length") * F.col("norm")), 9)).where(F.col("score") >= least)
    every = scored.select("path", F.lit(1).alias("turn"), "licence", "score").unionByName(stated(files).select("path", F.lit(0).alias("turn"), "licence", F.lit(1.0).alias("score")))
    best = every.groupBy("path").agg(F.min(F.struct("turn", (-F.col("score")).alias("minus"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end; empty for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the top included, as ``(directory, depth)``."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory"), n.alias("depth")))


def scan(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """``files(path, text)`` to ``(path, licence, score, origin, from_directory)``, one row a distinct path.

    ``origin`` is ``own`` for a licence in the file, ``inherited`` for that of the nearest
    directory above with a licence file, else ``none`` with a null licence. Of several licence
    files in a directory the best score counts, then the first name. Paths are compared without
    slashes at their ends or doubled ones.

    A null path takes no part; a null or empty text has no licence of its own; rows that repeat a
    path are one file with all their texts. An empty table gives an empty result.
    """
    files = files.select(F.regexp_replace(F.regexp_replace(F.col("path").cast("string"), "/+", "/"), "^/|/$", "").alias("path"), F.col("text").cast("string").alias("text"))
    own = own_licences(files, least, templates)
    licensed = own.where(F.col("path").rlike(LICENCE_FILE)).withColumn("directory", parent(F.col("path")))
    by_directory = licensed.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")).select("directory", F.col("b.licence").alias("dir_licence"), (-F.col("b.minus")).alias("dir_score"))
    paths = files.where("path is not null").select("path").distinct().withColumn("in_directory", parent(F.col("path")))
    # Each directory once: the files of one large directory do not multiply.
    above = paths.select("in_directory").distinct().withColumn("up", F.explode(ancestors(F.col("in_directory")))).select("in_directory", F.col("up.directory").alias("directory"), F.col("up.depth").alias("depth"))
    nearest = above.join(by_directory, "directory").groupBy("in_directory").agg(F.max(F.struct("depth", "directory", "dir_licence", "dir_score")).alias("n")).select("in_directory", "n.directory", "n.dir_licence", "n.dir_score")
    out = paths.join(own, "path", "left").join(nearest, "in_directory", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("licence", "dir_licence").alias("licence"), F.coalesce("score", "dir_score").alias("score"), origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("directory")).alias("from_directory"))
