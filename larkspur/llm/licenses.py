"""Licence scans: sparse TF-IDF cosine of licence headers and licence files to templates, then inheritance by directory.

Units are the lines of a file that could name a licence (``HINT``) and, of files with a licence file's name, the whole text and every two
paragraphs that follow each other (a title with its version, say). Units are
counted by their words first, so a notice that half the corpus carries is scored once. A term's weight is its count times
``ln((1 + N) / (1 + df)) + 1`` with N and df over all units of all files and the templates. A template counts only for units that have one of its
licence's decisive words (a version, say) and none of a neighbour's (``DECISIVE``), since those few words tell apart texts that are otherwise alike.
The version of a GNU licence counts only where it is bound to a name (``BOUND``); numbers of sections are none.
A unit with an SPDX line has the licences of the identifiers of its expression that are among ``SPDX``, with cosine 1, and no other ones.
A line that offers several licences ("MIT or Apache License, Version 2.0", "GPL version 2 or version 3") is also scored clause by clause; it has
all their licences, if clauses that name a licence (``NAMED``) show two or more. Clauses don't count in N and df.
A file's own licence is that of its best unit with a cosine of ``MIN_COSINE`` or more; ties go to the first name. ``licenses`` has that one and all
of its SPDX expressions and of its lines that offer several. A file without one inherits both from the licence file in the nearest ancestor
directory (its own directory first; in one directory the best cosine, then the first path). Everything is DataFrame functions.

Null and empty texts have no units. A null path is in no directory: such a row inherits nothing, leaves nothing to others and shares only with equal texts.
Repeated rows keep their own rows and count as often in df; rows of one path share what any of them shows. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

MIN_COSINE = 0.6
HINT = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|public domain|creative commons|\b[al]?gpl"
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e(?:[.-].*)?$|^copying(?:[.-].*)?$|^notice(?:\.txt|\.md)?$"
TOKEN = r"[^\p{L}\p{N}.+-]+"
#: A section's number at the start of a line, which is no version.
SECTION = r"(?m)^[ \t]*[0-9]+(?:\.[0-9]+)*[.)][ \t]"
#: In a unit's words, a version that a name stands before.
BOUND = r"(?:^| )(?:version|v|license|gpl|lgpl|agpl) ([0-9]+(?:\.[0-9]+)?)(?= |$)"
#: In a unit's words, a licence's name.
NAMED = r"(?:^| )(?:apache|mit|gnu|[al]?gpl|bsd|cc(?:0|-by[a-z-]*)?|creative|isc|mozilla|mpl|unlicense|unencumbered|general public)(?:v?-?[0-9.]+)?(?:-clause)?(?: |$)"
#: What stands between a line's clauses: a comma (unless a version follows), a slash before a capital.
_COMMA, _SLASH = r",\s+(?!(?i:version|v)\b|v?[0-9])", r"(?<=[A-Za-z0-9])[ \t]*/[ \t]*(?=[A-Z])"
#: Two versions of one name, in a line's words.
_VERSIONS = r"(general public license|[al]?gpl) (?:version |v)?([0-9]+(?:\.[0-9]+)?) (?:or|and) (?:the )?(?:version |v)?([0-9]+(?:\.[0-9]+)?)(?= |$)"

# Texts and notices by which files name these licences.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages however caused and on any theory of liability, whether in contract, strict liability, or tort arising in any way out of the use of this software, even if advised of the possibility of such damage."
_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {name} for more details."
_GNU_HEAD = "GNU {name} Version {v}, {when} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_LINES = ("This work is licensed under the GNU {name}, version {v}.", "Licensed under the GNU {name} v{v}.", "under the terms of the GNU {name} as published by the Free Software Foundation, version {v}.", "the terms of the GNU {name} version {v}", "You should have received a copy of the GNU {name} along with this {what}; version {v}.")
_GNU_SHORT = ("{short} version {v}", "Licensed under the GNU {short} v{v}.", "GNU {name} v{v}")
_CC = ("Licensed under CC {short} 4.0.", "This work is licensed under a Creative Commons {long} 4.0 International License.", "Creative Commons {long} 4.0 International Public License. By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {long} 4.0 International Public License.")


def _gnu(name: str, v: str, when: str, what: str = "program") -> tuple[str, ...]:
    short = {"A": "AGPL", "L": "LGPL", "G": "GPL"}[name[0]]
    return tuple(x.format(name=name, short=short, v=v, when=when, what=what) for x in (_GNU, _GNU_HEAD, *_GNU_LINES, *_GNU_SHORT))


def _cc(short: str, long: str) -> tuple[str, ...]:
    return tuple(x.format(short=short, long=long) for x in _CC)


TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3", "19 November 2007"),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "The Apache Software License, Version 1.1. Copyright (c) The Apache Software Foundation. All rights reserved. " + _BSD + " The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation."),
    "Apache-2.0": ("Apache License, Version 2.0", "Licensed under Apache 2.0.", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "BSD-2-Clause": (_BSD + _BSD_END, "Released under the 2-Clause BSD License.", "Licensed under the Simplified BSD License."),
    "BSD-3-Clause": (_BSD + _BSD_NAME + _BSD_END, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the 3-Clause BSD License.", "Licensed under the New BSD License."),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("CC0 1.0 Universal. Creative Commons Legal Code.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal public domain dedication.", "Dedicated to the public domain under CC0 1.0."),
    "GPL-2.0": _gnu("General Public License", "2", "June 1991"),
    "GPL-3.0": (*_gnu("General Public License", "3", "29 June 2007"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "2.1", "February 1999", "library"), "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "3", "29 June 2007", "library"), "This library is licensed under the GNU Lesser General Public License, version 3."),
    "MIT": ("MIT License", "Licensed under MIT.", "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released into the public domain under the Unlicense.", "This is free and unencumbered software released into the public domain."),
}

# By licence, words of which a unit must have one of each group, and words that it must not have.
# "=2" is a version 2 that is bound to a name.
_TWO, _THREE = "=2 =2.0 v2 v2.0 gplv2 gpl-2.0".split(), "=3 =3.0 v3 v3.0 gplv3 lgplv3 agplv3 gpl-3.0 lgpl-3.0 agpl-3.0".split()
_FOUR = ["4.0"]
DECISIVE: dict[str, tuple[list[list[str]], list[str]]] = {
    "AGPL-3.0": ([_THREE, ["affero", "agpl", "agplv3"]], []),
    "Apache-1.1": ([["1.1"]], ["2.0"]),
    "Apache-2.0": ([["2.0", "license-2.0", "2"]], ["1.1"]),
    "BSD-2-Clause": ([["2-clause", "simplified", "redistributions", "freebsd"]], ["neither", "3-clause", "apache"]),
    "BSD-3-Clause": ([["3-clause", "neither", "new", "bsd-style", "revised"]], ["2-clause", "apache"]),
    "CC-BY-4.0": ([_FOUR], "noncommercial attribution-noncommercial sharealike attribution-sharealike noderivatives attribution-noderivatives by-nc by-sa by-nd by-nc-sa by-nc-nd attribution-noncommercial-sharealike attribution-noncommercial-noderivatives".split()),
    "CC-BY-NC-4.0": ([_FOUR, ["by-nc", "noncommercial", "attribution-noncommercial"]], "sharealike noderivatives by-nc-sa by-nc-nd attribution-noncommercial-sharealike attribution-noncommercial-noderivatives".split()),
    "CC-BY-SA-4.0": ([_FOUR, ["by-sa", "sharealike", "attribution-sharealike"]], ["noncommercial", "by-nc-sa"]),
    "CC0-1.0": ([["cc0"]], []),
    "GPL-2.0": ([_TWO], [*_THREE, "affero", "lesser", "library", "lgpl", "agpl"]),
    "GPL-3.0": ([_THREE], [*_TWO, "affero", "lesser", "lgpl", "agpl"]),
    "ISC": ([["isc", "fee"]], []),
    "LGPL-2.1": ([["=2.1", "v2.1", "lgplv2.1", "lgpl-2.1"]], ["affero"]),
    "LGPL-3.0": ([_THREE, ["lesser", "lgpl", "lgplv3"]], ["2.1", "affero"]),
    "MIT": ([["mit", "charge"]], []),
    "MPL-2.0": ([["2.0", "2"], ["mozilla", "mpl"]], ["1.1"]),
    "Unlicense": ([["unlicense", "unencumbered"]], []),
}
# An identifier is a template of its licence, and a decisive word.
TEMPLATES = {k: (*texts, k) for k, texts in TEMPLATES.items()}
DECISIVE = {k: ([[*g, k.lower()] for g in groups], never) for k, (groups, never) in DECISIVE.items()}
#: Identifiers taken from an SPDX line as they stand, besides the names above; "-only", "-or-later" and "+" are left out.
SPDX = sorted({*TEMPLATES, "0BSD", "Apache-1.0", "Artistic-2.0", "BSL-1.0", "CC-BY-3.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0", "LGPL-2.0", "MPL-1.1", "MS-PL", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "Zlib"})
SPDX_LINE = r"(?i)SPDX-License-Identifier:\s*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"


def _tokens(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), TOKEN), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", ""))
    return F.filter(words, lambda w: w != "")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _clauses(line: Column) -> Column:
    """The words of the different clauses of a line that name licences, if there are two or more."""
    words = F.array_join(_tokens(F.regexp_replace(F.regexp_replace(line, _SLASH, " or "), _COMMA, " or ")), " ")
    named = F.filter(F.array_distinct(F.split(F.regexp_replace(words, _VERSIONS, "$1 version $2 or $1 version $3"), " (?:(?:or|and) )+")), lambda c: c.rlike(NAMED))
    return F.when(F.size(named) > 1, named).otherwise(F.array())


def units(files: DataFrame) -> DataFrame:
    """(path, words, spdx, line) of every unit and clause.

    words is its normalised text, spdx the known identifiers that it states (an array, null if none), line the words that a clause stands in, null for a unit.
    """
    rows = files.where(F.col("text").rlike(HINT)).withColumn("text", F.regexp_replace("text", SECTION, ""))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HINT))
    blocks = F.split("text", r"\n[ \t\r]*\n")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(1))), lambda i: F.array_join(F.slice(blocks, i, 2), " "))
    unit = lambda x: F.struct(x.alias("unit"), F.lit(False).alias("one_line"))
    of_lines = F.transform(lines, lambda x: F.struct(x.alias("unit"), F.lit(True).alias("one_line")))
    parts = rows.select("path", F.explode(F.when(name.rlike(LICENCE_FILE), F.concat(F.array(unit(F.col("text"))), F.transform(pairs, unit), of_lines)).otherwise(of_lines)).alias("u")).select("path", "u.*")
    known = F.create_map(*[F.lit(x) for k in SPDX for x in (k.lower(), k)])
    stated = F.split(F.lower(F.regexp_extract("unit", SPDX_LINE, 1)), r"[\s()]+")
    stated = F.array_compact(F.transform(stated, lambda x: F.try_element_at(known, F.regexp_replace(x, r"(-only|-or-later)$|[.+]+$", ""))))
    parts = parts.select("path", "unit", "one_line", F.array_join(_tokens(F.col("unit")), " ").alias("words"), F.when(F.size(stated) > 0, F.array_distinct(stated)).alias("spdx"))
    clauses = F.when(F.col("one_line") & F.col("spdx").isNull(), _clauses(F.col("unit"))).otherwise(F.array())
    rows = parts.select("path", "spdx", F.sha1("words").alias("line"), F.posexplode(F.concat(F.array("words"), clauses)).alias("nth", "words"))
    return rows.select("path", "words", "spdx", F.when(F.col("nth") > 0, F.col("line")).alias("line")).where("words <> ''")


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(k, i, t) for k, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, nth int, text string").select("license", "nth", F.array_join(_tokens(F.col("text")), " ").alias("words"))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(F.split("words", " ")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _decided(terms: Column, license: Column) -> Column:
    """Whether the words of a unit leave this licence possible."""
    out = F.lit(True)
    for name, (groups, never) in DECISIVE.items():
        fits = F.lit(True)
        for g in groups:
            fits = fits & F.arrays_overlap(terms, F.array(*map(F.lit, g)))
        if never:
            fits = fits & ~F.arrays_overlap(terms, F.array(*map(F.lit, never)))
        out = F.when(license == name, fits).otherwise(out)
    return out


def scores(counted: DataFrame) -> DataFrame:
    """(unit, license, cosine): the nearest template of each distinct unit (unit, words, n)."""
    spark = counted.sparkSession
    templates = template_table(spark)
    of_units = materialise(_counted(counted, "unit", "n"), "license-terms")
    of_templates = _counted(templates, "license", "nth")
    n_templates = sum(map(len, TEMPLATES.values()))
    total = F.lit(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + n_templates)
    df = of_units.select("term", "n").unionByName(of_templates.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = materialise(df.select("term", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf")), "license-idf")
    weighted = of_units.join(idf, "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("w"))
    known = of_templates.join(idf, "term").select("license", "nth", "term", (F.col("tf") * F.col("idf")).alias("v"))
    known = known.withColumn("size", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("license", "nth"))))
    size = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # The templates' terms are a fixed few hundred rows.
    dot = weighted.join(F.broadcast(known), "term").groupBy("unit", "license", "nth").agg((F.sum(F.col("w") * F.col("v") / F.col("size"))).alias("dot"))
    terms = F.concat(F.split("words", " "), F.transform(F.regexp_extract_all("words", F.lit(BOUND), 1), lambda v: F.concat(F.lit("="), v)))
    dot = dot.join(counted.select("unit", terms.alias("terms")), "unit").where(_decided(F.col("terms"), F.col("license")))
    cosine = dot.join(size, "unit").select("unit", "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"))
    best = cosine.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select("unit", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, license, licenses, cosine, origin (own, inherited, none), licence_file of every row of (doc_id, path, text)."""
    rows = files.select(F.col("doc_id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    # Rows without a path go by their text, under a key that no path has.
    rows = rows.withColumn("key", F.coalesce("path", F.concat(F.lit("\0"), F.sha1(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))))).withColumnsRenamed({"path": "given", "key": "path"})
    found = materialise(units(rows).select("path", F.sha1("words").alias("unit"), "words", "spdx", "line"), "license-units")
    counted = materialise(found.groupBy("unit").agg(F.first("words").alias("words"), F.count_if(F.col("line").isNull()).alias("n")), "license-distinct")
    scored = materialise(scores(counted).where(F.col("cosine") >= min_cosine), "license-scores")
    by_words = found.where("spdx is null").select("path", "line", "unit").join(scored, "unit").select("path", "line", "license", "cosine")
    single = by_words.where("line is null").select("path", "license", "cosine", F.lit(False).alias("listed"))
    # A line has at most as many licences as there are templates' names.
    offered = by_words.where("line is not null").groupBy("path", "line", "license").agg(F.max("cosine").alias("cosine"))
    offered = offered.groupBy("path", "line").agg(F.collect_list(F.struct("license", "cosine")).alias("all")).where(F.size("all") > 1)
    offered = offered.select("path", F.explode("all").alias("o")).select("path", "o.license", "o.cosine", F.lit(True).alias("listed"))
    stated = found.where("spdx is not null").select("path", F.explode("spdx").alias("license"), F.lit(1.0).alias("cosine"), F.lit(True).alias("listed"))
    best = single.unionByName(offered).unionByName(stated).groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"), F.collect_set(F.when(F.col("listed"), F.col("license"))).alias("more"))
    own = best.select("path", F.col("best.license").alias("license"), F.array_sort(F.array_union("more", F.array("best.license"))).alias("licenses"), (-F.col("best.less")).alias("cosine"))
    own = materialise(own, "license-own")

    holders = own.where(~F.col("path").startswith("\0")).where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)).withColumn("directory", _directory(F.col("path")))
    holders = holders.groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license", "licenses")).alias("h"))
    # Ancestors are walked for distinct directories, not for files.
    places = rows.where("given is not null").select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = places.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("directory", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    # Depth 0 is the root; a root-level path has the empty directory at depth 1 too.
    near = above.join(holders.select(F.col("directory").alias("above"), "h"), "above").groupBy("directory").agg(F.max_by("h", "depth").alias("h"))
    near = materialise(near, "license-near")

    out = rows.select("doc_id", "given", "path", F.when(F.col("given").isNotNull(), _directory(F.col("path"))).alias("directory")).join(own, "path", "left").join(near, "directory", "left")
    mine, theirs = F.col("license").isNotNull(), F.col("h").isNotNull()
    return out.select(
        "doc_id",
        F.col("given").alias("path"),
        F.coalesce("license", "h.license").alias("license"),
        F.coalesce("licenses", "h.licenses").alias("licenses"),
        F.coalesce("cosine", -F.col("h.less")).alias("cosine"),
        F.when(mine, "own").when(theirs, "inherited").otherwise("none").alias("origin"),
        F.when(~mine & theirs, F.col("h.path")).alias("licence_file"),
    )
