"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Every text as a whole, every paragraph and every line or sentence of it is compared with the templates' sentences and
whole texts. A term weighs 1 + ln(times in the unit), times its inverse document frequency over all documents; terms
that no template has weigh as terms of no document. Texts that cannot reach the least cosine with any template, as they
have none of the terms without which no template can be matched, are not cut; units that cannot, by bounds on their
distinct terms, are left out before they become rows of terms. Both bounds lose nothing. Everything is a DataFrame
operation.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

#: Names and wording of public licences and notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "MIT License. Copyright (c) [year] [fullname]. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Names of files that speak for their directory.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
#: Distinct terms of a text that as a whole is a licence file rather than a notice.
FILE_TERMS = 30
_CUT = r"\n+|(?<=[.!?:;])\s+"


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _weight(times: float) -> float:
    return 1 + math.log(times)


def units() -> list[tuple[str, dict[str, int]]]:
    """(licence, term counts) of each sentence of five terms or more, or the only one, and of each whole template."""
    out, seen = [], set()
    for name, text in TEMPLATES:
        parts = [p for p in re.split(_CUT, text) if len(terms_of(p)) >= 5] + [text]
        for p in parts:
            t = terms_of(p)
            if (name, tuple(t)) not in seen:
                seen.add((name, tuple(t)))
                out.append((name, {x: t.count(x) for x in sorted(set(t))}))
    return out


#: The largest value of _weight(n) ** 2 / n over all n, at n = e.
_STEEPEST = 4 / math.e


class LicenseIndex:
    """The templates' weights under the documents' frequencies. What the driver holds is bounded by the templates."""

    def __init__(self, docs: DataFrame, least: float):
        self.least = least
        self.units = units()
        vocabulary = sorted({t for _, u in self.units for t in u})
        known = F.array(*map(F.lit, vocabulary))
        rows = docs.select(F.array_intersect(_terms(F.coalesce("text", F.lit(""))), known).alias("t"))
        n = docs.count()
        df = {r.term: r.n for r in rows.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
        self.other = math.log(1 + n) + 1
        self.vectors = []
        for name, u in self.units:
            v = {t: _weight(k) * self.idf[t] for t, k in u.items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            self.vectors.append((name, {t: w / norm for t, w in v.items()}))
        #: By term, the largest share of a template's squared norm that it has.
        self.most: dict[str, float] = {}
        for _, v in self.vectors:
            for t, w in v.items():
                self.most[t] = max(self.most.get(t, 0.0), w * w)
        self.anchors = self._anchors({t for t in vocabulary if df.get(t, 0) <= 0.05 * n})

    def _anchors(self, rare: set[str]) -> list[str]:
        """Terms of which every unit that matches has one: each template's others are less than a match needs.

        Rare terms first, as a regex then passes over most texts; by how much is left to do.
        """
        chosen: list[str] = []
        todo = [dict(v) for _, v in self.vectors]
        while todo:
            gain: dict[str, float] = {}
            for v in todo:
                for t, w in v.items():
                    gain[t] = gain.get(t, 0.0) + w * w
            best = max(gain, key=lambda t: (t in rare, gain[t], t))
            chosen.append(best)
            for v in todo:
                v.pop(best, None)
            todo = [v for v in todo if sum(w * w for w in v.values()) >= self.least**2 - 1e-9]
        return sorted(chosen)

    def may_hold(self, text: Column) -> Column:
        """False only for texts of which no unit can match."""
        return F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(self.anchors) + ")(?![a-z0-9])")

    def may_match(self, terms: Column) -> Column:
        """False only for the terms of a unit that can't reach the least cosine.

        What a unit shares with one template is bounded by the largest shares of its distinct terms. And other terms,
        which weigh most, must leave enough of the unit's norm: n terms weigh 4 / e * n times their idf squared at most.
        """
        distinct = F.array_distinct(terms)
        held = F.array_intersect(distinct, F.array(*map(F.lit, self.most)))
        share = F.create_map(*[F.lit(x) for kv in self.most.items() for x in kv])
        bound = F.aggregate(held, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(share, t), F.lit(0.0)))
        others = F.size(distinct) - F.size(held)
        room = (1 / self.least**2 - 1) * _STEEPEST * (F.size(terms) - others)
        return (others <= room + 1e-6) & (bound >= self.least**2 - 1e-9)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(term, idf), and (template, license, term, share): weights over a template's norm."""
        idf = ", ".join(f"('{t}', {w!r}D)" for t, w in sorted(self.idf.items()))
        rows = ", ".join(f"({i}, '{name}', '{t}', {w!r}D)" for i, (name, v) in enumerate(self.vectors) for t, w in v.items())
        return spark.sql(f"SELECT * FROM VALUES {idf} AS x(term, idf)"), spark.sql(f"SELECT * FROM VALUES {rows} AS x(template, license, term, share)")


def matches(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(key, unit, license, cosine, size in distinct terms) of the units of ``docs(key, text)`` that reach ``least``.

    Unit 0 is the whole text; its paragraphs follow, if there are several, and its lines and sentences. A unit that fits
    several licences alike gets the first by name.
    """
    spark = docs.sparkSession
    index = LicenseIndex(docs, least)
    idf, shares = index.tables(spark)
    paragraphs = F.split("text", r"\n\s*\n")
    parts = F.concat(F.array("text"), F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array().cast("array<string>")), F.split("text", _CUT))
    held = docs.where(index.may_hold(F.col("text")))
    cut = held.select("key", F.posexplode(parts).alias("unit", "part")).withColumn("terms", _terms(F.col("part")))
    # Two aggregates read the few units that are left; without a table each would cut all texts anew
    found = Scratch(spark, "units").save(cut.where(index.may_match(F.col("terms"))).select("key", "unit", "terms"), "found")
    tf = found.select("key", "unit", F.explode("terms").alias("term")).groupBy("key", "unit", "term").agg(F.count("*").alias("times"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", (1 + F.log(F.col("times").cast("double"))) * F.coalesce("idf", F.lit(index.other)))
    norms = tf.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("size"))
    dots = tf.where("idf is not null").join(F.broadcast(shares), "term").groupBy("key", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(norms, ["key", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= least)
    best = scored.groupBy("key", "unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"), F.max("size").alias("size"))
    return best.select("key", "unit", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), "size")


def directories(path: Column) -> Column:
    """Array of (depth, directory) above a path, '' being the root at depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory")))


#: The columns that a scan adds.
RESULT = ("license", "cosine", "n_units", "own", "inherited", "inherited_from")
#: Directories with an answer, at most, that are broadcast; more of them are joined by directory and a salt of so many values.
FEW, SALTS = 100_000, 32


def scan(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``docs(doc_id, path, text)`` without text, with the columns of RESULT; a row for each row.

    license is the row's own best one, or else the one that it inherits. A row speaks for its directory, and those below
    without a nearer one, if its name is that of a licence file and it matches, or if its whole text of FILE_TERMS or
    more does. Of several such files in a directory the best cosine counts, then the licence's name. Null and empty texts
    match nothing; null paths have no directory; rows that repeat id, path and text are one file and get one result each.
    Long texts are read whole. Empty input: empty result. A column of ``docs`` that has the name of one of RESULT gives
    way to it; names that begin with _qw_ are reserved.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    carry = [c for c in docs.columns if c != "text" and c not in RESULT]
    key = F.xxhash64("doc_id", "path", "text", F.lit(9))
    found = scratch.save(matches(docs.select(key.alias("key"), "text"), least), "matches")
    own = found.groupBy(F.col("key").alias("_qw_key")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("_qw_best"),
        F.countDistinct(F.when(F.col("unit") > 0, F.col("unit"))).alias("_qw_units"),
        F.max(((F.col("unit") == 0) & (F.col("size") >= FILE_TERMS)).cast("int")).alias("_qw_whole"),
    )
    # Directories, not files, look for their nearest ancestor that speaks
    names = F.split("path", "/")
    here = F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), "/")
    slim = docs.select(*carry, key.alias("_qw_key"), here.alias("_qw_here"))
    rows = scratch.save(slim.join(own, "_qw_key", "left"), "rows")
    speaks = rows.where((F.col("_qw_whole") == 1) | (F.col("_qw_best").isNotNull() & F.element_at(names, -1).rlike(FILE_NAMES))).where("path is not null")
    spoken = speaks.groupBy(F.col("_qw_here").alias("directory")).agg(F.min("_qw_best").alias("spoken"))
    dirs = rows.where("path is not null").select(F.col("_qw_here").alias("here")).distinct()
    above = dirs.select("here", F.explode(directories(F.concat("here", F.lit("/x")))).alias("a")).select("here", F.col("a.depth").alias("depth"), F.col("a.directory").alias("directory"))
    nearest = above.join(spoken, "directory").groupBy(F.col("here").alias("_qw_here")).agg(F.max(F.struct("depth", "directory", "spoken")).alias("_qw_near"))
    nearest = scratch.save(nearest, "nearest")
    if nearest.count() <= FEW:
        out = rows.join(F.broadcast(nearest), "_qw_here", "left")
    else:
        salt = F.pmod("_qw_key", F.lit(SALTS)).cast("int").alias("_qw_salt")
        each = nearest.withColumn("_qw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("_qw_salt", salt).join(each, ["_qw_here", "_qw_salt"], "left")
    inherited = F.when(F.col("_qw_best").isNull(), F.col("_qw_near.spoken.license"))
    return out.select(
        *carry,
        F.coalesce(F.col("_qw_best.license"), inherited).alias("license"),
        (-F.col("_qw_best.c")).alias("cosine"),
        F.coalesce("_qw_units", F.lit(0)).cast("long").alias("n_units"),
        F.col("_qw_best").isNotNull().alias("own"),
        inherited.isNotNull().alias("inherited"),
        F.when(inherited.isNotNull(), F.col("_qw_near.directory")).alias("inherited_from"),
    )
