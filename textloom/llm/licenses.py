"""License scans: MinHash bands over overlapping windows retrieve templates, shingles verify them. SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.arrays import let
from textloom.llm.common import hot_join, stored, text_of
from textloom.operators.lookup import fits_broadcast

SHINGLE = 5
CONTAINED = 0.8
#: Probability that a window that holds a template shares a band with it, at the least.
FOUND = 0.999
#: Classes of template lengths; templates of one class share their windows.
RATIO = 1.5

# Notices that name a license, the standard headers of files, and texts of short licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License"),
    ("LGPL-3.0", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License"),
    ("AGPL-3.0", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
            "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
            "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
            "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                  "purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
                "this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
             "for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def _column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), "")


def shingles_of(words: Column, size: int | Column) -> Column:
    """Runs of ``size`` words, as texts; none if there are fewer words."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, _column(size)), " ")),
    ).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Band:
    """Windows and bands for templates of ``least`` to ``most`` words, in shingles of ``size`` words."""

    least: int
    most: int
    size: int

    @property
    def window(self) -> int:
        return self.most + max(1, self.most // 2)

    @property
    def step(self) -> int:
        """Any run of ``most`` words lies in one window."""
        return self.window - self.most + 1

    def bands(self, contained: float = CONTAINED, found: float = FOUND) -> int:
        """How many minima are compared so that a window with the share ``contained`` of a template is found.

        Each agrees with the probability of the Jaccard similarity, at the worst that of the shortest
        template in a window of other words.
        """
        template = self.least - self.size + 1
        shared = math.ceil(contained * template - 1e-9)
        similar = shared / (template + self.window - self.size + 1 - shared)
        return math.ceil(math.log(1 - found) / math.log(1 - similar)) if similar < 1 else 1


def length_classes(lengths: list[int]) -> list[Band]:
    """Classes that hold all lengths that occur. Templates of fewer than SHINGLE words are one shingle each."""
    found, least = [], None
    for n in sorted({n for n in lengths if n}):
        if n < SHINGLE:
            found.append(Band(n, n, n))
        elif least is None or n > least * RATIO:
            least = n
            found.append(Band(n, n, SHINGLE))
        else:
            found[-1] = Band(least, n, SHINGLE)
    return found


def _minima(shingles: Column, bands: int | Column) -> Column:
    """The smallest hash of the shingles under each of ``bands`` hash functions."""

    def least(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), _column(bands)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b)))
        )

    return let(F.transform(shingles, lambda s: F.xxhash64(s)), least)


def _anchors(templates: DataFrame, contained: float) -> DataFrame:
    """Words of which every text that holds a template has at least one.

    The longest words of a template, until more than 1 - ``contained`` of its shingles have one of them:
    a text without any of these words lacks too many shingles.
    """
    ranked = F.transform(
        F.sort_array(F.transform(F.array_distinct("words"), lambda w: F.struct(-F.length(w), w.alias("w")))), lambda s: s["w"]
    )
    held = templates.withColumn("ranked", ranked)
    missed = F.transform(
        F.sequence(F.lit(1), F.size("ranked")),
        lambda n: F.size(
            F.filter("shingles", lambda s: ~F.arrays_overlap(F.split(s, " "), F.slice("ranked", F.lit(1), n)))
        ),
    )
    enough = F.transform(missed, lambda m: m < contained * F.size("shingles"))
    chosen = F.slice("ranked", F.lit(1), F.array_position(enough, True).cast("int"))
    return held.select("class", F.explode(chosen).alias("word")).distinct()


def _anchor_windows(words: Column, hits: Column, number: int, c: Band, anchors: list[str]) -> Column:
    """``array<struct<class,start,words>>``: the windows of a class that hold one of its anchor words.

    ``hits`` are the places (at, word) of all anchor words of a text.
    """
    last = F.floor(F.greatest(F.size(words) - c.window + c.step - 1, F.lit(0)) / c.step).cast("int")

    def around(hit: Column) -> Column:
        first = F.greatest(F.ceil((hit["at"] - (c.window - 1)) / c.step), F.lit(0)).cast("int")
        return F.sequence(first, F.least(F.floor(hit["at"] / c.step).cast("int"), last))

    mine = F.filter(hits, lambda h: h["word"].isin(anchors))
    numbers = F.array_distinct(F.flatten(F.transform(mine, around)))
    return F.transform(
        numbers,
        lambda k: F.struct(
            F.lit(number).alias("class"), (k * c.step).alias("start"), F.slice(words, k * c.step + 1, F.lit(c.window)).alias("words")
        ),
    )


def matches(
    docs: DataFrame,
    templates: DataFrame,
    text_col: str = "text",
    contained: float = CONTAINED,
    found: float = FOUND,
) -> DataFrame:
    """``hash`` (128 bits of the text), ``licenses`` (license, containment, start), ``n``: for texts with a license.

    ``templates`` has license and text. Texts without any anchor word hold no template and are passed over.
    The others are cut into overlapping windows, made for each class of template lengths so that a whole template lies in
    one of them; a window and a template that share a band's minimum are compared shingle by shingle.
    ``containment`` is the largest share of a template's shingles in one window, ``start`` its first word.
    """
    spark = docs.sparkSession
    listed = templates.select("license", words_of(text_of("text")).alias("words")).where("size(words) > 0").distinct()
    lengths = [r["n"] for r in listed.select(F.size("words").alias("n")).distinct().collect()]
    classes = length_classes(lengths)
    if not classes:
        return spark.createDataFrame(
            [], "hash binary, licenses array<struct<license:string,containment:double,start:int>>, n bigint"
        )

    known = None
    for number, c in enumerate(classes):
        mine = listed.where(F.size("words").between(c.least, c.most))
        mine = mine.withColumn("shingles", F.array_distinct(shingles_of(F.col("words"), c.size)))
        mine = mine.select(F.lit(number).alias("class"), "*", _minima(F.col("shingles"), c.bands(contained, found)).alias("minima"))
        known = mine if known is None else known.union(mine)
    known = stored(known)
    # The templates are a list that someone wrote; a few words of each come to the driver.
    anchors: dict[int, list[str]] = {}
    for row in known.transform(_anchors, contained).collect():
        anchors.setdefault(row["class"], []).append(row["word"])
    every = sorted({word for listed in anchors.values() for word in listed})

    digest = F.unhex(F.md5(text_of(text_col).cast("binary")))
    texts = docs.select(digest.alias("hash"), words_of(text_of(text_col)).alias("words"))
    texts = texts.where(F.arrays_overlap("words", F.array(*map(F.lit, every))))
    places = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(every), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull()
    )
    windows = let(
        places,
        lambda hits: F.concat(*[_anchor_windows(F.col("words"), hits, i, c, sorted(anchors[i])) for i, c in enumerate(classes)]),
    )
    # Only windows move, each of equal texts once; so those of a long text go to many tasks.
    cut = texts.select("hash", F.explode(windows).alias("w")).select("hash", "w.*")
    cut = cut.groupBy("hash", "class", "start", "words").agg(F.count(F.lit(1)).alias("n"))

    def by_class(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("class") + 1)

    pieces = F.array_distinct(shingles_of(F.col("words"), by_class([c.size for c in classes])))
    cut = cut.select("hash", "n", "class", "start", pieces.alias("pieces")).where("size(pieces) > 0")
    minima = _minima(F.col("pieces"), by_class([c.bands(contained, found) for c in classes]))
    banded = cut.select("*", F.posexplode(minima).alias("band", "least"))
    bands = known.select("class", "license", "shingles", F.posexplode("minima").alias("band", "least"))
    met = banded.join(F.broadcast(bands) if fits_broadcast(bands) else bands, ["class", "band", "least"])
    share = F.size(F.array_intersect("pieces", "shingles")) / F.size("shingles")
    sure = met.withColumn("containment", share).where(F.col("containment") >= contained)
    best = sure.groupBy("hash", "license").agg(
        F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"), F.max("n").alias("n")
    )
    one = F.struct("license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("start"))
    return best.groupBy("hash").agg(F.sort_array(F.collect_list(one)).alias("licenses"), F.max("n").alias("n"))


def scan_licenses(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per document and license found: id, ``license``, ``containment``, ``start``.

    A license with several templates has one row, for the best of them. Documents without a license have no row;
    null and empty texts hold none, and empty templates match nothing. Repeated rows are reported each.
    """
    found = stored(matches(docs, templates, text_col, **options))
    digest = F.unhex(F.md5(text_of(text_col).cast("binary")))
    rows = docs.select(F.col(id_col).alias("_id"), digest.alias("hash"))
    joined = hot_join(rows, found, ["hash"], "n", ["licenses"])
    return joined.select(F.col("_id").alias(id_col), F.explode("licenses").alias("l")).select(id_col, "l.*")
