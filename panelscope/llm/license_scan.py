"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

Words are the lower-case runs of letters and digits; SHINGLE of them make a shingle. Texts and templates are cut into overlapping windows of
shingles, at several scales. A template is looked up by its windows at every place, at the
largest scale that fits into it one and a half times; a document's windows start every half
window, so an exact copy holds a document's window that equals one of the template's. A window's MinHash values are the minima of its shingles' 64-bit hashes under BANDS * ROWS masks
(hash xor mask orders the hashes anew for each mask), taken ROWS to a band. A document's window
and a template's window with the Jaccard similarity j share a band with the probability
1 - (1 - j^ROWS)^BANDS: 0.998 at j = 0.8 with the settings below, for a single window; equal
windows always do, and at the smallest scale, one shingle, windows are equal or disjoint.

Each retrieved place is verified with the shingles themselves: the share of the template's
shingles that occur in the document's words at that place, and about a fifth of the template's
length around it, must be at least ``threshold``. Of places that overlap, the one with the most
common shingles is reported: a BSD-3-Clause text holds nearly all of BSD-2-Clause, and a whole
GPL its own header. A template with fewer than SHINGLE words has
one shingle, all its words, and is found as such.

The templates' bands are broadcast when their counted size is small, else joined by a shuffle of
the bands, and only matched documents meet their shingles again. DataFrame functions only.

Edge cases: null and empty texts, and documents that have fewer words than a shingle, match no
longer template; templates without words match nothing; a license that a document repeats gives
one row with the number of places; rows that repeat an id are scanned each and reported each;
a text of any length is scanned whole, as one row's array of hashes; no documents or no templates
give no rows; other columns are not read.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import BROADCAST_BYTES, kept

SHINGLE = 5
THRESHOLD = 0.8
SCALES = (1, 8, 32)  # shingles per window
BLOCK = 4  # shingles; divides half of every larger scale
BANDS, ROWS = 6, 2
MAX_LISTED = 1000  # single shingles that are tested in a document before it is cut into them
SEED_STEP = 0x9E3779B97F4A7C15

# Notices and license texts to look for (public texts): identifier, text. Notices and headers are named
# so; every other text is whole, the long ones in the folder licenses.
LONG_TEXTS = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
TEMPLATES = [
    *((name, pkgutil.get_data("panelscope.llm", f"licenses/{name}.txt").decode()) for name in LONG_TEXTS),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        'prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND '
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "GPL-2.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1-header",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "LGPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details.",
    ),
    (
        "GPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MPL-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For "
        "more information, please refer to <http://unlicense.org/>",
    ),
]


def plain_words(text: Column) -> Column:
    """The lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of the word shingles, in order (fewer words than a shingle: one of all)."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def _masks() -> list[int]:
    """BANDS * ROWS fixed odd multiples of a 64-bit step, as signed longs."""
    values = [(SEED_STEP * (2 * i + 1)) & (2**64 - 1) for i in range(BANDS * ROWS)]
    return [v - 2**64 if v >= 2**63 else v for v in values]


def _least(hashes: Column, mask: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask))))


def window_bands(hashes: Column, scale: int, stride: int) -> Column:
    """Array of structs (scale, start, band): the band values of the windows of ``scale``
    shingles that start every ``stride``; the last one may be shorter. A window of one
    shingle is its own band value."""
    n = F.size(hashes)
    none = F.array().cast("array<struct<scale:int,start:int,band:bigint>>")
    if scale == 1:
        own = lambda h, i: F.struct(F.lit(1).alias("scale"), i.alias("start"), h.alias("band"))
        return F.transform(hashes, own)
    starts = F.sequence(F.lit(0), F.greatest(n - scale, F.lit(0)) + (stride - 1), F.lit(stride))

    def bands(i: Column) -> Column:
        inside = F.slice(hashes, i + 1, F.lit(scale))
        least = [_least(inside, m) for m in _masks()]
        return F.array(*[F.xxhash64(F.lit(scale), F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])

    every = F.flatten(
        F.transform(
            F.filter(starts, lambda i: i < n),
            lambda i: F.transform(
                bands(i), lambda v: F.struct(F.lit(scale).alias("scale"), i.cast("int").alias("start"), v.alias("band"))
            ),
        )
    )
    return F.when(n >= scale, every).otherwise(none)


def block_minima(hashes: Column) -> Column:
    """For every BLOCK shingles the MinHash values of that block; a window's are the least of its blocks'."""
    names = [f"h{t}" for t in range(BLOCK)]
    starts = F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(BLOCK))
    # out of bounds is null, which least() leaves out
    blocks = F.transform(starts, lambda i: F.struct(*[F.get(hashes, i + t).alias(n) for t, n in enumerate(names)]))
    minima = F.transform(blocks, lambda b: F.array(*[F.least(*[b[n].bitwiseXOR(F.lit(m)) for n in names]) for m in _masks()]))
    return F.when(F.size(hashes) > 0, minima).otherwise(F.array().cast("array<array<bigint>>"))


def document_bands(n: Column, blocks: Column, scale: int) -> Column:
    """``window_bands`` of a document with ``n`` shingles for windows that start every half
    window, from the MinHash values of its blocks."""
    stride = scale // 2
    last = F.greatest(n - scale, F.lit(0)) + (stride - 1)
    starts = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: i < n)

    def of_window(i: Column) -> Column:
        j = F.floor(i / BLOCK).cast("int")
        inside = [F.get(blocks, j + t) for t in range(scale // BLOCK)]
        least = [F.least(*[F.get(b, F.lit(m)) for b in inside]) for m in range(BANDS * ROWS)]
        return F.array(
            *[
                F.struct(
                    F.lit(scale).alias("scale"),
                    i.cast("int").alias("start"),
                    F.xxhash64(F.lit(scale), F.lit(b), *least[b * ROWS : (b + 1) * ROWS]).alias("band"),
                )
                for b in range(BANDS)
            ]
        )

    none = F.array().cast("array<struct<scale:int,start:int,band:bigint>>")
    return F.when(n >= scale, F.flatten(F.transform(starts, of_window))).otherwise(none)


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """license, t_words, t_hashes of every template with a word; its scale."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([tuple(t) for t in templates], "license string, text string")
    rows = templates.select("license", plain_words(F.col("text")).alias("t_words")).where(F.size("t_words") > 0)
    rows = rows.select("license", "t_words", shingle_hashes(F.col("t_words")).alias("t_hashes"))
    n = F.size("t_hashes")
    scale = F.lit(SCALES[0])
    for s in SCALES[1:]:
        # so long that one of a document's windows, which start every half window, lies inside any copy
        scale = F.when(n >= s + s // 2 - 1, F.lit(s)).otherwise(scale)
    return rows.withColumn("t_scale", scale)


def template_bands(templates: DataFrame) -> DataFrame:
    """license, scale, t_start, band: the bands of each template's windows at its scale, from
    every place."""
    parts = []
    for s in SCALES:
        own = templates.where(F.col("t_scale") == s).select("license", F.explode(window_bands(F.col("t_hashes"), s, 1)).alias("w"))
        parts.append(own.select("license", "w.scale", F.col("w.start").alias("t_start"), "w.band"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    # equal windows of a template are one entry: its first place is enough, as places are searched with slack
    return rows.groupBy("license", "scale", "band").agg(F.min("t_start").alias("t_start"))


def _single_bands(hashes: Column, bands: DataFrame) -> Column:
    """``window_bands`` of single shingles; none for a document without a shingle of the templates
    that are looked up so, when these are few enough to be looked for in the whole array at once."""
    every = window_bands(hashes, 1, 1)
    singles = bands.where("scale = 1").select("band").distinct()
    if singles.count() > MAX_LISTED:
        return every
    listed = [r["band"] for r in singles.collect()]
    none = F.array().cast("array<struct<scale:int,start:int,band:bigint>>")
    return F.when(F.arrays_overlap(hashes, F.array(*map(F.lit, listed))), every).otherwise(none) if listed else none


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and license found: id, license, containment (the best place's),
    first_word (of the first place, from 0, in the document's plain words), n_places."""
    spark = docs.sparkSession
    known = kept(template_table(spark, templates))
    bands = kept(template_bands(known))
    n_bands, n_words = bands.count(), known.agg(F.sum(F.size("t_words"))).first()[0] or 0
    is_small = 64 * n_bands + 48 * n_words <= BROADCAST_BYTES
    small = F.broadcast if is_small else (lambda side: side)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), plain_words(F.col(text_col)).alias("words")
    )
    rows = rows.select("row", "id", shingle_hashes(F.col("words")).alias("hashes"))
    rows = rows if is_small else kept(rows)
    carried = ["row", "id", "hashes"] if is_small else ["row"]
    windows = F.concat(
        _single_bands(F.col("hashes"), bands), *[document_bands(F.size("hashes"), F.col("blocks"), s) for s in SCALES[1:]]
    )
    hits = (
        rows.select(*carried, *([] if is_small else ["hashes"]), block_minima(F.col("hashes")).alias("blocks"))
        .select(*carried, windows.alias("windows"))
        # outer: else Spark also filters on the size of the windows, below the projection, and
        # computes each document's hashes again for every window
        .select(*carried, F.explode_outer("windows").alias("w"))
        .select(*carried, F.col("w.scale").alias("w_scale"), F.col("w.start").alias("w_start"), F.col("w.band").alias("w_band"))
        .join(small(bands), (F.col("w_band") == F.col("band")) & (F.col("w_scale") == F.col("scale")))
    )
    hits = hits if is_small else kept(hits).join(rows, "row")  # windows are shuffled without their document
    n = F.size("t_hashes")
    slack = F.ceil(n / 5).cast("int")
    begin = F.greatest(F.col("w_start") - F.col("t_start") - slack, F.lit(0))
    there = F.slice("hashes", begin + 1, n + 2 * slack)
    common = F.array_intersect(there, "t_hashes")
    share = F.size(common) / F.size(F.array_distinct("t_hashes"))
    # equal windows of a template are known by the first place only: the first common shingle tells where the copy is
    shingle = F.get(common, 0)
    place = F.greatest(begin + F.array_position(there, shingle) - F.array_position("t_hashes", shingle), F.lit(0))
    found = (
        hits.join(small(known.select(F.col("license").alias("of"), "t_hashes")), F.col("license") == F.col("of"))
        .select("row", "id", "license", place.alias("place"), n.alias("length"), F.size(common).alias("common"), share.alias("containment"))
        .where(F.col("containment") >= threshold)
    )
    places = found.groupBy("row", "id", "license", "place", "length").agg(F.max("common").alias("common"), F.max("containment").alias("containment"))
    return (
        _largest(places)
        .groupBy("row", "id", "license")
        .agg(F.max("containment").alias("containment"), F.min("place").alias("first_word"), F.count_distinct("place").alias("n_places"))
        .select(F.col("id").alias(id_col), "license", "containment", "first_word", "n_places")
    )


def _largest(places: DataFrame) -> DataFrame:
    """The matches that share no more than half of the shorter one's shingles' places with a larger
    match of another license: of a row's matches, by most common shingles, then containment, then
    license, each stays unless one that stays overlaps it."""
    one = F.struct((-F.col("common")).alias("rank"), (-F.col("containment")).alias("share"), "license", F.col("place").cast("int").alias("place"), "length")
    none = F.array().cast("array<struct<rank:int,share:double,license:string,place:int,length:int>>")

    def overlap(x: Column, y: Column) -> Column:
        both = F.least(x["place"] + x["length"], y["place"] + y["length"]) - F.greatest(x["place"], y["place"])
        return (x["license"] != y["license"]) & (2 * both > F.least(x["length"], y["length"]))

    def stay(kept_: Column, x: Column) -> Column:
        return F.when(F.exists(kept_, lambda y: overlap(x, y)), kept_).otherwise(F.concat(kept_, F.array(x)))

    rows = places.groupBy("row", "id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    rows = rows.select("row", "id", F.explode(F.aggregate("m", none, stay)).alias("m"))
    return rows.select("row", "id", "m.license", (-F.col("m.share")).alias("containment"), "m.place")
