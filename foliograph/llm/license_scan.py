"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

All of it is DataFrame expressions.  A text is cut into windows of twice a
template's length that overlap by half, so any passage of a template's length
lies whole in one.  Bands are of one row each: a window and a template collide
in a band if their least shingle under that band's hash is the same one, and
with BANDS bands a window that holds a template whole is missed with
probability below 1e-4.  That also makes pruning exact: a collision needs one of
the templates' least shingles in the window, so signatures are only worked out
where one is.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._shared import read_table

#: Words of a shingle (a shorter template is one shingle), bands, and the share of a template's shingles that a match holds.
SHINGLE, BANDS, CONTAINED = 5, 64, 0.8

#: Words too frequent to tell texts apart by.
FREQUENT = frozenset("a an and any are as at be by copy file for from general have if in is it may must not of on or public shall source terms than that the this to under use used was with without work you your code program notice above list other all no hope useful option".split())

#: License notices as they stand in files and pages.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _length_class(n: int) -> int:
    """Templates of up to 8 words have a window length of their own, longer ones share those of the next half power of two."""
    if n <= 8:
        return n
    size = 8
    while n > size:
        if n <= size * 3 // 2:
            return size * 3 // 2
        size *= 2
    return size


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _band_hash(shingle: int, band: int) -> int:
    """XXH64 of the signed shingle hash under the band's seed chain, as Spark's xxhash64(band, shingle) gives it."""
    first = xxhash.xxh64_intdigest(band.to_bytes(8, "little"), 42)
    return _signed(xxhash.xxh64_intdigest((shingle & (1 << 64) - 1).to_bytes(8, "little"), first))


def _gram_hash(words: list[str]) -> int:
    """What Spark's xxhash64 gives for the words as columns: each one's XXH64, seeded with the hash before it."""
    value = 42
    for w in words:
        value = xxhash.xxh64_intdigest(w.encode(), value)
    return _signed(value)


class Templates:
    """What a scan needs to know of its templates: their shingles and bands, and the anchors (least shingles) of each length class."""

    def __init__(self, texts: dict[str, str]):
        self.bands: list[tuple[int, int, int, str, int]] = []
        self.sets: list[tuple[str, int, list[int]]] = []
        #: (words of a class, words of a shingle) -> hashes
        self.anchors: dict[tuple[int, int], set[int]] = {}
        spelled: set[tuple[str, ...]] = set()
        for name, text in texts.items():
            words = template_words(text)
            if not words:
                continue
            width, size = min(SHINGLE, len(words)), _length_class(len(words))
            grams = {_gram_hash(words[i : i + width]): tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            self.sets.append((name, len(grams), sorted(grams)))
            for band in range(BANDS):
                least = min(grams, key=lambda g: _band_hash(g, band))
                self.anchors.setdefault((size, width), set()).add(least)
                spelled.add(grams[least])
                self.bands.append((size, width, band, name, _band_hash(least, band)))
        # every anchor holds one of these words, so a text without any holds no anchor
        self.needed: list[str] = []
        telling = {g: [w for w in g if w not in FREQUENT and not w.isdigit()] or list(g) for g in spelled}
        while telling:
            best = max(sorted({w for ws in telling.values() for w in ws}), key=lambda w: (sum(w in ws for ws in telling.values()), len(w)))
            self.needed.append(best)
            telling = {g: ws for g, ws in telling.items() if best not in ws}


@lru_cache(maxsize=4)
def _known(items: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(items))


def _grams(width: int) -> Column:
    """The hashes of a text's shingles of ``width`` words, in order, from its words ``ws``."""
    return F.transform(F.sequence(F.lit(0), F.size("ws") - width), lambda i: F.xxhash64(*(F.get("ws", i + k) for k in range(width))))


def _windows(known: Templates) -> Column:
    """Array of (size, width, start, grams): of all windows of 2 x size words from every ``size``-th word on, those around an anchor of their class."""

    def of(size: int, width: int, anchors: set[int]) -> Column:
        near = F.filter(f"p{width}", lambda p: F.get(f"g{width}", p).isin(*sorted(anchors)))
        starts = F.array_distinct(F.flatten(F.transform(near, lambda p: F.array(p - p % size, p - p % size - size))))
        return F.transform(F.filter(starts, lambda s: s >= 0), lambda s: F.struct(F.lit(size).alias("size"), F.lit(width).alias("width"), s.alias("start"), F.slice(f"g{width}", s + 1, F.lit(2 * size - width + 1)).alias("grams")))

    return F.concat(*(of(size, width, anchors) for (size, width), anchors in sorted(known.anchors.items())))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license, containment, first_word, n_windows.

    Words are runs of a-z and 0-9 after lower-casing.  ``containment``: the
    greatest share of the template's shingles that one window holds (0.8 or
    more); ``first_word``: where the first such window starts; ``n_windows``:
    how many windows hold it.  Rows that repeat an id, or each other, have rows
    of their own; a null id stays null; documents without a license, null and
    empty texts have no row, nor has an empty table; whole texts are looked at,
    however long; other columns aren't.
    """
    known = _known(tuple((TEMPLATES if templates is None else templates).items()))
    spark = docs.sparkSession
    if not known.sets:
        return spark.createDataFrame([], "doc_id long, license string, containment double, first_word long, n_windows long")
    widths = sorted({w for _, w in known.anchors})
    every = {w: sorted(set().union(*(a for (_, x), a in known.anchors.items() if x == w))) for w in widths}
    # partition and row number make a row's identity.  Not being deterministic, they and r1 and r2 also keep the optimizer
    # from working lower-cased texts and arrays out again inside each filter and lambda that looks at them.
    lowered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"), F.spark_partition_id().alias("part"))
    some = reduce(lambda a, b: a | b, (F.contains("low", F.lit(w)) for w in known.needed))
    words = F.split(F.trim(F.regexp_replace("low", "[^a-z0-9]+", " ")), " ")
    rows = lowered.where(some).select("doc_id", "part", F.monotonically_increasing_id().alias("row"), words.alias("ws"))
    empty = F.array().cast("array<bigint>")
    rows = rows.select("doc_id", "part", "row", F.rand(0).alias("r1"), *(F.when(F.size("ws") >= w, _grams(w)).otherwise(empty).alias(f"g{w}") for w in widths))
    place = lambda w: F.filter(F.sequence(F.lit(0), F.greatest(F.size(f"g{w}") - 1, F.lit(0))), lambda i: F.coalesce(F.get(f"g{w}", i).isin(*every[w]), F.lit(False)))
    rows = rows.select("*", F.rand(0).alias("r2"), *(place(w).alias(f"p{w}") for w in widths)).where(reduce(lambda a, b: a | b, (F.size(f"p{w}") > 0 for w in widths)))
    shingled = rows.where("r1 >= 0 and r2 >= 0").select("doc_id", "part", "row", F.explode(_windows(known)).alias("w")).select("doc_id", "part", "row", "w.*")
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("grams", lambda g: F.xxhash64(b.cast("long"), g))).alias("value")))
    banded = shingled.select("doc_id", "part", "row", "size", "width", "start", "grams", F.explode(least).alias("b")).select("doc_id", "part", "row", "size", "width", "start", "grams", "b.band", "b.value")
    index = spark.createDataFrame(known.bands, "size int, width int, band int, license string, value long")
    sets = spark.createDataFrame(known.sets, "license string, n int, own array<long>")
    # the index has BANDS rows a template, so its size does not depend on the documents
    met = banded.join(F.broadcast(index), ["size", "width", "band", "value"]).join(F.broadcast(sets), "license")
    share = F.size(F.array_intersect("own", "grams")) / F.col("n")
    held = met.select("doc_id", "part", "row", "license", "start", share.alias("share")).where(F.col("share") >= CONTAINED)
    found = held.groupBy("doc_id", "part", "row", "license").agg(F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("n_windows"))
    return found.select("doc_id", "license", "containment", "first_word", "n_windows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: licenses found in all documents."""
    return scan(read_table(spark, sf_dir, "documents"))
