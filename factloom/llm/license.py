"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment decides.

All work on a document happens in its own row: nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common notices and whole short licenses, by identifier.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "BSL-1.0",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    ),
)
#: Whole texts of long licenses, a file each beside this module.
TEXTS = Path(__file__).with_name("license_texts")


def templates() -> list[tuple[str, str]]:
    """(name, text) of all known notices and licenses."""
    return [*TEMPLATES, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _rolling(items: Column, n: int, of: Callable[[list[Column]], Column], kind: str) -> Column:
    places = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: of([F.get(items, i + k) for k in range(n)])).cast(f"array<{kind}>")


def shingle_hashes(tokens: Column, shingle: int) -> Column:
    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: _rolling(h, shingle, lambda part: F.xxhash64(*part), "bigint"))


def shingle_texts(tokens: Column, shingle: int) -> Column:
    return _rolling(tokens, shingle, lambda part: F.concat_ws(" ", *part), "string")


def band_values(hashes: Column, window: int, stride: int, bands: int) -> Column:
    """Values of all windows: each shingle's own hash, and of each window of ``window`` shingles one
    least hash a band (one row a band)."""

    def of(h: Column) -> Column:
        starts = F.when(F.size(h) >= window, F.sequence(F.lit(1), F.size(h) - window + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))

        def band(b: int) -> Column:
            return _let(F.transform(h, lambda x: F.xxhash64(x, F.lit(b))), lambda hb: F.transform(starts, lambda j: F.array_min(F.slice(hb, j, window))))

        return F.concat(h, *map(band, range(1, bands + 1)))

    return _let(hashes, of)


def _known(spark, known: Sequence[tuple[str, str]], shingle: int, window: int, bands: int, part: int) -> list:
    """(name, part, bands, shingles) of the parts of ``part`` shingles that each template is cut into."""
    rows = spark.createDataFrame([(n, t) for n, t in known], "name string, text string").withColumn("w", words(F.col("text")))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - shingle + 1) / part).cast("int") - 1))
    # the last part takes what would be less than a part of its own
    rows = rows.select("name", "w", F.explode(cuts).alias("part"), (F.size(cuts) - 1).alias("last"))
    length = F.when(F.col("part") == F.col("last"), F.size("w")).otherwise(F.lit(part + shingle - 1))
    rows = rows.select("name", "part", F.slice("w", F.col("part") * part + 1, length).alias("w")).withColumn("h", shingle_hashes(F.col("w"), shingle)).where(F.size("h") > 0)
    # a template of fewer shingles than a window has windows of one shingle, whose least hash is its own
    values = F.when(F.size("h") >= window, F.array_except(band_values(F.col("h"), window, 1, bands), F.col("h"))).otherwise(F.col("h"))
    return rows.select("name", "part", F.array_distinct(values).alias("bands"), F.array_distinct(shingle_texts(F.col("w"), shingle)).alias("shingles")).collect()


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | None = None, shingle: int = 5, window: int = 4, stride: int = 2, bands: int = 3, containment: float = 0.8, part: int = 64) -> DataFrame:
    """``docs``' doc_id with matches: an array of (template, containment, parts), empty if there is none.

    ``known`` is a fixed list (name, text), by default all of ``templates()``; it becomes part of the plan. Templates of fewer than ``shingle`` words are
    never found. A template is cut into parts of ``part`` shingles (the last up to twice that), and counts as contained if
    at least ``containment`` of some part's distinct shingles occur in the whole text; the greatest
    containment of its parts and the number of parts contained are returned. A text window that lies in an unchanged stretch of a template equals one
    of the template's windows and collides in every band; windows of similarity s collide with
    1 - (1 - s) ** bands, 0.99 at 0.8 for three bands. A stretch of ``window + stride - 1`` unchanged
    shingles always holds such a window. Null, empty and short texts match nothing; null and repeated
    doc_ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    parts = _known(docs.sparkSession, templates() if known is None else known, shingle, window, bands, part)
    every = sorted({b for r in parts for b in r.bands})
    # one literal for the whole table
    kind = "array<struct<name:string,bands:array<bigint>,shingles:array<string>>>"
    table = F.from_json(F.lit(json.dumps([{"name": r.name, "bands": r.bands, "shingles": r.shingles} for r in parts])), kind)
    values = band_values(shingle_hashes(words(F.coalesce("text", F.lit(""))), shingle), window, stride, bands)
    rows = docs.select("doc_id", "text", F.array_distinct(F.filter(values, lambda v: v.isin(every))).alias("hit"))

    def verified(t: Column, own: Column) -> Column:
        return F.struct(t["name"].alias("template"), (F.size(F.array_intersect(t["shingles"], own)) / F.size(t["shingles"])).alias("containment"))

    met = F.filter(table, lambda t: F.exists("hit", lambda h: F.array_contains(t["bands"], h)))
    found = _let(F.array_distinct(_let(words(F.col("text")), lambda w: shingle_texts(w, shingle))), lambda own: F.filter(F.transform(met, lambda t: verified(t, own)), lambda m: m["containment"] >= containment))
    none = F.array().cast("array<struct<template:string,containment:double,parts:int>>")
    return rows.select("doc_id", F.when(F.size("hit") > 0, _let(found, lambda f: _by_name(f))).otherwise(none).alias("matches"))


def _by_name(found: Column) -> Column:
    """One entry a template: its greatest containment and the number of its parts."""
    names = F.array_sort(F.array_distinct(F.transform(found, lambda m: m["template"])))
    return F.transform(names, lambda n: _let(F.filter(found, lambda m: m["template"] == n), lambda own: F.struct(n.alias("template"), F.array_max(F.transform(own, lambda m: m["containment"])).alias("containment"), F.size(own).alias("parts"))))
