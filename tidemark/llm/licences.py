"""Licence scans by MinHash bands over overlapping windows, in DataFrame functions only.

Words are runs of a-z and 0-9 (A-Z folded), so neither punctuation nor the place of line ends counts. A shingle is WIDTH words. A document is cut into blocks of BLOCK shingles;
two neighbouring blocks are a window, so windows overlap by half. A window has BANDS MinHash values, bands of
one row each: the least of the values that one of BANDS hash functions gives its shingles. Templates have windows of as many shingles at every place.

Of a template of 2 * BLOCK - 7 = 9 shingles or fewer that a document has, at least LEAST lies in one window, of a longer
one at least half a window does. The smallest case is a template of FEW = 5 shingles, 4 of them in a window of 16, a similarity of
4/17: a band is shared with a probability of 1 - (13/17)^24 = 0.998. For a template of fewer shingles the
band's keys are its shingles themselves, so these are always met. What the bands retrieve is verified: the
share of the template's shingles that the whole document contains must be 0.8 or more.

Windows and bands are rows only within a task, between two explodes and the look-up, as plain expressions that compile;
what leaves it are the distinct candidates. A candidate is a document row by the hash of its id and text, so repeated rows and rows without
doc_id are results like others, and a chance collision costs one verification more. Null, empty and shorter texts have no
matches. Templates are a small fixed table, whose keys are broadcast. One row for each document row and template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

WIDTH, BLOCK, BANDS, FEW, LEAST = 5, 8, 24, 5, 0.8
#: Notices and texts of common licences.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
}


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingled(rows: DataFrame) -> DataFrame:
    """rows with `own`, the hashes of each run of WIDTH words of their text in order, instead of the text."""
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (WIDTH - 1), F.lit(1)))
    run = F.transform(starts, lambda i: F.xxhash64(*(F.try_element_at("_w", i + j) for j in range(WIDTH))))
    return rows.select(*others, F.when(F.size("_w") >= WIDTH, run).otherwise(F.array().cast("array<bigint>")).alias("own"))


def least(hashes: Column) -> Column:
    """The least value of each of BANDS hash functions over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def keys_of(templates: DataFrame) -> DataFrame:
    """key and template, from template and own: the band values of all its windows, or its shingles if they are FEW."""
    n = F.size("own")
    starts = F.sequence(F.lit(1), F.greatest(n - (2 * BLOCK - 1), F.lit(1)))
    bands = F.flatten(F.transform(starts, lambda i: least(F.slice("own", i, 2 * BLOCK))))
    return templates.select("template", F.explode(F.array_distinct(F.when(n < FEW, F.col("own")).otherwise(bands))).alias("key"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, template, containment and first_word (place of the first shared shingle, from 0)."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()))
    known = shingled(docs.sparkSession.range(1).select(F.explode(rows).alias("t")).select("t.*")).withColumn("own", F.array_distinct("own")).where(F.size("own") > 0)
    row_key = F.xxhash64("doc_id", "text").alias("row")
    # explode_outer: for explode() a filter on the array would move down and make the words once more.
    # Each window as an array of its own, so that no row carries the whole text's. Where the text ends the window's first
    # shingle stands again, which changes no least value.
    starts = F.sequence(F.lit(1), F.greatest(F.size("own"), F.lit(1)), F.lit(BLOCK))
    cut = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), F.lit(2 * BLOCK - 1)), lambda j: F.coalesce(F.try_element_at("own", i + j), F.try_element_at("own", i), F.lit(0))))
    runs = shingled(docs.select(row_key, "text")).select("row", F.explode_outer(cut).alias("w"))
    runs = runs.select("row", *(F.get("w", F.lit(i)).alias(f"s{i}") for i in range(2 * BLOCK)))
    # Bands from BANDS on are the shingles of the window's first block, which are the keys of short templates.
    runs = runs.select("*", F.explode_outer(F.sequence(F.lit(0), F.lit(BANDS + BLOCK - 1))).alias("band"))
    value = F.least(*(F.xxhash64(f"s{i}", "band") for i in range(2 * BLOCK)))
    single = F.col("s0")
    for i in range(1, BLOCK):
        single = F.when(F.col("band") == BANDS + i, F.col(f"s{i}")).otherwise(single)
    keys = runs.select("row", F.when(F.col("band") < BANDS, value).otherwise(single).alias("key"))
    met = keys.join(F.broadcast(keys_of(known)), "key").select("row", "template").distinct()
    found = docs.select(row_key, "doc_id", "text").join(met, "row").select("doc_id", "text", "template")
    both = shingled(found).withColumnRenamed("own", "all").join(F.broadcast(known), "template")
    shared = both.select("doc_id", "template", "all", F.size("own").alias("n"), F.array_intersect("own", "all").alias("shared"))
    containment = F.size("shared").cast("double") / F.col("n")
    at = F.array_min(F.transform("shared", lambda h: F.array_position("all", h))) - 1
    return shared.select("doc_id", "template", containment.alias("containment"), at.alias("first_word")).where(F.col("containment") >= LEAST)
