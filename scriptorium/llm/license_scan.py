"""License scan: MinHash bands over text windows, then exact shingle containment.

Everything is a DataFrame expression over one row of the input; only the matches found are
shuffled, to make equal rows one.

Words are what stands between ASCII white space, lower-cased, without punctuation at
either end (what is nothing but punctuation is no word); shingles are five words (a
shorter text: all its words). A document is looked at through windows of ``WIDE`` shingles
that overlap, one starting every ``STEP`` shingles, the last ones as short as the text makes
them. A window's signature has ``BANDS`` bands of one minimum each, of the shingle hashes
XORed with a constant of the band. Templates of ``WIDE`` shingles or more are cut into
windows at every start; of shorter ones each shingle is a window, compared with each
shingle of the document (a window of one shingle has the same minimum in each band: one
band says it all). Two windows whose shingles overlap by a Jaccard share s agree in some
band with probability 1 - (1 - s) ** BANDS: a window within a copied passage equals one of
the template's (s = 1), at s = 0.5 eight bands find 0.996.

A template one of whose windows agrees is verified exactly: the share of its distinct
shingles, as strings, that the whole document holds must reach ``least`` (0.8). What is
returned is every verified (document, template) with that share and the words between
which its shingles lie.

Texts that are null, empty or without words give no rows; nor does an empty table. A null
key is a key like any other; repeated rows give equal matches, which are returned once. Templates are a bounded parameter (at most
``MOST`` windows), held in the plan as literals; a template without words is refused. Only
the two columns are read, whatever other columns are called."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WIDE, STEP, BANDS = 5, 8, 4, 8
MOST = 20_000
BLANK = r"[\x09-\x0D\x20]+"
EDGE = ".,;:!?()[]{}<>\"'`*_#|/\\&%$~=+-"

# Notices by which works commonly name their license.
TEMPLATES = [
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    (
        "mit-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "bsd-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "gpl-2.0-header",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "lgpl-2.1-header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "agpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mit-disclaimer",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    (
        "bsd-disclaimer",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED.",
    ),
    (
        "zlib-notice",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
    ),
    ("boost-1.0-line", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense-line", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "cc0-1.0-notice",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty.",
    ),
]


def band_constants() -> list[int]:
    return np.random.default_rng(9).integers(-(2**63), 2**63 - 1, BANDS, dtype=np.int64).tolist()


def words_of(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK)
    return F.array_remove(F.transform(parts, lambda w: F.btrim(w, F.lit(EDGE))), "")


def shingle_texts(words: Column) -> Column:
    n = F.size(words) - F.lit(SHINGLE - 1)
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    )


def word_hashes(text: Column) -> Column:
    """XXH64 of each word, the empty ones taken out by their hash."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK)
    return F.array_remove(F.transform(parts, lambda w: F.xxhash64(F.btrim(w, F.lit(EDGE)))), F.xxhash64(F.lit("")))


def shingle_hashes(words: Column) -> Column:
    """A hash for each shingle, from the hashes of its words."""
    n = F.size(words) - F.lit(SHINGLE - 1)
    each = lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(SHINGLE)])
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), each))


def with_bands(df: DataFrame, hashes: str, step: int, keep: list[str]) -> DataFrame:
    """A row for each window that starts every ``step`` shingles, with its band minima
    ``b0`` ... and ``h0`` ..., its first ``step`` shingles. One generated loop over the
    shingle hashes: the window's eight are read once and every band is a ``least`` of them.
    ``pin`` keeps the optimizer from moving filters on the bands below this projection,
    where each would work its band out again."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(step)))
    w = df.select(*keep, hashes, start.alias("at"))
    own = [F.get(F.col(hashes), F.col("at") + F.lit(k)) for k in range(WIDE)]
    bands = [F.least(*[h.bitwiseXOR(F.lit(c)) for h in own]).alias(f"b{i}") for i, c in enumerate(band_constants())]
    return w.select(*keep, "at", *[h.alias(f"h{k}") for k, h in enumerate(own[:step])], *bands, F.monotonically_increasing_id().alias("pin"))


def staged(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of working it out again (an optimizer
    that merged it into a lambda would do so for every element)."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def template_table(spark, templates: list[tuple[str, str]]) -> list[dict]:
    """(template, shingles, bands: band minima of its windows by band, single: the hashes of
    its shingles if they are fewer than a window) of each template."""
    if sum(len(t.split()) for _, t in templates) > MOST:
        raise ValueError(f"templates of more than {MOST} words")
    rows = spark.createDataFrame(templates, "template string, body string")
    rows = staged(rows.select("template", words_of(F.col("body")).alias("words"), word_hashes(F.col("body")).alias("wh")), "h", shingle_hashes(F.col("wh")))
    out = {}
    for r in rows.select("template", F.array_distinct(shingle_texts(F.col("words"))).alias("shingles"), "h").collect():
        if not r.shingles:
            raise ValueError(f"template {r.template} has no words")
        out[r.template] = {"template": r.template, "shingles": r.shingles, "bands": [set() for _ in range(BANDS)], "single": set(r.h) if len(r.h) < WIDE else set()}
    windows = with_bands(rows.where(F.size("h") >= WIDE).withColumn("n", F.size("h")), "h", 1, ["template", "n"])
    for r in windows.where(F.col("at") + WIDE <= F.col("n")).collect():
        for k in range(BANDS):
            out[r.template]["bands"][k].add(r[f"b{k}"])
    return list(out.values())


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, n_shingles, n_found, containment, first_word, last_word), words
    counted from 0, for every document and template that match; equal rows are one."""
    table = template_table(docs.sparkSession, templates)
    d = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    d = staged(d, "wh", word_hashes(F.col("t")))
    d = staged(d, "h", shingle_hashes(F.col("wh"))).select("k", "t", "h")
    windows = with_bands(d, "h", STEP, ["k", "t"])
    bands, single = [set().union(*(t["bands"][k] for t in table)) for k in range(BANDS)], set().union(*(t["single"] for t in table))
    tests = [F.col(f"b{k}").isin(sorted(x)) for k, x in enumerate(bands) if x] + [F.col(f"h{k}").isin(sorted(single)) for k in range(STEP) if single]
    any_ = F.lit(False)
    for test in tests:
        any_ = any_ | test
    hits = windows.where((F.col("pin") >= 0) & any_)
    # Few windows come this far: which template it is, then the exact check over the whole text.
    names = []
    for t in table:
        own = [F.col(f"b{k}").isin(sorted(t["bands"][k])) for k in range(BANDS) if t["bands"][k]] + [F.col(f"h{k}").isin(sorted(t["single"])) for k in range(STEP) if t["single"]]
        one = own[0]
        for test in own[1:]:
            one = one | test
        names.append(F.when(one, F.struct(F.lit(t["template"]).alias("template"), F.array(*map(F.lit, t["shingles"])).alias("shingles"))))
    hits = staged(hits, "w", words_of(F.col("t")))
    pairs = staged(hits, "x", shingle_texts(F.col("w"))).select("k", "x", F.explode(F.array_compact(F.array(*names))).alias("m"))
    found = pairs.select("k", "x", "m.template", "m.shingles", F.size(F.array_intersect("m.shingles", "x")).alias("n_found"))
    share = F.col("n_found") / F.size("shingles")
    where = F.filter(F.transform("x", lambda v, i: F.when(F.array_contains(F.col("shingles"), v), i)), lambda i: i.isNotNull())
    out = found.where(share >= F.lit(least)).select("k", "template", F.size("shingles").alias("n_shingles"), "n_found", share.alias("containment"), where.alias("at"))
    # A passage is found through several windows.
    return out.select(F.col("k").alias(key), "template", "n_shingles", "n_found", "containment", F.array_min("at").alias("first_word"), (F.array_max("at") + F.lit(SHINGLE - 1)).alias("last_word")).distinct()
