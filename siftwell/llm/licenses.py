"""License scans in DataFrame expressions only.

A text is first reduced to its word pairs that are pairs of any template. Around these, it is cut into overlapping windows of 8
words, one every 4; windows without such a pair share no band with any template, so no bands are counted for them, nor for documents with fewer distinct ones than any
template needs. A window's band value is the least of its word-pair hashes under one of ``bands`` keys (a min-hash band of one row); a
window is a candidate when a band value is that of a window of a license template. A notice
of five words or more shares at least 4 of the 7 pairs of some window, so that at least one of 10 bands
meets with a probability over 0.999; where a whole window lies inside the template, all bands meet.

Candidates are verified by exact, ordered containment, whatever the template's length: a word pair of the document that is one of the template tells by how
much the one is shifted against the other. The template's pairs are counted, each once, among hits whose shifts differ by
less than a quarter of its pairs (two at least): so they stand in the template's order, but for that drift. ``containment_percent`` of the
pairs must stand there, rounded in the document's favour; the same rule holds at every length. ``first_word`` is where the verified hits begin. Of licenses that
are found from the same word on, those with the highest containment count.

The templates are a fixed, small table; its band values are literals in the plan.

Defined results: null and empty texts, and texts of one word, match nothing; the case of
letters and punctuation around words don't count; repeated rows count once per id; rows of one id
with different texts are looked at text by text, and the best one counts; rows with a null id are found
under a null id; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, save

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

#: Fixed texts of public license notices: short notices, file headers and whole short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-named": "This project is licensed under the Apache License 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-named": "This project is licensed under the MIT License",
    "MIT-permission": _MIT[: _MIT.index(", including")],
    "MIT-text": _MIT + _NO_WARRANTY,
    "BSD-redistribution": _BSD_2[: _BSD_2.index(" 1.")],
    "BSD-2-Clause-conditions": _BSD_2,
    "BSD-3-Clause-conditions": _BSD_2 + _BSD_3,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": _GNU[: _GNU.index(", either")].format("General Public License"),
    "GPL-2.0-header": _GNU.format("General Public License", 2),
    "GPL-3.0-header": _GNU.format("General Public License", 3),
    "LGPL-2.1-header": _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0-header": _GNU.format("Lesser General Public License", 3),
    "AGPL-3.0-header": _GNU.format("Affero General Public License", 3),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


@dataclass(frozen=True)
class LicenseParams:
    window: int = 8
    step: int = 4
    bands: int = 10
    containment_percent: int = 75


def _pairs(text: Column) -> Column:
    """Hash of every two neighbouring words."""
    plain = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.\-]+|(?<![\p{L}\p{N}])[.\-]+|[.\-]+(?![\p{L}\p{N}])")
    hashed = F.transform(F.array_remove(plain, ""), lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))))


def _bands(pairs: Column, starts: Column, p: LicenseParams) -> Column:
    """Array of (window's first word, band value) of the windows with these starts."""

    def of_window(at):
        # Told apart by the band: a value of one band is none of another.
        return let(F.slice(pairs, at + 1, p.window - 1), lambda own: F.array(*[
            F.struct(at.alias("at"), F.xxhash64(F.lit(k), F.array_min(F.transform(own, lambda x: x.bitwiseXOR(F.xxhash64(F.lit(f"license band {k}")))))).alias("value")) for k in range(p.bands)
        ]))

    return F.flatten(F.transform(starts, of_window))


def _all_starts(pairs: Column, p: LicenseParams) -> Column:
    return F.when(F.size(pairs) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(pairs) - p.window + 1, F.lit(0))))


def _starts_around(places: Column, p: LicenseParams) -> Column:
    """The window starts, multiples of the step, whose windows hold one of the places."""
    reach = -(-(p.window - 1) // p.step)
    return F.array_distinct(F.flatten(F.transform(places, lambda x: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda back: (F.floor(x["at"] / p.step).cast("int") - back) * p.step), lambda s: (s >= 0) & (s + p.window - 1 > x["at"])
    ))))


def _missing(k: int, p: LicenseParams) -> int:
    """How many of a template's k pairs may be missing."""
    return k * (100 - p.containment_percent) // 100


def templates(spark: SparkSession, p: LicenseParams = LicenseParams(), texts: dict[str, str] | None = None) -> DataFrame:
    """(license, value, wanted): the band values of all windows of every template, and its word pairs."""
    rows = spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")
    paired = rows.withColumn("pairs", _pairs(F.col("text")))
    windows = let(F.col("pairs"), lambda x: _bands(x, _all_starts(x, p), p))
    return paired.select("license", "pairs", F.explode(windows).alias("w")).select("license", "w.value", "pairs").distinct()


def licenses(docs: DataFrame, p: LicenseParams = LicenseParams(), id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the license notices in each document."""
    known = save(templates(docs.sparkSession, p, texts), "templates")
    values = [r[0] for r in known.select("value").distinct().collect()]  # as many as the templates have words
    wanted = known.select("license", "pairs").distinct()
    sizes = wanted.select(F.size(F.array_distinct("pairs")).alias("k"), F.explode("pairs").alias("pair")).collect()
    pairs_of_any = sorted({r["pair"] for r in sizes})
    least = min((r["k"] - _missing(r["k"], p) for r in sizes), default=1)

    def held(pairs):
        # Of a text's pairs, those of any template are kept, with their places. No template has fewer that must stand than the least.
        places = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("at"), x.alias("pair"))), lambda x: x["pair"].isin(pairs_of_any))
        some = lambda x: F.when(F.size(F.array_distinct(F.transform(x, lambda e: e["pair"]))) >= least, F.filter(_bands(pairs, _starts_around(x, p), p), lambda w: w["value"].isin(values)))
        return let(places, lambda x: F.struct(x.alias("places"), some(x).alias("met")))

    read = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), let(_pairs(docs[text_col]), held).alias("h"))
    met = save(read.where(F.size("h.met") > 0).select("doc_id", "version", "h.*").dropDuplicates(["doc_id", "version"]), "met")
    windows = met.select("doc_id", "version", F.explode("met").alias("w")).select("doc_id", "version", "w.*")
    found = windows.join(known.select("license", "value"), "value").groupBy("doc_id", "version", "license").agg(F.countDistinct("at").alias("n_windows"))
    by_pair = wanted.select("license", F.size(F.array_distinct("pairs")).alias("k"), F.posexplode("pairs").alias("pos", "pair"))
    placed = met.select("doc_id", "version", F.explode("places").alias("x")).select("doc_id", "version", "x.*").join(by_pair, "pair")
    # Hits whose shifts differ by less than the drift lie together in one of two neighbouring groups.
    shift = F.floor((F.col("at") - F.col("pos")) / F.greatest(F.floor(F.col("k") / 4), F.lit(2)))
    placed = placed.withColumn("shift", F.explode(F.array(shift, shift - 1)))
    first_seen = placed.groupBy("doc_id", "version", "license", "k", "shift", "pair").agg(F.min("at").alias("at"))
    held_pairs = first_seen.groupBy("doc_id", "version", "license", "k", "shift").agg(F.count("*").alias("n"), F.min("at").cast("long").alias("first_word"))
    enough = held_pairs.where(F.col("n") >= F.col("k") - F.floor(F.col("k") * (100 - p.containment_percent) / 100))
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col("first_word")).alias("back"))).alias("best")
    sure = enough.groupBy("doc_id", "version", "license", "k").agg(best).alias("s")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "version", "license")]
    both = sure.join(found.alias("f"), same[0] & same[1] & same[2]).select("s.doc_id", "s.version", "s.license", (F.col("s.best.n") / F.col("s.k")).alias("containment"), "f.n_windows", (-F.col("s.best.back")).alias("first_word"))
    top = F.max("containment").over(Window.partitionBy("doc_id", "version", "first_word"))
    both = both.withColumn("top", top).where("containment = top")
    return both.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.max("n_windows").alias("n_windows"), F.min("first_word").alias("first_word"))
