"""License scan in DataFrame operations only: MinHash bands over overlapping windows, then exact containment.

Words are lower-cased runs of letters and digits; features are shingles of five words. A template of ``n``
shingles is looked for in windows of ``2 n`` shingles that begin every ``n``, so a copy lies whole in some window.
A copy that keeps the share ``c`` of a template has Jaccard similarity of at least ``c / (3 - c)`` with its
window; with one row a band, ``b`` bands miss it with probability ``(1 - c / (3 - c)) ** b``, and ``b`` is chosen
so that this is below MISS. What the bands retrieve is verified by counting shared shingles.

Band keys are minima of rehashed shingles, so a window can only collide if it holds a shingle that is some
template's minimum. Documents without any such shingle are left out before windows are made; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
SHINGLE = 5
#: Least share of a template's shingles that a window must hold.
CONTAINED = 0.8
#: Highest probability that the bands miss a window that holds that share.
MISS = 1e-3
#: Templates are configuration: their shingles and band keys become constants of the plan, so a longer list is refused.
MOST_SHINGLES = 20_000

#: License notices in the wording of their publishers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "Mozilla-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "All-rights-reserved": "All rights reserved",
}


def bands_for(contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands of one row that miss a window with this containment with at most this probability."""
    return ceil(log(miss) / log(1 - contained / (3 - contained)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _joined(left: Column, right: Column, shift: int) -> Column:
    """``xxhash64(left[i], right[i + shift])`` for every i at which both are there."""
    n = F.least(F.size(left), F.size(right) - shift)
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b)))


def shingles_of(text: Column) -> Column:
    """``struct(words, s3, s5)``: the number of words, and the hashes of all shingles of three and of five words, in order."""
    last = lambda h, h2: _let(_joined(h2, h2, 2), lambda h4: F.struct(F.size(h).alias("words"), _joined(h2, h, 2).alias("s3"), _joined(h4, h, 4).alias("s5")))
    return _let(F.transform(words_of(text), lambda w: F.xxhash64(w)), lambda h: _let(_joined(h, h, 1), lambda h2: last(h, h2)))


def template_rows(spark: SparkSession, templates: dict[str, str], bands: int) -> tuple[DataFrame, DataFrame, dict[int, list[int]]]:
    """Templates (``template``, ``kind``, ``n``, ``shingles``), their bands (``kind``, ``n``, ``band``, ``key``, ``minimum``, ``template``) and all minima by kind.

    ``kind`` is the size of a template's shingles: five, or three if it has fewer words. Both tables are bounded by the list.
    """
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").select("template", shingles_of(F.col("text")).alias("s"))
    kind = F.when(F.col("s.words") >= SHINGLE, 5).otherwise(3)
    shingles = F.array_distinct(F.when(F.col("s.words") >= SHINGLE, F.col("s.s5")).otherwise(F.col("s.s3")))
    known = rows.select("template", kind.alias("kind"), F.size(shingles).alias("n"), shingles.alias("shingles")).collect()
    if any(r.n < 1 for r in known):
        raise ValueError("a template has at least three words")
    if sum(r.n for r in known) > MOST_SHINGLES:
        raise ValueError(f"templates have at most {MOST_SHINGLES} shingles together")
    table = spark.createDataFrame([(r.template, r.kind, r.n, r.shingles) for r in known], "template string, kind int, n int, shingles array<bigint>")
    keyed = table.select("template", "kind", "n", F.explode("shingles").alias("s")).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    lowest = keyed.groupBy("template", "kind", "n", "band").agg(F.min(F.struct(F.xxhash64("s", "band").alias("key"), F.col("s"))).alias("m")).select("kind", "n", "band", "m.key", F.col("m.s").alias("minimum"), "template").collect()
    minima = {k: sorted({r.minimum for r in lowest if r.kind == k}) for k in (3, 5)}
    return table, spark.createDataFrame([tuple(r) for r in lowest], "kind int, n int, band int, key bigint, minimum bigint, template string"), minima


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, miss: float = MISS) -> DataFrame:
    """``doc_id``, ``template``, ``containment``, ``first_word`` of every template found in every row of ``docs`` (``doc_id``, ``text``).

    ``containment`` is the largest share of the template's shingles in one window, ``first_word`` where the first such window
    begins. Whole texts are scanned. Templates of fewer than five words use shingles of three. Null and empty texts hold
    nothing; repeated rows and repeated ids give one row per template, rows without a ``doc_id`` one row with a null id;
    extra columns are ignored; an empty table gives no rows.
    """
    spark, bands = docs.sparkSession, bands_for(contained, miss)
    known, keys, minima = template_rows(spark, templates, bands)

    def hits(s: Column, kind: int) -> Column:
        at = F.transform(s, lambda h, i: F.when(h.isin(minima[kind]), F.struct(F.lit(kind).alias("kind"), i.alias("at"), h.alias("h"))))
        return F.filter(at, lambda x: x.isNotNull())

    whole = lambda s: F.struct(s["s3"].alias("s3"), s["s5"].alias("s5"), F.concat(hits(s["s3"], 3), hits(s["s5"], 5)).alias("hits"))
    near = F.filter(F.array(_let(shingles_of(F.col("text").cast("string")), whole)), lambda x: F.size(x["hits"]) > 0)
    # Windows that hold a minimum of some template of their length; the sizes of these tables are bounded by the list.
    lengths = keys.select("kind", "n", F.col("minimum").alias("h")).distinct()
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(near).alias("d")).select("doc_id", "d.s3", "d.s5", F.explode("d.hits").alias("x")).select("doc_id", "s3", "s5", "x.*")
    block = (F.col("at") / F.col("n")).cast("int")
    begins = F.array_distinct(F.array(block * F.col("n"), F.greatest(block - 1, F.lit(0)) * F.col("n")))
    windows = hit.join(F.broadcast(lengths), ["kind", "h"]).withColumn("begin", F.explode(begins))
    own = F.array_distinct(F.slice(F.when(F.col("kind") == 3, F.col("s3")).otherwise(F.col("s5")), F.col("begin") + 1, 2 * F.col("n")))
    windows = windows.select("doc_id", "kind", "n", "begin", own.alias("own")).distinct()
    # Bands retrieve templates, shared shingles decide.
    lowest = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("own", lambda h: F.xxhash64(h, b))).alias("key")))
    banded = windows.select("*", F.explode(lowest).alias("b")).select("doc_id", "kind", "n", "begin", "own", "b.*")
    retrieved = banded.join(F.broadcast(keys), ["kind", "n", "band", "key"]).select("doc_id", "begin", "own", "template").distinct()
    share = F.size(F.array_intersect("own", "shingles")) / F.col("n")
    verified = retrieved.join(F.broadcast(known), "template").select("doc_id", "template", share.alias("share"), "begin").where(F.col("share") >= contained)
    return verified.groupBy("doc_id", "template").agg(F.max("share").alias("containment"), F.min(F.struct((-F.col("share")).alias("c"), F.col("begin").alias("at"))).alias("best")).select("doc_id", "template", "containment", F.col("best.at").alias("first_word"))
