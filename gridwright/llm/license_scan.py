"""License scan, SQL functions only.

Over each document lie windows of twice a template's length that overlap by
half, so any passage up to one word longer than the template lies wholly in one
of them. Windows of that size also open at each shingle shared with a template:
moving a window right to its first shared shingle loses none, so no passage of
up to twice the template's length is missed, wherever it starts. Windows that hold a shingle of some template get a MinHash signature and meet
the templates in bands of one value each. A passage with containment ``c`` of
the template's shingles makes the window's Jaccard similarity at least ``j``;
the number of bands is the smallest with ``1 - (1 - j) ** bands >=
PROBABILITY`` for every template length. Retrieved templates are verified by
the exact containment of their shingles in the window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import written
from gridwright.llm.passages import LITERALS, SHINGLE, hit_windows, passage_table

CONTAINMENT = 0.8
PROBABILITY = 0.999

# Notices of public licenses.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation; either version 2 of "
                         "the License, or (at your option) any later version."),
    ("LGPL", "licensed under the GNU Lesser General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("template_id"), F.lit(n).alias("license"), F.lit(t).alias("text"))
            for k, (n, t) in enumerate(NOTICES)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def bands_for(n: int, containment: float = CONTAINMENT, probability: float = PROBABILITY) -> int:
    """Bands of one row for a template of ``n`` words in windows of ``2 n``."""
    own, window = n - SHINGLE + 1, 2 * n - SHINGLE + 1
    shared = math.ceil(containment * own)
    j = shared / (own + window - shared)
    return 1 if j >= 1 else math.ceil(math.log(1 - probability) / math.log(1 - j))


def minhash_sql(hashes: str, bands: int) -> str:
    return f"transform(sequence(0, {bands - 1}), j -> array_min(transform({hashes}, h -> xxhash64(h, j))))"


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, literals: int = LITERALS) -> DataFrame:
    """``doc_id, license, template_id, window_start, window_words,
    containment, shared, places``: for each document and template the window
    that holds most of it; ``places`` is the number of half-overlapping windows
    that hold it, 1 if only a window at a shared shingle does.

    ``templates`` has ``template_id, license, text``. Null and empty texts
    hold nothing; templates of fewer than five words are not looked for.
    Repeated rows give one result. Of equally good windows the first counts.
    Documents shorter than a window are one window. Empty tables give an empty
    result; other columns are ignored."""
    t = written(passage_table(templates, "template_id", "text"), "templates")
    sizes = [r["n"] for r in t.select("n").distinct().collect()]  # as many as there are template lengths
    bands = max([bands_for(n, containment) for n in sizes], default=1)
    opened = ("array(struct(cast(n * (i div n) as int) as start, 2 * n as size), "
              "struct(cast(n * (i div n - 1) as int) as start, 2 * n as size), struct(i as start, 2 * n as size))")
    windows = written(hit_windows(docs, t, opened, literals), "license-windows")
    kinds = (windows.select("n", "win", F.xxhash64("win").alias("wk")).groupBy("n", "wk").agg(F.max("win").alias("win")))
    kinds = written(kinds, "license-kinds")
    signed = kinds.select("n", "wk", F.posexplode(F.expr(minhash_sql("win", bands))).alias("band", "v"))
    filed = t.select("n", "key", F.posexplode(F.expr(minhash_sql("sh", bands))).alias("band", "v"))
    pairs = signed.join(filed, ["n", "band", "v"]).select("n", "wk", "key").distinct()
    sure = (pairs.join(kinds, ["n", "wk"]).join(t.select("key", F.array_distinct("sh").alias("sh")), "key")
            .select("n", "wk", "key", F.size(F.array_intersect("win", "sh")).alias("shared"), F.size("sh").alias("own"))
            .withColumn("containment", F.col("shared") / F.col("own")).filter(F.col("containment") >= containment))
    best = F.max(F.struct("containment", (-F.col("start")).alias("s"), "shared", "n")).alias("x")
    found = (windows.select("doc_id", "tk", "n", "start", F.xxhash64("win").alias("wk")).join(sure, ["n", "wk"])
             .groupBy("doc_id", "tk", "key").agg(best, F.expr("greatest(1, count_if(start % n = 0))").alias("places")))
    names = templates.select("template_id", "license")
    return found.join(names, found["key"] == names["template_id"]).select(
        "doc_id", "license", "template_id", (-F.col("x.s")).alias("window_start"), (2 * F.col("x.n")).alias("window_words"),
        F.col("x.containment").alias("containment"), F.col("x.shared").alias("shared"), "places")
