"""License notices in documents, by MinHash bands over overlapping windows. DataFrame functions only.

A passage matches a template when it holds at least `threshold` of the template's word shingles.
Words are runs of a-z and 0-9 of the text in lower case, shingles five words (a shorter template is
one shingle). Steps:

1. Cue words are chosen so that more than a fifth of every template's shingles hold one. A passage
   that matches therefore holds a cue; only documents with one are cut into words. Their shingles are
   hashed once; from then on no row holds words, only hashes of a window.
2. Overlapping windows around the cues, for each template length n: n + step - 1 words at every
   step-th word, step = n // 8 or 1, so that any n words lie within one window.
3. MinHash signatures, 24 bands of 2. A window around a match has a Jaccard similarity of about 0.6
   or more to the template and shares a band with a chance above 0.9999.
4. Exact containment of the template's shingles decides. Of each document and template the window
   with the highest containment is reported, the first of equal ones.
5. A passage with words put in may be longer than any window. Its shingles with a cue are looked up
   exactly (by step 1 it has one). Where no window matches, the shortest span of at most STRETCH times
   the template's words that holds enough of its shingles is reported, the first of equal ones.

Templates are a parameter, a bounded list kept on the driver. A null or empty text matches nothing,
rows with a null id give no row, rows of one doc_id are one document. Other columns are not read. Memory
is a fixed multiple of one text, whatever cue words it holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SHINGLE, THRESHOLD, BANDS, ROWS, STRETCH = 5, 0.8, 24, 2, 3

# Notices by which public licenses are declared, and short licenses as a whole.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0-boilerplate": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "GFDL": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Words that are good cues, tried first.
CUES = ["license", "licensed", "licence", "copyright", "redistribution", "permission"]


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _shingles(words: list[str], size: int) -> list[tuple]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def cue_words(templates: dict[str, str], size: int, threshold: float) -> set[str]:
    """Words such that less than `threshold` of each template's shingles are without one."""
    chosen: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        order = [c for c in CUES if c in words] + sorted(set(words), key=lambda w: (-len(w), w))
        for cue in order:
            shingles = _shingles(words, size)
            if sum(not chosen & set(s) for s in shingles) < threshold * len(shingles) - 1e-9:
                break
            chosen.add(cue)
    return chosen


def hashed_shingles(words: str, size: int) -> str:
    """Hashes of all runs of `size` words, in order; of fewer words none."""
    return f"transform(CASE WHEN size({words}) >= {size} THEN sequence(0, size({words}) - {size}) ELSE array() END, i -> xxhash64(array_join(slice({words}, i + 1, {size}), ' ')))"


def band_values(shingles: str, bands: int, rows: int) -> Column:
    """One hash a band of the smallest hashes of the shingles under bands * rows functions."""
    low = f"array_min(transform({shingles}, x -> xxhash64(x, b * {rows} + r)))"
    return F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, transform(sequence(0, {rows - 1}), r -> {low})))")


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, shingle: int = SHINGLE, stretch: float = STRETCH) -> DataFrame:
    """(doc_id, license, start_word, n_words, containment)."""
    listed = {k: template_words(v) for k, v in (templates or TEMPLATES).items() if template_words(v)}
    cues = sorted(cue_words({k: " ".join(w) for k, w in listed.items()}, shingle, threshold))
    clean = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    cued = docs.where("doc_id is not null").where(F.lower("text").rlike("(?:" + "|".join(cues) + ")") if cues else F.lit(False))
    words = materialize(cued.select("doc_id", F.split(clean, " ").alias("words")).distinct(), "license_words")

    best = None
    for size in sorted({min(shingle, len(w)) for w in listed.values()}):
        own = {k: w for k, w in listed.items() if min(shingle, len(w)) == size}
        found = _windows(words, own, cues, size, threshold)
        if size == shingle:
            found = found.unionByName(_broken_passages(words, own, cues, size, threshold, stretch))
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = words.select("doc_id", F.lit("").alias("license"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("held")).alias("w"), F.lit(0).alias("broken")).where("false")
    best = best.groupBy("doc_id", "license").agg(F.min_by("w", "broken").alias("w"))  # windows first
    return best.select("doc_id", "license", F.col("w.start").cast("int").alias("start_word"), F.col("w.n").cast("int").alias("n_words"), F.round("w.held", 6).alias("containment"))


def _known(words: DataFrame, listed: dict[str, list[str]], size: int) -> DataFrame:
    """(license, n, wanted): the templates' distinct shingles, a bounded parameter."""
    rows = words.sparkSession.createDataFrame(list(listed.items()), "license string, words array<string>")
    return rows.select("license", F.size("words").alias("n"), F.array_distinct(F.expr(hashed_shingles("words", size))).alias("wanted"))


def _windows(words: DataFrame, listed: dict[str, list[str]], cues: list[str], size: int, threshold: float) -> DataFrame:
    """(doc_id, license, w, broken): the best window of each document and template."""
    known = _known(words, listed, size)
    marked = ", ".join(f"'{c}'" for c in cues)
    spots = f"filter(sequence(0, size(words) - 1), i -> element_at(words, i + 1) IN ({marked}))"
    text = words.select("doc_id", F.expr(hashed_shingles("words", size)).alias("h"), F.expr(spots).alias("spots"))
    lengths = sorted({len(w) for w in listed.values()})
    shapes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(max(1, n // 8)).alias("step")) for n in lengths])
    shaped = text.select("doc_id", "h", "spots", F.explode(shapes).alias("shape")).select("doc_id", "h", "spots", "shape.*")
    starts = "array_distinct(flatten(transform(spots, a -> sequence(greatest(0, a - n - step + 2 + step - 1) div step, a div step))))"
    cut = f"transform({starts}, i -> struct(int(i * step) AS start, array_distinct(slice(h, int(i * step) + 1, greatest(n + step - {size}, 1))) AS shingles))"
    windows = shaped.select("doc_id", "n", F.explode(F.expr(cut)).alias("win")).select("doc_id", "n", "win.*").where(F.size("shingles") > 0)
    banded = windows.withColumn("band", F.explode(band_values("shingles", BANDS, ROWS)))
    bands = known.select("license", "n", "wanted", F.explode(band_values("wanted", BANDS, ROWS)).alias("band"))
    hits = banded.join(F.broadcast(bands), ["n", "band"])  # the templates are a bounded parameter
    held = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    found = hits.select("doc_id", "license", "start", "n", held.alias("held")).where(F.col("held") >= threshold - 1e-9)
    best = F.max_by(F.struct("start", "n", "held"), F.struct("held", -F.col("start")))
    return found.groupBy("doc_id", "license").agg(best.alias("w"), F.lit(0).alias("broken"))


def _broken_passages(words: DataFrame, listed: dict[str, list[str]], cues: list[str], size: int, threshold: float, stretch: float) -> DataFrame:
    """(doc_id, license, w, broken): the shortest span that holds enough shingles of a template."""
    longer = {k: w for k, w in listed.items() if len(w) > size}
    known = _known(words, longer, size).withColumn("reach", F.floor(F.col("n") * stretch - size).cast("int"))
    with_cue = words.sparkSession.createDataFrame(
        [(k, " ".join(w[i : i + size])) for k, w in longer.items() for i in range(len(w) - size + 1) if set(w[i : i + size]) & set(cues)], "license string, gram string"
    )
    cued = with_cue.select("license", F.xxhash64("gram").alias("gram"))
    grams = known.select("license", F.size("wanted").alias("total"), "reach", F.explode("wanted").alias("gram"))
    places = words.select("doc_id", F.posexplode(F.expr(hashed_shingles("words", size))).alias("i", "gram"))
    pairs = places.join(F.broadcast(cued), "gram").select("doc_id", "license").distinct()  # the templates are a bounded parameter
    held = places.join(F.broadcast(grams), "gram").join(pairs, ["doc_id", "license"], "left_semi")
    most = max((int(len(w) * stretch) for w in longer.values()), default=0)
    ahead = Window.partitionBy("doc_id", "license").orderBy("i").rangeBetween(0, most)  # of one document
    span = F.filter(F.collect_list(F.struct("i", "gram")).over(ahead), lambda x: x["i"] <= F.col("i") + F.col("reach"))
    need = F.ceil(F.col("total") * threshold - 1e-9)
    full = held.withColumn("span", span).where(F.size(F.array_distinct(F.transform("span", lambda x: x["gram"]))) >= need)
    kinds = lambda to: F.size(F.array_distinct(F.transform(F.filter("span", lambda z: z["i"] <= to), lambda z: z["gram"])))
    ends = F.array_min(F.transform(F.filter("span", lambda y: kinds(y["i"]) >= need), lambda y: y["i"]))
    ended = full.withColumn("end", ends).withColumn("share", kinds(F.col("end")) / F.col("total"))
    length = F.col("end") - F.col("i") + size
    passage = F.struct(F.col("i").alias("start"), length.cast("int").alias("n"), F.col("share").alias("held"))
    shortest = F.min_by(passage, F.struct(length, F.col("i")))
    return ended.groupBy("doc_id", "license").agg(shortest.alias("w"), F.lit(1).alias("broken"))
