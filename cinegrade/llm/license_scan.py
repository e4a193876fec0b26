"""License scan: MinHash bands over overlapping text windows retrieve templates, containment verifies.

Built-in functions only. A text becomes words and shingles of SHINGLE words. Shingles with a word
that no template has can be in no template, so windows are filled from the others alone; texts
without any drop out in the scan, and no text is shuffled.

Templates fall into classes by their number of shingles n: width w is the power of two with
w / 2 < n <= w. A class has windows of SPAN * w positions that begin at every w-th position, so every span of
(SPAN - 1) * w positions lies whole inside one of them: a template is found wherever it stands, also with w
further words put into it. If a window holds the share c of a template's shingles, their
Jaccard similarity is at least c n / (SPAN * w + (1 - c) n); with one hash to a band, `bands_for` gives the number of bands at which such a pair misses all of them with
probability MISS at most. Retrieved pairs are verified exactly: the share of the template's
shingles that the window has.

Defined cases: null and empty texts match nothing; a template of fewer than SHINGLE words is an
error, as it has no shingle; equal rows give equal matches once per row; an empty table or no
template gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import hinted, written

SHINGLE, SHARE, MISS = 5, 0.8, 1e-3
SPAN = 3
WORD = "[\\p{L}\\p{N}]+"
#: Wordings of public license notices.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
                 "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    ("apache-2.0-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bands_for(share: float = SHARE, miss: float = MISS) -> int:
    """Bands of one hash at which the least similar window and template miss each other with probability `miss`."""
    least = share * 0.5 / (SPAN + (1 - share) * 0.5)  # n just over w / 2
    return math.ceil(math.log(miss) / math.log(1 - least))


def _shingle(words: Column, at: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, F.lit(SHINGLE)), " ")


def _bands(shingles: Column, bands: int) -> Column:
    """(band, least): the least hash of the shingles under each band's seed."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda band: F.struct(
        band.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band))).alias("least")))


def template_table(templates: DataFrame) -> DataFrame:
    """template_id, shingles (distinct) and width of (template_id, text) rows."""
    words = templates.select("template_id", words_of(F.col("text")).alias("words"))
    short = words.where(F.size("words") < SHINGLE).select("template_id").first()
    if short:
        raise ValueError(f"template {short[0]} has fewer than {SHINGLE} words")
    at = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    shingles = words.select("template_id", "words", F.array_distinct(F.transform(at, lambda i: _shingle(F.col("words"), i))).alias("shingles"))
    width = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int")
    return shingles.select("template_id", "words", "shingles", width.alias("width"))


def notices(spark) -> DataFrame:
    return spark.createDataFrame(NOTICES, "template_id string, text string")


def license_matches(docs: DataFrame, templates: DataFrame, share: float = SHARE, miss: float = MISS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template_id, containment (share of the template's shingles in the best window) and first_word,
    where that window's first shingle stands, for each row and template whose containment is at least `share`.

    templates: (template_id, text), a list for people to keep up; its words are put into the plan. An id may
    have several wordings; the best one counts.
    """
    known = written(template_table(templates), "templates")
    vocabulary = [r[0] for r in known.select(F.explode("words").alias("w")).distinct().orderBy("w").collect()]
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    bands = bands_for(share, miss)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    rows = rows.where(F.size("words") >= SHINGLE)

    def all_known(i: Column) -> Column:
        found = F.lit(True)
        for k in range(SHINGLE):
            found = found & F.get("words", i + k).isin(vocabulary)
        return found

    places = F.filter(F.sequence(F.lit(0), F.size("words") - SHINGLE), all_known)
    found = rows.select("doc_id", "row", "words", places.alias("places")).where(F.size("places") > 0)
    shingles = found.select("doc_id", "row", F.explode(F.transform("places", lambda i: F.struct(i.alias("at"), _shingle(F.col("words"), i).alias("shingle")))).alias("s"))
    in_windows = shingles.select("doc_id", "row", "s.*", F.explode(F.array(*(F.lit(w) for w in widths))).alias("width"))
    window = F.floor(F.col("at") / F.col("width"))
    in_windows = in_windows.select("doc_id", "row", "width", "at", "shingle", F.explode(F.array(*[window - k for k in range(SPAN)])).alias("window"))
    windows = in_windows.groupBy("doc_id", "row", "width", "window").agg(
        F.collect_set("shingle").alias("held"), F.min("at").alias("first_word"))  # SPAN * w shingles at most
    marked = windows.select("doc_id", "row", "width", "window", "first_word", "held", F.explode(_bands(F.col("held"), bands)).alias("b"))
    marked = marked.select("doc_id", "row", "width", "window", "first_word", "held", "b.*")
    of_templates = known.select("template_id", "shingles", "width", F.explode(_bands(F.col("shingles"), bands)).alias("b")).select("template_id", "shingles", "width", "b.*")
    met = marked.join(hinted(of_templates, 65_536), ["width", "band", "least"])
    verified = met.withColumn("containment", F.size(F.array_intersect("held", "shingles")) / F.size("shingles")).where(F.col("containment") >= share)
    best = verified.groupBy("doc_id", "row", "template_id").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "template_id", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"))
