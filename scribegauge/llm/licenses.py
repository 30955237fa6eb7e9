"""License scans by MinHash bands over overlapping windows, with built-in functions only.

Texts and license templates are sequences of five-word shingles. Windows of WIDE shingles, every second one, are
reduced to a MinHash value per band (the least shingle hash under that band's permutation, here an exclusive or with a
constant); templates are reduced likewise at every offset. Equal values retrieve a template. A text that holds 0.8 of
a template's shingles holds a run of WIDE + 1 of them unbroken, because a changed word breaks five at most; some window
lies in that run, and equal windows agree in every band: retrieval is certain. Templates too short for that are
retrieved by windows of one shingle. Then the exact share of the template's shingles in the text decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, text_of, without, written
from .lookup import owners_of, rows_with, text_key, texts_of, token_hashes

SHINGLE, WIDE, STEP, CONTAINMENT = 5, 4, 2, 0.8
#: One constant a band.
BANDS = (0x1B873593CC9E2D51, 0x5BD1E995C2B2AE35)

#: Notices of public licenses, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def templates_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, notice string")


def _shingles(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, step: int) -> list[Column]:
    """For each band, the values of windows that begin at every step-th shingle; windows at the end are shorter."""
    starts = F.when(F.size(shingles) > 0, F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def band(b: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(F.lit(b), F.least(*[F.get(shingles, i + k).bitwiseXOR(F.lit(BANDS[b])) for k in range(WIDE)])))

    return [band(b) for b in range(len(BANDS))]


def licensed(docs: DataFrame, text_column: str = "text", templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """docs plus license, template, matched, shingles and containment: a row for each row of docs and template it holds.

    matched of the template's distinct shingles occur in the text; containment is their share. Templates of fewer than
    five words match nothing. Null and empty texts match nothing; equal texts match alike; an empty table gives no rows.
    Input columns named as an output are replaced. templates: (template int, license, notice), by default TEMPLATES.
    """
    need(docs, text_column)
    outputs = ("license", "template", "matched", "shingles", "containment")
    docs = without(docs, *outputs)
    known = templates if templates is not None else templates_table(docs.sparkSession)
    known = written(known.select("template", "license", token_hashes(text_of("notice")).alias("__sg_tokens")).select("template", "license", _shingles(F.col("__sg_tokens")).alias("__sg_known")).where(F.size("__sg_known") > 0), "license-templates")
    full = [F.slice(band, 1, F.size("__sg_known") - WIDE + 1) for band in _bands(F.col("__sg_known"), 1)]
    values = F.when(F.size("__sg_known") > WIDE + 1, F.concat(*full)).otherwise(F.col("__sg_known"))
    seeds = written(known.select("template", F.explode(values).alias("seed")).distinct(), "license-seeds")

    text = text_of(text_column)
    rows = docs.select(text_key(text).alias("__sg_key"), token_hashes(text).alias("__sg_tokens")).select("__sg_key", _shingles(F.col("__sg_tokens")).alias("__sg_all"))
    windows = rows.select("__sg_key", F.explode_outer(F.concat(F.col("__sg_all"), *_bands(F.col("__sg_all"), STEP))).alias("seed"))
    hits = written(owners_of(windows, seeds).select("__sg_key", "template").distinct(), "license-hits")
    texts = texts_of(docs, text_column, hits.select("__sg_key").distinct())
    # in steps: what a lambda refers to must be a column, or it would be computed anew for every element
    texts = texts.select(F.reverse("__sg_key").alias("__sg_other"), token_hashes(F.col("__sg_text")).alias("__sg_tokens"))
    texts = texts.select("__sg_other", F.array_distinct(_shingles(F.col("__sg_tokens"))).alias("__sg_all"))
    pairs = hits.join(texts, F.reverse("__sg_key") == F.col("__sg_other")).join(known, "template")
    wanted = F.array_distinct("__sg_known")
    verdicts = pairs.select("__sg_key", "license", "template", F.size(F.array_intersect(wanted, "__sg_all")).cast("long").alias("matched"), F.size(wanted).cast("long").alias("shingles"))
    verdicts = written(verdicts.withColumn("containment", F.col("matched") / F.col("shingles")).where(F.col("containment") >= containment), "license-verdicts")
    return rows_with(docs, text_column, verdicts)
