"""License scans: TF-IDF cosine to templates, then inheritance along paths.

Every whole text is searched for notices: lines or sentences with a word that
licence texts use. A notice becomes a sparse TF-IDF vector; the document
frequencies of all terms are counted over all notices of the corpus and joined
back to the notices' terms, each distinct notice being weighed once. The
notice's licence is the template of the largest cosine, if that reaches
``threshold``; a file's own licence is that of its best notice.

A file without one inherits: the licence files (LICENSE, COPYING, NOTICE, with
any ending) of a directory give the directory its licence, each distinct
directory is joined with its ancestors' licences on the path, the nearest one
stands, and files take it by a join on their directory.

All of it is DataFrame expressions; the templates are a fixed list.

Defined cases: null or empty text has no notice; a null path has no directory
and inherits nothing; ties between templates go to the first name, between a
directory's licence files to the larger cosine, then the first name; repeated
rows are answered once each; other input columns stay out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.arrays import materialize
from vigil.llm.common import only, read, stored
from vigil.llm.registry import register

THRESHOLD = 0.5
# Fixed: short statements and grants by which licences are recognised.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_NOTICE = r"(?i)licen[sc]e|copyright|rights reserved|public domain|redistribut|hereby granted"
_UNITS = r"\n+|(?<=[.!?])[ \t\r]+"
_TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"


def _terms(unit: Column) -> Column:
    return F.regexp_extract_all(F.lower(unit), F.lit(f"({_TERM})"), 1)


def _template_terms() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(_TERM, text.lower()))) for name, text in TEMPLATES]


def notices(files: DataFrame) -> DataFrame:
    """Add ``notices``: the lines and sentences of the text that may state a licence."""
    found = F.filter(F.split("text", _UNITS), lambda u: u.rlike(_NOTICE))
    some = F.when(F.col("text").rlike(_NOTICE), found).otherwise(F.array().cast("array<string>"))
    return materialize(files, "notices", some)


def _dealt(score: Column, norm: Column) -> Column:
    """(score, license) of the largest cosine, the first on ties."""
    names = F.array(*(F.lit(name) for name, _ in TEMPLATES))
    scored = F.transform(F.arrays_zip(score.alias("dot"), names.alias("license")),
                         lambda s: F.struct((s["dot"] / norm).alias("score"), s["license"].alias("license")))
    return F.aggregate(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("license")),
                       lambda a, s: F.when(s.score > a.score + 1e-12, s).otherwise(a))


def recognised(found: DataFrame, threshold: float) -> DataFrame:
    """(unit, score, license) of the distinct notices, by digest, that reach
    ``threshold`` with their nearest template."""
    spark = found.sparkSession
    units = (found.select(F.explode("notices").alias("u")).groupBy(F.md5("u").alias("unit"))
             .agg(F.first("u").alias("u"), F.count("*").alias("n")))
    terms = stored(units.select("unit", "n", F.explode(_terms(F.col("u"))).alias("term"))
                   .groupBy("unit", "n", "term").agg(F.count("*").alias("tf")), "notice-terms")
    total = found.agg(F.sum(F.size("notices"))).first()[0] or 0
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    idf = stored(df.select("term", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")), "idf")
    templates = _template_terms()
    vocabulary = sorted({t for _, v in templates for t in v})
    known = {r.term: r.idf for r in idf.filter(F.col("term").isin(vocabulary)).collect()}  # the templates' terms
    weight = np.array([[v.get(t, 0) * known.get(t, math.log(1 + total) + 1) for _, v in templates]
                       for t in vocabulary])
    weight /= np.sqrt((weight ** 2).sum(0))
    table = spark.createDataFrame([(t, w.tolist()) for t, w in zip(vocabulary, weight, strict=True)],
                                  "term string, w array<double>")
    own = F.col("tf") * F.col("idf")
    dots = [F.sum(own * F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"d{k}") for k in range(len(templates))]
    return (terms.join(idf, "term").join(F.broadcast(table), "term", "left")  # the templates' terms
            .groupBy("unit").agg(F.sqrt(F.sum(own * own)).alias("norm"), *dots)
            .select("unit", _dealt(F.array(*(f"d{k}" for k in range(len(templates)))), F.col("norm")).alias("b"))
            .select("unit", "b.*").filter(F.col("score") >= threshold))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, own_license, own_score, license, inherited_from) of every file."""
    src = only(files, key=key, path=path, text=text)
    found = stored(notices(src).select("key", "path", "notices", F.monotonically_increasing_id().alias("row")), "notices")
    best = (found.select("row", F.posexplode("notices").alias("pos", "u"))
            .select("row", "pos", F.md5("u").alias("unit")).join(recognised(found, threshold), "unit")
            .groupBy("row").agg(F.max(F.struct("score", -F.col("pos"), "license")).alias("best")))
    own = found.select("row", "key", "path").join(best, "row", "left").select(
        "key", "path", F.col("best.license").alias("own_license"), F.round("best.score", 6).alias("own_score"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    own = stored(own, "own-licenses")
    stated = (own.filter(F.col("own_license").isNotNull() & F.col("name").rlike(_LICENSE_FILE))
              .groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), "own_license")).alias("b"))
              .select(F.col("dir").alias("ancestor"), F.col("b.own_license").alias("from_dir")))
    # ancestors of each distinct directory: its prefixes before a slash, and itself
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")))
    lines = (own.filter(F.col("own_license").isNull() & F.col("path").isNotNull()).select("dir").distinct()
             .select("dir", F.explode(prefixes).alias("p")).select("dir", "p.*"))
    nearest = (lines.join(stated, "ancestor").groupBy("dir")
               .agg(F.max(F.struct("depth", "from_dir", "ancestor")).alias("n"))
               .select("dir", F.col("n.from_dir").alias("given"), F.col("n.ancestor").alias("given_by")))
    joined = own.join(nearest, "dir", "left")
    bare = F.col("own_license").isNull() & F.col("path").isNotNull()
    return joined.select(
        F.col("key").alias(key), F.col("path").alias(path), "own_license", "own_score",
        F.when(bare, F.col("given")).otherwise(F.col("own_license")).alias("license"),
        F.when(bare, F.col("given_by")).alias("inherited_from"))


def files_of(documents: DataFrame) -> DataFrame:
    """Stand-in for a code corpus: a path for each document (every fortieth is
    its directory's licence file)."""
    name = F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string")))
    return documents.select("doc_id", F.concat_ws(
        "/", F.lit(""), "source", "lang", (F.col("doc_id") % 7).cast("string"),
        F.coalesce(name, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("path"), "text")


@register("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of all documents, laid out as files."""
    return scan(files_of(read(spark, sf_dir, "documents")))
