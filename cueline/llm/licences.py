"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written

MIT_TEXT = """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Notices, titles, identifiers and full texts of well-known licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "MIT License"),
    ("MIT", "Distributed under the MIT license."),
    ("MIT", MIT_TEXT),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", BSD_TEXT),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "CC-BY-NC-4.0", "CC-BY-4.0", "MPL-2.0")),
)
TERM = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"
#: A line, block or clause is a notice if it has one of these.
NOTICE = r"(?i)licen[cs]e|copyright|permission|redistribut|creative commons"
BLANK = r"\n[\x20\t]*\n"
#: Where clauses end: after punctuation before white space.
CLAUSE = r"(?<=[.,;:!?)])\s+"
THRESHOLD = 0.75
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)[^/]*$"


def _bags(units: DataFrame, *keys: str) -> DataFrame:
    """Terms of the texts ``s`` with their counts."""
    terms = F.explode(F.regexp_extract_all(F.lower("s"), F.lit(TERM), F.lit(0)))
    return units.select(*keys, terms.alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def _weighed(bags: DataFrame, idf: DataFrame, *keys: str) -> DataFrame:
    """Bags with ``w``, the weight of a term, and ``norm``, the length of the whole vector."""
    t = bags.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return t.withColumn("norm", F.sqrt(F.sum(F.pow("w", F.lit(2))).over(Window.partitionBy(*keys))))


def units_of(files: DataFrame) -> DataFrame:
    """``file, unit, s``: what is compared. Each line and each block between blank lines that looks like a notice, each of their
    clauses that does, and, where ``whole`` is true (licence files), the whole text."""
    text = F.regexp_replace(text_of("text"), "\r\n?", "\n")
    noticed = lambda parts: F.filter(parts, lambda x: x.rlike(NOTICE))
    lines, blocks = noticed(F.split(text, "\n", -1)), noticed(F.split(text, BLANK, -1))
    clauses = F.flatten(F.transform(blocks, lambda x: noticed(F.split(x, CLAUSE, -1))))
    t = files.select("file", "whole", text.alias("t"), F.concat(lines, blocks, clauses).alias("u"))
    every = F.when(F.col("whole") & F.col("t").rlike(NOTICE), F.array_append("u", F.col("t"))).otherwise(F.col("u"))
    return t.select("file", F.posexplode(F.array_distinct(every)).alias("unit", "s"))


def notices(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The best licence of each ``file`` (columns file, text, whole): ``file, licence, score``; ties by name.

    Document frequencies count all units of the corpus and the templates. The template table has a row for each term
    given by the caller, so broadcasting it is bounded by that argument; a term that the templates lack only adds to a length.
    """
    spark = files.sparkSession
    given = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, s string")
    bag, own = written(_bags(units_of(files), "file", "unit")), _bags(given, "template", "licence")
    seen = bag.select("term").unionByName(own.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = bag.select("file", "unit").distinct().count() + len(templates)
    idf = written(seen.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    terms = written(_weighed(own, idf, "template").select("term", "template", "licence", (F.col("w") / F.col("norm")).alias("weight")))
    dots = _weighed(bag, idf, "file", "unit").join(F.broadcast(terms), "term").groupBy("file", "unit", "template", "licence", "norm").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.select("file", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("low"), F.col("licence").alias("licence"))).alias("b"))
    return best.select("file", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, licence, score, origin`` of every row; origin ``header``, ``directory`` or ``none``.

    A file with a notice of its own has that licence. Any other takes that of the nearest directory above it (its own
    included) with a licence file, found by joining the prefixes of its path. Of several licence files in a directory
    the best score counts, then the name. Null path: no ancestors. Null or empty text: no notice. Rows that repeat a
    path and an id share their notices. No rows in, no rows out.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text_of(text_col).alias("text"))
    key = F.xxhash64("doc_id", F.coalesce("path", F.lit("")), "text")
    whole = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))
    own = written(notices(t.select(key.alias("file"), "text", whole.alias("whole")), templates, threshold))
    t = t.select("doc_id", "path", key.alias("file")).join(own, "file", "left")
    folder, base = F.regexp_extract("path", r"^(.*/)?([^/]*)$", 1), F.regexp_extract("path", r"^(.*/)?([^/]*)$", 2)
    licensed = t.filter(base.rlike(LICENCE_FILE) & F.col("licence").isNotNull()).groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("low"), F.col("licence").alias("given"))).alias("b")).select("dir", "b.given", (-F.col("b.low")).alias("given_score"))
    dirs = t.filter("licence is null and path is not null").select(folder.alias("own")).distinct()
    parts = F.split("own", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))))
    near = dirs.select("own", F.explode(F.array_distinct(above)).alias("dir")).join(licensed, "dir").groupBy("own").agg(F.max(F.struct(F.length("dir").alias("depth"), F.col("given"), F.col("given_score"))).alias("a")).select("own", "a.given", "a.given_score")
    t = t.withColumn("own", folder).join(near, "own", "left")
    origin = F.when(F.col("licence").isNotNull(), F.lit("header")).when(F.col("given").isNotNull(), F.lit("directory")).otherwise(F.lit("none"))
    return t.select("doc_id", "path", F.coalesce("licence", "given").alias("licence"), F.coalesce("score", "given_score").alias("score"), origin.alias("origin"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: files lie in folders of 64 by id under the language, and each folder's first document is its LICENSE."""
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 512).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"), name)
    return scan(documents(spark, sf_dir).withColumn("path", path))
