"""License scans: TF-IDF cosine to templates, then inheritance from directories.

Files are (path, text). Headers are their sentences, of single lines and of running
text, that mention a licence; each is compared with every template by the cosine of
sparse TF-IDF vectors (term counts times the templates' inverse document
frequencies). A licence has several templates: notices, the identifier line and the
standard header or first words of its text. A file takes the licence of the best
template of its headers if the cosine reaches ``THRESHOLD``. A file whose whole text,
of any length, has a cosine of ``WHOLE`` or more to a template of its licence, or to
all of its templates together, is a licence file (a column ``licence_file`` may say
so instead). It also speaks for its directory; a file without a licence of its own
takes that of its nearest ancestor directory that has one.

Native: DataFrame functions only. Only sentences that mention a licence, and the
texts of files that have one, are exploded into terms, and the terms are counted
before anything is joined. The templates are a fixed table, the only data
broadcast. Directories are resolved among themselves first (one row each); the files
then join one row of their own directory. That table is stored, so the join has a
shuffle on both sides and a directory with a third of all files is split by the
skew rule.

Edge cases: null or empty texts have no header; very long texts are read whole.
Null paths lie in no directory and have no header of their own. Several licence
files in one directory: the highest cosine speaks, then the smallest path. Equal
cosines: the licence first in alphabetical order. Repeated rows (same path) are one
file and get equal results. Files that find nothing: licence null, ``how`` = none.
An empty table gives no rows. Columns named in ``keep`` pass through; others, of
whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

THRESHOLD, WHOLE = 0.6, 0.2
MENTION = "(?i)licen[cs]|copyright|spdx|permission is hereby|permission to use|free software|public domain"
#: Borders of the sentences of lines, and of running text.
LINES, RUNS = "\n|[.!?] ", "[.!?:] "

#: Licence notices as they are commonly written, standard headers and first words of licence texts.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GNU.format("General Public License", "2")),
    ("GPL-3.0", GNU.format("General Public License", "3")),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GNU.format("Lesser General Public License", "3")),
    ("MIT", "This project is licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
            "to the following conditions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Identifier lines: the licence's name, with both endings for the GNU ones.
GNU_NAMES = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in TEMPLATES})
              for end in (("-only", "-or-later") if name in GNU_NAMES else ("",))]
NAMES = sorted({n for n, _ in TEMPLATES})


def terms(column):
    """Lower-case words of letters, digits and inner dots and hyphens."""
    plain = F.regexp_replace(F.lower(column), "[^a-z0-9.-]+", " ")
    return F.filter(F.transform(F.split(plain, " "), lambda t: F.regexp_replace(t, "^[.-]+|[.-]+$", "")), lambda t: t != "")


def template_vectors(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(template, licence, term, weight) of unit length, and (term, idf); both fixed by ``TEMPLATES``.

    Besides the templates, numbered as they stand, each licence has one of all its templates together, numbered below zero.
    """
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, text string")
    tf = rows.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1.0 + len(TEMPLATES)) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    number = F.create_map(*[x for i, n in enumerate(NAMES) for x in (F.lit(n), F.lit(-1 - i))])
    together = tf.groupBy(number[F.col("licence")].alias("template"), "licence", "term").agg(F.sum("tf").alias("tf"))
    raw = tf.unionByName(together).join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(F.broadcast(norm), "template").select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def _weighed(rows: DataFrame, idf: DataFrame, keys) -> DataFrame:
    """(keys, term, w) of rows (keys, terms)."""
    unseen = F.log(F.lit(1.0 + len(TEMPLATES))) + 1.0
    return (rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
            .join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen)))


def headers(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, cosine): the licence of the best template of each file's licence sentences."""
    vectors, idf = template_vectors(files.sparkSession)
    vectors = vectors.where("template >= 0")
    both = F.concat(F.split("text", LINES), F.split(F.regexp_replace("text", "[ \t\r\n]+", " "), RUNS))
    sentences = (files.where(F.col("text").rlike(MENTION) & F.col("path").isNotNull())
                 .select("path", F.explode(F.array_distinct(F.filter(both, lambda x: x.rlike(MENTION)))).alias("sentence"))
                 .select("path", "sentence", terms(F.col("sentence")).alias("terms")))
    # a sentence's norm and its products with all templates in one aggregate
    wide = _weighed(sentences, idf, ["path", "sentence"]).join(F.broadcast(_by_term(vectors)), "term", "left")
    sums = [F.sum(F.coalesce(f"t{i}", F.lit(0.0)) * F.col("w")).alias(f"s{i}") for i in range(len(TEMPLATES))]
    scored = (wide.groupBy("path", "sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *sums)
              .select("path", F.explode(F.array(*[F.struct(F.round(F.col(f"s{i}") / F.col("norm"), 6).alias("cosine"),
                                                           F.lit(name).alias("licence")) for i, (name, _) in enumerate(TEMPLATES)])).alias("m"))
              .select("path", "m.cosine", "m.licence").where(F.col("cosine") >= threshold))
    best = scored.groupBy("path").agg(F.max("cosine").alias("cosine"))
    return (scored.join(best, ["path", "cosine"]).groupBy("path", "cosine").agg(F.min("licence").alias("licence")))


def _by_term(vectors: DataFrame) -> DataFrame:
    """One row per term with its weight in each template."""
    pick = [F.max(F.when(F.col("template") == i, F.col("weight"))).alias(f"t{i}") for i in range(len(TEMPLATES))]
    return vectors.groupBy("term").agg(*pick)


def licence_files(files: DataFrame, own: DataFrame, least: float = WHOLE) -> DataFrame:
    """The distinct paths of files whose whole text is near their licence's templates, whatever its length."""
    vectors, idf = template_vectors(files.sparkSession)
    # stored, as a condition on the terms would else be tested on the texts of all files
    texts = stored(files.select("path", "text").join(own.select("path", "licence"), "path"))
    texts = texts.select("path", "licence", F.xxhash64("text").alias("copy"), terms(F.col("text")).alias("terms"))
    w = _weighed(texts, idf, ["path", "licence", "copy"])
    norm = w.groupBy("path", "copy").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (w.join(F.broadcast(vectors), ["licence", "term"]).groupBy("path", "copy", "template")
            .agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    return dots.join(norm, ["path", "copy"]).where(F.round(F.col("dot") / F.col("norm"), 6) >= least).select("path").distinct()


def directory(path):
    """The directory of a path, with its closing slash; empty at the top."""
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def scan(files: DataFrame, threshold: float = THRESHOLD, keep=()) -> DataFrame:
    """(``keep``, path, licence, how, cosine, from_dir) of rows (path, text[, licence_file])."""
    own = stored(headers(files, threshold))
    names = files.select(*keep, "path", directory(F.col("path")).alias("dir"))
    speaks = files.where("licence_file").select("path").distinct() if "licence_file" in files.columns else licence_files(files, own)
    speak = (speaks.withColumn("dir", directory(F.col("path"))).join(own, "path")
             .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("path"), F.col("licence"))).alias("first"))
             .select(F.col("dir").alias("from_dir"), F.col("first.licence").alias("dir_licence"), (-F.col("first.c")).alias("dir_cosine")))
    speak = stored(speak)
    dirs = names.select("dir").where("dir is not null").distinct()
    # every directory looks up all of its ancestors and keeps the deepest one that speaks
    parts = F.split(F.regexp_replace("dir", "/$", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    climb = dirs.select("dir", F.explode(above).alias("from_dir")).join(speak, "from_dir")
    nearest = stored(climb.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "dir_licence", "dir_cosine")).alias("a"))
                     .select("dir", "a.from_dir", "a.dir_licence", "a.dir_cosine"))
    found = names.join(own, "path", "left")
    lack = found.where("licence is null").drop("licence", "cosine").join(nearest, "dir", "left").select(
        *keep, "path", F.col("dir_licence").alias("licence"),
        F.when(F.col("dir_licence").isNotNull(), F.lit("directory")).otherwise(F.lit("none")).alias("how"),
        F.col("dir_cosine").alias("cosine"), "from_dir")
    have = found.where("licence is not null").select(*keep, "path", "licence", F.lit("header").alias("how"), "cosine",
                                                     F.lit(None).cast("string").alias("from_dir"))
    return have.unionByName(lack)


#: Of the derived tree: ids divisible by TOP lie at the top of their source, of the others those divisible by MIDDLE one level below.
TOP, MIDDLE = 31, 13


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of ``documents`` as a file of a tree.

    The tree is source / doc_id div 1000 / doc_id div 50 / doc_id, with some
    files at the two upper levels, so that parents speak for directories below.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source")
    step = lambda n: F.floor(F.col("doc_id") / n).cast("long").cast("string")
    top = F.col("doc_id") % TOP == 0
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(~top, step(1000)), F.when(~top & (F.col("doc_id") % MIDDLE != 0), step(50)),
                                              F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("path"), "text")
    return scan(files, keep=["doc_id"])


_VALUES = ", ".join(f"({i}, '" + n + "', '" + t.replace("'", "''") + "')" for i, (n, t) in enumerate(TEMPLATES))
_TERMS = "regexp_replace(unnest(string_split(regexp_replace(lower({}), '[^a-z0-9.-]+', ' ', 'g'), ' ')), '^[.-]+|[.-]+$', '', 'g')"

SQL = rf"""
WITH templates(template, licence, text) AS (VALUES {_VALUES}),
tt AS (SELECT template, licence, {_TERMS.format('text')} AS term FROM templates),
ttf AS (SELECT template, licence, term, count(*) AS tf FROM tt WHERE term <> '' GROUP BY ALL),
idf AS (SELECT term, ln({len(TEMPLATES)}.0e0 + 1 ) - ln(1.0e0 + count(*)) + 1 AS idf FROM ttf GROUP BY term),
allf AS (SELECT CAST(template AS VARCHAR) AS template, licence, term, tf FROM ttf UNION ALL SELECT 'all ' || licence, licence, term, sum(tf) FROM ttf GROUP BY licence, term),
raw AS (SELECT template, licence, term, tf * idf AS w FROM allf JOIN idf USING (term)),
vec AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM raw),
files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), CASE WHEN doc_id % {TOP} <> 0 THEN CAST(doc_id // 1000 AS VARCHAR) END,
         CASE WHEN doc_id % {TOP} <> 0 AND doc_id % {MIDDLE} <> 0 THEN CAST(doc_id // 50 AS VARCHAR) END, coalesce(CAST(doc_id AS VARCHAR), 'none')) AS path
  FROM documents),
sent AS (SELECT DISTINCT path, sentence FROM (
  SELECT path, unnest(list_concat(string_split_regex(text, '
|[.!?] '), string_split_regex(regexp_replace(text, '[ 	
]+', ' ', 'g'), '[.!?:] '))) AS sentence
  FROM files WHERE regexp_matches(text, '{MENTION}')) WHERE regexp_matches(sentence, '{MENTION}')),
st AS (SELECT path, sentence, {_TERMS.format('sentence')} AS term FROM sent),
stf AS (SELECT path, sentence, term, count(*) AS tf FROM st WHERE term <> '' GROUP BY ALL),
sw AS (SELECT path, sentence, term, tf * coalesce(idf, ln({len(TEMPLATES)}.0e0 + 1) + 1) AS w FROM stf LEFT JOIN idf USING (term)),
sn AS (SELECT path, sentence, sqrt(sum(w * w)) AS norm FROM sw GROUP BY ALL),
cs AS (SELECT path, licence, round(sum(sw.w * weight) / any_value(norm), 6) AS cosine
       FROM sw JOIN sn USING (path, sentence) JOIN vec USING (term) WHERE template NOT LIKE 'all %' GROUP BY path, sentence, template, licence),
own AS (SELECT path, cosine, licence FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) AS r FROM cs WHERE cosine >= {THRESHOLD}) WHERE r = 1),
wt AS (SELECT path, licence, text, {_TERMS.format('text')} AS term FROM (SELECT DISTINCT path, text FROM files) JOIN own USING (path)),
wf AS (SELECT path, licence, text, term, count(*) AS tf FROM wt WHERE term <> '' GROUP BY ALL),
ww AS (SELECT path, licence, text, term, tf * coalesce(idf, ln({len(TEMPLATES)}.0e0 + 1) + 1) AS w FROM wf LEFT JOIN idf USING (term)),
wn AS (SELECT path, text, sqrt(sum(w * w)) AS norm FROM ww GROUP BY ALL),
whole AS (SELECT DISTINCT path FROM (SELECT path, round(sum(ww.w * weight) / any_value(norm), 6) AS cosine
          FROM ww JOIN wn USING (path, text) JOIN vec USING (licence, term) GROUP BY path, text, template) WHERE cosine >= {WHOLE}),
f AS (SELECT doc_id, path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir, path IN (SELECT path FROM whole) AS speaks, licence, cosine FROM files LEFT JOIN own USING (path)),
speak AS (SELECT * FROM (SELECT dir AS from_dir, licence AS dl, cosine AS dc, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) AS r
                         FROM f WHERE speaks AND licence IS NOT NULL) WHERE r = 1),
dirs AS (SELECT DISTINCT dir FROM f),
near AS (SELECT dir, from_dir, dl, dc FROM (
  SELECT dir, from_dir, dl, dc, row_number() OVER (PARTITION BY dir ORDER BY length(from_dir) DESC) AS r
  FROM dirs JOIN speak ON starts_with(dirs.dir, from_dir)) WHERE r = 1)
SELECT doc_id, f.path, coalesce(licence, dl) AS licence,
       CASE WHEN licence IS NOT NULL THEN 'header' WHEN dl IS NOT NULL THEN 'directory' ELSE 'none' END AS how,
       coalesce(cosine, dc) AS cosine, CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM f LEFT JOIN near ON near.dir = f.dir
"""
