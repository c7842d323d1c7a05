"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

DataFrame operations only.  A file is compared in three ways, each by joining
TF-IDF vectors on terms: as a whole and by its opening block with full licence
texts and standard notices, and by single passages, the sentences that hold an
anchor word, with short notices.  A file with a match has that licence itself; if it matches
as a whole, or its passages make up enough of it, it is a licence file and licenses its
directory.  Every other file takes the licence of the nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.common import stored
from scorecraft.session import bounded_broadcast

#: Short notices by which works name their licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD license."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("Zlib", "Released under the zlib License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission."),
)
#: Licences whose full text is in license_texts, and the notices that their texts tell to put at the start of a file.
FULL_TEXTS = ("MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "GPL-1.0", "LGPL-3.0", "LGPL-2.1", "LGPL-2.0",
              "MPL-2.0", "CC0-1.0", "ISC", "Zlib", "Unlicense")
_GNU = ("{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
        "the Free Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General "
        "Public License along with {0}. If not, see <https://www.gnu.org/licenses/>.")
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
     "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
     "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
     "License."),
    ("GPL-3.0", _GNU.format("This program", "", "3")), ("GPL-2.0", _GNU.format("This program", "", "2")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser ", "3")), ("LGPL-2.1", _GNU.format("This library", "Lesser ", "2.1")),
    ("AGPL-3.0", _GNU.format("This program", "Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
ANCHOR = r"(?i)licen[sc]e|copyright|spdx|rights reserved|public domain|redistribution|permission is hereby"
SENTENCE = r"[\r\n]+|(?<=[.!?])[ \t]+"
TERM = r"[^a-z0-9.+-]+"
BREAK = r"[.+-]*+[^a-z0-9.+-]++[.+-]*+"
#: An identifier line, its expression (group 1), and a notice that denies what it names.
IDENTIFIER = (r"(?i)SPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)")
DENIED = (r"(?i)\b(?:not|never|no longer)\s+(?:[a-z]+\s+){0,2}(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed)\s+"
          r"(?:[a-z]+\s+){0,2}under\b")
MIN_COSINE, FILE_SHARE = 0.6, 0.2
#: Least cosine of a block with a text; an opening block has a text's number of terms, and a share and number more.
BLOCK_COSINE, OPENING = 0.75, (1.05, 8)


def terms(text: Column) -> Column:
    """Lower-case terms: runs of letters, digits, ``.``, ``+`` and ``-``, without dots or dashes at the ends."""
    # dots and dashes beside a break belong to it
    return F.array_remove(F.split(F.btrim(F.lower(text), F.lit(".+-")), BREAK), "")


def _weighted(counted: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf x idf over the length of the key's vector."""
    w = counted.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def match_passages(passages: DataFrame, templates: tuple = TEMPLATES, least: float = MIN_COSINE) -> DataFrame:
    """(passage, license, score): the best template of each distinct passage text, if its cosine reaches ``least``.

    Document frequencies are over all passages (each occurrence counts) and the
    templates.  Equal passages are compared once.
    """
    spark = passages.sparkSession
    listed = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    texts = passages.groupBy("passage").agg(F.count(F.lit(1)).alias("n"))
    words = texts.select("passage", "n", F.explode(terms(F.col("passage"))).alias("term")).groupBy("passage", "n", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    template_words = listed.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    seen = words.select("term", "n").union(template_words.select("term", F.lit(1).cast("long")))
    total = texts.agg((F.coalesce(F.sum("n"), F.lit(0)) + len(templates)).alias("total"))
    df = seen.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (F.log((1 + total.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = stored(idf, "license-idf")
    # one row per term of the fixed templates
    side = F.broadcast(_weighted(template_words, idf, "template").withColumnRenamed("w", "_w"))
    cosine = (_weighted(words.select("passage", "term", "tf"), idf, "passage").join(side, "term")
              .groupBy("passage", "template").agg(F.round(F.sum(F.col("w") * F.col("_w")), 6).alias("score")))
    best = cosine.groupBy("passage").agg(F.max(F.struct("score", (-F.col("template")).alias("order"))).alias("b"))
    return (best.where(F.col("b.score") >= least).select("passage", F.col("b.score").alias("score"), (-F.col("b.order")).alias("template"))
            .join(F.broadcast(listed.select("template", "license")), "template").select("passage", "license", "score"))


def _block_templates() -> list[tuple[str, list[str]]]:
    """(license, terms) of the full texts and notices."""
    here = package_files("scorecraft.llm").joinpath("license_texts")
    texts = [(n, here.joinpath(f"{n}.txt").read_text(encoding="utf-8")) for n in FULL_TEXTS] + list(NOTICES)
    return [(n, [w for w in (t.strip(".+-") for t in re.split(TERM, text.lower())) if w]) for n, text in texts]


def match_blocks(files: DataFrame, least: float = BLOCK_COSINE) -> DataFrame:
    """(file_id, path, license, score, whole) of files that as a whole, or by their opening block, reach ``least`` with a text.

    Weights are (1 + ln tf) x idf, with document frequencies over all files for the terms of the texts; a term that no text has
    weighs like one that no file has, so it always counts against a match.  Every file is cut into terms once; which of the
    texts' terms it holds is kept, a few small words a file, and gives the frequencies.  Pairs of a file and a text are then left out
    only if the file lacks so many of the text's weightiest terms that no part of it can reach ``least``: the squared
    weights of the terms it has are a bound.  What is left is scored, a row per file, text, span and term; no texts are stored.
    """
    spark = files.sparkSession
    texts = _block_templates()
    vocabulary = sorted({w for _, words in texts for w in words})
    # no condition on what is worked out here or below: the optimizer would work it out once more in a filter
    held = stored(files.where("text IS NOT NULL").select("file_id", "path", F.array_intersect(
        terms(F.col("text")), F.split(F.lit(" ".join(vocabulary)), " ")).alias("held")), "license-held")
    df = {r["term"]: r["df"] for r in held.select(F.explode_outer("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    n = files.count()
    idf, rare = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + n) + 1
    side, tests, spans = [], [], []
    for i, (_, words) in enumerate(texts):
        raw = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        # the weightiest terms, which hold three quarters of the squared weight: all others give what is left at most
        order = sorted(raw, key=lambda w: (-raw[w], w))
        share = [(raw[w] / norm) ** 2 for w in order]
        top = next(k for k in range(1, len(order) + 1) if sum(share[:k]) >= 0.75)
        lacking = least * least - sum(share[top:]) - 1e-6
        need = next(k for k in range(top + 1) if sum(share[:k]) >= lacking)
        side += [(i, w, x / norm) for w, x in raw.items()]
        tests.append((order[:top], need))
        spans.append(int(OPENING[0] * len(words)) + OPENING[1])
    # bounded by the fixed texts
    weights = F.broadcast(spark.createDataFrame(side, "template int, term string, _w double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, _idf double"))
    names = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(texts)], "template int, license string"))
    enough = [F.when(F.size(F.array_intersect("held", F.split(F.lit(" ".join(top)), " "))) >= need, F.lit(i)) for i, (top, need) in enumerate(tests)]
    few = F.size("held") >= min(need for _, need in tests)
    asked = held.where(few).select("file_id", "path", F.explode_outer(F.array(*enough)).alias("template")).where("template IS NOT NULL")
    # rows of one file and path are asked for alike
    asked = stored(asked.groupBy("file_id", "path").agg(F.collect_set("template").alias("templates")), "license-asked")
    asked, _ = bounded_broadcast(asked)
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("file_id", "path")]
    near = files.where("text IS NOT NULL").alias("f").join(asked.alias("a"), same[0] & same[1]).select(
        "f.file_id", "f.path", terms(F.col("f.text")).alias("terms"), "templates")
    span = F.element_at(F.array(*map(F.lit, spans)), F.col("template") + 1)  # span 0: the whole; an opening as long as the file is the whole
    near = (near.select("file_id", "path", "terms", F.explode_outer("templates").alias("template"))
            .select("*", F.explode_outer(F.when(F.size("terms") > span, F.array(F.lit(0), span)).otherwise(F.array(F.lit(0)))).alias("span"))
            .select("file_id", "path", "template", "span", F.when(F.col("span") == 0, F.col("terms")).otherwise(
                F.slice("terms", F.lit(1), F.greatest("span", F.lit(1)))).alias("terms")))
    pair = ["file_id", "path", "template", "span"]
    counted = near.select(*pair, F.explode_outer("terms").alias("term")).groupBy(*pair, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = (1 + F.log("tf")) * F.coalesce("_idf", F.lit(rare))
    scored = (counted.join(idfs, "term", "left").join(weights, ["template", "term"], "left").withColumn("w", w)
              .groupBy(*pair).agg(F.round(F.sum(F.col("w") * F.coalesce("_w", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("score")))
    return scored.where(F.col("score") >= least).join(names, "template").select("file_id", "path", "license", "score", (F.col("span") == 0).alias("whole"))


def family(name: Column) -> Column:
    """Licences of one family share most of their wording: the GNU ones, BSD, CC; else the name itself."""
    first = F.split_part(name, F.lit("-"), F.lit(1))
    return F.when(first.isin("GPL", "LGPL", "AGPL"), "GNU").when(first.isin("BSD", "CC"), first).otherwise(name)


def identifiers(files: DataFrame) -> DataFrame:
    """(file_id, path, expression, licenses): the SPDX expressions of each file that has one, joined by AND, and the licences they name.

    Names lose a trailing ``+``, ``-only`` or ``-or-later``; exceptions after WITH are in the expression alone.
    """
    found = files.where(F.col("text").rlike(IDENTIFIER)).select("file_id", "path", F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1)), lambda e: F.regexp_replace(e, r"[ \t]+", " "))).alias("all"))
    bare = F.flatten(F.transform("all", lambda e: F.split(F.regexp_replace(F.regexp_replace(e, r"(?i) WITH [^ )]+", ""), "[()]", ""), "(?i) (?:AND|OR) ")))
    names = F.transform(bare, lambda x: F.regexp_replace(x, r"(?i)(?:\+|-only|-or-later)$", ""))
    return found.select("file_id", "path", F.array_join("all", " AND ").alias("expression"), F.array_distinct(names).alias("names"))


def scan_licenses(files: DataFrame, templates: tuple = TEMPLATES, least: float = MIN_COSINE, share: float = FILE_SHARE) -> DataFrame:
    """file_id, path, license, score, how, license_dir, licenses, expression for every row of ``files`` (file_id, path, text).

    ``licenses`` are all licences that a file itself names, sorted: those of its SPDX expressions (``expression``), the best of the whole file
    or else of its opening block, and the best of each passage; of a whole file's passages only those of another family, since
    a full text names its relatives.  ``license`` is one of them: of a file with an expression the first name in it.
    A passage that denies a licence ("not released under ...") does not count.

    ``how`` is ``file`` (a licence file: it matches a text as a whole, or its matched passages hold at least ``share``
    of its words), ``header``, ``inherited`` or NULL.  Of a file's matches those of the whole count before those of
    its opening block, and these before passages; then the highest score, then the first licence by name; of a directory's licence files likewise, then the
    smallest file_id.  A licence file licenses the directory it lies in and all
    below, the nearest above a file counts; ``license_dir`` names it for inherited licences.

    NULL and empty texts have no licence of their own but inherit; a NULL path lies
    in no directory; rows with the same file_id and path share what any of them
    declares; repeated rows stay; an empty table gives no rows; other columns are
    not read.  Texts are scanned twice without a shuffle; only passages, and files that
    share enough terms with a licence text, are shuffled, and equal ones as one row.
    """
    found = F.when(F.col("text").rlike(ANCHOR), F.col("text"))
    anchored = files.select("file_id", "path", found.alias("text")).where("text IS NOT NULL").select(
        "file_id", "path", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"),
        F.filter(F.split("text", SENTENCE), lambda s: s.rlike(ANCHOR) & ~s.rlike(IDENTIFIER) & ~s.rlike(DENIED)).alias("all"))
    passages = stored(anchored.select("file_id", "path", "n_words", F.explode_outer("all").alias("passage")).where("passage IS NOT NULL")
                      .withColumn("passage", F.trim("passage")), "license-passages")
    known = match_passages(passages, templates, least)
    hits = passages.join(known, "passage")
    held = F.regexp_count("passage", F.lit(r"\S+"))
    hits = hits.select("file_id", "path", "license", "score", F.lit(2).alias("by"), held.alias("held"), "n_words").unionByName(
        match_blocks(files).select("file_id", "path", "license", "score", F.when(F.col("whole"), 0).otherwise(1).alias("by")),
        allowMissingColumns=True)
    said = identifiers(files)
    hits = hits.unionByName(said.select("file_id", "path", F.posexplode("names").alias("place", "license")).select(
        "file_id", "path", "license", (1 - F.col("place") * 1e-6).alias("score"), F.lit(-1).alias("by"), F.lit(0).cast("int").alias("held"),
        F.lit(1).cast("int").alias("n_words")))
    said = said.select("file_id", "path", "expression")
    grouped = hits.groupBy("file_id", "path").agg(
        F.min(F.struct("by", (-F.col("score")).alias("low"), "license")).alias("b"),
        F.min(F.when(F.col("by").isin(0, 1), F.struct("by", (-F.col("score")).alias("low"), "license"))).alias("block"),
        F.collect_set(F.when(F.col("by").isin(-1, 2), F.struct("by", "license"))).alias("named"),  # as many as there are licences
        (F.sum(F.when(F.col("by") == 2, F.col("held"))) / F.max(F.when(F.col("by") == 2, F.col("n_words")))).alias("covered"))
    other = F.filter("named", lambda x: (x["by"] == -1) | (F.col("block.by") != 0) | F.col("block").isNull() | (family(x["license"]) != family(F.col("block.license"))))
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.col("block.license")), F.transform(other, lambda x: x["license"])))))
    # two rows of one file and path share what any of them declares
    said = said.groupBy("file_id", "path").agg(F.min("expression").alias("expression"))
    ids = [F.col(f"g.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("file_id", "path")]
    own = stored(grouped.alias("g").join(said.alias("x"), ids[0] & ids[1], "left").select(
        F.col("g.file_id").alias("file_id"), F.col("g.path").alias("path"), F.col("b.license").alias("license"),
        F.when(F.col("b.by") == -1, F.lit(1.0)).otherwise(-F.col("b.low")).alias("score"), every.alias("licenses"), "expression",
        (F.coalesce(F.col("block.by") == 0, F.lit(False)) | F.coalesce(F.col("covered") >= share, F.lit(False))).alias("is_file")), "license-own")

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)  # empty: the root
    dirs = (own.where("is_file AND path IS NOT NULL").withColumn("dir", folder).groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "license", "file_id")).alias("b"))
        .select(F.col("dir").alias("license_dir"), F.col("b.license").alias("_license"), (-F.col("b.low")).alias("_score")))
    asked = files.where("path IS NOT NULL").select(folder.alias("dir")).distinct()
    bits = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(bits)), lambda k: F.array_join(F.slice(bits, 1, k), "/"))))
    near = (asked.select("dir", F.explode(F.array_distinct(above)).alias("license_dir")).join(dirs, "license_dir")
            .groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "_license", "_score")).alias("n"))
            .select(F.col("dir").alias("_dir"), "n.license_dir", "n._license", "n._score"))
    near, _ = bounded_broadcast(stored(near, "license-dirs"), 100_000)
    mine = own.select(F.col("file_id").alias("_id"), F.col("path").alias("_path"), "license", "score", "licenses", "expression", "is_file")
    rows = files.select("file_id", "path").join(mine, F.col("file_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    rows = rows.withColumn("dir", folder).join(near, F.col("dir") == F.col("_dir"), "left")
    has = F.col("license").isNotNull()
    how = F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("_license").isNotNull(), "inherited")
    return rows.select("file_id", "path", F.coalesce("license", "_license").alias("license"),
                       F.when(has, F.col("score")).otherwise(F.col("_score")).alias("score"), how.alias("how"),
                       F.when(~has, F.col("license_dir")).alias("license_dir"),
                       F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "expression")


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/thousand/hundred/doc_id.txt, every tenth one folder higher; NULLs are ``none``."""
    n = F.col("doc_id")
    thousand, hundred = (F.coalesce(F.expr(f"cast(doc_id div {k} as string)"), F.lit("none")) for k in (1000, 100))
    bits = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), thousand, F.when(n % 10 != 0, hundred),
            F.concat(F.coalesce(n.cast("string"), F.lit("none")), F.lit(".txt"))]
    return docs.select(n.alias("file_id"), F.concat_ws("/", *bits).alias("path"), "text")
