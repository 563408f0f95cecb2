"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Three things are compared with templates by the cosine of their TF-IDF vectors, joined on terms: sentences with a licence word with
licence sentences, windows of words around a licence word with whole headers, and whole texts with whole licence texts. Windows and whole
texts are runs of words, so comment marks and line ends do not matter. Document frequencies of the templates' terms are counted over all
documents. A file that is a whole licence text, or whose matched sentences hold most of its words, is a licence file and speaks for its
directory; a file without a licence of its own takes that of the nearest directory above it, found by joining each directory's ancestors.
Built-in functions only; the broadcast tables hold the templates' terms, whose number the code fixes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notice and licence sentences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Public-Domain", "This work is dedicated to the public domain."),
)
# Headers of source files, as their licences give them. Short licence texts are headers too.
GNU = "either version {} of the License, or (at your option) any later version."
LOSS = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
FREE, GPL = "free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation", "General Public License"
ONLY = "free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
NOTICES = tuple(
    notice
    for name, title, version in (
        ("GPL-2.0", GPL, "2"), ("GPL-3.0", GPL, "3"), ("LGPL-2.0", "Library " + GPL, "2"), ("LGPL-2.1", "Lesser " + GPL, "2.1"), ("LGPL-3.0", "Lesser " + GPL, "3"), ("AGPL-3.0", "Affero " + GPL, "3"),
    )
    for notice in (
        (name, f"{FREE.format(':', title)}, {GNU.format(version)}"),
        (name, f"{FREE.format(':', title)}, {GNU.format(version)} This program {LOSS.format(title)}"),
        (name, ONLY.format(title, version)),
    )
) + (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("GFDL-1.2", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Whole licence texts. AGPL-3.0 is put together from GPL-3.0 and the parts in which it differs.
WHOLE = tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt")))
#: A licence text of at most so many words also stands at the head of source files.
HEADER_WORDS = 300
#: Lengths of the windows in words, each moved by an eighth of itself. Further ones start with a notice's first words and have its length, so that
#: texts that differ in the version alone are told apart.
WINDOWS = (32, 45, 64, 90, 128, 180, 256)
#: A sentence that many licence headers begin with; a header goes before it.
WEAK = "Proprietary"
THRESHOLD = 0.6
#: Least cosine of a whole text with a whole licence text. English prose shares only frequent words with one.
WHOLE_THRESHOLD = 0.8
FILE_SHARE = 0.5
TOKEN = r"[a-z0-9]+(\.[0-9]+)*"
TRIGGER = r"licen[cs]e|rights reserved|spdx|public domain|creative commons|permission|redistribut|copyright"
#: Words of which a match of TRIGGER holds at least one: of two words the second.
MARK = r"licen[cs]e|^reserved|spdx|^domain|^commons|permission|redistribut|copyright"
ENDS = r"([.;:])\s+"


def terms_of(text: str) -> list[str]:
    return [m[0] for m in re.finditer(TOKEN, text.lower())]


HEADERS = NOTICES + tuple(t for t in WHOLE if len(terms_of(t[1])) <= HEADER_WORDS)
VOCABULARY = tuple(sorted({t for _, text in TEMPLATES for t in terms_of(text)}))
ANCHORS = tuple(sorted({(*t[:3], len(t)) for _, text in NOTICES for t in [terms_of(text)]}))
ALL_TERMS = tuple(sorted({t for _, text in TEMPLATES + HEADERS + WHOLE for t in terms_of(text)}))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Number of documents, and for each term of the templates how many hold it. Null texts count as empty documents."""
    vocabulary = F.lit(list(ALL_TERMS))
    seen = docs.select(F.explode(F.array_union(F.array_intersect(tokens(F.coalesce(text_col, F.lit(""))), vocabulary), F.array(F.lit("")))).alias("term"))
    counts = {r["term"]: r["n"] for r in seen.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def idf(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def matches(units: DataFrame, templates: Sequence[tuple[str, str]], vocabulary: Sequence[str], n: int, counts: dict[str, int], threshold: float) -> DataFrame:
    """(key, words, b): the number of words and the best (-score, license) of the units (key, tokens) that some template matches."""
    spark = units.sparkSession
    weights = {t: idf(n, counts.get(t, 0)) for t in vocabulary}
    rows = []
    for k, (name, text) in enumerate(templates):
        tf = Counter(terms_of(text))
        norm = math.sqrt(sum((c * weights[t]) ** 2 for t, c in tf.items()))
        rows += [(k, name, t, c * weights[t] / norm) for t, c in tf.items()]
    known_templates = spark.createDataFrame(rows, "template int, license string, term string, tw double")
    known = spark.createDataFrame([(t, w) for t, w in weights.items()], "term string, idf double")
    words = units.select("key", F.explode("tokens").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    words = words.join(F.broadcast(known), "term", "left").select("key", "term", "tf", (F.col("tf") * F.coalesce("idf", F.lit(idf(n, 0)))).alias("w"))
    norms = words.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = words.join(F.broadcast(known_templates), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    return scored.groupBy("key", "words").agg(F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("b"))


def windows(texts: DataFrame) -> DataFrame:
    """(text_key, key, tokens): the windows of every length that hold a licence word. Words that start a comment line are taken out.

    Windows are cut around the places of licence words alone, so a long text costs its words once and its windows only where they may count."""
    bare = F.regexp_replace("text", r"(?im)^[ \t]*(dnl|rem)\b", " ")
    phrases = sorted({x[:3] for x in ANCHORS})
    places = lambda test: F.filter(F.transform("all", lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    words = texts.select("text_key", tokens(bare).alias("all"))
    words = words.withColumns({"marks": places(lambda w: w.rlike(MARK)), "heads": places(lambda w: w.isin(sorted({x[0] for x in phrases})))})
    n = F.size("all")

    def cut(size: int) -> Column:
        step = size // 8
        last = F.greatest(n - size + step - 1, F.lit(0))

        def around(at: Column) -> Column:
            low = F.ceil(F.greatest(at - size + 1, F.lit(0)) / step).cast("int") * step
            high = F.least(at, last)
            return F.when(low <= high, F.sequence(low, high, F.lit(step))).otherwise(F.array().cast("array<int>"))

        return F.transform(F.array_distinct(F.flatten(F.transform("marks", around))), lambda at: F.slice("all", at + 1, F.lit(size)))

    word = lambda at: F.get("all", at)
    begins = lambda a, b, c: F.filter("heads", lambda at: (word(at) == a) & (word(at + 1) == b) & (word(at + 2) == c))
    words = words.select("*", *(begins(*x).alias(f"at{k}") for k, x in enumerate(phrases)))
    notice = lambda a, b, c, size: F.transform(f"at{phrases.index((a, b, c))}", lambda at: F.slice("all", at + 1, F.lit(size)))
    found = words.select("text_key", F.explode(F.concat(*map(cut, WINDOWS), *(notice(*x) for x in ANCHORS))).alias("tokens"))
    found = found.withColumn("s", F.array_join("tokens", " ")).where(F.col("s").rlike(TRIGGER))
    return found.select("text_key", "tokens", F.md5("s").alias("key"))


def own_licences(texts: DataFrame, n: int, counts: dict[str, int]) -> DataFrame:
    """(text_key, own_license, score, is_license_file) of the distinct texts (text_key, text) that match a licence. A whole licence text
    goes before the sentences and headers inside it."""
    texts = texts.where(F.lower("text").rlike(TRIGGER))
    sentences = texts.select("text_key", F.explode(F.split(F.regexp_replace("text", ENDS, "$1\n"), "\n")).alias("s"))
    sentences = sentences.where(F.lower("s").rlike(TRIGGER)).select("text_key", "s", F.md5("s").alias("key"))
    distinct = sentences.groupBy("key").agg(F.min("s").alias("s")).select("key", tokens(F.col("s")).alias("tokens"))
    best = matches(distinct, TEMPLATES, VOCABULARY, n, counts, THRESHOLD)
    hits = sentences.select("text_key", "key").join(best, "key").groupBy("text_key").agg(F.min("b").alias("b"), F.sum("words").alias("matched"))
    total = texts.select("text_key", F.size(tokens(F.col("text"))).alias("total"))
    told = hits.join(total, "text_key").select("text_key", F.when(F.col("b.license") == WEAK, 2).otherwise(1).alias("rank"), "b", (F.col("matched") >= FILE_SHARE * F.col("total")).alias("file"))

    cuts = windows(texts)
    best = matches(cuts.groupBy("key").agg(F.min("tokens").alias("tokens")), HEADERS, ALL_TERMS, n, counts, THRESHOLD)
    headed = cuts.select("text_key", "key").join(best, "key").groupBy("text_key").agg(F.min("b").alias("b")).select("text_key", F.lit(1).alias("rank"), "b", F.lit(False).alias("file"))

    best = matches(texts.select(F.col("text_key").alias("key"), tokens(F.col("text")).alias("tokens")), WHOLE, ALL_TERMS, n, counts, WHOLE_THRESHOLD)
    whole = best.select(F.col("key").alias("text_key"), F.lit(0).alias("rank"), "b", F.lit(True).alias("file"))

    found = told.union(headed).union(whole).groupBy("text_key").agg(F.min(F.struct("rank", "b")).alias("f"), F.max("file").alias("is_license_file"))
    return found.select("text_key", F.col("f.b.license").alias("own_license"), (-F.col("f.b.m")).alias("score"), "is_license_file")


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: id, path, own_license, score, is_license_file, license, license_from.

    license is the file's own, else that of the nearest directory on its path, the root last; license_from is the file's path or that
    directory. A directory takes the licence that most of its licence files name, the first in order on ties. Null texts are empty; a
    null path lies in the root; equal texts are matched once; repeated rows stay; other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col), F.lit(""))
    base = files.select(id_col, F.col(path_col).alias("path"), F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), F.md5(text).alias("text_key"))
    n, counts = document_frequencies(files, text_col)
    texts = files.select(F.md5(text).alias("text_key"), text.alias("text")).where(F.lower("text").rlike(TRIGGER)).groupBy("text_key").agg(F.min("text").alias("text"))
    own = own_licences(texts, n, counts)
    base = base.join(own, "text_key", "left")
    votes = base.where("is_license_file").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    licences = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("own_license").alias("license"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    chain = base.select("dir").distinct().select("dir", F.inline(above)).join(licences, "above")
    inherited = chain.groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("i")).select("dir", F.col("i.license").alias("dir_license"), F.col("i.above").alias("dir_from"))
    mine = F.col("own_license").isNotNull()
    return base.join(inherited, "dir", "left").select(
        id_col, "path", "own_license", "score", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "dir_license").alias("license"), F.when(mine, F.col("path")).otherwise(F.col("dir_from")).alias("license_from"),
    )


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def twin_sql(path_sql: str) -> str:
    """DuckDB statement with the rows of license_scan over documents, whose path is the given expression and which hold licence sentences
    only: headers and whole licence texts have no twin."""
    return f"""
WITH templates AS (SELECT * FROM (VALUES {values((k, *t) for k, t in enumerate(TEMPLATES))}) v(template, license, body)),
ttf AS (SELECT template, license, term, count(*) tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{TOKEN}')) term FROM templates) GROUP BY ALL),
base AS (SELECT doc_id, {path_sql} AS path, regexp_replace(coalesce({path_sql}, ''), '/?[^/]*$', '') AS dir, coalesce("text", '') AS body FROM documents),
docs_n AS (SELECT count(*) n FROM base),
df AS (SELECT term, count(*) df FROM (SELECT DISTINCT d, term FROM (SELECT row_number() OVER () d, unnest(regexp_extract_all(lower(body), '{TOKEN}')) term FROM base) WHERE term IN (SELECT term FROM ttf)) GROUP BY term),
idf AS (SELECT DISTINCT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 idf FROM ttf LEFT JOIN df USING (term), docs_n),
tnorm AS (SELECT template, sqrt(sum(tf * idf * tf * idf)) norm FROM ttf JOIN idf USING (term) GROUP BY template),
tw AS (SELECT template, license, term, tf * idf / norm tw FROM ttf JOIN idf USING (term) JOIN tnorm USING (template)),
texts AS (SELECT DISTINCT body FROM base WHERE regexp_matches(lower(body), '{TRIGGER}')),
sentences AS (SELECT body, s FROM (SELECT body, unnest(string_split(regexp_replace(body, '{ENDS}', '\\1' || chr(10), 'g'), chr(10))) s FROM texts) WHERE regexp_matches(lower(s), '{TRIGGER}')),
words AS (SELECT s, term, count(*) tf FROM (SELECT s, unnest(regexp_extract_all(lower(s), '{TOKEN}')) term FROM (SELECT DISTINCT s FROM sentences)) GROUP BY ALL),
weighed AS (SELECT s, term, tf, tf * coalesce(idf, ln(n + 1) + 1) w FROM words LEFT JOIN idf USING (term), docs_n),
norms AS (SELECT s, sqrt(sum(w * w)) norm, sum(tf) words FROM weighed GROUP BY s),
scored AS (SELECT s, words, license, round(sum(w * tw) / any_value(norm), 6) score FROM weighed JOIN tw USING (term) JOIN norms USING (s) GROUP BY s, words, template, license),
best AS (SELECT s, words, max(score) score, arg_min(license, (-score, license)) license FROM scored WHERE score >= {THRESHOLD} GROUP BY s, words),
own AS (SELECT body, arg_min(license, (-score, license)) own_license, max(score) score, sum(words) >= {FILE_SHARE} * len(regexp_extract_all(lower(body), '{TOKEN}')) is_license_file FROM sentences JOIN best USING (s) GROUP BY body),
found AS (SELECT base.*, own_license, score, coalesce(is_license_file, false) is_license_file FROM base LEFT JOIN own USING (body)),
votes AS (SELECT dir above, own_license, count(*) n FROM found WHERE is_license_file GROUP BY ALL),
licences AS (SELECT above, arg_min(own_license, (-n, own_license)) license FROM votes GROUP BY above),
chain AS (SELECT dir, k AS depth, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') above FROM (SELECT DISTINCT dir FROM base), range(0, 64) r(k) WHERE k <= len(string_split(dir, '/'))),
inherited AS (SELECT dir, arg_max(license, depth) dir_license, arg_max(above, depth) dir_from FROM chain JOIN licences USING (above) GROUP BY dir)
SELECT doc_id, path, own_license, score, is_license_file, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NOT NULL THEN path ELSE dir_from END AS license_from
FROM found LEFT JOIN inherited USING (dir)"""
