"""License scan by a positional index of rare words, in DataFrame functions only.

1. One pass over the texts splits each into normalised words, once, and takes
   the postings of the phrases' words from it: (word, place).  Base phrases are
   runs of postings at consecutive places.  A text keeps its words for the next
   steps only if the postings hold every word of some template's mandatory
   phrases.
2. The document frequency of every such word over all documents; there are no
   more of them than words in the phrases.
3. Each template is looked up by the rarest words (highest IDF) of its own
   mandatory phrases: place in the file minus place in the template is an
   offset, and the postings are intersected by counting the words that agree on
   the same offset.  Wherever the phrases stand all their words do, so no place
   of them is missed, whatever other templates the text holds.
4. At each such offset the mandatory phrases must stand where the template has
   them, and the template must agree with the text in at least half of its words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .scratch import table

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, mandatory phrases, and the text of a notice, a file header or a licence's own grant.
TEMPLATES = (
    ("gpl-3.0", ("gnu general public license version 3",), "This work is licensed under the GNU General Public License version 3"),
    ("apache-2.0", ("apache license version 2 0",), "Licensed under the Apache License, Version 2.0"),
    ("mit-notice", ("mit license",), "Released under the MIT License"),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "Licensed under CC BY-NC 4.0"),
    (
        "cc-by-4.0",
        ("creative commons attribution 4 0",),
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    (
        "cc0-1.0",
        ("has waived all copyright and related or neighboring rights",),
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    (
        "mit",
        ("granted free of charge to any person obtaining a copy of this software",),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "gpl-notice",
        ("under the terms of the gnu general public license",),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program.",
    ),
    (
        "lgpl-notice",
        ("under the terms of the gnu lesser general public license",),
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "agpl-notice",
        ("under the terms of the gnu affero general public license",),
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "apache-header",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-2-clause",
        ("redistributions in binary form must reproduce", "provided with the distribution this software is provided by"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY",
    ),
    (
        "bsd-3-clause",
        ("redistributions in binary form must reproduce", "neither the name of"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        ("permission to use copy modify and or distribute this software",),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        ("mozilla public license v 2 0",),
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
    ),
    (
        "bsl-1.0",
        ("any person or organization obtaining a copy of the software",),
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software",
    ),
    (
        "zlib",
        ("permission is granted to anyone to use this software for any purpose",),
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
    (
        "unlicense",
        ("free and unencumbered software released into the public domain",),
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: Words by which a template is looked up.
ASKED = 2
MIN_FRACTION = 0.5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a fixed value."""
    return re.split(NOT_WORD, text.lower().strip("()\"'. "))


def _find(body: list[str], key: list[str]) -> int:
    return next(i for i in range(len(body)) if body[i : i + len(key)] == key)


#: Of each template: label, words, and the mandatory words as (place, word).
BODIES = [(label, words_of(text)) for label, _, text in TEMPLATES]
MUST = [
    sorted({(_find(body, k.split()) + n, w) for k in keys for n, w in enumerate(k.split())})
    for (_, keys, _), (_, body) in zip(TEMPLATES, BODIES, strict=True)
]
#: Words of phrases: the index has postings of these.
INDEXED = sorted({w for must in MUST for _, w in must} | {w for p in PHRASES for w in p.split()})


def normalise(text: Column) -> Column:
    """Lower-case words joined by one space.

    ``lower`` also changes letters beyond A-Z.  Those are word characters
    before and after, so no word begins or ends elsewhere, and the only one
    that turns into a single ASCII letter is the Kelvin sign, kept as it is.
    """
    kelvin = "K"
    low = F.lower(F.coalesce(text, F.lit("")))
    whole = F.when(text.contains(kelvin), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(low)
    return F.trim(F.regexp_replace(whole, NOT_WORD, " "))


def _features(docs: DataFrame) -> DataFrame:
    norm = docs.select("doc_id", normalise(F.col("text")).alias("norm"))

    def per_text(words: Column) -> Column:
        # (word, place) of indexed words only; all words of a phrase are indexed, so it is a run of postings
        posted = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(INDEXED), F.struct(w.alias("w"), i.alias("p")))))
        return F.struct(posted.alias("hits"), F.size(words).cast("long").alias("n"), words.alias("words"))

    def stands(hits: Column, j: Column, start: Column, phrase: str) -> Column:
        follows = [(F.get(hits, j + k)["w"] == w) & (F.get(hits, j + k)["p"] == start + k) for k, w in enumerate(phrase.split())]
        return F.coalesce(reduce(lambda a, b: a & b, follows), F.lit(False))

    def places(hits: Column) -> Column:
        at = lambda x, j: F.array(*(F.when(stands(hits, j, x["p"], p), F.struct(F.lit(label).alias("label"), x["p"].alias("p"))) for p, label in PHRASES.items()))
        return F.array_compact(F.flatten(F.transform(hits, at)))

    split = norm.select("doc_id", F.when(F.col("norm") != "", let(F.split("norm", " "), per_text)).alias("x"))
    found = split.select("doc_id", "x", F.array_distinct(F.col("x.hits.w")).alias("present"), let(F.col("x.hits"), places).alias("base"))
    held = [F.size(F.array_intersect(F.array(*map(F.lit, sorted({w for _, w in must}))), F.col("present"))) == len({w for _, w in must}) for must in MUST]
    whole = F.when(F.size("present") > 0, reduce(lambda a, b: a | b, held)).otherwise(False)
    return found.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce("x.n", F.lit(0).cast("long")).alias("n_words"),
        F.col("base.p").alias("starts"),
        F.sort_array(F.array_distinct(F.col("base.label"))).alias("base"),
        "present",
        F.when(whole, F.struct("x.hits", "x.words")).alias("kept"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``.

    doc_id, n_words, n_base (places of the base phrases), first_word and
    last_word (their smallest and largest start, words from 0; null without a
    place), base_labels, labels (base and method), score.  The score is the
    largest share of a found template's words that stand where it has them, at
    least 0.5 where a base phrase stands, else 0.  A null text is an empty
    one: no words, no labels.  Repeated rows and null doc_ids come back as they
    are; other columns are ignored.
    """
    features = table(_features(docs.select("doc_id", "text")), "license-words")
    spark = docs.sparkSession
    seen = features.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    posted = _postings({r["w"]: r["df"] for r in seen.collect()})  # at most one row for each indexed word
    candidates = features.where("kept is not null").select("row", "kept.hits", "kept.words")
    asked_for = sorted({w for w, _, _ in posted})
    found = candidates.select("row", F.explode(F.filter("hits", lambda x: x["w"].isin(asked_for))).alias("x")).select("row", "x.w", "x.p")
    rows = [F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(q).alias("q")) for w, t, q in posted]
    votes = found.join(F.broadcast(_rows(spark, rows)), "w").groupBy("row", "t", (F.col("p") - F.col("q")).alias("off")).agg(F.count("*").alias("votes"))
    asked = F.array(*(F.lit(sum(x == t for _, x, _ in posted)) for t in range(len(TEMPLATES))))
    offsets = votes.where(F.col("votes") == F.get(asked, F.col("t"))).select("row", "t", "off")
    aligned = offsets.join(F.broadcast(_bodies(spark)), "t").join(candidates.select("row", "words"), "row")
    at = lambda q: F.when(F.col("off") + q >= 0, F.get("words", F.col("off") + q))
    must = F.forall("must", lambda m: F.coalesce(at(m["q"]) == m["w"], F.lit(False)))
    agree = F.filter(F.transform("body", lambda w, q: at(q) == w), lambda x: x)
    checked = aligned.where(must).select("row", "label", (F.size(agree) / F.size("body")).alias("share")).where(F.col("share") >= MIN_FRACTION)
    own = checked.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    n_base = F.coalesce(F.size("starts"), F.lit(0)).cast("long")
    n_base = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(n_base).cast("long")
    base = F.coalesce("base", none)
    return features.join(own, "row", "left").select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("own", none))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def _postings(frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, place) of the ASKED rarest words of each template's mandatory phrases."""
    posted = []
    for t, must in enumerate(MUST):
        rarest = sorted(must, key=lambda m: (frequency.get(m[1], 0), m[1], m[0]))[:ASKED]
        posted += [(w, t, q) for q, w in rarest]
    return posted


def _bodies(spark: SparkSession) -> DataFrame:
    """One row a template: its label, words, and mandatory words with their places."""
    rows = []
    for t, ((label, body), must) in enumerate(zip(BODIES, MUST, strict=True)):
        marks = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(w).alias("w")) for q, w in must))
        rows.append(F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.array(*map(F.lit, body)).alias("body"), marks.alias("must")))
    return _rows(spark, rows)


def _sql() -> str:
    """DuckDB SQL for ``scan`` over ``documents``: phrase and share decide at every place, without an index."""
    rows, seeds, places = [], [], []
    for n, ((label, keys, _), (_, body)) in enumerate(zip(TEMPLATES, BODIES, strict=True)):
        at = [_find(body, k.split()) for k in keys]
        text = ", ".join(f"'{w}'" for w in body)
        rows.append(f"('{label}', [{text}])")
        same = " AND ".join(f"ws[i + {q + k + 1 - at[0]}] = '{w}'" for q, key in zip(at, keys, strict=True) for k, w in enumerate(key.split()))
        seeds.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: {same})) - {at[0]} AS off FROM d")
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"SELECT r, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: {same})) AS p FROM d")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t(label, body) AS (VALUES {", ".join(rows)}),
seed AS ({" UNION ALL ".join(seeds)}),
aligned AS (SELECT r, label, len(list_filter(range(len(body)), lambda q: off + q >= 0 AND ws[off + q + 1] = body[q + 1])) / len(body) AS share
  FROM seed JOIN t USING (label) JOIN d USING (r)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM aligned WHERE share >= {MIN_FRACTION} GROUP BY r),
place AS ({" UNION ALL ".join(places)}),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS b, list(DISTINCT label) AS labels FROM place GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  greatest(coalesce(share, 0.0), CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN own USING (r) LEFT JOIN base USING (r)"""


SQL = _sql()
