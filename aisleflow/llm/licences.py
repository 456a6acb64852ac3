"""Licence scan: lines and windows of a text against licence templates by Dice similarity over word bigrams.

A text and its lines are normalised to words. Dice similarity can only reach the threshold for sizes
within a factor of each other, so a unit only meets templates in its size range, and only through the
bigrams they share. Windows as long as a template are laid over the whole text, so a notice that is wrapped
over lines or stands within a longer line is met as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aisleflow.llm.storage import materialize

#: Bigrams of all templates up to which they are sent to every task.
SMALL = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The notices by which texts declare a licence, and the paragraphs of short licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "This project is licensed under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
}


def templates(spark: SparkSession, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(name, i, text) for name, versions in texts.items() for i, text in enumerate(versions)], "licence string, version int, template string")


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lowered."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))


def bigrams(w: Column) -> Column:
    """Pairs of neighbouring words, repeats included."""
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))


def _words_of_lines(lines: Column) -> Column:
    """The words of all lines in order: line, bigrams ``n`` of that line, whether the next word is ``inside`` it."""
    return F.flatten(F.transform(lines, lambda w, i: F.transform(w, lambda x, j: F.struct(i.alias("line"), (F.size(w) - 1).alias("n"), (j < F.size(w) - 1).alias("inside"), x.alias("word")))))


def _pairs(flat: Column) -> Column:
    """The bigrams of a text's words: place ``p`` and gram, beside what is known of the first word."""
    n = F.greatest(F.size(flat) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(flat, F.lit(1), n), F.slice(flat, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), F.concat(a["word"], F.lit(" "), b["word"]).alias("gram")))
    return F.transform(pairs, lambda x, p: F.struct(p.alias("p"), x["a"]["line"].alias("line"), x["a"]["n"].alias("n"), x["a"]["inside"].alias("inside"), x["gram"].alias("gram")))


def _best_window(hits: Column, of: str, threshold: float) -> Column:
    """struct<common, line> of the first best window of ``of`` places that starts at a hit. ``hits`` is
    sorted by place p; a window of ``of`` places has at most ``of`` of them, so each start looks at its next few only.
    The best window over all places starts at a hit, as one that does not loses nothing on its way to the next."""

    def common(hits: Column, start: Column, i: Column) -> Column:
        own = F.filter(F.slice(hits, i + 1, F.col(of)), lambda x: x["p"] < start["p"] + F.col(of))
        several = F.filter(own, lambda x: x["times"] > 1)  # grams that the template repeats
        again = F.transform(F.array_distinct(F.transform(several, lambda x: F.struct(x["gram"].alias("gram"), x["times"].alias("times")))), lambda g: F.least(g["times"], F.size(F.filter(several, lambda x: x["gram"] == g["gram"])).cast("long")) - 1)
        n = F.size(F.array_distinct(F.transform(own, lambda x: x["gram"]))) + F.aggregate(again, F.lit(0).cast("long"), lambda s, x: s + x)
        n = F.when(F.size(own) >= F.lit(threshold) * F.col(of), n).otherwise(0)
        return F.struct(n.alias("common"), (-start["p"]).alias("first"), start["line"].alias("line"))

    # an array of one binds the sorted hits to a name: an expression that a lambda names runs once per element
    return F.transform(F.array(hits), lambda h: F.array_max(F.transform(h, lambda start, i: common(h, start, i))))[0]


def scan(docs: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """One row per document: doc_id, licence, score, line (from 0, null for the whole text) and
    n_lines, the number of places (lines, whole text) at which a unit matches.

    Units are the lines of a text and, if it has several lines with words, the whole text. A licence that none
    of them matches is looked for in windows: for each of its templates the best window of as many words over
    all lines, the first one of several; it stands on the line of its
    first word, and past the end of the text it is filled with blanks. A unit
    matches a template if the Dice coefficient of their bigrams, counted with repeats, is
    ``threshold`` or more; the best match names the document's licence, ties by licence and line.
    Documents without a match have nulls and 0. ``texts`` is (licence, version, template).

    Edge cases: null and empty texts and units of a single word match nothing; a null id is an id;
    rows with the same id are one document and give one row; other columns are ignored;
    empty frames of documents or templates give no matches.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = texts.select("licence", "version", bigrams(words(F.col("template"))).alias("b")).where(F.size("b") > 0).withColumn("of", F.size("b"))
    grams = marks.select("licence", "version", "of", F.explode("b").alias("gram")).groupBy("licence", "version", "of", "gram").agg(F.count(F.lit(1)).alias("times"))
    size = marks.agg(F.sum("of").alias("grams")).first()

    split = base.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), F.transform(F.split("text", "\n"), words).alias("lines"))
    split = split.select("doc_id", "row", "lines", (F.size(F.filter("lines", lambda w: F.size(w) > 0)) > 1).alias("several"), F.aggregate("lines", F.lit(-1), lambda n, w: n + F.size(w)).alias("total"))
    found = split.select("doc_id", "row", "several", "total", F.transform(F.array(_words_of_lines(F.col("lines"))), _pairs)[0].alias("hits"))
    if (size["grams"] or 0) <= SMALL:
        # few templates: their bigrams select those of a text before anything is written out
        grams = F.broadcast(grams)
        known = [r["gram"] for r in grams.select("gram").distinct().collect()]
        found = found.withColumn("hits", F.filter("hits", lambda h: h["gram"].isin(known)))
    # outer, as a condition on the array itself would compute it once more
    units = found.select("doc_id", "row", "several", "total", F.inline_outer("hits")).where("gram is not null")
    # what is left are the few texts and bigrams that licences share; two kinds of units are made of them
    hits = materialize(units.join(grams, "gram"), "licence-hits")

    places = F.array(
        F.when(F.col("inside"), F.struct(F.col("line").alias("at"), F.col("n").alias("size"))),
        F.when(F.col("several"), F.struct(F.lit(None).cast("int").alias("at"), F.col("total").alias("size"))),
    )
    shared = hits.select("doc_id", "licence", "version", "of", "gram", "times", F.explode(F.filter(places, lambda u: u.isNotNull())).alias("u"))
    shared = shared.select("doc_id", "licence", "version", "of", "gram", "times", F.col("u.at").alias("line"), F.col("u.size").alias("n"))
    # 2 * min(n, of) >= threshold * (n + of) bounds the size of a unit by that of the template
    shared = shared.where(2 * F.least("n", "of") >= F.lit(threshold) * (F.col("n") + F.col("of")))
    rated = shared.groupBy("doc_id", "line", "n", "licence", "version", "of", "gram", "times").agg(F.count(F.lit(1)).alias("here"))
    rated = rated.groupBy("doc_id", "line", "n", "licence", "version", "of").agg(F.sum(F.least("here", "times")).alias("common"))
    rated = rated.withColumn("score", 2 * F.col("common") / (F.col("n") + F.col("of")))

    # grams that a text repeats count as often as the template has them, an upper bound for any window
    counted = hits.groupBy("doc_id", "row", "licence", "version", "of", "gram", "times").agg(F.collect_set(F.struct("p", "gram", "line", "times")).alias("hits"))
    counted = counted.groupBy("doc_id", "row", "licence", "version", "of").agg(F.sum(F.least(F.size("hits"), "times")).alias("most"), F.flatten(F.collect_list("hits")).alias("hits"))
    windows = counted.where(F.col("most") >= F.lit(threshold) * F.col("of")).withColumn("best", _best_window(F.array_sort("hits"), "of", threshold))
    windows = windows.select("doc_id", F.col("best.line").alias("line"), "licence", (F.col("best.common") / F.col("of")).alias("score"))

    per_unit = rated.select("doc_id", "line", "licence", "score", F.lit(0).alias("kind")).unionByName(windows.withColumn("kind", F.lit(1))).where(F.col("score") >= threshold)
    per_unit = per_unit.withColumn("first", F.min("kind").over(W.partitionBy("doc_id", "licence"))).where("kind = first")
    per_unit = per_unit.groupBy("doc_id", "line", "licence").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "licence", F.asc_nulls_last("line")))
    ranked = per_unit.withColumn("place", best)
    picked = ranked.groupBy(F.col("doc_id").alias("_id")).agg(*[F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in ("licence", "score", "line")], F.count_distinct(F.coalesce("line", F.lit(-1))).alias("n_lines"))
    ids = base.select("doc_id").distinct()
    return ids.join(picked, ids["doc_id"].eqNullSafe(F.col("_id")), "left").select("doc_id", "licence", "score", F.col("line").cast("long"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
