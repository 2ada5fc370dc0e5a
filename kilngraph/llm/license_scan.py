"""License scans by diagonal voting, with DataFrame functions only.

All rolling three-word hashes of a text are joined to the template positions of the same hash (a fixed, small table that
is broadcast; hashes that it does not have are left out before they become rows) and of the same words; matches are
aggregated by template and offset diagonal (text position less template position), neighbouring diagonals are merged (words
put in or left out move the diagonal), and a span is verified: it counts when enough of its template's words stand in it in the
template's order.  One shuffle, of matches and one marker row a text; no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
#: Diagonals this near to each other are one span.
GAP = 4
#: Share of a template's positions that a merged span must cover.
COVER = 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count where their words stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Well-known notices, whole or their distinctive sentences; these are found also when they are slightly changed.
TEMPLATES = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "released into the public domain by the author": "public-domain",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
}


def template_positions(spark: SparkSession, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """(hash, gram, template, position, grams, label, base): a row for each three words of a phrase, and one marker row."""
    rows = []
    for k, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in (BASE if base is None else base).items()), *((p, x, False) for p, x in (TEMPLATES if templates is None else templates).items())]):
        words = re.findall(WORD, phrase)
        if len(words) < GRAM:
            raise ValueError(f"a phrase needs {GRAM} words: {phrase}")
        for i in range(len(words) - GRAM + 1):
            gram = F.xxhash64(*[F.lit(w) for w in words[i : i + GRAM]])
            rows.append(F.struct(gram.alias("hash"), F.lit(" ".join(words[i : i + GRAM])).alias("gram"), F.lit(k).alias("template"), F.lit(i).alias("position"), F.lit(len(words) - GRAM + 1).alias("grams"), F.lit(label).alias("label"), F.lit(is_base).alias("base")))
    marker = F.struct(F.lit(0).cast("long").alias("hash"), F.lit("").alias("gram"), F.lit(-1).alias("template"), F.lit(0).alias("position"), F.lit(0).alias("grams"), F.lit("").alias("label"), F.lit(False).alias("base"))
    return spark.range(1).select(F.inline(F.array(marker, *rows)))


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places where a base phrase's words stand consecutively; first_word, last_word: smallest and largest start,
    null without a place; labels: those of the base phrases and of the templates covered; score: best cover.  A template is
    covered where `cover` of its three-word grams stand in a span in the template's order, each once.
    A null text is empty: no words, empty labels, score 0.  Each row gives a row, also where rows repeat.
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    positions = template_positions(docs.sparkSession, base, templates)
    known = [r["hash"] for r in positions.select("hash").distinct().collect()]  # as many as the phrases have words
    gram = lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("hash"), i.alias("at"))
    grams = F.filter(F.transform("words", gram), lambda g: g["hash"].isin(known) & (g["at"] <= F.size("words") - GRAM))
    spelt = F.transform(grams, lambda g: F.struct(g["hash"].alias("hash"), g["at"].alias("at"), F.array_join(F.slice("words", g["at"] + 1, GRAM), " ").alias("gram")))
    mark = F.struct(F.lit(0).cast("long").alias("hash"), F.size("words").alias("at"), F.lit("").alias("gram"))
    rows = words.select("doc_id", "key", F.inline(F.concat(spelt, F.array(mark))))
    votes = rows.join(F.broadcast(positions), ["hash", "gram"])
    votes = votes.select("doc_id", "key", "template", "grams", "label", "base", "position", (F.col("at") - F.col("position")).alias("diagonal"))
    votes = votes.repartition("doc_id", "key")  # what follows needs no other shuffle
    lines = votes.groupBy("doc_id", "key", "template", "grams", "label", "base", "diagonal").agg(F.collect_set("position").alias("positions"), F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("template") < 0), True).otherwise(F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True)))
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    places = F.transform("positions", lambda p: F.struct(p.alias("p"), (p + F.col("diagonal")).alias("at")))
    spans = lines.withColumn("places", places).groupBy("doc_id", "key", "template", "grams", "label", "base", "span").agg(
        F.min("diagonal").alias("start"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.max("n").alias("n")
    )
    # the template's positions in order, each at the next place of the text behind the one before
    first = F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("at"), F.lit(0).alias("n"))
    ordered = F.aggregate("places", first, lambda s, x: F.when((x["p"] > s["p"]) & (x["at"] > s["at"]), F.struct(x["p"].alias("p"), x["at"].alias("at"), (s["n"] + 1).alias("n"))).otherwise(s))
    spans = spans.withColumn("covered", ordered["n"])
    share = F.col("covered") / F.greatest("grams", F.lit(1))
    real = F.col("template") >= 0
    place = real & F.col("base") & (F.col("covered") == F.col("grams"))
    found = place | (real & ~F.col("base") & (share >= cover))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "key").agg(
        F.max(F.when(~real, F.col("start"))).cast("long").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        names(place).alias("base_labels"), names(found).alias("labels"), F.round(F.coalesce(F.max(F.when(found, share)), F.lit(0.0)), 6).alias("score"),
        F.max(F.when(~real, F.col("n"))).cast("int").alias("rows"),
    )
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
