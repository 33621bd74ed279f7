"""Licence notices in documents, in DataFrame expressions only.

Each sentence of a line is judged, and so is each run over a sentence's or line's end: its last words and
what follows it in its paragraph, as far as the longest notice reaches. A logistic
regression over word pairs and triples tells licence families apart, with a class for licences of other names and
one for everything else; it is trained on notices and on variants of them, and its temperature is set on other variants. Documents are scored
by joining their hashed word pairs and triples with the sparse weights. A predicted
family is confirmed if the line or run holds most of the pairs and triples of one of its notices.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.tables import whole_text

# Usual notices of each family, public texts.
NOTICES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "License: AGPL-3.0",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
        "Licensed under the Apache 2.0 license.",
        "Available under the terms of the Apache License 2.0.",
        "Distributed under the Apache License, Version 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD-3-Clause",
        "Licensed under the BSD license.",
        "Available under the terms of the BSD license.",
        "Distributed under the BSD license.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPL-3.0",
        "Licensed under the GPL.",
        "Available under the terms of the GNU General Public License.",
        "Distributed under the GNU General Public License, version 2.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "License: ISC",
        "Licensed under the ISC license.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "License: LGPL-2.1",
        "Available under the terms of the GNU Lesser General Public License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "Available under the terms of the MIT license.",
        "Distributed under the MIT license.",
        "Licensed under MIT.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
        "Available under the terms of the Mozilla Public License.",
    ),
}
OTHER = "unknown"
# Notices of licences whatever their names; a name is one or two words that no notice holds.
UNLISTED = "unlisted"
UNLISTED_TEXTS = (
    "Licensed under the {} License, version 1.0.",
    "Licensed under the {} Public License, version 2.0.",
    "Licensed under the {} license.",
    "Distributed under the {} License, Version 1.0.",
    "Distributed under the {} Software License, version 2.0.",
    "Released under the {} License.",
    "Released under the {} Public License, Version 2.",
    "Available under the terms of the {} License.",
    "This program and the accompanying materials are made available under the terms of the {} Public License v1.0",
    "This software is released into the public domain.",
    "The author places this work in the public domain and disclaims copyright to this source code.",
    "This is free software, dedicated to the public domain.",
    "Anyone is free to use, copy, modify or distribute this software for any purpose.",
    "SPDX-License-Identifier: {}",
)
OTHER_TEXTS = (
    "All rights reserved. No part of this publication may be reproduced without written permission.",
    "Licensed under the terms of the customer agreement between the parties.",
    "Released under the supervision of the committee in spring.",
    "This work is licensed to members of the association only.",
    "The driving license was issued under the name of the owner, version 2.",
    "You may not use this form except in compliance with the rules.",
    "The general public was admitted to the library free of charge.",
    "Permission is granted to park in the marked places with or without a card.",
    "The source of the river and the terms of the treaty were discussed.",
    "The park is free and open to the public at any time.",
    "The book was released under the title of the film in the public library.",
    "Tickets are available under the terms of the offer.",
    "The leaflets were distributed under the doors of the village.",
    "The work of the author was placed in the museum.",
    "The prisoners were released into the care of the town.",
    "Anyone is free to use the hall for any purpose.",
    "This program is subject to change; you can modify it under the terms of your contract.",
    "",
)
FAMILIES = (*sorted(NOTICES), UNLISTED, OTHER)
SEED, VARIANTS = 11, 12
CERTAIN, COVERED = 0.5, 0.5
# A line's end, or a sentence's: a stop and a space.
ENDS = r"\n|(?<=[.!?])[ \t]+"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def grams(words: list[str]) -> list[str]:
    """Word pairs and triples, joined by spaces."""
    return [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


LONGEST = max(len(words_of(t)) for notices in NOTICES.values() for t in notices)


@lru_cache(1)
def telling_words() -> tuple[str, ...]:
    """Words of which each run that confirms a notice holds one: without them, too few of any notice's pairs and triples are left."""
    chosen: set[str] = set()
    for notice in (t for notices in NOTICES.values() for t in notices):
        every = {*grams(words_of(notice))}
        for word in sorted({*words_of(notice)}, key=lambda w: (-len(w), w)):
            if len([g for g in every if not chosen & {*g.split()}]) < COVERED * len(every):
                break
            chosen.add(word)
    return tuple(sorted(chosen))


def variants(rng: random.Random) -> tuple[list[list[str]], list[int]]:
    """Notices with words left out, cut short or among other words; short scraps of them count as other."""
    texts, labels = [], []
    for family, notices in NOTICES.items():
        for words in map(words_of, notices):
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > rng.choice([0, 0, 0.08])]
                texts.append(["q"] * rng.randrange(5) + kept + ["q"] * rng.randrange(5))
                labels.append(FAMILIES.index(family))
                if len(words) < 3:
                    continue
                size = max(2, len(words) // 4)
                start = rng.randrange(max(1, len(words) - size + 1))
                texts.append(["q"] * 4 + words[start : start + size])
                labels.append(FAMILIES.index(OTHER))
    for text in UNLISTED_TEXTS:
        for _ in range(VARIANTS):
            words = words_of(text.format(" ".join(["q"] * rng.randrange(1, 3))))
            texts.append(["q"] * rng.randrange(5) + [w for w in words if rng.random() > 0.03] + ["q"] * rng.randrange(5))
            labels.append(FAMILIES.index(UNLISTED))
    for text in OTHER_TEXTS:
        for _ in range(VARIANTS):
            texts.append([w for w in words_of(text) if rng.random() > 0.05])
            labels.append(FAMILIES.index(OTHER))
    return texts, labels


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def trained() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The vocabulary, its weights by family over the temperature, and the intercepts."""
    unlisted = (g for t in UNLISTED_TEXTS for g in grams(words_of(t.format("q"))) if "q" not in g.split())
    vocabulary = sorted({*unlisted, *(g for notices in NOTICES.values() for t in notices for g in grams(words_of(t)))})
    number = {g: i for i, g in enumerate(vocabulary)}

    def counted(texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for row, words in enumerate(texts):
            for g in grams(words):
                if g in number:
                    x[row, number[g]] += 1
        return x

    texts, labels = variants(random.Random(SEED))
    x, y = counted(texts), np.eye(len(FAMILIES))[labels]
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES))
    for _ in range(400):
        rest = (softmax(x @ w + b) - y) / len(y)
        w -= 2.0 * (x.T @ rest + 1e-4 * w)
        b -= 2.0 * rest.sum(0)
    texts, labels = variants(random.Random(SEED + 1))
    z = counted(texts) @ w + b
    loss = {t: -np.log(softmax(z / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
    heat = min(loss, key=loss.get)
    return vocabulary, w / heat, b / heat


def gram_hashes(words: Column) -> Column:
    """Hashes of the pairs and triples of an array of word hashes; an odd number out is null."""

    def at(i: Column) -> Column:
        a, b, c = F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
        return F.array(F.when(b.isNotNull(), F.xxhash64(a, b)), F.when(c.isNotNull(), F.xxhash64(a, b, c)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def weight_table(spark: SparkSession) -> DataFrame:
    """(gram, w0, w1, ...): the hash of each pair and triple of the notices with its weights; as many rows as they have."""
    vocabulary, weights, _ = trained()
    names = [f"w{k}" for k in range(len(FAMILIES))]
    rows = [(g, *map(float, w)) for g, w in zip(vocabulary, weights)]
    table = spark.createDataFrame(rows, "name string, " + ", ".join(f"{n} double" for n in names))
    hashes = F.transform(F.split("name", " "), lambda w: F.xxhash64(w))
    table = table.select(hashes.alias("h"), *names)
    two, three = F.xxhash64(F.get("h", 0), F.get("h", 1)), F.xxhash64(F.get("h", 0), F.get("h", 1), F.get("h", 2))
    return table.select(F.when(F.size("h") == 2, two).otherwise(three).alias("gram"), *names)


def notice_table(spark: SparkSession) -> DataFrame:
    """(family, notices): the gram hashes of each notice of a family."""
    rows = [(family, t) for family, notices in NOTICES.items() for t in notices]
    table = spark.createDataFrame(rows, "family string, notice string")
    own = table.select("family", word_hashes(F.col("notice")).alias("h")).select("family", gram_hashes(F.col("h")).alias("g"))
    own = own.select("family", F.array_distinct(F.array_compact("g")).alias("g"))
    return own.groupBy("family").agg(F.collect_list("g").alias("notices"))


def licence_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, family, probability, coverage, confirmed) of every line with a weighed pair or triple
    that is not plainly something else, and of every confirmed run of lines whose family none of its lines confirms.

    The end of a sentence counts as the end of a line, so each notice of a line is judged on its own.
    ``family`` is "unknown" where no family reaches ``CERTAIN``, or the licence is of another name. Both broadcast tables hold
    the notices above, a fixed number of rows.
    """
    spark = docs.sparkSession
    _, _, intercepts = trained()
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(whole_text(), ENDS).alias("lines"), _tells(whole_text()).alias("tells"))
    numbered = split.select("doc_id", "row", F.posexplode(_with_next("lines", F.col("tells"))).alias("line_no", "x"))
    # a line alone, then with what follows it
    units = F.array(F.lit(""), F.when(_tells(F.concat_ws(" ", "x.line", "x.next")), F.col("x.next")).otherwise(""))
    numbered = numbered.select("doc_id", "row", "line_no", "x.line", F.posexplode(units).alias("run", "next")).filter("run = 0 or next <> ''")
    hashed = numbered.select("doc_id", "row", "line_no", "run", "line", "next", _unit_hashes().alias("h"))
    pairs = hashed.select("doc_id", "row", "line_no", "run", "line", "next", gram_hashes(F.col("h")).alias("grams"))
    # explode_outer: for explode Spark adds a filter that works out all pairs once more
    each = pairs.select("doc_id", "row", "line_no", "run", "line", "next", F.explode_outer("grams").alias("gram"))
    met = each.join(F.broadcast(weight_table(spark)), "gram")
    sums = [(F.sum(f"w{k}") + float(b)).alias(f"z{k}") for k, b in enumerate(intercepts)]
    scored = met.groupBy("doc_id", "row", "line_no", "run").agg(F.first("line").alias("line"), F.first("next").alias("next"), *sums)
    # the sums as one array: as columns of their own, the optimizer's inferred filters fill the driver
    where = ("doc_id", "row", "line_no", "run", "line", "next")
    scored = scored.select(*where, F.array(*[F.col(f"z{k}") for k in range(len(FAMILIES))]).alias("z"))
    top = F.array_max("z")
    odds = F.aggregate("z", F.lit(0.0), lambda total, z: total + F.exp(z - top))
    likely = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("z", top).cast("int"))
    scored = scored.select(*where, likely.alias("likely"), (1 / odds).alias("probability"))
    certain = (F.col("probability") >= CERTAIN) & (F.col("likely") != UNLISTED)
    sure = F.when(certain, F.col("likely")).otherwise(OTHER)
    scored = scored.filter(F.col("likely") != OTHER).select(*where, sure.alias("family"), "probability")
    scored = scored.withColumn("h", _unit_hashes()).withColumn("own", gram_hashes(F.col("h")))
    scored = scored.join(F.broadcast(notice_table(spark)), "family", "left")
    covered = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("own"))) / F.size(n)))
    scored = scored.withColumn("coverage", F.coalesce(covered, F.lit(0.0)))
    scored = scored.select(*where, "family", "probability", "coverage", (F.col("coverage") >= COVERED).alias("confirmed"))
    kept = _own_runs(scored.filter("run = 0 or confirmed"))
    line = F.when(F.col("run") == 1, F.concat_ws("\n", "line", "next")).otherwise(F.col("line"))
    return kept.select("doc_id", "line_no", line.alias("line"), "family", "probability", "coverage", "confirmed")


def _tells(text: Column) -> Column:
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(telling_words()) + r")(?![\p{L}\p{N}])")


def _with_next(lines: str, tells: Column) -> Column:
    """(line, next) of each line: ``next`` is what follows up to a line without words, at most as many words as the longest notice.

    ``lines`` is a column of its own, as a lambda would work out an expression once per line.
    """
    gap, word = r"[^\p{L}\p{N}\n]*+", r"[\p{L}\p{N}]++"
    start = rf"^{gap}{word}(?:{gap}\n?+{gap}{word}){{0,{LONGEST - 1}}}+"

    def pair(line: Column, i: Column) -> Column:
        after = F.array_join(F.slice(lines, i + 2, F.lit(LONGEST)), "\n")
        return F.struct(line.alias("line"), F.regexp_extract(after, start, 0).alias("next"))

    return F.when(tells, F.transform(lines, pair)).otherwise(F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit("").alias("next"))))


def _unit_hashes() -> Column:
    """Word hashes of a line, or of a run: the line's last words, as many as the longest notice has, and what follows."""
    own = word_hashes(F.col("line"))
    tail = F.slice(own, F.greatest(F.size(own) - LONGEST + 1, F.lit(1)), F.lit(LONGEST))
    return F.when(F.col("run") == 0, own).otherwise(F.concat(tail, word_hashes(F.col("next"))))


def _own_runs(found: DataFrame) -> DataFrame:
    """Without the runs whose family one of their lines confirms, and those that share lines with a better run, the last of equals."""
    by = Window.partitionBy("doc_id", "row", "family").orderBy("line_no")
    line = F.min(F.when(F.col("confirmed") & (F.col("run") == 0), F.col("line_no"))).over(by.rangeBetween(0, LONGEST))
    last = F.col("line_no") + 1 + F.regexp_count("next", F.lit("\n"))
    place = F.when(F.col("run") == 1, F.struct("coverage", "line_no"))
    span = F.when(F.col("run") == 1, F.struct("coverage", "line_no", last.alias("last")))
    near = F.collect_list(span).over(by.rangeBetween(-LONGEST, LONGEST))
    marked = found.withColumns({"_line": line, "_last": last, "_place": place, "_near": near})
    better = F.exists(
        "_near", lambda x: (F.struct(x["coverage"], x["line_no"]) > F.col("_place")) & (x["line_no"] <= F.col("_last")) & (x["last"] >= F.col("line_no"))
    )
    kept = (F.col("run") == 0) | (F.coalesce(F.col("_line") > F.col("_last"), F.lit(True)) & ~better)
    return marked.filter(kept).drop("_line", "_last", "_place", "_near")


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, families (sorted, confirmed ones), n_confirmed, n_unknown and the lines found.

    Null and empty texts have none. Rows with the same doc_id, null included, share the
    findings of all of them. ``n_unknown`` counts lines that read like a licence but belong
    to no family for certain, or whose notice is not confirmed.
    """
    line = F.struct("line_no", "line", "family", "confirmed")
    lines = licence_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    lines = lines.select(F.col("doc_id").alias("_id"), "lines")
    joined = docs.select("doc_id").join(lines, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    found = F.coalesce("lines", F.array().cast("array<struct<line_no:int,line:string,family:string,confirmed:boolean>>"))
    joined = joined.select("doc_id", found.alias("lines"))
    sure = F.filter("lines", lambda x: x["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    n = F.size(sure).cast("long")
    return joined.select("doc_id", families.alias("families"), n.alias("n_confirmed"), (F.size("lines") - n).alias("n_unknown"), "lines")
