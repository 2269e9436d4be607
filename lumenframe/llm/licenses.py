"""License scans: a trained paragraph classifier, confirmed by template comparison.

A multinomial logistic regression over sparse word 1- to 3-grams names the
licence family of a paragraph, or ``unknown``. It is trained here, on the driver,
from short public notices and variants of them against ordinary prose; weights
are made sparse by a proximal step, and a temperature fitted on held-out
variants calibrates the probabilities. Below ``LEAST_PROBABILITY`` the family is
``unknown``. A prediction is confirmed when the paragraph holds enough of the
word 3-grams of one of the family's notices.

A paragraph is a line that holds an anchor; with the neighbouring lines after it that hold an anchor or three
words of a notice one after another, as in a notice that is wrapped, it is a paragraph as well. It is reported if it is confirmed and
no line of it is confirmed by itself; its lines are reported otherwise.

Features are grams that hold an anchor: a word of the notices that ordinary
prose lacks. A paragraph without an anchor has no feature and is ``unknown`` by
the bias alone, so only paragraphs with an anchor are scored, with equal results.

Plan: DataFrame functions only. Texts are read once: lines with an anchor, few, are written
with a number of their row. They are cut into grams, which join a broadcast table (one row per
gram of the trained vocabulary or of a notice, below ``LARGEST_VOCABULARY`` rows whatever the
input) with weights and notices side by side, and are summed per paragraph.

Null and empty texts have no paragraphs. Repeated rows give repeated findings. Of families with
equal scores the first listed wins, of notices the first. Paragraph numbers count lines from 0,
blank ones included; ``lines`` is how many lines a paragraph has. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

UNKNOWN = "unknown"
LEAST_PROBABILITY = 0.6
LEAST_SIMILARITY = 0.5
LARGEST_VOCABULARY = 20_000
_WORD = re.compile(r"[a-z0-9]+")

#: Short public notices by family (fixed values).
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Distributed under the terms of the Apache License Version 2.0, January 2004.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Distributed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Released under the GPL v3.",
        "Code under GPLv3.",
        "Licensed under GPLv2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL version 2.1.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the terms of the AGPL v3.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Shared under the terms of the CC BY-NC-ND 3.0 license.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "(c) 2021 by the authors. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "This material may not be reproduced or redistributed without prior written permission of the copyright holder.",
    ),
}

#: Ordinary prose, some of it about licences without granting one (fixed values).
PROSE: tuple[str, ...] = (
    "The committee met on Tuesday to discuss the budget for the next version of the plan.",
    "She renewed her driving license after the exam and drove to work the same day.",
    "The restaurant lost its liquor license last year because of repeated complaints.",
    "A fishing license is required for any person older than sixteen.",
    "Copyright law differs between countries and is often misunderstood by authors.",
    "The city published a report on public transport and the general state of its roads.",
    "Apache helicopters were seen over the valley during the exercise.",
    "He studied at MIT before moving to the west coast to found a software company.",
    "The museum of creative arts opens its doors to the public for free on Sundays.",
    "Members of the house of commons voted on the attribution of funds.",
    "The mozilla browser was used by many people at that time.",
    "The eclipse of the moon was visible across the whole domain of the northern lights.",
    "All people have rights, and some of them are reserved for citizens only.",
    "You can use this file to write down the terms that you want to learn.",
    "The source of the river is a small lake in the mountains; no permission is needed to visit.",
    "A copy of the letter was found with the documentation of the house in 2004.",
    "The foundation gives money to schools, free of charge, under some conditions.",
    "Le comite a publie un rapport sur le budget de la ville et la version finale du plan.",
    "Die Stadt hat gestern einen neuen Bericht ueber den Verkehr und die Strassen vorgelegt.",
    "El consejo de la ciudad publico un informe sobre el estado general de las carreteras.",
    "This is a work of fiction, and the names in it are released from any resemblance.",
    "In binary form the number is easy to modify, and the code is met with interest.",
    "The international team reached version four of the list, dated the first of January.",
    "Use the following list and or the library to find the book that is available.",
    "The program was made available to a general audience without fee or restriction of age.",
    "Any use or copying of the recipe is welcome; share it with your friends for any purpose.",
    "The agreement was distributed to one or more contributors under the same terms as before.",
    "Prior written notice is strictly needed, and holders of tickets may enter the hall.",
    "The subject of the text is not to be put into later files or forms of the project, except for the style of the material they shared, v or sa or nd.",
    "A great deal of provided materials was dedicated to the holder of the accompanying and associated universal clause.",
    "Seats are reserved for guests, and all rights of way are kept.",
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str], most: int = 3) -> list[str]:
    return list(dict.fromkeys(" ".join(ws[i : i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)))


class Model:
    """``weights``: gram to one number a class; ``classes[0]`` is unknown; ``templates``: family, 3-grams."""

    def __init__(self, classes, anchors, weights, bias, temperature, templates):
        self.classes, self.anchors, self.weights, self.bias = classes, anchors, weights, bias
        self.temperature, self.templates = temperature, templates

    def probabilities(self, text: str) -> np.ndarray:
        """For tests: the plain form of what Spark computes."""
        z = self.bias.copy()
        for g in grams(words(text)):
            if g in self.weights:
                z = z + self.weights[g]
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def variants(ws: list[str], rng, n: int) -> list[list[str]]:
    """Copies with words lost or set between ordinary ones."""
    filler = words(" ".join(PROSE))
    out = [ws]
    for _ in range(n):
        w = [x for x in ws if len(ws) < 6 or rng.random() > 0.08]
        a, b = (int(x) for x in rng.integers(0, 9, 2))
        start = int(rng.integers(0, len(filler) - 20))
        out.append(filler[start : start + a] + w + filler[start + a : start + a + b])
    return out


@lru_cache(maxsize=4)
def train(seed: int = 0, steps: int = 200, rate: float = 2.0, sparsity: float = 2e-4) -> Model:
    rng = np.random.default_rng(seed)
    classes = [UNKNOWN, *NOTICES]
    prose = [words(p) for p in PROSE]
    common = {w for p in prose for w in p} - {"license", "licensed", "copyright", "mit", "apache", "mozilla", "eclipse", "reserved"}
    anchors = sorted(w for w in {w for texts in NOTICES.values() for t in texts for w in words(t)} - common if not w.isdigit())
    is_anchor = set(anchors)
    rows, y, held = [], [], []
    for c, texts in enumerate(NOTICES.values(), 1):
        for t in texts:
            for j, v in enumerate(variants(words(t), rng, 7)):
                rows.append(v)
                y.append(c)
                held.append(j >= 6)
    for p in prose:
        for j, v in enumerate(variants(p, rng, 7)):
            rows.append(v)
            y.append(0)
            held.append(j >= 6)
    for a in anchors:  # an anchor alone says little
        for _ in range(2):
            start = int(rng.integers(0, 60))
            rows.append([*prose[start % len(prose)][:6], a, *prose[(start + 1) % len(prose)][:6]])
            y.append(0)
            held.append(False)
    keep = lambda g: any(w in is_anchor for w in g.split())
    sets = [[g for g in grams(r) if keep(g)] for r in rows]
    held, y = np.array(held), np.array(y)
    vocabulary = sorted({g for s, h in zip(sets, held, strict=True) if not h for g in s})
    if len(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError("vocabulary too large to broadcast")
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        x[i, [at[g] for g in s if g in at]] = 1
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, yt = x[~held], y[~held]
    share = np.bincount(yt, minlength=len(classes))
    weight = (len(yt) / len(classes) / share[yt]).astype(np.float32)
    weight[yt == 0] *= 3
    weight /= weight.sum()

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for i in range(steps):
        p = softmax(xt @ w + b)
        p[np.arange(len(yt)), yt] -= 1
        p *= weight[:, None]
        lr = rate if i < steps * 0.7 else rate / 4
        w -= lr * (xt.T @ p)
        w = np.sign(w) * np.maximum(np.abs(w) - lr * sparsity, 0)
        b -= lr * p.sum(0)
    z, yh = x[held] @ w + b, y[held]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean() for t in np.arange(0.1, 2.01, 0.05)}
    temperature = float(min(loss, key=loss.get))
    if int(b.argmax()) != 0:
        raise ValueError("the bias must favour unknown")
    used = np.flatnonzero(np.abs(w).sum(1) > 0)
    templates = [(f, [g for g in grams(words(t)) if g.count(" ") == 2] or [" ".join(words(t))]) for f, ts in NOTICES.items() for t in ts]
    return Model(classes, anchors, {vocabulary[i]: w[i].astype(np.float64) for i in used}, b.astype(np.float64), temperature, templates)


def gram_frame(spark, model: Model) -> DataFrame:
    """``(gram, w, hits)`` rows from one literal, so no Python feeds them: weights, and the notices that hold the gram with their families and sizes."""
    rows: dict[str, list[str]] = {g: [",".join(f"{v:.6f}" for v in w), ""] for g, w in model.weights.items()}
    for i, (family, grams_) in enumerate(model.templates):
        for g in grams_:
            row = rows.setdefault(g, ["", ""])
            row[1] += f"{';' if row[1] else ''}{i},{model.classes.index(family)},{len(grams_)}"
    if len(rows) > LARGEST_VOCABULARY:
        raise ValueError("vocabulary too large to broadcast")
    listed = "\n".join(f"{g}\t{w}\t{h}" for g, (w, h) in rows.items())
    made = spark.range(1).select(F.explode(F.split(F.lit(listed), "\n")).alias("r")).select(F.split("r", "\t").alias("r"))
    w = F.when(F.col("r")[1] != "", F.split(F.col("r")[1], ",").cast("array<double>"))
    hits = F.when(F.col("r")[2] != "", F.transform(F.split(F.col("r")[2], ";"), lambda h: F.split(h, ",").cast("array<int>")))
    return made.select(F.col("r")[0].alias("gram"), w.alias("w"), hits.alias("hits"))


def gram_column(n: int) -> F.Column:
    """The ``n``-grams of the word array ``ws``."""
    at = F.sequence(F.lit(1), F.size("ws") - (n - 1))
    made = F.transform(at, lambda i: F.array_join(F.slice("ws", i, n), " "))
    return F.when(F.size("ws") >= n, made).otherwise(F.array().cast("array<string>"))


def trie_pattern(words_: list[str]) -> str:
    """A pattern that matches any of the words as a whole word, branching letter by letter."""
    tree: dict = {}
    for w in words_:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def made(at: dict) -> str:
        parts = [re.escape(c) + made(k) for c, k in sorted(at.items()) if c]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        return f"(?:{body})?" if "" in at and body else body

    return f"(?<![a-z0-9]){made(tree)}(?![a-z0-9])"


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def notice_lines(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """``(rid, id, paragraph, line, anchored)``: lines, in lower case, that hold an anchor or three words of a notice
    one after another, of texts with any anchor; ``rid`` numbers rows."""
    anchor, low = trie_pattern(model.anchors), F.translate(F.col(text_col), *LOWER)
    three = sorted({g for _, grams_ in model.templates for g in grams_})
    # numbered before lines are, since one select would number lines
    rows = docs.where(low.rlike(anchor)).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), low.alias("low"))
    rows = rows.select("rid", "id", F.posexplode(F.split("low", "\n")).alias("paragraph", "line"))
    rows = rows.withColumn("anchored", F.col("line").rlike(anchor))
    return rows.where(F.col("anchored") | F.regexp_replace("line", "[^a-z0-9]+", " ").rlike(trie_pattern(three)))


def paragraphs(lines: DataFrame) -> DataFrame:
    """``(rid, id, run, paragraph, lines, line)``: every anchored line, and every run of neighbouring lines, from its first anchored one on, joined."""
    w = W.partitionBy("rid").orderBy("paragraph")
    start = F.when(F.col("paragraph") - F.lag("paragraph").over(w) == 1, 0).otherwise(1)
    numbered = lines.withColumn("run", F.sum(start).over(w))
    since = W.partitionBy("rid", "run").orderBy("paragraph").rowsBetween(W.unboundedPreceding, 0)
    numbered = numbered.withColumn("begun", F.max("anchored").over(since)).where("begun")
    runs = numbered.groupBy("rid", "run").agg(
        F.first("id").alias("id"), F.min("paragraph").alias("paragraph"), F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("paragraph", "line"))).alias("all")
    )
    joined = runs.where("lines > 1").select("rid", "id", "run", "paragraph", "lines", F.array_join(F.transform("all", lambda x: x["line"]), " ").alias("line"))
    return numbered.where("anchored").select("rid", "id", "run", "paragraph", F.lit(1).cast("long").alias("lines"), "line").unionByName(joined)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """Family, calibrated probability and nearest notice of every paragraph of which some family beats the unknown class."""
    tokens = F.regexp_extract_all("line", F.lit("[a-z0-9]+"), 0)
    key = ["rid", "run", "paragraph", "lines"]
    cut = found.select(*key, "id", tokens.alias("ws")).select(*key, "id", F.explode(F.array_distinct(F.concat(*[gram_column(n) for n in (1, 2, 3)]))).alias("gram"))
    met = written(cut.join(F.broadcast(gram_frame(found.sparkSession, model)), "gram"), "grams")
    sums = [F.sum(F.coalesce(F.col("w")[c], F.lit(0.0))).alias(f"z{c}") for c in range(len(model.classes))]
    z = F.array(*[(F.col(f"z{c}") + F.lit(float(model.bias[c]))) / F.lit(model.temperature) for c in range(len(model.classes))])
    best = met.groupBy(*key).agg(F.first("id").alias("id"), *sums).select(*key, "id", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    best = best.select(*key, "id", (F.array_position("z", F.col("top")) - 1).cast("int").alias("best"), (1 / total).alias("probability")).where("best > 0")
    hits = met.where("hits is not null").select(*key, F.explode("hits").alias("h"))
    shared = hits.groupBy(*key, F.col("h")[0].alias("template"), F.col("h")[1].alias("best")).agg((F.count(F.lit(1)) / F.max(F.col("h")[2])).alias("similarity"))
    nearest = shared.groupBy(*key, "best").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"))).alias("n"))
    return best.join(nearest, [*key, "best"], "left")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``(id, paragraph, lines, family, probability, template, similarity, confirmed)``.

    One row for every paragraph for which some family beats the unknown class;
    its family is ``unknown`` where the calibrated probability is too low.
    """
    model = model or train()
    lines = written(notice_lines(docs, model, id_col, text_col), "licence-lines")
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("best") + 1)
    known = F.col("probability") >= LEAST_PROBABILITY
    similarity = F.coalesce(F.col("n.similarity"), F.lit(0.0))
    rows = scored(paragraphs(lines), model).select(
        "rid", "run", "id", "paragraph", "lines", F.when(known, family).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("probability", 6).alias("probability"),
        (-F.col("n.t")).alias("template"), F.round(similarity, 6).alias("similarity"), (known & (similarity >= LEAST_SIMILARITY)).alias("confirmed"),
    )
    # a confirmed run stands for its lines, unless one of them is confirmed alone
    w = W.partitionBy("rid", "run")
    sure = F.coalesce(F.max((F.col("lines") == 1) & F.col("confirmed")).over(w), F.lit(False))
    whole = F.coalesce(F.max((F.col("lines") > 1) & F.col("confirmed")).over(w), F.lit(False))
    rows = rows.withColumn("_whole", whole & ~sure)
    return rows.where(F.when(F.col("lines") > 1, F.col("_whole")).otherwise(~F.col("_whole"))).drop("rid", "run", "_whole")


def op1_licenses(spark, sf_dir) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")
