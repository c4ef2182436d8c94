"""Licence scan: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Paragraphs are parted by blank lines; wrapped lines are joined, so a notice may stand inside a longer line, over
several lines, or in a text without line breaks.  Of each family the window of the paragraph with most of one
template's words (at least CONFIRM_AT of them) is classified, and counts if the classifier names that family.  A
paragraph has at most one row a family.

The classifier is a sparse logistic regression (softmax over the licence families and ``unknown``) on word unigrams
and bigrams, trained on the driver, in numpy, from the templates below and from paragraphs of no licence.  Probabilities
are calibrated by a temperature fitted on whole templates and whole paragraphs of no licence that the fitted model has not seen;
below KEEP_AT the answer is ``unknown``.

Scanning is DataFrame functions only, one row at a time without shuffle.  Paragraphs that hold less than
CONFIRM_AT of each template's words are passed over before windows are made: no window of theirs could be confirmed.

Defined cases: null or empty texts and a null doc_id's texts are scanned as any other (null: no paragraphs); repeated rows are
reported each; a very long text or line is one paragraph, scanned whole; of equally good windows the last one counts, with the longest
template, of equally likely families the first of TEMPLATES; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm.shared import table

#: Short notices by family.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction.", "This project is licensed under the terms of the MIT license."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "lgpl-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "bsd-3-clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public-domain": ("This work is released into the public domain.", "This is free and unencumbered software released into the public domain."),
    "all-rights-reserved": ("All rights reserved.", "Copyright, all rights reserved by the authors."),
}
#: Paragraphs of no licence, some with its words.
OTHERS = (
    "The driver must show a valid license to the officer.", "A new version of the software was released under the old name.", "The general public was free to use the library.",
    "They licensed the song to a studio for a film.", "You may not use this door except in an emergency.", "The foundation published a source for the work.", "This is the version of the story that people know.",
    "Copyright law is the subject of the book.", "The terms of the agreement are subject to change.", "It is under the table in the public room.", "Notice of the meeting is hereby given to any person.",
    "All seats are reserved for the members.", "The rights of the people are held by all.", "He reserved the right to say so.",
    "The apache tribes lived in the south.", "The university and its students published the results.", "The bill was released by the commons.", "He had two of them and three of those.",
)
#: Whole standard paragraphs.
CANONICAL = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "bsd-3-clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "public-domain": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
UNKNOWN = "unknown"
WORD = r"[a-z0-9]+"
KEEP_AT, CONFIRM_AT = 0.6, 0.7
EPOCHS, RATE, L2, SEED, FOLDS = 400, 0.5, 1e-3, 11, 3


def words_of(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(WORD, lowered)


def grams_of(words: list[str]) -> list[str]:
    """Distinct unigrams and bigrams, in order."""
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def variants(rng: np.random.Generator, text: str, n: int) -> list[list[str]]:
    """The words of a template with some left out or strange ones put in."""
    out, words = [], words_of(text)
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.08]
        for _ in range(int(rng.integers(0, 3))):
            w.insert(int(rng.integers(0, len(w) + 1)), f"x{rng.integers(0, 50)}")
        out.append(w or words)
    return out


def texts_of() -> dict[str, tuple[str, ...]]:
    return {c: (*ts, *CANONICAL.get(c, ())) for c, ts in TEMPLATES.items()}


def fit(data: list[tuple[int, list[str]]], at: dict[str, int], k: int, bias: np.ndarray) -> np.ndarray:
    """Weights [gram, class] by gradient descent on the rows (class, words)."""
    x, y = rows_of([w for _, w in data], at), np.eye(k)[[c for c, _ in data]]
    weights = np.zeros((len(at), k))
    for _ in range(EPOCHS):
        gap = softmax(x @ weights + bias) - y
        weights -= RATE * (x.T @ gap / len(x) * 10 + L2 * weights)
    return weights


def rows_of(words: list[list[str]], at: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(words), len(at)))
    for i, w in enumerate(words):
        x[i, [at[g] for g in grams_of(w) if g in at]] = 1
    return x


@functools.cache
def train() -> tuple[list[str], list[str], np.ndarray, np.ndarray, float]:
    """(classes, grams, weights [gram, class], bias, temperature).

    The temperature comes of FOLDS models that have each not seen some whole texts, neither them nor
    variants of them: texts of families with more than one, and texts of no licence.
    """
    rng = np.random.default_rng(SEED)
    classes = [*TEMPLATES, UNKNOWN]
    k = len(classes)
    texts = [(c, t, n if len(ts) > 1 else None) for c, ts in enumerate(texts_of().values()) for n, t in enumerate(ts)] + [(k - 1, t, n) for n, t in enumerate(OTHERS)]
    data = [(c, w, None if n is None else n % FOLDS) for c, t, n in texts for w in [words_of(t), *variants(rng, t, 8)]]
    grams = sorted({g for _, t, _ in texts for g in grams_of(words_of(t))})
    at = {g: i for i, g in enumerate(grams)}
    bias = np.zeros(k)
    bias[-1] = 1.0  # without evidence: unknown
    logits, truth = [], []
    for fold in range(FOLDS):
        held = [(c, w) for c, w, f in data if f == fold]
        weights = fit([(c, w) for c, w, f in data if f != fold], at, k, bias)
        logits.append(rows_of([w for _, w in held], at) @ weights + bias)
        truth += [c for c, _ in held]
    z, y = np.concatenate(logits), np.eye(k)[truth]
    losses = {t: -np.log(np.maximum((softmax(z / t) * y).sum(axis=1), 1e-12)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)}
    weights = fit([(c, w) for c, w, _ in data], at, k, bias)
    weights[np.abs(weights) < 0.02] = 0
    # Multiples of 2**-16 add up exactly in any order.
    return classes, grams, np.round(weights * 65536) / 65536, bias, min(losses, key=losses.get)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _literal(value, kind: str) -> str:
    text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{kind}')"


def classified(out: DataFrame) -> DataFrame:
    """Rows whose column ``words`` the classifier gives a licence family, with ``family`` and ``probability``."""
    classes, grams, weights, bias, temperature = train()
    k = len(classes)
    used = [i for i in range(len(grams)) if weights[i].any()]
    model = _literal({grams[i]: weights[i].tolist() for i in used}, "map<string,array<double>>")
    out = out.withColumn("grams", F.expr("array_distinct(concat(words, zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, size(words)), (a, b) -> concat(a, ' ', b))))"))
    out = out.withColumn("z", F.expr(f"aggregate(filter(transform(grams, g -> try_element_at({model}, g)), v -> v IS NOT NULL), {_literal(bias.tolist(), 'array<double>')}, (s, v) -> zip_with(s, v, (a, b) -> a + b), s -> transform(s, a -> a / {temperature}D))"))
    out = out.withColumn("e", F.expr("transform(z, a -> exp(a - array_max(z)))"))
    out = out.withColumn("best", F.expr("array_position(z, array_max(z))")).withColumn("probability", F.expr("element_at(e, cast(best AS int)) / aggregate(e, 0D, (s, a) -> s + a)"))
    names = "array(" + ",".join(f"'{c}'" for c in classes) + ")"
    out = out.withColumn("family", F.expr(f"element_at({names}, cast(best AS int))")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= KEEP_AT))
    return out


def compared() -> dict[str, list[dict]]:
    """Templates by family: n distinct words t, and the longest window w that may hold them."""
    return {c: [{"n": len(set(words_of(t))), "w": math.ceil(len(words_of(t)) / CONFIRM_AT), "t": sorted(set(words_of(t)))} for t in ts] for c, ts in texts_of().items()}


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (by blank lines), family, probability and similarity (containment) of every notice within a paragraph."""
    families = compared()
    every = sorted({w for ts in families.values() for t in ts for w in t["t"]})
    model = _literal([{"label": c, "ts": ts} for c, ts in families.items()], "array<struct<label:string,ts:array<struct<n:int,w:int,t:array<string>>>>>")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # Generators compute the words and the candidates once; a filter on a plain column would have them made again.
    out = docs.select("doc_id", F.posexplode(F.expr(f"transform(split({lowered}, '\\n[ \\t\\r]*\\n'), p -> regexp_extract_all(p, '{WORD}', 0))")).alias("paragraph", "all_words"))
    hits = f"array_intersect(all_words, {_literal(every, 'array<string>')})"
    near = f"filter(transform({model}, g -> named_struct('label', g.label, 'ts', filter(g.ts, x -> size(array_intersect(x.t, h)) >= {CONFIRM_AT}D * x.n))), g -> size(g.ts) > 0)"
    out = out.select("doc_id", "paragraph", "all_words", F.explode(F.expr(f"flatten(transform(array({hits}), h -> {near}))")).alias("g"))
    # The best window begins with a word of the template.
    starts = "filter(sequence(1, size(all_words)), i -> array_contains(x.t, element_at(all_words, i)))"
    window = f"transform({starts}, i -> named_struct('s', size(array_intersect(x.t, slice(all_words, i, x.w))) / x.n, 'i', i, 'w', x.w))"
    best = f"array_max(flatten(transform(g.ts, x -> {window})))"
    out = out.select("doc_id", "paragraph", "all_words", F.col("g.label").alias("label"), F.explode(F.expr(f"filter(array({best}), m -> m.s >= {CONFIRM_AT}D)")).alias("m"))
    out = classified(out.withColumn("words", F.expr("slice(all_words, m.i, m.w)"))).where("family = label")
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", F.col("m.s").alias("similarity"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents"))
