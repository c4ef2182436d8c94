"""Notices alone on a line, inside longer lines, wrapped over lines, and without any line break."""

import re

import numpy as np
import pytest

from brontide.llm import license_scan as L

from tests.llm import cases

MIT = L.CANONICAL["mit"][0]
GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
PROSE = "the river ran past some houses and a mill where people sold bread in the morning " * 12


def found(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", 1, 1, True, 1) for i, t in enumerate(texts)]
    out = {}
    for r in L.op5_license_scan(spark, cases.write(spark, tmp_path, rows)).collect():
        out.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.probability, r.similarity))
    return {i: sorted(x) for i, x in out.items()}


def expected(text):
    """Every window of every template, by the plain rule."""
    classes, grams, weights, bias, temperature = L.train()
    at, out = {g: i for i, g in enumerate(grams)}, []
    for n, paragraph in enumerate(re.split(r"\n[ \t\r]*\n", text) if text is not None else ()):
        words = L.words_of(paragraph)
        for family in L.TEMPLATES:
            best = (0, 0, 0)
            for t in (*L.TEMPLATES[family], *L.CANONICAL.get(family, ())):
                need, w = set(L.words_of(t)), -int(-len(L.words_of(t)) / L.CONFIRM_AT // 1)
                best = max([best, *((len(need & set(words[i : i + w])) / len(need), i, w) for i in range(len(words)) if words[i] in need)])
            if best[0] < L.CONFIRM_AT:
                continue
            held = words[best[1] : best[1] + best[2]]
            z = (bias + sum((weights[at[g]] for g in L.grams_of(held) if g in at), np.zeros(len(classes)))) / temperature
            p = L.softmax(z[None])[0]
            if classes[int(np.argmax(z))] == family and p.max() >= L.KEEP_AT:
                out.append((n, family, pytest.approx(float(p.max())), pytest.approx(best[0])))
    return sorted(out, key=lambda e: e[:2])


def test_what_a_scan_of_single_lines_loses(spark, tmp_path):
    texts = [MIT, MIT.replace(", ", ",\n"), "Some other words here on this page. Released under the MIT License.", GPL, re.sub(r"(?m)^", "# ", GPL), PROSE + MIT + PROSE, PROSE + "Licensed under CC BY-SA 4.0. " + PROSE, "Copyright 2019 by them. All rights reserved.", "The file header says: Released under the MIT License."]
    got = found(spark, tmp_path, texts)
    assert {i: [x[1] for x in f] for i, f in got.items()} == {0: ["mit"], 1: ["mit"], 2: ["mit"], 3: ["gpl-3.0"], 4: ["gpl-3.0"], 5: ["mit"], 6: ["cc-by-sa-4.0"], 7: ["all-rights-reserved"], 8: ["mit"]}


def test_every_text_of_the_tables_and_no_other(spark, tmp_path):
    known = [(f, t) for table in (L.TEMPLATES, L.CANONICAL) for f, ts in table.items() for t in ts]
    texts = [PROSE + t + " " + PROSE for _, t in known] + list(L.OTHERS) + ["Licensed under the Frobnicate License, Version 7.", PROSE]
    got = found(spark, tmp_path, texts)
    assert {i: [x[1] for x in f] for i, f in got.items()} == {i: [f] for i, (f, _) in enumerate(known)}


def test_against_brute_force(spark, tmp_path):
    lines = [t for ts in L.TEMPLATES.values() for t in ts] + list(L.OTHERS)
    texts = [t for _, t, *_ in cases.documents()] + [" ".join(lines), "\n".join(lines), "\n \n".join(lines), GPL + "\n\n" + MIT + "\n \t\r\n" + PROSE, GPL.replace("\n", "\nf\n"), None, ""]
    assert found(spark, tmp_path, texts) == {i: e for i, t in enumerate(texts) if (e := expected(t))}


def test_empty_table(spark, tmp_path):
    assert L.op5_license_scan(spark, cases.write(spark, tmp_path, [])).collect() == []


def test_planted_notices_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = docs.where("text LIKE '%Released under the MIT License.%' OR text LIKE '%Licensed under CC BY-NC 4.0.%' OR text LIKE '%All rights reserved.%' OR text LIKE '%GNU General Public License, version 3.%' OR text LIKE '%Licensed under the Apache License, Version 2.0.%'")
    found = L.op5_license_scan(spark, sf_dir).select("doc_id").distinct()
    assert planted.count() > 0 and planted.join(found, "doc_id", "left_anti").count() == 0 and found.join(planted, "doc_id", "left_anti").count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, family string, words string, paragraph string, m int"
    rows = [(1, MIT, "f", "w", "p", 1)] * 2 + [(None, MIT, "f", "w", "p", 1), (None, None, "f", "w", "p", 1)]
    got = L.notices(spark.createDataFrame(rows, schema)).select("doc_id", "family").collect()
    assert sorted((str(r.doc_id), r.family) for r in got) == [("1", "mit"), ("1", "mit"), ("None", "mit")]
