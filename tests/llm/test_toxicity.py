import zlib

import numpy as np

from brontide.llm import textops, toxicity

from tests.llm import cases

STEMS = ("zorgul", "brathek", "quimdor")


def corpus(n=500, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(150)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        t = [words[k] for k in rng.integers(0, 150, rng.integers(20, 60))]
        if toxic:
            for _ in range(3):
                t.insert(int(rng.integers(0, len(t))), str(rng.choice(STEMS)) + str(rng.choice(["", "s", "en", f"{i}x"])))
        rows.append((i, " ".join(t), "en", "s", 1, 2, True, 3))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    rows += [(1000, None, None, None, 1, 1, True, 1), (1001, "", "en", "s", 1, 1, True, 1)]
    path = cases.write(spark, tmp_path, rows)
    spark.createDataFrame([*labels, (1001, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, path).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    fold = [i for i, _, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in fold]) > 0.95


def test_without_labels_or_rows(spark, tmp_path):
    path = cases.write(spark, tmp_path, corpus(4)[0])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert {r.score for r in toxicity.op4_toxicity(spark, path).collect()} == {0.0}
    path = cases.write(spark, tmp_path / "b", [])
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert toxicity.op4_toxicity(spark, path).collect() == []


def test_grams_share_stems():
    raw = np.frombuffer(b"zorgul zorgulen", np.uint8)
    words, buckets = toxicity.word_grams(raw, *textops.word_spans(raw, np.array([0, len(raw)]))[:2])
    assert len(set(buckets[words == 0]) & set(buckets[words == 1])) >= 12


def plain_grams(word):
    """Buckets of a word, by the plain rule, byte by byte."""
    mask = (1 << 64) - 1
    w = b"\x1f" + bytes(c + 32 if 65 <= c <= 90 else c for c in word.encode()) + b"\x1f"
    out = []
    for n in toxicity.SIZES:
        for i in range(len(w) - n + 1):
            h = 0
            for c in w[i : i + n]:
                h = (h * 1099511628211 + c + 1) & mask
            out.append(int(textops.mix(np.array([(h + n) & mask], np.uint64))[0]) % toxicity.BUCKETS)
    whole = np.frombuffer(w, np.uint8)
    return [*out, int(textops.span_hashes(whole, np.array([0]), np.array([len(w)]), textops.BYTE_MUL[1])[0]) % toxicity.BUCKETS]


def test_scores_against_brute_force():
    """The average over every word, repeated ones and passages included."""
    model = np.random.default_rng(2).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    texts = [r[1] or "" for r in cases.documents()[:25]] + ["a b c d e a b c d e a b c d e", "x", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for t, got in zip(texts, toxicity.text_scores(raw, offsets, model, -1.5), strict=True):
        words = cases.words(t)
        z = sum(float(model[b]) for w in words for b in plain_grams(w)) / max(1, len(words)) - 1.5
        assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_null_ids_repeated_rows_ties_and_a_column_named_like_the_score(spark, tmp_path):
    rows, labels = corpus(120)
    schema = "doc_id long, text string, toxicity string, toxic int"
    given = [(i, t, "mine", 7) for i, t, *_ in rows] + [(None, rows[0][1], "mine", 7), (None, None, "mine", 7)] + [(0, rows[0][1], "mine", 7)] * 3 + [(5, "other text of the same id", "mine", 7)]
    docs = spark.createDataFrame(given, schema)
    known = spark.createDataFrame([*labels, (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs, *model, name="_score")
    assert got.columns == [*docs.columns, "_score"] and {r.toxicity for r in got.collect()} == {"mine"}
    first = {r._score for r in got.where("doc_id = 0").collect()}
    assert len(first) == 1 and first == {r._score for r in got.where("doc_id IS NULL AND text IS NOT NULL").collect()}
    assert toxicity.fit(docs.unionAll(docs), known)[1] == model[1]  # repeated rows are learned from once
    path = str(tmp_path / "n")
    docs.drop("toxicity", "toxic").write.parquet(f"{path}/documents.parquet")
    known.write.parquet(f"{path}/labels.parquet")
    assert {r.held_out for r in toxicity.op4_toxicity(spark, path).where("doc_id IS NULL").collect()} == {False}


def test_no_size_switch():
    """A few labelled texts are learned from like many."""
    texts = ["all is well here", "you zorgul", "a fine day", "zorgul again"]
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = textops.word_spans(raw, np.array([0, len(raw)]))
        _, b = toxicity.word_grams(raw, s, e)
        k, n = np.unique(b, return_counts=True)
        bags.append((k, (n / len(s)).astype(np.float32)))
    model, bias = toxicity.train(bags, [0, 1, 0, 1])
    raw = np.frombuffer(b"the zorgulsthe day", np.uint8)
    a, b = toxicity.text_scores(raw, np.array([0, 11, 18]), model, bias)
    assert a > 0.5 > b
