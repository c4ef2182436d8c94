"""Repeated rows, null ids, very long texts, ties, empty tables and clashing names, for operators whose own tests lack them."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from brontide.llm import bpe, ngram_lm, quality, substring_dedup, toxicity, url_filter

from tests.llm import cases
from tests.llm.test_quality import expected as statistics
from tests.llm.test_substring_dedup import expected as kept_words

SCHEMA = "doc_id long, text string, score string, n_tokens string, shard string, quality string"
LONG = " ".join(f"w{k % 997}" for k in range(40_000))
ROWS = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "another text"), (None, "a b c d e f g"), (None, None), (4, LONG), (5, LONG + " end"), (6, ""), (7, "x" * 70_000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in ROWS], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def found(spark, query, folder):
    return sorted((tuple(r) for r in query(spark, folder).collect()), key=str)


def test_language_model(spark, folder):
    """An own model: plain counts, weights by plain EM over single tokens instead of a histogram."""
    tokens = [(i, [*cases.words(t), None]) for i, t in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c1, c2 = collections.Counter(), collections.Counter()
    for i, t in tokens:
        if not held(i):
            c1.update(t)
            c2.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(c1.values()), len(c1)
    c1["<s>"] = c1[None]
    bucket = lambda c: min(int(c).bit_length(), ngram_lm.BUCKETS - 1)
    events = collections.defaultdict(collections.Counter)
    for i, t in tokens:
        for h, w in zip(["<s>", *t[:-1]], t, strict=True) if not held(i) else ():
            events[bucket(c1[h] - 1)][(c2[h, w] - 1) / max(c1[h] - 1, 1), (c1[w] - 1) / (n - 1)] += 1
    weights = {}
    for b, seen in events.items():
        lam = (0, 0.5, 0.5) if b == 0 else (1 / 3, 1 / 3, 1 / 3)
        for _ in range(ngram_lm.ITERATIONS):
            total = [0.0, 0.0, 1e-3]
            for (p2, p1), m in seen.items():
                parts = (lam[0] * p2, lam[1] * p1, lam[2] / (v + 1))
                for k in range(3):
                    total[k] += m * parts[k] / sum(parts)
            lam = tuple(x / sum(total) for x in total)
        weights[b] = lam
    want = []
    for i, t in tokens:
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            a, b, u = weights.get(bucket(c1[h]), (1 / 3, 1 / 3, 1 / 3) if c1[h] else (0, 0.5, 0.5))
            score += math.log10(a * c2[h, w] / max(c1[h], 1) + b * c1[w] / n + u / (v + 1))
        want.append((i, held(i), len(t), sum(c1[w] > 0 for w in t), n, base, score))
    got = found(spark, ngram_lm.op1_deleted_interpolation, folder)
    want.sort(key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5])
        assert g[6] == pytest.approx(w[6], rel=0.02)  # the histogram bins probabilities by eighths of an octave


def plain_votes(s):
    words = max(1, s["n_words"])
    upper, mean, stops, symbols = s["n_upper"] / max(1, s["word_chars"]), s["word_chars"] / words, s["n_stops"] / words, s["n_symbols"] / words
    usual = symbols < 0.02 and upper < 0.15 and 3 <= mean <= 9 and 0.005 <= stops <= 0.3 and words >= 20
    varied = s["n_repeat_words"] == 0 and s["n_dup_lines"] == 0 and words >= 100 and symbols < 0.05
    bad = [symbols > 0.1, upper > 0.4, s["n_repeat_words"] / words > 0.1, s["n_dup_lines"] / max(1, s["n_lines"]) > 0.2, mean < 2.5 or mean > 12, stops > 0.6]
    return [int(usual), *(-int(b) for b in bad), int(varied)]


def test_quality_verdicts_against_plain_em(spark, tmp_path):
    rows = [(r[0], r[1]) for r in cases.documents()] + ROWS
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    stats, votes = [], []
    for _, t in rows:
        n_words, chars, symbols, dups, repeats = statistics(t)
        if repeats is None:  # long texts: by counts of windows
            w = cases.words(t)
            windows = collections.Counter(zip(*(w[k:] for k in range(5)), strict=False))
            repeats = len({j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        s = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats}
        s |= {"n_lines": sum(bool(cases.words(x)) for x in (t or "").split("\n")), "n_upper": sum("A" <= c <= "Z" for c in t or ""), "n_stops": sum(c in ".!?" for c in t or "")}
        stats.append(s)
        votes.append(plain_votes(s))
    k, right = len(votes[0]), [quality.ACCURACY] * len(votes[0])
    smooth = quality.SMOOTH * len(rows) + 1
    good = lambda v: 1 / (1 + math.exp(-sum(x * math.log(right[j] / (1 - right[j])) for j, x in enumerate(v))))
    for _ in range(quality.ITERATIONS):
        p = [good(v) for v in votes]
        right = [min(max((sum(x if v[j] > 0 else 1 - x for x, v in zip(p, votes, strict=True) if v[j]) + smooth * quality.ACCURACY) / (sum(v[j] != 0 for v in votes) + smooth), 0.5), 0.999) for j in range(k)]
    want = []
    for (i, _), s, v in zip(rows, stats, votes, strict=True):
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        want.append((i, *(s[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, not failed and good(v) >= quality.KEEP_AT))
    assert [r[:8] for r in found(spark, quality.op2_quality_rules, path)] == sorted(want, key=str)


def test_substring_dedup(spark, folder):
    rows = [(i if i is not None else 1 << 62, t) for i, t in ROWS]
    want = sorted(((None if i == 1 << 62 else i, *v) for i, t in rows for v in [kept_words_of(rows, i, t)]), key=str)
    assert [r[:4] for r in found(spark, substring_dedup.op3_substring_dedup, folder)] == want


def kept_words_of(rows, i, t):
    others = [(j, u) for j, u in rows if j < i]
    v = kept_words([*others, (i, t)], substring_dedup.WINDOW)[i]
    return v[:3]


def test_columns_of_any_name_travel(spark):
    rows = [(1, LONG, "a"), (2, LONG, "b"), (2, "short", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string")
    assert sorted(map(tuple, substring_dedup.without_repeats(docs).collect())) == [(1, LONG, "a"), (2, "short", "c")]


def test_byte_bpe(spark, folder):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    ids = [(i, t or "", theirs.encode_ordinary(t or "")) for i, t in ROWS]
    want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, x in ids]
    assert found(spark, bpe.op10_byte_bpe, folder) == sorted(want, key=str)


def test_url_filter(spark, tmp_path):
    urls = [(1, "http://a.example.com/en/77"), (1, "http://a.example.com/en/77"), (None, "http://b.net/de/"), (2, "http://x.org/" + "p/" * 20_000), (None, None)]
    path = str(tmp_path)
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, html string, rule string")
    pages.write.parquet(f"{path}/pages.parquet")
    got = found(spark, url_filter.op9_url_filter, path)
    assert len(got) == 5 and got.count((1, "a.example.com", "/en/77", "example.com/en/7", "allow")) == 2 and (None, "b.net", "/de/", "net/de/", "block") in got
    tied = url_filter.judge(pages, rules=(("allow", "com/en/"), ("block", "com/en/"))).where("page_id = 1").select("verdict").distinct().collect()
    assert len(tied) == 1
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_toxicity_of_long_and_repeated_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 0), (7, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, *toxicity.fit(docs, labels), name="score")
    assert got.count() == len(ROWS) and got.where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert len({r.score for r in got.where("text = 'a b c d e f g'").collect()}) == 1
