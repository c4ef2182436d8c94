import collections
import math
import zlib

import numpy as np
import pytest

from brontide.llm import exchange as X
from brontide.llm import ngram_lm

from tests.llm import cases


def test_query_against_brute_force(spark, tmp_path):
    rows = cases.documents()
    got = {r.doc_id: r for r in ngram_lm.op1_deleted_interpolation(spark, cases.write(spark, tmp_path, rows)).collect()}
    tokens = {i: [*cases.words(cases.lower(t)), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c1, c2 = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            c1.update(t)
            c2.update(zip(["<s>", *t[:-1]], t, strict=True))
    total, distinct = sum(c1.values()), len(c1)
    c1["<s>"] = c1[None]
    cells = collections.Counter()
    for i, t in tokens.items():
        for h, w in zip(["<s>", *t[:-1]], t, strict=True) if not held[i] else ():
            ch = np.array([c1[h] - 1])
            p = [(c2[h, w] - 1) / max(c1[h] - 1, 1), (c1[w] - 1) / max(total - 1, 1)]
            cells[(int(ngram_lm.bucket(ch)[0]), *(int(ngram_lm._bin(np.array([x]))[0]) for x in p))] += 1
    weights = ngram_lm.learn([(*k, float(n)) for k, n in cells.items()], distinct)
    assert len(got) == len(rows)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c1[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((c1[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t))
        score = 0.0
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            a, b, u = weights[int(ngram_lm.bucket(np.array([c1[h]]))[0])]
            score += math.log10(a * c2[h, w] / max(c1[h], 1) + b * c1[w] / total + u / (distinct + 1))
        assert r.score == pytest.approx(score)
    fold = [r for r in got.values() if r.held_out]
    assert fold and sum(r.score for r in fold) > sum(r.base_score for r in fold)


def test_probabilities_sum_to_one():
    weights = ngram_lm.learn([(3, 9, 40, 10.0), (3, 0, 30, 5.0), (0, 0, 25, 4.0)], 9)
    assert np.allclose(weights.sum(axis=1), 1)
    c1, c2 = np.array([5, 3, 2]), np.array([2, 4, 0])
    p = ngram_lm.token_probabilities(c1, c2, np.full(3, 6), 10, 3, weights)
    assert 0 < p.sum() <= 1 + 1e-9


def test_empty_and_untrained(spark, tmp_path):
    assert ngram_lm.op1_deleted_interpolation(spark, cases.write(spark, tmp_path / "a", [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = ngram_lm.op1_deleted_interpolation(spark, cases.write(spark, tmp_path / "b", [(only, "a b", "en", "s", 1, 1, True, 1)])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        for top in (1, 200, 1 << 20, 1 << 63):
            v = rng.integers(0, top, n, dtype=np.uint64)
            assert (X.unpack(X.pack(v), n) == v).all()
            assert (X.unpack_sorted(X.pack_sorted(np.sort(v)), n) == np.sort(v)).all()
    assert (np.argsort(X.signed_order([3, -1, 0, -(1 << 63)])) == [3, 1, 2, 0]).all()
