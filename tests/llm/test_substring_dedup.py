import hashlib

import pytest

from brontide.llm import substring_dedup as S

from tests.llm import cases


def expected(rows, size):
    first = {}
    for i, t, *_ in rows:
        w = cases.words(t)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, t, *_ in rows:
        w = cases.words(t)
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = cases.documents(seed=9, n=90)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op3_substring_dedup(spark, cases.write(spark, tmp_path, rows)).collect()}
    want = expected(rows, 50)
    assert got == {i: v[:3] for i, v in want.items()}
    assert sum(v[1] > 0 for v in want.values()) > 10


@pytest.mark.parametrize("bits", [None, 3])
def test_texts_and_a_crowded_sketch(spark, monkeypatch, bits):
    # With eight cells nearly all windows are suspects; the exact pass still decides.
    if bits:
        monkeypatch.setattr(S, "sketch_bits", lambda n: bits)
    rows = cases.documents(seed=4)
    want = expected(rows, 7)
    for r in S.deduplicate(cases.frame(spark, rows), size=7, with_text=True).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3]
        assert r.kept_text == (want[r.doc_id][3] if r.n_removed else None)


def test_ties_nulls_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (5, text), (None, text), (7, text)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 1, True, 1) for i, t in rows], cases.SCHEMA)
    got = sorted((str(r.doc_id), r.n_removed) for r in S.deduplicate(frame).collect())
    assert got == [("5", 0), ("5", 0), ("7", 60), ("None", 60)]
    assert S.deduplicate(frame.limit(0)).collect() == []


def test_a_long_text_is_hashed_run_by_run(monkeypatch):
    import numpy as np

    from brontide.llm import textops as T

    texts = [r[1] or "" for r in cases.documents()] + ["x" * 300 + " y", " " * 200 + "z", "a\tb " * 90]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = T.hashed_words(raw, offsets, 2, lower=True)
    for limit in (7, 64, 1000):
        monkeypatch.setattr(T, "PIECE_BYTES", limit)
        monkeypatch.setattr(T, "pieces", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
        got = T.hashed_words(raw, offsets, 2, lower=True)
        assert (got[1] == want[1]).all() and all((g == w).all() for g, w in zip(got[0], want[0], strict=True))
    assert np.diff(want[1]).tolist() == [len(cases.words(t)) for t in texts]
