import random

import numpy as np
import pytest

from brontide.llm import jaccard_join as J
from brontide.llm import textops as T

from tests.llm import cases


def shingles(text):
    w = cases.words(cases.lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def expected(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                r, s = sorted((root(i), root(j)))
                comp[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=2, groups=7, n=130):
    """Chains of edits, a passage that many texts share, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rng.choice((4, 6, 9, 25, 60, 120)))] for _ in range(groups)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(t) // 30))):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t = [word() for _ in range(rng.randint(0, 6))] + passage + [word() for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.2 and rows:
            t = rows[rng.randrange(len(rows))][1].upper().split()
        rows.append((1000 - i, " ".join(t)))
    return [(i, t, "en", "s", 1, 1, True, 1) for i, t in rows]


@pytest.mark.parametrize("rows", [cases.documents(), near_copies()], ids=["odd", "near"])
def test_query_against_brute_force(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "HOT", 9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op8_jaccard_join(spark, cases.write(spark, tmp_path, rows)).collect()}
    want = expected(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_signatures_lose_no_link():
    """Whichever shingles are hot, for all sets alike."""
    rng = np.random.default_rng(4)
    for trial in range(1500):
        n = int(rng.integers(1, 300)) if trial % 2 else int(rng.integers(1, 12))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 7 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            share = np.uint64(rng.choice([0, 10, 50, 90, 100]))
            hot = lambda x: T.mix(x) % np.uint64(100) < share  # noqa: B023, E731
            assert len(np.intersect1d(J.signatures(a, hot(a)), J.signatures(b, hot(b))))


def test_a_hot_passage_makes_no_hot_bucket():
    rng = np.random.default_rng(5)
    passage = np.unique(rng.integers(0, 1 << 63, 46, dtype=np.uint64))
    seen = {False: {}, True: {}}
    for _ in range(400):
        x = np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 120, dtype=np.uint64)]))
        for known in seen:
            for k in J.signatures(x, np.isin(x, passage) & known).tolist():
                seen[known][k] = seen[known].get(k, 0) + 1
    assert max(seen[False].values()) > 5 and max(seen[True].values()) == 1


def test_bands():
    for size in range(1, 3000):
        assert J.band_of(size * 100 // 75) - J.band_of(size) <= 1 and (size == 1 or J.band_of(size) >= J.band_of(size - 1))


def test_ties_nulls_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (9, None), (9, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 1, True, 1) for i, t in rows], cases.SCHEMA)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in J.joined(frame).collect()) == [("5", 2, 5), ("5", 2, 5), ("9", 0, 9), ("9", 0, 9), ("None", 2, 5)]
    assert J.joined(frame.limit(0)).collect() == []


def by_id(spark, rows):
    return {(r.doc_id, r.n_shingles): r.component_id for r in J.joined(spark.createDataFrame(rows, "doc_id long, text string, component_id string, shingles int")).collect()}


def chain(n, first):
    """Each text shares enough with the one before, few with the others."""
    words = [f"w{k}" for k in range(400)]
    return [(first + i, " ".join(words[8 * i : 8 * i + 120]), "x", 1) for i in range(n)]


@pytest.mark.parametrize("first", [-(1 << 63), 1 << 62, (1 << 63) - 7])
def test_ids_of_any_size(spark, first):
    got = J.joined(spark.createDataFrame(chain(6, first), "doc_id long, text string, component_id string, shingles int")).collect()
    assert {r.component_id for r in got} == {first} and len(got) == 6


def test_repeated_ids_of_different_texts_and_null_ids(spark):
    a, b, c = chain(1, 0)[0][1], " ".join(f"x{k}" for k in range(90)), " ".join(f"y{k}" for k in range(80))
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(5, a, "x", 1), (5, b, "x", 1), (9, near(a), "x", 1), (3, near(b), "x", 1), (None, near(c), "x", 1), (7, c, "x", 1), (None, "no one has such a text", "x", 1), (None, None, "x", 1)]
    got = by_id(spark, rows)
    assert {k[0]: v for k, v in got.items() if k[0]} == {5: 3, 9: 3, 3: 3, 7: 7}
    assert sorted((n, str(v)) for (i, n), v in got.items() if i is None) == [(0, "None"), (2, "None"), (76, "7")]


def test_many_unlike_sets_of_one_shingle(spark):
    """One shared shingle in small sets gives large buckets without links; two texts of them do link."""
    rng = random.Random(8)
    rows = [(i, "the one that all share " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 8))), "x", 1) for i in range(4000)]
    rows += [(5000, rows[17][1] + " " + " ".join(f"q{k}" for k in range(40)), "x", 1), (5001, rows[17][1] + " " + " ".join(f"q{k}" for k in range(39)), "x", 1)]
    got = by_id(spark, rows)
    assert {i: c for (i, _), c in got.items() if i != c} == {5001: 5000}


def test_parity_never_excludes_a_link():
    rng = np.random.default_rng(6)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 8)), dtype=np.uint64)]))
        if len(b):
            p, q = (np.frombuffer(J.parity(x), np.uint8)[None] for x in (a, b))
            places = 8 * min(p.shape[1], q.shape[1])
            differing = int(np.bitwise_count(J.folded(p, places) ^ J.folded(q, places)).sum())
            assert differing <= len(np.setxor1d(a, b))


def test_relays_give_the_same(spark, tmp_path, monkeypatch):
    """With a fan of 3 the 24 shards need three hops."""
    from brontide.llm import exchange, ngram_lm, substring_dedup

    rows = near_copies(seed=5, n=60) + [(i + 5000, t, *r) for i, t, *r in cases.documents(seed=3, n=40)]
    folder = cases.write(spark, tmp_path, rows)
    queries = (J.op8_jaccard_join, ngram_lm.op1_deleted_interpolation, substring_dedup.op3_substring_dedup)
    want = [sorted(map(str, q(spark, folder).collect())) for q in queries]
    monkeypatch.setattr(exchange, "FAN", 3)
    assert [sorted(map(str, q(spark, folder).collect())) for q in queries] == want
