import random

import numpy as np

from brontide.llm import decontaminate as D

from tests.llm import cases


def best_edits(item, text):
    """Plain dynamic programme: the item against any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text):
    import re

    return re.sub(rb"[\x20\x09-\x0D]+", b" ", cases.lower(text).encode())


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (12, 20, 30, 30, 4, 1)] + ["", None]
    items.append(items[2])
    docs = [None, "", items[1].upper().replace(" ", "\n ")]
    for _ in range(60):
        t = list(rng.choice(items[:4]))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        docs.append(" ".join([word() for _ in range(rng.randint(0, 30))] + ["".join(t)] + [word() for _ in range(rng.randint(0, 30))]))
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(frame, bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        for j, b in enumerate(items):
            p = plain(b).strip(b" ")
            if len(p) >= 4 and t:
                k = D.budget(len(p))[0]
                e = best_edits(p, plain(t))
                if e <= k:
                    want[i, j] = e
    assert {k: r.edits for k, r in got.items()} == want
    for (i, j), r in got.items():
        region = docs[i].encode()[r.first_byte : r.end_byte]
        assert best_edits(plain(items[j]), plain(region.decode("utf-8", "ignore"))) <= D.budget(len(plain(items[j])))[0]


def test_blocks_and_empty(spark, monkeypatch):
    bench = spark.createDataFrame([(i, "abcdefgh" * 3 + str(i)) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx " + "abcdefgh" * 3 + "4 yy")], "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK_CHARS", 30)
    assert len(list(D.blocks(bench, 30))) == 5
    assert {r.item_id for r in D.contaminated(docs, bench).collect()} >= {4}
    assert D.contaminated(docs, bench.limit(0)).collect() == []
    assert D.contaminated(docs.limit(0), bench).collect() == []


def test_budget_obeys_the_lemma():
    for m in range(1, 500):
        k, q, need = D.budget(m)
        assert need >= 1 and (m < 4 or need <= max(1, m + 1 - q - k * q))
    assert np.all(D.gram_keys(np.frombuffer(b"abcdabcdabcd", np.uint8), 8)[[0]] == D.gram_keys(np.frombuffer(b"abcdabcdabcd", np.uint8), 8)[[4]])


def test_many_hits_are_found_in_parts(spark, monkeypatch):
    """A phrase that all items share, and texts that repeat it, give far more hits than a part holds."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    phrase = "the same old phrase of all the items "
    items = [phrase + " ".join(word() for _ in range(9)) for _ in range(12)] + ["ab " * 25, "x" * 60]
    docs = [phrase * 40, phrase * 9 + items[3] + phrase * 9, "ab " * 400, "x" * 900, "y" * 50 + "x" * 58 + "z" * 50, items[5][:-3] + " " + phrase * 20 + items[6]]
    want = {(i, j): e for i, t in enumerate(docs) for j, b in enumerate(items) if (e := best_edits(plain(b).strip(b" "), plain(t))) <= D.budget(len(plain(b).strip(b" ")))[0]}
    lengths = np.cumsum([0, *(len(d) for d in docs)])
    raw = np.frombuffer("".join(docs).encode(), np.uint8)
    block = D.Items(list(range(len(items))), items)
    whole = D.find(block, raw, lengths)
    for part in (50, 1000):
        monkeypatch.setattr(D, "PART", part)
        assert D.find(block, raw, lengths) == whole
    assert {(r, i): e for r, i, e, *_ in whole} == want and (1, 3) in want and (5, 6) in want


def test_repeated_rows_null_ids_and_blocks(spark, monkeypatch):
    item = "a passage of the benchmark that some texts hold"
    docs = spark.createDataFrame([(1, f"x {item} y", "c")] * 2 + [(None, item, "c"), (3, "nothing", "c"), (None, None, "c")], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([(7, item), (8, item), (None, item), (9, "another passage which no text has at all")], "item_id long, text string")
    pairs = lambda: sorted(str(tuple(r)[:3]) for r in D.contaminated(docs, bench).collect())
    want = sorted(str((d, i, 0)) for d in (1, 1, None) for i in (7, 8, None))
    assert pairs() == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    assert pairs() == want
    assert sorted(str(tuple(r)) for r in D.without_leaks(docs, bench).collect()) == ["(3, 'nothing', 'c')", "(None, None, 'c')"]
