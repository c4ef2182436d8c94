import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brontide.llm import wavelet

from tests.llm import cases


LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=300), st.integers(1, 40))
def test_access_count_and_occurrences(ids, block):
    old, wavelet.BLOCK_BITS = wavelet.BLOCK_BITS, block * 8
    try:
        m = wavelet.WaveletMatrix(wavelet.build(np.array(ids, np.uint32), np.array([7, 9]), np.array([len(ids), 0])))
        assert m.tokens().tolist() == ids and m.doc_ids.tolist() == [7, 9] and m.lengths.tolist() == [len(ids), 0]
        for i in range(0, len(ids), 17):
            assert m.access(i) == ids[i]
        for v in {*ids[:4], 3, 1 << 20}:
            places = [i for i, x in enumerate(ids) if x == v]
            assert m.count(v) == len(places) and m.count(v, 2, 9) == ids[2:9].count(v)
            assert [m.occurrence(v, k) for k in range(len(places))] == places
    finally:
        wavelet.BLOCK_BITS = old


def encoded(coder, texts, end=None):
    data = [t.encode() for t in texts]
    ids, sizes = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), end)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


SPECIAL = ["the end<|endoftext|> of", "foo <|endoftext|> bar", "<|endoftext|>", "<|endoftext|", "a\nb c\nd.", " lead", "tail ", "tail\n", "two  blanks", "don't we'll o'n'S", "naïve größe, déjà!", "日本 語 x", "a\u00a0b c\u2028d", "x\x1cy z\x85"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\ta'sé1.<|>日 　\x1c", max_size=30), st.text(alphabet="ab é.,!'\n", max_size=30)), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + SPECIAL
    assert encoded(wavelet.encoder(), texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(wavelet.encoder(), texts, 2) == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]


SEGMENTS = ["don't-5's''s", "'s5 't 'tis", "a.b,c 3.14 x2y", "é. ×. ÷a é×é ß5", "жд-5 ѿ. Ҁ. ҂a", "日本。. 日. e\u0301. ²5 5²", "a\u00a0. .\u00a0b", "a\x00. \x7f5", "\n'll.\n\"Well-known\"", "ſ's ŉ'T"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab'st.-5 \n", max_size=30), st.text(alphabet="aé×÷ÿĀſжѿҀ҂日。.'5²\u0301\u00a0 \n", max_size=30)), min_size=1, max_size=6))
def test_segments_encode_as_whole_texts(texts):
    texts = texts + SEGMENTS
    assert encoded(wavelet.encoder(), texts, 2) == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_a_word_is_encoded_once_whatever_marks_follow():
    coder = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    model, asked = coder.model, []

    class Counted:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    coder.model = Counted()
    words, marks = [f"wor{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"], ["", ".", ",", "...", "$$", ");", ":5", "-5,"]
    texts = [" ".join(["x", *(w + m for w in words)]) for m in marks]
    assert encoded(coder, texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 2 * len(words)  # 100 words, "x" and a few runs of marks, not 800 words


def test_a_table_that_grows(monkeypatch):
    monkeypatch.setattr(wavelet, "LEAST_SLOTS", 4)
    coder = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for a in range(0, 5000, 1000):
        texts = [" ".join(f"w{i}" for i in range(b, b + 100)) + "." for b in range(a // 2, a + 1000, 100)]
        assert encoded(coder, texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.known == np.count_nonzero(coder.keys) and coder.known <= wavelet.FULL * len(coder.keys)


def test_added_tokens_as_text():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    assert encoded(wavelet.encoder(None, True), SPECIAL) == [plain.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert encoded(wavelet.encoder(None, True), SPECIAL) != encoded(wavelet.encoder(), SPECIAL)


def test_a_full_memo_and_words_of_one_key(monkeypatch):
    coder = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in cases.documents()]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for memo in (0, 40):
        monkeypatch.setattr(wavelet, "MEMO", memo)
        for _ in range(2):
            assert encoded(coder, texts) == want
    coder.checks ^= np.uint32(1)  # as if every known word were another one of the same key
    monkeypatch.setattr(wavelet, "MEMO", 1 << 40)
    assert encoded(coder, texts) == want


def test_query_against_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 20_000)
    rows = cases.documents()
    got = {r.doc_id: r for r in wavelet.op6_wavelet_files(spark, cases.write(spark, tmp_path, rows)).collect()}
    at = 0
    for doc_id, text, *_ in sorted(rows):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_starts_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "STARTS", 2)
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 500)
    rows = [(i % 7 if i % 5 else None, f"text {i % 11} of some words " * (1 + i % 3), 1) for i in range(300)] + [(3, None, 1)] * 3
    got = wavelet.read_files(wavelet.write_files(spark.createDataFrame(rows, "doc_id long, text string, file int"))).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    sizes = lambda found: sorted((str(i), n) for i, n in found)
    assert sizes((r.doc_id, r.n_tokens) for r in got) == sizes((i, len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)


def test_empty_table(spark, tmp_path):
    assert wavelet.op6_wavelet_files(spark, cases.write(spark, tmp_path, [])).collect() == []
