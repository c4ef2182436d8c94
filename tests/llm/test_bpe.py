import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brontide.llm import bpe

from tests.llm import cases


@pytest.fixture(scope="module")
def reference():
    ours = bpe.encoder()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\ta'sé1.<|>日\u00a0\u3000", max_size=40)))
def test_same_ids_as_tiktoken(text):
    ours = bpe.encoder()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_query_against_tiktoken(spark, tmp_path, reference):
    rows = cases.documents()
    got = {r.doc_id: r for r in bpe.op10_byte_bpe(spark, cases.write(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    assert bpe.op10_byte_bpe(spark, cases.write(spark, tmp_path, [])).collect() == []
