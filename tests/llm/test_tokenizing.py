import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenizing as T

PATH = os.path.join(T.FOLDER, T.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = T.load_ranks(PATH)
    return T.Encoder(ranks), T.Decoder(ranks), tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_public_library_and_back(both, text):
    own, decoder, public = both
    ids = own.encode(text)
    assert ids == public.encode_ordinary(text)
    assert decoder.decode(ids) == text


def test_long_runs(both):
    own, decoder, public = both
    for text in ("a" * 30_000, "ab" * 9000, " " * 5000, "中文" * 4000, "<|endoftext|>", "🙂" * 500):
        assert own.encode(text) == public.encode_ordinary(text)


def test_frame(spark, both):
    rows = [(1, "hello world", 5), (2, None, 5), (3, "", 5), (4, "  \n", None), (1, "hello world", 5), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r["doc_id"], tuple(r["ids"])) for r in T.encode_column(df).collect()}
    own = both[0]
    assert out == {(1, tuple(own.encode("hello world"))), (2, ()), (3, ()), (4, tuple(own.encode("  \n"))), (None, tuple(own.encode("x")))}
    assert T.encode_column(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df).collect()}
    assert counts[2] == 0 and counts[3] == 0 and counts[1] == len(own.encode("hello world"))
