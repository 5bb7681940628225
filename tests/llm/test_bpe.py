import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tiktoken")
import tiktoken

from stellate.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.vocabulary("byte_bpe_50k")), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    with open(bpe.vocabulary("byte_bpe_50k"), "rb") as f:
        return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_texts(text):
    with open(bpe.vocabulary("byte_bpe_50k"), "rb") as f:
        enc = test_texts.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={}))
    text = text.encode("utf-8", "ignore").decode()
    assert list(bpe.load(bpe.vocabulary("byte_bpe_50k")).encode(text)) == enc.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aabbcdeinrst '.-=0é中\U0001f600\n", max_size=120))
def test_pieces(text):
    enc = bpe.load(bpe.vocabulary("byte_bpe_50k"))
    ids = enc.encode(text)
    inverse = test_pieces.__dict__.setdefault("inverse", {n: t for t, n in enc.ids.items()})
    assert b"".join(inverse[i].encode("latin-1") for i in ids).decode() == text


def test_long_pieces_take_linear_time(other):
    for text in ("a" * 20_000, "-=" * 5_000, "中" * 3_000, "é=" * 2_000):
        assert list(bpe.load(bpe.vocabulary("byte_bpe_50k")).encode(text)) == other.encode_ordinary(text)


def test_corpus(spark, other):
    texts = [None, "", " ", "<|endoftext|> is text", "same", "same", "x" * 100_000, "wörld 世界"]
    docs = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(docs).collect()}
    assert got == {n: other.encode_ordinary(t or "") for n, t in enumerate(texts)}
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
