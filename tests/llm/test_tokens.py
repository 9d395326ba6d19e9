import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafmill.llm import tokens as K

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(K.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.serialise_model(K.read_ranks()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {t: i for i, t in enumerate(K.read_ranks())}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\n\tté日ग<|endoftext|>0", max_size=80))
def test_same_ids_as_the_reference_and_back(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text


def test_column(spark):
    d = spark.createDataFrame([(1, "hello world", 7), (2, "", 7), (3, None, 7), (4, " ", 7), (5, "<|endoftext|>", 7), (6, "word " * 50_000, 7)], "doc_id INT, text STRING, ids_ INT")
    got = {r.doc_id: r.ids for r in K.with_ids(d).collect()}
    assert got[2] == [] == got[3] and got[1] == [31373, 995] and len(got[4]) == 1 and 50256 not in got[5] and len(got[6]) > 50_000
    assert K.with_ids(d.limit(0)).count() == 0 and K.with_ids(d, F.lower("text"), "x").columns[-1] == "x"


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(K, "MEMO", 10)
    text = " ".join(f"w{i}" for i in range(50))
    assert encoder.decode(encoder.encode(text)) == text and len(encoder.memo) <= 60


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        K.serialise_model([bytes([b]) for b in range(255)])
