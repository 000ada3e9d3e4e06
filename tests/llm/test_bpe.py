import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.bpe import Codec, Utf8Machine, encode_column
from tidewater.llm.queries import op7_bpe, vocabulary
from tidewater.session import table

import public_tokenizers

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def same(own, library, text):
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(packed) == text.encode()
    assert "".join(own.decode_stream(np.frombuffer(packed, "<u4").tolist())) == text


def test_fixed_texts(own, library):
    for t in ["", " ", "a\n\n b  ", "it's I'll 'S", "日本語 😀👍🏽 ñandú", "x" * 5000, "ab" * 3000 + " c", "   z", "0123456789" * 30, "<|endoftext|>"]:
        same(own, library, t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abet hionst\n'sé", max_size=200))
def test_any_text(own, library, text):
    same(own, library, text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(0, 30), max_size=6))
def test_utf8_machine_does_not_depend_on_the_cuts(data, cuts):
    m, out, at = Utf8Machine(), "", 0
    for c in sorted(min(c, len(data)) for c in cuts) + [len(data)]:
        out += m.feed(data[at:c])
        at = c
    assert out + m.finish() == data.decode("utf-8", "replace")


def test_query_against_the_library(spark, library):
    got = {r.doc_id: r for r in op7_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (2, "", "y")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, encode_column(df, PATH, public_tokenizers.PATTERN, payload=True).select("doc_id", "n_tokens", "decoded").collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (2, 0, ""), (None, 2, "a b")], key=str)
    assert encode_column(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
