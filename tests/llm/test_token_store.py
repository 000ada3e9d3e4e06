import zlib

import numpy as np
import pytest

from tidewater.llm.queries import op1_token_store, vocabulary
from tidewater.llm.token_store import PerfectHash, write_store
from tidewater.session import scratch_path, table

SCHEMA = "doc_id long, text string, key string, shard int"


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_query_against_plain_encoding(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect())
    want, at = [], 0
    for (k, _), ids in zip(docs, plain([t for _, t in docs]), strict=True):
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op1_token_store(spark, "/root/testdata/sf0.001").collect())) == want


def test_edge_rows_and_keyed_access(spark):
    data = [(3, "a\x0bb  c", "x", 1), (1, None, None, None), (7, "", "x", 2), (2, "ﬁne É <|endoftext|> x" * 50, "y", 0), (None, "no key", "z", 0)] + [(9, "copy", "c", 5)] * 60
    store = write_store(spark.createDataFrame(data, SCHEMA), scratch_path(spark, "t"), vocabulary("word_bpe_49k.json"), 1)
    got = store.read_all().collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = plain([r[1] for r in order])
    assert [(r.key, bytes(r.ids)) for r in sorted(got, key=lambda r: r.start)] == [(r[0], i.tobytes()) for r, i in zip(order, ids, strict=True)]
    some = store.get(spark.createDataFrame([(9,), (2,), (4,), (None,), (9,)], "doc_id long")).collect()
    assert sorted(r.key for r in some) == [2] + [9] * 60


def test_empty_table(spark):
    store = write_store(spark.createDataFrame([], SCHEMA), scratch_path(spark, "t"), vocabulary("word_bpe_49k.json"), 1)
    assert store.read_all().collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_rejects_absent_keys(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    h, number = PerfectHash.build(keys)
    assert sorted(number.tolist()) == list(range(n))
    h = PerfectHash.load(h.dump())
    assert (h.find(keys) == number).all()
    assert (h.find(keys + np.uint64(1 << 41)) == -1).all()


def test_every_character_splits_like_the_library():
    from tidewater.llm.token_store import WordMemoEncoder

    own = WordMemoEncoder(vocabulary("word_bpe_49k.json"), 1)
    texts = [f"ab{chr(c)}cd {chr(c)} x" for c in [*range(0x3100), 0xFEFF, 0x1F600]]
    for text, ids, want in zip(texts, own.encode(texts), plain(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).astype("<u4").tolist() == want.tolist(), repr(text)


def test_words_share_the_ids_of_their_parts():
    from tidewater.llm.token_store import WordMemoEncoder

    own = WordMemoEncoder(vocabulary("word_bpe_49k.json"), 1)
    text = "Word, word. WORD!"
    assert b"".join(own.encode([text])) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids + [1], own.dtype).tobytes()
    assert set(own.parts) == {"", "word", ",", ".", "!"}
    odd = "It's, x<|endoftext|>, a—, é, é, ABC İx, 's, don't' 12.5% ... a≠, ΟΔΟΣ, q̀!! 中, A.B.C. <B>, ß$$$ x², xⅠ. ǅ, </w>, a</w>"
    for t in [odd, *odd.split()]:
        assert next(own.encode([t])) == np.array(own.tokenizer.encode(t, add_special_tokens=False).ids + [1], own.dtype).tobytes(), t
