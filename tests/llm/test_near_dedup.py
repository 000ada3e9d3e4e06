import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import near
from tidewater.llm import near_dedup
from tidewater.llm.near_dedup import Signer, allowed, banding, looked_up, near_duplicates
from tidewater.llm.queries import op5_near_dedup
from tidewater.session import materialize, table

KIND = "doc_id long, text string, comp string, id string, bucket int"


def check(spark, docs):
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], KIND)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == near(docs)


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == near(docs)


def test_groups_with_links_near_the_threshold(spark):
    rng = random.Random(5)
    docs, at = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(9999)}" for _ in range(150)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            docs.append((at, " ".join(w)))
            at += 1
    rng.shuffle(docs)
    check(spark, docs)


def test_empty_null_short_and_repeated(spark):
    check(spark, [(9, None), (8, ""), (7, " \n\t"), (6, "One two"), (5, "one  TWO"), (4, "one two three"), (3, "É a b c d e"), (2, "é a b c d e"), (1, "x " * 50_000), (0, "x " * 40_000)])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_all_alike(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("the same words in each of these").alias("text"))
    assert {r.component_id for r in near_duplicates(docs).collect()} == {0}


def test_bands_follow_the_threshold():
    assert banding(85) == (6, 28)
    for percent in (80, 85, 90):
        rows, bands = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 2e-6


def test_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(f"w{rng.randrange(99999)}" for _ in range(30)) for _ in range(3))
    docs = [(1, a), (1, b), (3, b), (3, b), (None, b), (None, c), (5, c + " x"), (None, None)]
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], KIND)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 26, 1), (1, 26, 1), (3, 26, 1), (3, 26, 1), (None, 26, 1), (None, 26, None), (5, 27, 5), (None, 0, None)], key=str)


def test_sketches_of_linked_sets_are_near():
    rng = np.random.default_rng(3)
    signer = Signer(*banding(85))
    for size in (5, 30, 200, 1500, 6000):
        for _ in range(60):
            x = rng.integers(1 << 63, size=size, dtype=np.uint64) * np.uint64(2)
            both = -(-85 * size // 100)
            cut = both + rng.integers(size - both + 1)
            pair = [np.sort(x[:cut]), np.sort(np.concatenate([x[:both], x[cut:]]))]
            (_, u, k), (_, v, m) = (signer.sign(s) for s in pair)
            assert np.bitwise_count((u ^ v).view(np.uint64)).sum() <= allowed(float(len(pair[0])), float(len(pair[1])), k, m, 85)


def test_many_texts_just_under_the_threshold_are_told_apart(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(w)))
    check(spark, docs)


def test_frequent_keys_are_looked_up_whole(spark):
    rows = spark.createDataFrame([(i % 3 if i < 90 else i,) for i in range(100)], "k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("k").alias("v"))
    for total in (100, 100_000):
        got = looked_up(rows, table, "k", "n", total)
        assert got.count() == 100 and got.where("k <> v").count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_links_that_no_star_finds_are_no_row_each(spark, monkeypatch, small):
    """The smallest ids are near all others and linked with none, so that every star misses; the others are all linked."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    docs = []
    for i in range(220):
        w = list(base)
        for k in rng.sample(range(5, 145), 3 if i < 20 else 1):
            w[k] = f"x{i}y{k}"
        docs.append((i, " ".join(w)))
    made = {}

    def counted(df, label):
        out = materialize(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    if small:
        monkeypatch.setattr(near_dedup, "BLOCK", 30)
        monkeypatch.setattr(near_dedup, "SET_BYTES", 40_000)
    check(spark, docs)
    assert made["again"] > 200
    assert max(made.values()) <= banding(85)[1] * len(docs), made
