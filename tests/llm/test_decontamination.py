import hashlib
import random

from tests.llm.brute import contaminated
from tidewater.llm import decontamination as D
from tidewater.llm.queries import op9_decontamination
from tidewater.session import table


def rows(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()]
    assert rows(op9_decontamination(spark, d)) == contaminated(docs, items)


def fixture():
    rng = random.Random(3)
    words = ["a", "b", "cc", "é", "9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 40, 400])))) for i in range(60)] + [(60, None), (61, "A b. " * 4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 40])] + [(90, None), (91, "--"), (92, "a b " * 10), (10, "a b " * 10)]
    items += [(100, " ".join(docs[-3][1].split()[:20]))]
    return docs, items


def test_short_items_blocks_and_shards(spark, monkeypatch):
    docs, items = fixture()
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = contaminated(docs, items)
    assert rows(D.contamination(frame, bench)) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    assert rows(D.contamination(frame, bench)) == want
    no_short = [i for i in items if len((i[1] or "").split()) >= 5]
    bench = spark.createDataFrame(no_short, "item_id long, text string")
    assert rows(D.contamination(frame, bench)) == contaminated(docs, no_short)


def test_empty_tables(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(D.contamination(frame, none)) == contaminated(docs, [])
    assert D.contamination(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_repeated_and_null_ids_are_judged_by_row(spark, monkeypatch):
    hit, plain = " ".join(f"w{i}" for i in range(20)), "nothing of this is benchmark text " * 3
    docs = [(1, hit), (1, plain), (1, plain), (None, hit), (None, plain), (2, "other " + " ".join(f"n{i}" for i in range(15)))]
    items = [(7, hit), (None, " ".join(f"n{i}" for i in range(15))), (None, "z y x"), (8, hit)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = contaminated([(1, hit)], [(7, hit), (8, hit)])[1]
    none = contaminated([(1, plain)], [])[1]
    want = [(1, *one), (1, *none), (1, *none), (None, *one), (None, *none), (2, 16, 15, 1, hashlib.sha256(b"").hexdigest(), True)]
    for size in (4 << 20, 100):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(frame, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_documents_longer_than_a_shard(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "SHARD_SYMBOLS", 16)
    item = " ".join(f"w{i}" for i in range(20))
    texts = [f"{'x ' * n}{item} y {item}" for n in range(40)] + ["", None, "w1 w2"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "body"])
    (got,) = D._scan(iter([batch]), D.Windows([(5, item)]))
    assert got["spans"].to_pylist() == [[[n, n + 20], [n + 21, n + 41]] for n in range(40)] + [[], [], []]
    assert got["items"].to_pylist() == [[5]] * 40 + [[], [], []]
