import hashlib
import random

import corpus_pipeline
from tests.llm.brute import contaminated, near, secrets
from tidewater.llm.secrets import redact
from tidewater.llm.toxicity import score_toxicity
from tidewater.session import table

D = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = table(spark, D, "documents")
    clean = [(r.doc_id, r.text) for r in score_toxicity(docs, table(spark, D, "labels")).where("predicted = 0").collect()]
    comp = near(clean)
    first = [(d, t) for d, t in clean if comp[d][1] == d]
    bad = contaminated(first, [(r.item_id, r.text) for r in table(spark, D, "benchmark").collect()])
    left = [(d, t) for d, t in first if not bad[d][4]]
    masked = {r.doc_id: r.text for r in redact(docs).collect()}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, D).collect()}
    assert got == {d: hashlib.sha256((masked[d] or "").encode()).hexdigest() for d, _ in left}
    assert all(not secrets(masked[d]) for d, _ in left)


def test_stages_keep_the_columns(spark):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert set(out.columns) == set(docs.columns) and out.count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(99999)}" for _ in range(n))
    a, b, c, d, hit = words(60), words(60), words(60), words(60), words(30)
    rows = [(3, a), (3, a), (3, b), (None, c), (None, c), (None, a), (5, d), (4, d), (7, ""), (7, ""), (None, None), (None, None), (8, hit), (8, words(50)), (None, hit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = corpus_pipeline.near_dedup(spark, docs, D)
    want = [(3, a), (3, b), (None, c), (4, d), (7, ""), (None, None), (None, None), (8, hit), (8, rows[13][1])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    spark.createDataFrame([(1, hit)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((r for r in rows if r[1] != hit), key=str)


def test_stages_keep_clashing_columns_nulls_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "plain words about gardens and rivers " * 3_000), (4, "token=abcdefgh1234 here"), (4, "token=abcdefgh1234 here")]
    docs = spark.createDataFrame([(*r, "s", 7, "f", 1.5, "r") for r in rows], "doc_id long, text string, score string, base int, found string, predicted double, spans string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        got = out.collect()
        assert out.columns == docs.columns, name
        assert {(r.score, r.base, r.found, r.predicted, r.spans) for r in got} <= {("s", 7, "f", 1.5, "r")}, name
        texts = sorted((r.doc_id, r.text or "") for r in got)
        if name == "near_dedup":
            assert [d for d, _ in texts] == [1, 2, 3, 4]
        elif name == "secrets":
            assert [t for d, t in texts if d == 4] == ["[secret] here"] * 2 and {r.text for r in got if r.doc_id < 3} == {None, ""}
        elif name == "decontamination":
            assert texts == sorted((d, t or "") for d, t in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert sorted(r.doc_id for r in last) == [1, 2, 3, 4, 4]
    assert {r.decoded_sha256 for r in last if r.doc_id < 3} == {hashlib.sha256(b"").hexdigest()}
