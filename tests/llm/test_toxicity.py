import zlib

from tidewater.llm import toxicity
from tidewater.llm.queries import op8_toxicity
from tidewater.llm.toxicity import score_toxicity
from tidewater.session import table


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_toxicity(spark, d).collect()}
    assert len(got) == table(spark, d, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.toxic, got[r.doc_id].predicted) for r in table(spark, d, "labels").collect() if got[r.doc_id].held_out]
    assert sum(y == p for y, p in held) / len(held) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a", 1), (1, None, 1), (2, "", 1), (3, "bad " * 50_000, 1), (4, "good", 1), (4, "good", 1), (5, "bad", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (5, None), (99, 1), (None, 1), (2, 7)], "doc_id long, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    none = score_toxicity(docs, labels.limit(0)).collect()
    assert all(r.score < 1e-6 and r.predicted == 0 for r in none)
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_a_text_over_the_bound_is_passed_over_and_labels_may_disagree(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CHARS", 20_000)
    docs = [(i, ("vile filthy insult " if i % 2 else "kind gentle praise ") * 3 + f"n{i}") for i in range(120)] + [(500 + i, "x" * 30_000) for i in range(8)]
    marks = [(i, i % 2) for i in range(120)] + [(500 + i, 0) for i in range(8)] + [(7, 0), (7, 1)]
    frame = spark.createDataFrame([(*d, None) for d in docs], "doc_id long, text string, predicted string")
    rows = {r.doc_id: r for r in score_toxicity(frame, spark.createDataFrame(marks, "doc_id long, toxic int"), prefix="my_").collect()}
    assert len(rows) == 128 and all(r.predicted is None for r in rows.values())
    held = [r for i, r in rows.items() if i < 120 and r.my_held_out]
    assert held and all(r.my_predicted == r.doc_id % 2 for r in held)
