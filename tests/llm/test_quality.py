import duckdb

from tidewater.llm.quality import BASE, RULES, judge, judged_sql, rated
from tidewater.llm.queries import op3_quality

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def both(frame, view):
    con = duckdb.connect()
    con.execute(f"create view documents as {view}")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({judged_sql()})").fetchall()
    assert sorted(tuple(r) for r in frame.select(COLUMNS).collect()) == sorted(want)


def test_query_against_sql(spark):
    both(op3_quality(spark, "/root/testdata/sf0.01"), "select * from '/root/testdata/sf0.01/documents.parquet'")


def test_edges(spark, tmp_path):
    texts = [None, "", " \t\n", "a b c a b c", "\n".join(["same line"] * 40), "a a a a", "é b\u0085 c\u000bd", "# * x|y <z> 😀\n\n# * x|y <z> 😀", "w " * 30_000, " ".join(f"word{i}" for i in range(60))]
    frame = spark.createDataFrame([(i, t, "x", False) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean")
    frame.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    both(judge(frame), f"select * from '{tmp_path}/d/*.parquet'")
    assert judge(frame).where("doc_id = 9").first().kept
    assert judge(frame.limit(0)).count() == 0


def test_order_follows_the_sample(spark):
    long = " ".join(f"word{i}" for i in range(80))
    symbols = [(long + " #" * 60,)] * 40 + [(long,)] * 60
    repeats = [("alpha beta gamma " * 60,)] * 40 + [(long,)] * 60
    for rows, first in ((symbols, "symbols"), (repeats, "repeats")):
        order = rated(spark.createDataFrame(rows, "text string"))
        assert order[0][0].name == first and len(order) == len(BASE + RULES)
        assert [x[1] / x[2] for x in order] == sorted((x[1] / x[2] for x in order), reverse=True)
    costs = {r.name: c for r, _, c in rated(spark.createDataFrame([(long,)], "text string"))}
    assert costs["repeats"] > costs["dup_lines"] > costs["few_words"]


def test_cascade_without_measures_and_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.where("doc_id < 20")).withColumn("failed_rule", docs.doc_id)
    want = sorted((r.doc_id, r.kept) for r in judge(docs).collect())
    lean = judge(docs, with_measures=False)
    assert sorted((r.doc_id, r.kept) for r in lean.collect()) == want and "n_words" not in lean.columns
