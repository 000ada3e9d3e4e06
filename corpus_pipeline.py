"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets and byte-level BPE, in this order.

Each stage keeps the columns of documents; the last returns doc_id with the digests of its token ids and of their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import materialize, table

#: tests/llm/test_pipeline.py holds the stage against all pairs at this similarity.
NEAR_PERCENT = 85


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts are judged like others, repeated rows each for itself."""
    from tidewater.llm.toxicity import score_toxicity

    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), prefix="_toxic_")
    return scored.where("_toxic_predicted = 0").select(docs.columns)


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with a written key of each row, because ids may repeat or be null."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), label)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity NEAR_PERCENT or more) one row stays, that of smallest id.

    Null ids come last, so a row without id stays where no row with one is a near copy.  Texts without words are near
    copies of nothing: of these, rows that repeat an id and text shrink to one, and rows without id all stay.
    """
    from tidewater.llm.near_dedup import near_duplicates

    rows = keyed(docs, "near-rows")
    groups = near_duplicates(rows, percent=NEAR_PERCENT, key="_row").select("_row", "n_shingles", "component_id")
    empty = F.col("n_shingles") == 0
    same = [
        F.when(~empty | F.col("doc_id").isNull(), F.col("component_id")).alias("group"),
        F.when(empty, F.col("doc_id")).alias("id"),
        F.when(empty, F.md5("text")).alias("body"),
    ]
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = rows.select("_row", "doc_id", "text").join(groups, "_row").groupBy(*same).agg(first.alias("_row")).select("_row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more is benchmark text go, each judged by itself; null and wordless texts stay."""
    from tidewater.llm.decontamination import contamination

    rows = keyed(docs, "benchmark-rows")
    bad = contamination(rows, table(spark, sf_dir, "benchmark"), key="_row").where("contaminated").select("_row")
    return rows.join(bad, "_row", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is masked; n_chars follows, where it is a column.  Null texts stay null."""
    from tidewater.llm.secrets import redact

    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in out.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and the digests of the ids and of their decoding; null text is empty."""
    import public_tokenizers

    from tidewater.llm.bpe import encode_column
    from tidewater.llm.queries import vocabulary

    return encode_column(docs.select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("bpe", bpe)]

#: SQL can't express the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
