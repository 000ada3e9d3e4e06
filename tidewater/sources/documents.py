"""Documents as rows: whole files, and texts cut into the numbered chunks of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file under any path that Spark reads; invalid UTF-8 shows as U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def in_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, seq, chunk, last): the text in pieces of ``size`` characters, numbered from 0; null and empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / size)).cast("int")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), n.alias("_n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    piece = F.col("_text").substr(F.col("seq") * size + 1, F.lit(size))
    return rows.select(key, F.col("seq").cast("bigint").alias("seq"), piece.alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("last"))
