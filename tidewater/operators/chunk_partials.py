"""Prefixes of chunked streams, one row per chunk: the batch twin of tidewater.streaming.chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_prefixes(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    """(stream, seq, prefix): all chunks of a stream up to this one, joined; a null chunk adds nothing.

    One shuffle, on the stream.  States of a stream are as many and as long as its chunks, whatever the plan.
    """
    so_far = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.select(stream, seq, F.array_join(F.collect_list(F.coalesce(chunk, F.lit(""))).over(so_far), "").alias("prefix"))


def escape_json(text):
    """The text as the inside of a JSON string."""
    body = F.to_json(F.struct(text.alias("v")))
    return body.substr(F.lit(7), F.length(body) - 8)
