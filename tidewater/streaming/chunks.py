"""Partial states of chunked streams under Structured Streaming.

State per stream: the text so far, the next sequence number, the chunks that came early, and the number of the last chunk
once it is known.  An early chunk waits until the gap before it is filled; one that was folded before is ignored.  Nothing is
held back silently: while chunks wait, each batch reports the first missing number, and when the last chunk has been folded
one more row says that the stream has ended.  The processor only joins text: decoding stays in expressions on the prefixes.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind: chunk (seq was folded), missing (seq is waited for), end (seq follows the last chunk).
OUTPUT = "stream bigint, seq bigint, kind string, prefix string"
STATE = "prefix string, due bigint, early string, last bigint"


def _fold(key, batches, state):
    prefix, due, early, last = state.get if state.exists else ("", 0, "{}", None)
    waiting = {int(k): v for k, v in json.loads(early).items()}
    begun = due
    for batch in batches:
        for seq, chunk, ends in zip(batch["seq"], batch["chunk"], batch["ends"], strict=True):
            if ends:
                last = int(seq)
            if seq >= due:
                waiting[int(seq)] = chunk or ""
    rows = []
    while due in waiting:
        prefix += waiting.pop(due)
        rows.append((key[0], due, "chunk", prefix))
        due += 1
    if waiting:
        rows.append((key[0], due, "missing", prefix))
    if last is not None and begun <= last < due:
        rows.append((key[0], due, "end", prefix))
    state.update((prefix, due, json.dumps(waiting), last))
    yield pd.DataFrame(rows, columns=["stream", "seq", "kind", "prefix"])


def streaming_prefixes(chunks: DataFrame, stream: str, seq: str, chunk: str, last: str | None = None) -> DataFrame:
    """OUTPUT of a streaming frame of chunks, whose numbers start at 0; column ``last`` marks a stream's last chunk."""
    ends = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    rows = chunks.select(F.col(stream).cast("bigint").alias("stream"), F.col(seq).cast("bigint").alias("seq"), F.col(chunk).alias("chunk"), ends.alias("ends"))
    return rows.groupBy("stream").applyInPandasWithState(_fold, OUTPUT, STATE, "append", "NoTimeout")
