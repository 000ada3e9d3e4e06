"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training reads at most MAX_ROWS labelled rows, taken by a hash of the id; a text that would bring its characters over MAX_CHARS
is passed over, and the next ones are taken.  Features are hashed n-grams of the lower-cased
characters, present or not; each counts with its log ratio of smoothed class frequencies, and logistic regression with an
L2 penalty learns the weights.  The model is two vectors of FEATURES numbers, whatever the data's size.

Defined results: null and empty text score the model's intercept; labels that are null, neither 0 nor 1, or of unknown
documents are not learnt from; a document labelled twice counts twice; without labels of both kinds every score is the
share of label 1 (0 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.session import materialize, ship

ORDERS = (3, 4, 5)
FEATURES = 1 << 20
MAX_ROWS = 6_000
MAX_CHARS = 24_000_000
MIN_ROWS = 4


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of the whole text."""
    x = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = np.zeros(FEATURES, bool)
    for n in ORDERS:
        if len(x) < n:
            break
        h = np.full(len(x) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ x[j : len(x) - n + 1 + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        flag[h & np.uint32(FEATURES - 1)] = True
    return np.flatnonzero(flag).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], passes: int = 5) -> tuple[np.ndarray, float]:
    """Weights (ratio times learnt weight) and intercept."""
    y = np.array([t for _, t in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        p = min(max(share, 1e-9), 1 - 1e-9)
        return np.zeros(FEATURES, np.float32), float(np.log(p / (1 - p)))
    count = [np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.int32)]
    for f, t in rows:
        count[t][f] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((count[1] + 1) / (n1 + 2)) - np.log((count[0] + 1) / (n0 + 2))
    ratio[(count[0] + count[1]) < MIN_ROWS] = 0
    ratio = ratio.astype(np.float32)
    w = np.ones(FEATURES, np.float32) * np.float32(0.02)
    b = float(np.log(n1 / n0))
    rng = np.random.default_rng(7)
    squares = np.full(FEATURES, 1e-2, np.float32)
    for turn in range(passes):  # Adagrad over single rows
        rate = 0.05 / (1 + 0.1 * turn)
        for i in rng.permutation(len(rows)):
            f, t = rows[i]
            r = ratio[f]
            z = float(w[f] @ r) + b
            g = 1 / (1 + np.exp(-max(min(z, 30), -30))) - t
            if abs(g) < 1e-3:
                continue
            step = np.float32(g) * r + np.float32(1e-5) * w[f]
            squares[f] += step * step
            w[f] -= np.float32(rate) * step / np.sqrt(squares[f])
            b -= 0.02 * rate * g
    return w * ratio, b


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, text: int, passed: int) -> Iterator[pa.RecordBatch]:
    """The first ``passed`` columns and the score of column ``text``."""
    for b in batches:
        z = np.array([float(weights[features(t.as_py())].sum(dtype=np.float64)) + bias for t in b.column(text)])
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        yield pa.RecordBatch.from_arrays([*b.columns[:passed], pa.array(score, pa.float64())], [str(i) for i in range(passed + 1)])


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Learns from rows outside the held-out quarter; the driver sees at most MAX_ROWS texts and MAX_CHARS characters."""
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    few = marks.withColumn("o", F.xxhash64("id")).orderBy("o", "id", "y").limit(MAX_ROWS)
    rows, chars = [], 0
    got = materialize(docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(few), "id"), "labelled")
    for r in got.orderBy("o", "id", "y").toLocalIterator():
        if chars + len(r.body or "") > MAX_CHARS:
            continue
        chars += len(r.body or "")
        rows.append((features(r.body), r.y))
    return fit(rows)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted and held_out, each under ``prefix``; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    weights, bias = train(docs, labels, key, text)
    model = spark.sparkContext.broadcast(weights)
    score, predicted, held = (prefix + n for n in ("score", "predicted", "held_out"))
    keep = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in (score, predicted, held)])
    names = keep.columns
    # the text goes to the workers once, unless it is not among the columns that come back
    rows, at = (keep, names.index(text)) if text in names else (docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("_body")), len(names))
    schema = StructType(list(keep.schema.fields)).add(score, "double")
    out = rows.mapInArrow(lambda it: _score(it, model.value, bias, at, len(names)), schema)
    return out.withColumn(predicted, (F.col(f"`{score}`") >= threshold).cast("int")).withColumn(held, held_out(key))
