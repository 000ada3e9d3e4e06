"""Benchmark decontamination with an FM-index over each training shard.

A task cuts its documents into shards, and each shard's word sequence gets an FM-index: suffix order, its Burrows-Wheeler
transform in a wavelet matrix for ranks, and every eighth suffix position.  All benchmark windows of one length are
searched backwards at once; occurrences are located by walking to a sampled position and their spans are merged.

Every word of a document that some benchmark item holds is indexed; runs of other words become one separator.  A document
longer than a shard is cut into pieces that overlap by a window less a word.

Defined results: null, empty or wordless text has no words, no hits and is not contaminated; an item without words has no
window; an item shorter than a window is one window; repeated items of one id count once; items of null id are searched too
and count as one item, null in items and the empty name in items_sha256; an empty benchmark hits nothing.  Each row of the
documents is judged by itself, whatever its id: repeated and null ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.arrays import running_max
from tidewater.session import materialize, ship

WINDOW = 13
SAMPLE = 8
#: Symbols of one shard's index, and bytes of benchmark text whose windows are held at once.
SHARD_SYMBOLS = 1 << 18
BLOCK_BYTES = 4 << 20

#: A-Z become a-z; the other ASCII characters outside 0-9 and a-z become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit vector with running counts per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, int, int]] = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            run = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=run[1:])
            zeros = len(seq) - int(run[-1])
            self.levels.append((run, zeros, bit))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for run, zeros, bit in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + run[low], low - run[low])
            at = np.where(one, zeros + run[at], at - run[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for run, zeros, bit in self.levels:
            one = run[at + 1] > run[at]
            out |= one.astype(at.dtype) << bit
            at = np.where(one, zeros + run[at], at - run[at])
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        done = pair[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.cumsum(done[1:] != done[:-1])
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, top: int):
        """``seq`` ends with a 0 found nowhere else; symbols reach ``top``."""
        sa = suffix_order(seq)
        bwt = seq[sa - 1]
        self.ranks = WaveletMatrix(bwt, top)
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=top + 1), out=self.before[1:])
        self.n = len(seq)
        self.marked = sa % SAMPLE == 0
        self.order = np.cumsum(self.marked) - self.marked
        self.places = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of ``phrases``."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, col]
            low[live] = self.before[c] + self.ranks.rank(c, low[live])
            high[live] = self.before[c] + self.ranks.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high[np.setdiff1d(np.arange(len(phrases)), live, assume_unique=True)] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, rows = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        live = np.arange(len(rows))
        while len(live):
            known = self.marked[rows[live]]
            here = live[known]
            out[here] = self.places[self.order[rows[here]]] + steps[here]
            live = live[~known]
            c = self.ranks.access(rows[live])
            rows[live] = self.before[c] + self.ranks.rank(c, rows[live])
            steps[live] += 1
        return out


class Windows:
    """The benchmark's windows in word numbers, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids: dict[bytes, int] = {}
        held: dict[int, dict[tuple[int, ...], set[int | None]]] = {}
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if not seq:
                continue
            width = min(WINDOW, len(seq))
            group = held.setdefault(width, {})
            for i in range(len(seq) - width + 1):
                group.setdefault(tuple(seq[i : i + width]), set()).add(item)
        self.vocabulary = len(self.ids)
        self.phrases = [(w, np.array(list(g), np.int64).reshape(-1, w), list(g.values())) for w, g in sorted(held.items())]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words of no item."""
        get = self.ids.get
        return np.array([get(w, -1) for w in words], np.int64)


def _search(shard: list[tuple[int, int, np.ndarray]], windows: Windows) -> dict[int, tuple[list[tuple[int, int]], set[int | None]]]:
    """For each document of the shard's pieces (document, first word, numbers) with occurrences: its spans, and the items."""
    parts, docs, origin = [], [], []
    for place, first, seq in shard:
        known = seq >= 0
        kept = np.flatnonzero(known | np.concatenate(([False], known[:-1])))
        parts += [np.where(known[kept], seq[kept] + 2, 1), np.ones(1, np.int64)]
        docs.append(np.full(len(kept) + 1, place, np.int64))
        origin.append(np.append(kept + first, first + len(seq)))
    if not windows.phrases or not any(len(p) > 1 for p in parts):
        return {}
    parts.append(np.zeros(1, np.int64))
    text, doc, at = np.concatenate(parts), np.concatenate(docs), np.concatenate(origin)
    index = FMIndex(text, windows.vocabulary + 1)
    found: dict[int, tuple[list[tuple[int, int]], set[int | None]]] = {}
    for width, phrases, items in windows.phrases:
        low, high = index.search(phrases + 2)
        n = high - low
        which = np.repeat(np.arange(len(phrases)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        where = index.locate(rows)
        for w, p in zip(which.tolist(), where.tolist(), strict=True):
            spans, names = found.setdefault(int(doc[p]), ([], set()))
            spans.append((int(at[p]), int(at[p]) + width))
            names |= items[w]
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, spans, items = [], [[] for _ in range(len(b))], [set() for _ in range(len(b))]
        shard, held = [], 0

        def flush(shard, spans=spans, items=items):
            for place, (s, names) in _search(shard, windows).items():
                spans[place] += s
                items[place] |= names

        for place, t in enumerate(b.column(b.num_columns - 1)):
            seq = windows.numbers(words_of(t.as_py()))
            n.append(len(seq))
            for first in range(0, len(seq), SHARD_SYMBOLS):
                piece = seq[first : first + SHARD_SYMBOLS + WINDOW - 1]
                shard.append((place, first, piece))
                held += len(piece)
                if held >= SHARD_SYMBOLS:
                    flush(shard)
                    shard, held = [], 0
        flush(shard)
        spans = [[list(x) for x in merged(s)] for s in spans]
        items = [sorted(names, key=lambda x: (x is None, x or 0)) for names in items]
        out = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-1], "n_words", "spans", "items"])


def merged_spans(spans: Column) -> Column:
    """The same for a column of spans in any order."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def joined(x: Column) -> Column:
        def cut(reach: Column) -> Column:
            opens = F.transform(x, lambda s, i: F.when(i > 0, s[0] > F.get(reach, i - 1)).otherwise(True))

            def zipped(o: Column) -> Column:
                begin = F.transform(F.filter(x, lambda s, i: F.get(o, i)), lambda s: s[0])
                end = F.filter(reach, lambda r, i: F.coalesce(F.get(o, i + 1), F.lit(True)))
                return F.zip_with(begin, end, lambda b, e: F.array(b, e.cast("long")))

            return once(opens, zipped)

        return once(running_max(F.transform(x, lambda s: s[1].cast("int"))), cut)

    return once(F.array_sort(spans), joined)


def find_windows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, spans (merged word ranges, end exclusive) and the items that occur.

    The benchmark is gone through in blocks of about BLOCK_BYTES, whatever its size; each block is one pass.  Where there
    are several, rows get a key that is written before the first, and the passes' results are put together by it.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    if blocks > 1:
        src = materialize(src.select(F.monotonically_increasing_id().alias("row"), "id", "body"), "rows")
    given = ", ".join(f"{c} long" for c in src.columns[:-1])
    passes = []
    for i in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else bench
        windows = Windows([(r.item_id, r.text) for r in part.collect()])
        passes.append(src.mapInArrow(lambda it, w=windows: _scan(it, w), f"{given}, n_words long, spans array<array<long>>, items array<long>"))
    if blocks == 1:
        return passes[0].withColumnRenamed("id", key)
    every = passes[0]
    for p in passes[1:]:
        every = every.union(p)
    flat = every.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).drop("row")
    return flat.withColumn("spans", merged_spans(F.col("spans"))).withColumnRenamed("id", key)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """find_windows with its digest: n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more)."""
    found = find_windows(docs, benchmark, key, text)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit("")))), ",")
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(names, 256))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
