"""Near-duplicate documents by banded MinHash with odd sketches, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles.  Texts with the same word sequence are one class, and only the
class's smallest id goes on.  MinHash samples of a class make its band keys; more of them, the least shingle in each of
SAMPLES ranges of the hash (as good as the set itself where that is small), are folded into a parity bitmap, its odd sketch.
The bits in which two sketches differ estimate the similarity: pairs whose estimate is SLACK deviations under the threshold
are dropped, the others are confirmed on the full sets.

Which pairs of a bucket are compared: in each of ROUNDS rounds every member that is still apart from the bucket's pivots so
far is compared with the next one, and of the near ones only the nearest over all its buckets is confirmed, so a bucket of n
near copies costs n comparisons and each document one confirmation.  What is apart then is compared with the whole bucket, in
blocks of sketches inside a task, which gives the members with a near one in another component; these are compared once more,
in blocks with their full sets, and a task passes over what its links have joined.  So no pair is a row: rows are members of
buckets, or the links of a forest over them.

Keys that many rows share (words of copies, centres of stars) are looked up by a broadcast of at most SPREAD of them.

Defined results: null, empty or wordless text has an empty set and links with nothing; under five words the whole sequence
is one shingle; rows that repeat an id are one document, linked by any of their texts; a row of null id takes the component
of an equal text that has one, else null, and links nothing; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize, ship

WIDTH = 5
#: Chance that a pair right at the threshold shares no band.
MISSED = 2e-6
SAMPLES = SKETCH_BITS = 2048
#: Of 8,000 pairs right at the threshold, of each of six sizes from 7 to 2,000 shingles, none differed by more bits than this allows.
SLACK = 3.0
#: Rounds of stars, sketches in a block, and the share of the rows (one in SPREAD) from which on a key is frequent.
ROUNDS, BLOCK, SPREAD = 2, 2048, 1000
#: Bytes of a block with full sets, and those of a row besides its set.
SET_BYTES, ROW_BYTES = 1 << 20, 600

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    import xxhash

    out = []
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        h = memo.get(w)
        if h is None:
            if len(memo) > 200_000:
                memo.clear()
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles."""
    n = len(words)
    if not n:
        return words
    width = min(WIDTH, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = _mix(acc * _M1 + words[j : n - width + 1 + j])
    return np.unique(acc)


def banding(percent: int) -> tuple[int, int]:
    """Samples in a band, and as many bands as MISSED takes at this threshold: 6 and 28 for 85 %, 5 and 34 for 80 %."""
    rows = max(1, min(6, (percent - 55) // 5))
    return rows, math.ceil(math.log(MISSED) / math.log1p(-max(0.01, min(0.99, percent / 100)) ** rows))


def allowed(na, nb, ka, kb, percent: int, m=np):
    """The most bits in which the sketches of linked sets of these sizes and numbers of samples differ; of arrays, or with
    ``m`` = pyspark.sql.functions of columns."""
    t = percent / 100
    drawn = lambda x: SAMPLES * (1 - m.exp(x * math.log1p(-1 / SAMPLES)))
    union = (na + nb) / (1 + t)
    of_union = drawn(union) * (ka + kb) / (drawn(na) + drawn(nb))
    left_out = m.abs(union - of_union) / (union - 1 + 1e-9)
    both = t * of_union - SLACK * m.sqrt(of_union * t * (1 - t) * left_out)
    differ = m.abs(ka + kb - 2 * both)
    kept = m.exp(-2 * differ / SKETCH_BITS)
    spread = m.abs(SKETCH_BITS / 4 * (1 - kept * kept) - differ * kept * kept)
    return SKETCH_BITS / 2 * (1 - kept) + SLACK * m.sqrt(spread)


class Signer:
    def __init__(self, rows: int, bands: int) -> None:
        rng = np.random.default_rng(20240)
        self.rows = rows
        k = rows * bands
        self.mul = rng.integers(1 << 31, size=k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(1 << 32, size=k, dtype=np.uint32)
        self.band = np.arange(bands, dtype=np.uint64) * _M1

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 512):
            part = x[None, at : at + 512] ^ self.flip[:, None]
            part *= self.mul[:, None]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Band keys; the odd sketch: bit b is the parity of the samples that fall on b; and the number of samples."""
        key = self.band.copy()
        for row in self.minima(s).astype(np.uint64).reshape(-1, self.rows).T:
            key = _mix(key * _M1 + row)
        part = s >> np.uint64(64 - SAMPLES.bit_length() + 1)
        least = s[np.concatenate(([True], part[1:] != part[:-1]))]  # the set is sorted
        bits = (_mix(least * _M1) % np.uint64(SKETCH_BITS)).astype(np.int64)
        parity = (np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return key.view(np.int64), np.packbits(parity).view(np.int64), len(least)


def _signed(batches: Iterator[pa.RecordBatch], rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    signer, memo = Signer(rows, bands), {}
    for b in batches:
        n, names, keys, bits, samples = [], [], [], [], []
        for t in b.column(1):
            words = word_hashes(t.as_py(), memo)
            s = shingle_set(words)
            n.append(len(s))
            names.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(s) else None)
            k, o, m = signer.sign(s) if len(s) else (None, None, None)
            keys.append(k)
            bits.append(o)
            samples.append(m)
        longs = pa.list_(pa.int64())
        made = [pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, longs), pa.array(bits, longs), pa.array(samples, pa.int32())]
        yield pa.RecordBatch.from_arrays([b.column(0), *made], ["id", "n_shingles", "name", "bands", "sketch", "samples"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for b in batches:
        sets = [shingle_set(word_hashes(t.as_py(), memo)).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            good.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent))
        yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _by_block(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple]:
    """Of two blocks of a bucket - its odd members, and any -: bucket, main, the blocks, and the places in them of pairs of
    different components that look near, nearest first.  A pair comes in the first bucket that both are in."""

    def block(rows: pa.Array) -> tuple[np.ndarray, ...]:
        *first, bands, sketch = rows.flatten()[:6]  # id, comp, n, samples
        wide = [x.flatten().to_numpy().reshape(len(x), -1) for x in (bands, sketch)]
        return (*(c.to_numpy() for c in first), wide[0], wide[1].view(np.uint64))

    for batch in batches:
        for i in range(batch.num_rows):
            bucket, main = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            odd, every = (batch.column(k).slice(i, 1).flatten() for k in (2, 3))
            ia, ca, na, ka, ba, sa = block(odd)
            ib, cb, nb, kb, bb, sb = block(every)
            for at in range(0, len(ia), 64):
                part = slice(at, at + 64)
                u, v = na[part, None].astype(float), nb[None, :].astype(float)
                x, y = np.nonzero((ca[part, None] != cb) & ((cb == main) | (ia[part, None] > ib)) & (100 * np.minimum(u, v) >= percent * np.maximum(u, v)))
                x = x + at
                bits = np.bitwise_count(sa[x] ^ sb[y]).sum(axis=1, dtype=np.int64)
                near = bits <= allowed(na[x].astype(float), nb[y].astype(float), ka[x].astype(float), kb[y].astype(float), percent)
                x, y, bits = x[near], y[near], bits[near]
                same = ba[x] == bb[y]
                mine = ba[x, np.argmax(same, axis=1)] == bucket
                order = np.argsort(bits[mine], kind="stable")
                yield bucket, main, odd, every, x[mine][order], y[mine][order]


def _near_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of each bucket that look near one of another component, each once: a bucket's blocks come in a row."""
    now, seen = None, set()
    for bucket, main, odd, every, x, y in _by_block(batches, percent):
        if bucket != now:
            now, seen = bucket, set()
        for rows, at in ((odd, np.unique(x)), (every, np.unique(y))):
            ids = rows.field("id").to_numpy()[at].tolist()
            new = [i not in seen for i in ids]
            if any(new):
                seen.update(ids)
                cols = rows.take(pa.array(at[new])).flatten()
                both = [pa.array([k] * len(cols[0]), pa.int64()) for k in (bucket, main)]
                yield pa.RecordBatch.from_arrays([*both, *cols], ["bucket", "main", "id", "comp", "n", "samples", "bands", "sketch"])


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a > b) between components, confirmed on the full sets.  Pairs that earlier links of the task join are passed over."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            up[c] = c = up.get(up[c], up[c])
        return c

    for _, _, odd, every, x, y in _by_block(batches, percent):
        a, b = [], []
        ia, ca, sa, ib, cb, sb = (rows.field(k) for rows in (odd, every) for k in ("id", "comp", "shingles"))
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            u, v = root(ca[i].as_py()), root(cb[j].as_py())
            if u != v and similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (sa[i], sb[j])), percent):
                up[max(u, v)] = min(u, v)
                ends = ia[i].as_py(), ib[j].as_py()
                a.append(max(ends))
                b.append(min(ends))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def in_blocks(rows: DataFrame, *more: str) -> DataFrame:
    """bucket, main, a block of the bucket's members outside its main component, a block of its members: each with each."""
    row = F.struct("id", "comp", "n", "samples", "bands", "sketch", *more).alias("row")
    placed = rows.select("bucket", "main", F.pmod(F.xxhash64("id"), "blocks").alias("block"), row)
    # the filter comes after the grouping, so that both sides read one shuffle
    every = placed.groupBy("bucket", "main", "block").agg(F.collect_list("row").alias("all"))
    odd = every.select("bucket", "main", F.filter("all", lambda r: r.comp != F.col("main")).alias("odd")).where(F.size("odd") > 0)
    return odd.join(every.select("bucket", "all").hint("merge"), "bucket").select("bucket", "main", "odd", "all")


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, whose ``n`` is how many of ``total`` rows may have its key (each key there once).

    The keys of more than one row in SPREAD, hence at most SPREAD of them, go to all tasks; the others are shuffled.
    """
    often = table.where(F.col(n) > total // SPREAD)
    seldom = table.where(F.col(n) <= total // SPREAD)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom.hint("merge"), key)
    return rest.unionByName(rows.join(F.broadcast(often), key))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb")
    return materialize(rows.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in an edge: the smallest id reachable.

    Each round links the neighbours of a vertex, and the vertex, to the smallest of them, which keeps the number of edges,
    until nothing changes.  A vertex with many links is a key of sums, and is looked up without being dealt to one task.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.union(e.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "low")
        total = 2 * e.count()
        star = looked_up(both, low, "u", "n", total).select(F.col("v").alias("x"), "m").union(low.select("u", "m"))
        nxt = materialize(star.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), "edges")
        # done when no id is both a child and a parent and each child has one parent: then every edge is (member, root)
        kids = nxt.groupBy("u").agg(F.count("*").alias("n"))
        twice = kids.where("n > 1").limit(1).count()
        if not twice and not nxt.select("v").distinct().join(kids.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            root = nxt.select(F.col("u").alias("id"), F.col("v").alias("comp"))
            return root.union(nxt.select("v", "v").distinct().toDF("id", "comp"))
        e = nxt


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_shingles, class_id (smallest id of the same words) and component_id."""
    spark = docs.sparkSession
    ship(spark)
    rows, bands = banding(percent)
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    signed = materialize(src.mapInArrow(lambda it: _signed(it, rows, bands), "id long, n_shingles long, name binary, bands array<long>, sketch array<long>, samples int"), "signed")
    classes = materialize(signed.where("name is not null").groupBy("name").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    named = signed.where("name is not null").select("id", "n_shingles", "name")
    member = looked_up(named, classes, "name", "n", signed.count()).select("id", "n_shingles", "rep")
    member = member.union(signed.where("name is null").select("id", "n_shingles", F.col("id").alias("rep")))
    # the samples depend on the set alone, so the representative's row is the class's
    chosen = classes.where("rep is not null").select("name", F.col("rep").alias("id"))
    reps = materialize(signed.join(chosen.hint("merge"), ["name", "id"]).dropDuplicates(["name", "id"]).select("id", "n_shingles", "samples", "bands", "sketch"), "reps")
    keys = reps.select("id", F.explode("bands").alias("bucket")).repartition("bucket")
    full = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    inside = materialize(keys.join(full.hint("merge"), "bucket").distinct(), "buckets")
    used = inside.select("id").distinct()
    sets = materialize(src.join(used.hint("merge"), "id").mapInArrow(_sets, "id long, shingles binary"), "sets")

    apart = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    most = allowed(F.col("nsa"), F.col("nsb"), F.col("ksa"), F.col("ksb"), percent, F)

    def sketched(name: str, col: str) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("sketch").alias(col), F.col("n_shingles").alias(f"n{col}"), F.col("samples").alias(f"k{col}")).hint("merge")

    sizes = f"100 * least(nsa, nsb) >= {percent} * greatest(nsa, nsb)"
    links, comp, main = None, None, None
    at = inside.select("bucket", "id", F.col("id").alias("comp"))
    for _ in range(ROUNDS):
        # the pivot of a bucket is the smallest id not in the component of an earlier one
        left = at if main is None else at.join(main.hint("merge"), "bucket").where("comp <> main").select("bucket", "id", "comp")
        pivot = left.groupBy("bucket").agg(F.min_by(F.struct("id", "comp"), "id").alias("p"))
        stars = left.join(pivot.hint("merge"), "bucket").where("comp <> p.comp").select(F.col("id").alias("a"), F.col("p.id").alias("b")).distinct()
        near = stars.join(sketched("a", "sa"), "a").join(sketched("b", "sb"), "b").where(sizes).select("a", "b", apart("sa", "sb").alias("bits"), most.alias("most")).where("bits <= most")
        best = materialize(near.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b")), "near")
        found = confirm(best, sets, percent)
        links = found if links is None else links.union(found)
        comp = components(links)
        at = materialize(inside.join(comp.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp")), "placed")
        parts = at.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        main = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
        main = materialize(main.select("bucket", "main", F.ceil(F.col("n") / BLOCK).alias("blocks")), "main")

    # what is still apart, against the whole bucket
    open_ = at.join(main.hint("merge"), "bucket").join(reps.withColumnRenamed("n_shingles", "n").hint("merge"), "id")
    kind = "bucket long, main long, id long, comp long, n long, samples int, bands array<long>, sketch array<long>"
    near = in_blocks(open_).mapInArrow(lambda it: _near_rows(it, percent), kind)
    near = materialize(near.dropDuplicates(["bucket", "id"]), "again")
    blocks = near.groupBy("bucket").agg(F.ceil(F.sum(F.col("n") * 8 + ROW_BYTES) / SET_BYTES).alias("blocks"))
    whole = near.join(blocks.hint("merge"), "bucket").join(sets.hint("merge"), "id")
    more = materialize(in_blocks(whole, "shingles").mapInArrow(lambda it: _forest(it, percent), "a long, b long"), "links")
    if more.limit(1).count():
        comp = components(links.union(more))
    placed = member.join(comp.select(F.col("id").alias("rep"), "comp").hint("merge"), "rep", "left")
    return placed.select(F.col("id").alias(key), "n_shingles", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
