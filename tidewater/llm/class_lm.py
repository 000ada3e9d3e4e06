"""Brown class-based bigram model: P(text) is the product of class transitions and word emissions.

Every training word gets its class by exchange, the move that most raises the likelihood of the class bigrams:

1. ``exchange`` moves each of the CLUSTERED most frequent words, one after the other, until little moves;
2. the HELD most frequent words move against that grid, from their counts after each context (a Spark aggregation);
3. all other words, as many as the corpus has, do the same in the tasks of a DataFrame keyed by word.

A word's context is the class of the word before it; words that are not among the HELD share RARE contexts by their hash, so
that a task knows the context without looking the word up.  A word that training has not seen has the sum over all classes of
their share for unseen words.  For each context the probabilities of all words and of an unseen one add up to one.

The HELD words' counts travel with the tasks (a fixed bound); all other words of a document are joined with the lexicon, so
the vocabulary grows with the corpus.

Defined results: null, empty or wordless text is the end token alone; rows repeat if ids repeat; without training rows
N = V = 0 and every token has probability 1 in both scores; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize, ship

CLUSTERED, CLASSES, RARE, HELD = 800, 40, 8, 60_000
ROUNDS = 4
#: Added to transition counts and to emission counts.
MOVE, EMIT = 0.1, 0.5
END = b"\n"  # no word holds it
DICT_WORDS = 200_000


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _xlx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for b in batches:
        for t in b.column(0):
            seen.update(tokens(t.as_py()))
            if len(seen) > DICT_WORDS:
                yield out()
                seen.clear()
    yield out()


class Reader:
    """Numbers the words of a text: a held word's place in ``words``, or -1 less its hash among the RARE."""

    def __init__(self, words: list[bytes]):
        self.place = {w: i for i, w in enumerate(words)}

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.place.get
        return np.array([i if (i := get(w)) is not None else -1 - zlib.crc32(w) % RARE for w in words], np.int64)


def contexts(codes: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """The context that each word gives the next one: its class, or one of the RARE from ``classes`` on."""
    # words past the end of ``cls`` have no class yet
    known = (codes >= 0) & (codes < len(cls))
    return np.where(known, cls[np.where(known, codes, 0)], classes + np.where(codes < 0, -1 - codes, codes % RARE))


def _cells(total: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part // width), pa.array(part % width), pa.array(total[part])], ["a", "b", "n"])


def _core_pairs(batches: Iterator[pa.RecordBatch], reader: Reader, core: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours by place; all words but the core are ``core``."""
    width = core + 1
    total = np.zeros(width * width, np.int64)
    for b in batches:
        for t in b.column(0):
            seq = reader.codes([END, *tokens(t.as_py())])
            seq[(seq < 0) | (seq > core)] = core
            at, n = np.unique(seq[:-1] * width + seq[1:], return_counts=True)
            total[at] += n
    yield from _cells(total, width)


def _held_contexts(batches: Iterator[pa.RecordBatch], reader: Reader, cls: np.ndarray, classes: int, held: int) -> Iterator[pa.RecordBatch]:
    """Counts (held word, context); words that aren't held are place ``held``."""
    width = classes + RARE
    total = np.zeros((held + 1) * width, np.int64)
    for b in batches:
        for t in b.column(0):
            seq = reader.codes([END, *tokens(t.as_py())])
            at, n = np.unique(np.where(seq[1:] < 0, held, seq[1:]) * width + contexts(seq[:-1], cls, classes), return_counts=True)
            total[at] += n
    yield from _cells(total[: held * width], width)


def _other_contexts(batches: Iterator[pa.RecordBatch], reader: Reader, cls: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """Counts (word, context) of the words that aren't held."""
    seen: Counter[tuple[bytes, int]] = Counter()

    def out():
        words, at = zip(*seen, strict=True) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(at, pa.int8()), pa.array(list(seen.values()), pa.int64())], ["word", "g", "n"])

    for b in batches:
        for t in b.column(0):
            words = tokens(t.as_py())
            seq = reader.codes([END, *words])
            other = np.flatnonzero(seq[1:] < 0)
            seen.update(zip([words[i] for i in other.tolist()], contexts(seq[other], cls, classes).tolist(), strict=True))
            if len(seen) > DICT_WORDS:
                yield out()
                seen.clear()
    yield out()


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word; ``pairs`` holds bigram counts, its last row and column those of all other words, a class of its own."""
    n = len(pairs) - 1
    k = min(classes, max(1, n))
    cls = np.append(np.arange(n) % k, k)
    hot = np.eye(k + 1)[cls]
    grid = hot.T @ pairs @ hot
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            old = cls[w]
            to, fro, own = pairs[w] @ hot, pairs[:, w] @ hot, pairs[w, w]
            to[old] -= own
            fro[old] -= own
            base = grid.copy()
            base[old] -= to
            base[:, old] -= fro
            base[old, old] -= own
            # the margins without w; what leads to w and from it is counted there whatever its class
            rows, cols = base.sum(1) + fro, base.sum(0) + to
            out_w, in_w = to.sum() + own, fro.sum() + own
            # gain of putting w into each class c: changed cells of the grid less those of the margins
            gain = (_xlx(base + to[None, :]) - _xlx(base)).sum(1) + (_xlx(base + fro[:, None]) - _xlx(base)).sum(0)
            d = np.diag(base)
            gain += _xlx(d + to + fro + own) - _xlx(d + to) - _xlx(d + fro) + _xlx(d)
            gain -= _xlx(rows + out_w) - _xlx(rows) + _xlx(cols + in_w) - _xlx(cols)
            new = int(np.argmax(gain[:k]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            base[new] += to
            base[:, new] += fro
            base[new, new] += own
            grid = base
            if new != old:
                hot[w, old], hot[w, new], cls[w] = 0.0, 1.0, new
                moved += 1
        if not moved:
            break
    return cls[:n]


def best_class(word: np.ndarray, g: np.ndarray, n: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For words 0, 1, ... whose counts after contexts ``g`` are ``n`` (by word, each with one at least), the class in which
    they raise the likelihood most: grid[g, c] counts the words of class c after g, those to be placed not among them."""
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    ends, mass, out = np.append(first[1:], len(word)), grid.sum(0), []
    for at in range(0, len(first), 512):  # a bounded part of the table at a time
        lo, hi = first[at], ends[min(at + 512, len(first)) - 1]
        base, some = grid[g[lo:hi]], n[lo:hi]
        cells = np.add.reduceat(_xlx(base + some[:, None]) - _xlx(base), first[at : at + 512] - lo, axis=0)
        total = np.add.reduceat(some, first[at : at + 512] - lo)[:, None]
        out.append(np.argmax(cells - (_xlx(mass + total) - _xlx(mass)), axis=1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _place(batches: Iterator[pa.RecordBatch], grid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word, c, at (list of contexts), n (list of counts) -> word, c, k and the grid's new cells of each batch by a null word."""
    for b in batches:
        if not b.num_rows:
            continue
        at, n = b.column(2), b.column(3)
        size = at.value_lengths().to_numpy(zero_copy_only=False)
        k = best_class(np.repeat(np.arange(b.num_rows), size), at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float), grid)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k, pa.int32()), at, n], ["word", "c", "k", "at", "n"])


@dataclass
class Model:
    """``words`` are the held ones; ``lexicon`` has (word, c, k) of all others."""

    words: list[bytes]
    counts: np.ndarray
    cls: np.ndarray
    grid: np.ndarray
    class_words: np.ndarray
    lexicon: DataFrame
    n: int
    v: int

    @property
    def classes(self) -> int:
        return self.grid.shape[1]

    def move(self) -> np.ndarray:
        """log10 P(class | context)."""
        return np.log10((self.grid + MOVE) / (self.grid.sum(1, keepdims=True) + MOVE * self.classes))

    def below(self) -> np.ndarray:
        """The denominator of a class's emissions; an unseen word takes the place of one more."""
        return self.grid.sum(0) + EMIT * (self.class_words + 1)

    def unseen(self) -> np.ndarray:
        """log10 P(unseen word | context)."""
        return np.log10((10 ** self.move()) @ (EMIT / self.below()))


def held_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the least count (of a fixed scale) that at most ``most`` words reach, by count, then word."""
    step = F.floor(F.log2("c") * 16)
    sizes = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    taken, least = 0, None
    for s, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, s
    if least is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def learn(train: DataFrame) -> Model:
    """The model of the texts in the first column of ``train``."""
    counts = materialize(train.mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = held_words(counts, HELD)
    words, c = [w for w, _ in top], np.array([x for _, x in top], np.int64)
    spark = train.sparkSession
    reader = spark.sparkContext.broadcast(Reader(words))
    core = min(CLUSTERED, len(words))

    def cells(rows: DataFrame, high: int, wide: int) -> np.ndarray:
        """A grid of a fixed size, summed by Spark; its cells come as a few packed rows."""
        flat = rows.groupBy((F.col("a") * wide + F.col("b")).alias("at")).agg(F.sum("n").alias("n"))
        packed = flat.groupBy(F.pmod("at", F.lit(64)).alias("part")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
        out = np.zeros(high * wide)
        for r in packed.toLocalIterator():
            out[np.array(r["at"], np.int64)] = np.array(r["n"], float)
        return out.reshape(high, wide)

    shape = "a long, b long, n long"
    first = exchange(cells(train.mapInArrow(lambda it: _core_pairs(it, reader.value, core), shape), core + 1, core + 1), CLASSES)
    classes = int(first.max(initial=0)) + 1
    width = classes + RARE

    size = len(words)
    if size:
        seen = cells(train.mapInArrow(lambda it: _held_contexts(it, reader.value, first, classes, size), shape), size, width)
        hot = np.eye(classes)
        grid = seen[:core].T @ hot[first]
        cls = np.concatenate([first, np.zeros(size - core, np.int64)])
        if size > core:
            word, g = np.nonzero(seen[core:])
            cls[core:] = best_class(word, g, seen[core:][word, g], grid)
        # the held words have their classes now, so contexts are theirs from here on
        again = cells(train.mapInArrow(lambda it: _held_contexts(it, reader.value, cls, classes, size), shape), size, width)
        grid = again.T @ hot[cls]
    else:
        cls, grid = np.zeros(0, np.int64), np.zeros((width, classes))
    class_words = np.bincount(cls, minlength=classes).astype(float)

    each = (
        train.mapInArrow(lambda it: _other_contexts(it, reader.value, cls, classes), "word binary, g tinyint, n long")
        .repartition("word")
        .groupBy("word", "g").agg(F.sum("n").alias("n"))
        .groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("g").alias("at"), F.collect_list("n").alias("n"))
    )
    placed = materialize(each.mapInArrow(lambda it: _place(it, grid), "word binary, c long, k int, at array<tinyint>, n array<long>"), "lexicon")
    lexicon = placed.select("word", "c", "k")
    for r in lexicon.groupBy("k").agg(F.count("*").alias("n")).collect():
        class_words[r.k] += r.n
    more = placed.select("k", F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at", "k").agg(F.sum("x.n").alias("n"))
    for r in more.collect():
        grid[r["at"], r.k] += r.n
    return Model(words, c, cls, grid, class_words, lexicon, int(n), int(v))


def _score(batches: Iterator[pa.RecordBatch], reader: Reader, model: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Sums over the words held here; the other words of each text by context, with their numbers."""
    cls, base, emit, move = model
    classes = move.shape[1]
    kind = pa.list_(pa.struct([("word", pa.binary()), ("g", pa.int8()), ("n", pa.int64())]))
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for t in b.column(1):
            words = tokens(t.as_py())
            seq = reader.codes([END, *words])
            g, here = contexts(seq[:-1], cls, classes), seq[1:]
            known = here >= 0
            w, gk = here[known], g[known]
            other = np.flatnonzero(~known)
            rest = Counter(zip([words[i] for i in other.tolist()], g[other].tolist(), strict=True))
            row = (len(words), len(w), float(base[w].sum()), float(emit[w].sum() + move[gk, cls[w]].sum()), [{"word": x, "g": y, "n": n} for (x, y), n in rest.items()])
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "n_tokens", "known", "base", "model", "rest"])


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    m = learn(src.where(~held_out("id")).select("body"))
    move, unseen, below = m.move(), m.unseen(), m.below()
    if not m.n:  # nothing learnt: every token has probability 1
        move, unseen = np.zeros_like(move), np.zeros_like(unseen)
    emit = np.log10((m.counts + EMIT) / below[m.cls]) if len(m.words) else np.zeros(0)
    shared = spark.sparkContext.broadcast((Reader(m.words), (m.cls, np.log10((m.counts + 1) / (m.n + m.v + 1)), emit, move)))
    part = materialize(
        src.mapInArrow(lambda it: _score(it, *shared.value), "id long, n_tokens long, known long, base double, model double, rest array<struct<word:binary,g:tinyint,n:long>>").withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    words = part.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.g", "x.n")
    cell = lambda values, at: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (at + 1).cast("int"))
    lexicon = m.lexicon.select("word", "c", "k", F.log10((F.col("c") + EMIT) / cell(below, F.col("k"))).alias("e"))
    c = F.coalesce("c", F.lit(0))
    share = F.coalesce(cell(move.ravel(), F.col("g") * F.lit(m.classes) + F.col("k")) + F.col("e"), cell(unseen, F.col("g")))
    rest = (
        words.join(lexicon, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"),
            F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(m.n + m.v + 1)))).alias("b"),
            F.sum(F.col("n") * share).alias("m"),
        )
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = part.join(rest, "row", "left").select(
        F.col("id").alias(key), held_out("id").alias("held_out"), "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"),
        F.lit(m.n).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("model") + zero("m")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
