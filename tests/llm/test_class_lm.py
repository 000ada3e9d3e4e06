import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.brute import SPACE, lower
from tidewater.llm import class_lm
from tidewater.llm.queries import op10_class_lm
from tidewater.session import table


def base(docs):
    toks = {d: [*SPACE.findall(lower(t)), b"\n"] for d, t in docs}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    c = Counter(w for d, ws in toks.items() if not out[d] for w in ws)
    n, v = c.total(), len(c)
    return {d: (out[d], len(ws), sum(c[w] > 0 for w in ws), n, pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))) for d, ws in toks.items()}


def rows(frame):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in frame.collect()}


def test_query_base_and_held_out_gain(spark):
    d = "/root/testdata/sf0.01"
    frame = op10_class_lm(spark, d).cache()
    assert rows(frame) == base([(r.doc_id, r.text) for r in table(spark, d, "documents").collect()])
    s = frame.where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert s.s > s.b


def test_edges_with_few_words_held(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CLUSTERED", 3)
    monkeypatch.setattr(class_lm, "HELD", 4)
    docs = [(0, None), (1, ""), (2, "A b É"), (3, "a a b c d"), (4, "x y z \n "), (5, "long " * 20_000), (6, "new words"), (7, "a b")]
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_tokens int")
    assert rows(class_lm.score_texts(frame)) == base(docs)
    assert class_lm.score_texts(frame.limit(0)).count() == 0


def likelihood(pairs, cls, k):
    """Of the class bigrams: all words but those of ``cls`` are class ``k``."""
    full = [*cls, k]
    grid = Counter()
    for a, row in enumerate(pairs):
        for b, n in enumerate(row):
            grid[full[a], full[b]] += n
    xlx = lambda x: x * math.log(x) if x > 0 else 0.0
    rows, cols = Counter(), Counter()
    for (a, b), n in grid.items():
        rows[a] += n
        cols[b] += n
    return sum(map(xlx, grid.values())) - sum(map(xlx, rows.values())) - sum(map(xlx, cols.values()))


def test_exchange_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(5):
        pairs = rng.poisson(3, (11, 11)).astype(float)
        cls = class_lm.exchange(pairs, 3, rounds=100).tolist()
        best = likelihood(pairs, cls, 3)
        start = likelihood(pairs, [i % 3 for i in range(10)], 3)
        assert best >= start - 1e-9
        for w in range(10):
            for c in range(3):
                assert likelihood(pairs, [*cls[:w], c, *cls[w + 1 :]], 3) <= best + 1e-6


def test_placing_against_brute_force():
    rng = np.random.default_rng(5)
    grid = rng.poisson(4, (6, 4)).astype(float)
    counts = rng.poisson(1, (700, 6))
    counts[counts.sum(1) == 0, 0] = 1
    word, g = np.nonzero(counts)
    got = class_lm.best_class(word, g, counts[word, g].astype(float), grid)
    xlx = lambda x: x * math.log(x) if x > 0 else 0.0
    for w in range(700):
        gains = [sum(xlx(grid[i, c] + counts[w, i]) - xlx(grid[i, c]) for i in range(6)) - xlx(grid[:, c].sum() + counts[w].sum()) + xlx(grid[:, c].sum()) for c in range(4)]
        assert gains[got[w]] == pytest.approx(max(gains))


def test_score_against_the_model_written_out(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CLUSTERED", 6)
    monkeypatch.setattr(class_lm, "HELD", 12)
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{min(int(x), 40)}" for x in rng.geometric(0.12, 30))) for i in range(60)] + [(60, "w1 new words w2"), (61, None), (61, "w3 w3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = frame.where(~class_lm.held_out("doc_id")).select("text")
    m = class_lm.learn(train)
    place = {w: (int(m.cls[i]), int(m.counts[i])) for i, w in enumerate(m.words)} | {bytes(r.word): (r.k, r.c) for r in m.lexicon.collect()}
    held = set(m.words)
    assert len(place) == m.v and sum(c for _, c in place.values()) == m.n and 0 < len(held) < m.v
    move, below, unseen = 10 ** m.move(), m.below(), 10 ** m.unseen()
    context = lambda w: place[w][0] if w in held else m.classes + zlib.crc32(w) % class_lm.RARE
    for g in range(len(move)):
        assert sum(move[g, k] * (c + class_lm.EMIT) / below[k] for k, c in place.values()) + unseen[g] == pytest.approx(1)

    def score(text):
        out, last = 0.0, b"\n"
        for w in class_lm.tokens(text):
            g = context(last)
            out += math.log10(move[g, place[w][0]] * (place[w][1] + class_lm.EMIT) / below[place[w][0]] if w in place else unseen[g])
            last = w
        return out

    got = sorted((r.doc_id, round(r.score, 6)) for r in class_lm.score_texts(frame).collect())
    assert got == sorted((d, round(score(t), 6)) for d, t in docs)
