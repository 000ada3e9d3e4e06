"""Byte-level BPE as a lazily determinised transducer, and streaming decoding through an incremental UTF-8 machine.

The merges are never replayed on text.  A token sequence is the BPE encoding of a string exactly when each two neighbours
are *compatible* (merging their joined bytes gives the same two back), so the encoding of every prefix is that of a shorter
prefix plus one compatible token.  Reading byte by byte, only the start positions from which some token could still extend
matter; the transducer's state is the bytes since the earliest of them with the tokens that lead to each.  Tokens on which
all these paths agree are emitted at once, so the lookahead is bounded by the longest token.  A transition is determinised
and numbered when it is met a second time, and from then on is one dictionary access; where a piece meets one for the first
time, the paths of its bytes not yet settled are followed one by one.  Whether two tokens are compatible is read off their own
merge trees, by undoing the merges along the boundary from the last one back.

Ids are decoded through an incremental UTF-8 machine, a run of DECODE_IDS at a time.

Defined results: null and empty text encode to no ids; text of any length is streamed through the same machine; a piece
that is itself a token is that token, as in the rank-file format's own encoder; unknown or split UTF-8 decodes to U+FFFD.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import ship

#: Pieces whose ids a worker remembers in each of two generations, and transitions it keeps, before the older go.
MEMO_PIECES = 150_000
MEMO_STEPS = 100_000
#: Meetings at which a transition is determinised.
DETERMINISE_AT = 16
#: Compatible pairs, and transitions not determinised, that a worker keeps.
MEMO_PAIRS = 200_000
DECODE_IDS = 1 << 16
#: Pieces longer than this are not remembered.
MEMO_BYTES = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes one piece of text; ``step`` is the incremental form."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = [0] * (max(ranks.values(), default=0) + 1)
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.child: dict[int, int] = {}  # trie over the tokens: node << 8 | byte -> node
        self.token = [-1]  # the token that ends at a node
        for t, r in ranks.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = r
        self.fits: dict[int, bool] = {}
        self.split: dict[int, tuple[int, ...]] = {}
        self.reset()

    def reset(self) -> None:
        # a state: last emitted token, and per live start (trie node of the bytes since then, tokens to it not yet emitted)
        self.states: list[tuple] = [(-1, ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: dict[int, int] = {}  # how often a transition that is not determinised was met

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, until none is left (of rank ``below``)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            found = [get(a + b, below) for a, b in pairwise(parts)]
            best = min(found)
            if best >= below:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, t: int) -> tuple[int, ...]:
        """The tokens that the last merge of ``t`` joins; none if its merges don't come in the order of their ranks."""
        got = self.split.get(t)
        if got is None:
            parts = self.merged(self.tokens[t], t)
            got = self.split[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else ()
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``; for a piece's first token (a = -1), whether it merges to itself."""
        key = (a + 1) << 32 | b
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            got = self.fits[key] = self._stays(a, b)
        return got

    def _stays(self, a: int, b: int) -> bool:
        y = self.tokens[b]
        if a < 0:
            return len(y) == 1 or bool(self.halves(b)) or self.merged(y) == [y]
        x, limit = self.tokens[a], 1 << 60
        whole = [x, y]
        while True:
            # these two stand side by side until the merge of rank ``limit``
            if self.ranks.get(x + y, limit) < limit:
                return False
            if len(y) > 1 and (b >= a or len(x) == 1):
                parts, limit = self.halves(b), b + 1  # of equal ranks the left pair goes first
                b = parts[0] if parts else -1
            elif len(x) > 1:
                parts, limit = self.halves(a), a
                a = parts[1] if parts else -1
            else:
                return True
            if not parts:
                return self.merged(b"".join(whole)) == whole
            x, y = self.tokens[a], self.tokens[b]

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the ids that this byte settles; determinised when first asked for."""
        key = state << 8 | byte
        done = self.steps.get(key)
        if done is None:
            done = self.steps[key] = self._determinise(*self.states[state], byte)
        return done

    def _determinise(self, last: int, live: tuple, byte: int) -> tuple[int, tuple[int, ...]]:
        reached, still = None, []
        for node, path in live:
            node = self.child.get(node << 8 | byte, 0)
            if node:
                still.append((node, path))
                token = self.token[node]
                if reached is None and token >= 0 and self.compatible(path[-1] if path else last, token):
                    reached = (*path, token)
        still.append((0, reached))
        agreed = len(reached)
        for _, path in still:
            if path[:agreed] != reached[:agreed]:
                agreed = next((i for i, (x, y) in enumerate(zip(path, reached, strict=False)) if x != y), min(len(path), agreed))
        out = reached[:agreed]
        nxt = (out[-1], tuple([(node, p[agreed:]) for node, p in still])) if agreed else (last, tuple(still))
        n = self.number.get(nxt)
        if n is None:
            n = self.number[nxt] = len(self.states)
            self.states.append(nxt)
        return n, out

    def _follow(self, last: int, data: bytes) -> list[int]:
        """The ids of ``data`` after token ``last``, without determinising: the machine's paths, longest token first.

        One compatible path at most leads to a place, so a place whose paths have all ended is not entered again.
        """
        child, ends, known, size, n = self.child.get, self.token, self.fits.get, self.size, len(data)
        path: list[int] = []
        open_: list[tuple[int, list[int]]] = []  # places on the path, with the tokens not tried there
        ended: set[int] = set()
        at, before = 0, last
        while at < n:
            node, fresh = 0, []
            for i in range(at, n):
                node = child(node << 8 | data[i])
                if not node:
                    break
                t = ends[node]
                if t >= 0:
                    fresh.append(t)
            while True:
                if not fresh:
                    ended.add(at)
                    at, fresh = open_.pop()
                    path.pop()
                    before = path[-1] if path else last
                    continue
                t = fresh.pop()
                if ended and at + size[t] in ended:
                    continue
                fits = known((before + 1) << 32 | t)
                if self.compatible(before, t) if fits is None else fits:
                    break
            open_.append((at, fresh))
            path.append(t)
            before = t
            at += size[t]
        return path

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        state, met, get = 0, self.met, self.steps.get
        for byte in piece:
            key = state << 8 | byte
            done = get(key)
            if done is None:
                times = met.get(key, 0) + 1
                if times < DETERMINISE_AT or len(self.steps) > MEMO_STEPS:
                    if times == 1 and len(met) > MEMO_PAIRS:
                        met.clear()
                    met[key] = times
                    if ids:
                        return ids + self._follow(ids[-1], piece[sum([self.size[t] for t in ids]) :])
                    return self._follow(-1, piece)
                done = self.step(state, byte)
            state, out = done
            if out:
                ids += out
        return ids + list(self.states[state][1][-1][1])


class Utf8Machine:
    """Incremental UTF-8: whole characters come out at once, an unfinished one waits for its next bytes."""

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if back >= need or b in (0xC0, 0xC1) or b > 0xF4:
                    return 0
                if back > 1:
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                    if not low <= data[1 - back] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = self.unfinished(data)
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


class Codec:
    """A rank file and its split pattern: whole texts to packed ids (little-endian uint32) and back."""

    def __init__(self, path: str, pattern: str):
        import gc

        import regex

        gc.set_threshold(200_000, 20, 50)  # the tables are large and hold no cycles
        self.ranks = load_ranks(path)
        self.fst = Transducer(self.ranks)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.table[r] = t

    def _ids(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            raw = piece.encode()
            ids = self.fst.encode(raw)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > MEMO_BYTES:
                return out
        if len(self.memo) >= MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        self.memo[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        ids = self._ids
        out = []
        for p in self.split(text):
            out.append(self.memo.get(p) or ids(p))
        return b"".join(out)

    def decoded(self, ids: bytes) -> Iterator[str]:
        """The text of packed ids in pieces of whole characters."""
        machine, token = Utf8Machine(), self.table.__getitem__
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), DECODE_IDS):
            yield machine.feed(b"".join(map(token, every[i : i + DECODE_IDS].tolist())))
        yield machine.finish()

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind packed ids, valid UTF-8 or not."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for i in ids:
            yield machine.feed(self.table[i])
        yield machine.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process, so that what it has determinised serves all its tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _digest(batches: Iterator[pa.RecordBatch], path: str, pattern: str, payload: bool) -> Iterator[pa.RecordBatch]:
    import hashlib

    c = codec(path, pattern)
    for b in batches:
        texts = b.column(b.num_columns - 1)
        n, a, d, ids, decoded = [], [], [], [], []
        for t in texts:
            packed = c.encode(t.as_py() or "")
            digest, parts = hashlib.sha256(), []
            for part in c.decoded(packed):
                digest.update(part.encode())
                if payload:
                    parts.append(part)
            n.append(len(packed) // 4)
            a.append(hashlib.sha256(packed).hexdigest())
            d.append(digest.hexdigest())
            if payload:
                ids.append(packed)
                decoded.append("".join(parts))
        out = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
        if payload:
            out += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(out, [str(i) for i in range(len(out))])


def encode_column(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", payload: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and with ``payload`` the packed ids and the decoded text; one narrow pass.

    Column names of ``docs`` that clash with these are replaced.
    """
    ship(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if payload else [])
    kinds = ["long", "string", "string", "binary", "string"]
    keep = [f for f in docs.schema.fields if f.name not in made]
    schema = docs.select(*[F.col(f"`{f.name}`") for f in keep]).schema
    for name, kind in zip(made, kinds, strict=False):
        schema = schema.add(name, kind)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias("_body"))
    return rows.mapInArrow(lambda b: _digest(b, rank_file, pattern, payload), schema)
