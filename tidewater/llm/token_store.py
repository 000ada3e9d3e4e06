"""Token-id output: raw id payload shards, and a minimal perfect hash index with fingerprints for keyed access.

Layout under the store's folder (any filesystem that Arrow opens by URI; all executors must see it)::

    data/shard-<p>-<attempt>.bin   16-byte header, then the ids of all its documents as little-endian integers
    data/shard-<p>-<attempt>.idx   per document: key (int64), null flag (uint8), first id's position (uint64) + the end
    runs/                          Parquet: one row per shard and key - which documents of that shard have the key
    index/                         Parquet: per hash bucket (of the number that each row repeats) the perfect hash, fingerprints and (shard, ordinal, count)

Shards hold documents in ascending key order (nulls first), so shard number and ordinal give the global order.  A task
writes files under its own attempt's name and only reports them in ``runs`` when it succeeds: a retry or a lost executor
leaves an orphan file that nothing refers to.

The perfect hash is built level by level: a level is a bit array with ``GAMMA`` bits a key; keys that land alone on a bit
are settled there, the rest go to the next level; a settled key's number is the rank of its bit.  A lookup is one bit test
per level, then a fingerprint comparison, then the key stored beside the payload, so absent keys are always rejected.

Defined results: null text is the empty text (only the end id); repeated keys share one index entry that spans all their
documents; an empty table gives a store without shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import ship, shuffle_width

MAGIC = b"TWTK"
HEADER = struct.Struct("<4sHHQ")
#: Bits per remaining key at each level of the perfect hash.
GAMMA = 2.0
#: Keys per index bucket; the number of buckets grows with the keys, so that one bucket always fits in a task.
BUCKET_KEYS = 1 << 16
#: Words and parts of words whose ids a worker remembers in each of two generations (about 150 bytes each).
MEMO_WORDS = 400_000
#: A pre-tokenizer under which a word's last letter or digit and the punctuation after it are never in one piece.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that str.split takes for white space and the tokenizers library doesn't.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordMemoEncoder:
    """Encodes with the tokenizers library, remembering the ids of white-space separated words as packed bytes.

    Valid for tokenizers that drop white space before merging, so that no token spans it.
    """

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # ids of the parts that several words share: in lower case, and without the punctuation at the end
        self.parts: dict[str, bytes] = {"": b""}
        self.older_parts: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("normalizer") or {}).get("normalizers") or []
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        known = {n["type"] for n in steps} <= {"NFC", "Replace", "Lowercase"} and all(n["pattern"] == {"Regex": "\\s+"} for n in steps if n["type"] == "Replace")
        self.splits = known and first.get("pattern") == {"Regex": _PIECES} and first.get("behavior") == "Removed" and bool(first.get("invert"))
        self.lowers = any(n["type"] == "Lowercase" for n in steps)
        suffix = made["model"].get("end_of_word_suffix")
        self.lasts = None
        if self.splits and suffix:
            self.lasts = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.lasts[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        #: words with these may hold an added token
        self.marks = "".join({t["content"][0] for t in made["added_tokens"]})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            words = [w for w in _WHITE.split(text) if w] if _NOT_WHITE.search(text) else text.split()
            new = set(words).difference(self.memo)
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
                new = set(words)
            if new and self.older:
                known = self.older.keys() & new
                self.memo.update((w, self.older[w]) for w in known)
                new -= known
            if new:
                self._learn(list(new), any(m in text for m in self.marks))
            yield b"".join(map(self.memo.__getitem__, words)) + self.end

    def _learn(self, new: list[str], marked: bool) -> None:
        """Puts the ids of these words into the memo."""
        cores = new
        if self.splits:
            # cut only after a letter or digit that the pre-tokenizer takes for one too
            cores = [c if (c := w.rstrip(string.punctuation))[-1:].isalnum() and c[-1] < "\u3100" else w for w in new]
            if self.lowers:
                cores = [c.lower() if c.isascii() else c for c in cores]
            if marked:
                cores = [w if any(m in w for m in self.marks) else c for w, c in zip(new, cores, strict=True)]
        tails = [w[len(c) :] for w, c in zip(new, cores, strict=True)]
        asked = {*cores, *tails}
        if len(self.parts) + len(asked) > MEMO_WORDS:
            self.parts, self.older_parts = {"": b""}, self.parts
        parts, fresh = self.parts, asked.difference(self.parts)
        known = self.older_parts.keys() & fresh
        parts.update((p, self.older_parts[p]) for p in known)
        fresh -= known
        # a part of ASCII letters is one piece, so its last token shows where it ends
        letters = [p for p in fresh if p.isascii() and p.isalpha()] if self.lasts is not None else []
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([letters], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            self._keep(letters, ids, np.flatnonzero(self.lasts[ids]) + 1)
        others = list(fresh.difference(letters))
        if others:
            e = self.tokenizer.encode(others, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            self._keep(others, ids, np.bincount(np.array(e.word_ids, np.int64), minlength=len(others)).cumsum() if len(ids) else np.zeros(len(others), np.int64))
        self.memo.update((w, parts[c] + parts[t]) for w, c, t in zip(new, cores, tails, strict=True))

    def _keep(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, lo = ids.tobytes(), 0
        for p, hi in zip(parts, (ends * self.width).tolist(), strict=True):
            self.parts[p] = raw[lo:hi]
            lo = hi


_encoders: dict[tuple[str, int], WordMemoEncoder] = {}


def _encoder(path: str, end_id: int) -> WordMemoEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordMemoEncoder(path, end_id)
    return _encoders[path, end_id]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], out: str, tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    ctx = TaskContext.get()
    shard, name = ctx.partitionId(), f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
    enc = sink = None
    keys, nulls, starts, at = [], [], [0], 0
    for b in batches:
        if not b.num_rows:
            continue
        if sink is None:
            enc = _encoder(tokenizer_path, end_id)
            fs, root = _open(f"{out}/data")
            fs.create_dir(root, recursive=True)
            sink = fs.open_output_stream(f"{root}/{name}.bin")
            sink.write(HEADER.pack(MAGIC, 1, enc.width, 0))
        for key, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
            sink.write(ids)
            at += len(ids) // enc.width
            keys.append(key or 0)
            nulls.append(key is None)
            starts.append(at)
    if sink is None:
        return
    sink.close()
    k, z, s = np.array(keys, "<i8"), np.array(nulls, "u1"), np.array(starts, "<u8")
    with fs.open_output_stream(f"{root}/{name}.idx") as f:
        f.write(k.tobytes() + z.tobytes() + s.tobytes())
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (z[1:] != z[:-1]))))
    count = np.diff(np.append(first, len(k)))
    yield pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(np.full(len(first), shard, np.int32)),
            "file": pa.array([name] * len(first)),
            "n_shard": pa.array(np.full(len(first), len(k), np.int64)),
            "key": pa.array(k[first], mask=z[first].astype(bool)),
            "ordinal": pa.array(first.astype(np.int64)),
            "n_docs": pa.array(count.astype(np.int64)),
            "n_tokens": pa.array((s[first + count] - s[first]).astype(np.int64)),
        }
    )


_RUNS = "shard int, file string, n_shard long, key long, ordinal long, n_docs long, n_tokens long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers: distinct keys stay distinct."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys, with 32-bit fingerprints to reject absent ones."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray):
        self.levels, self.prints = levels, prints
        self.ranks = []
        before = 0
        for bits in levels:
            r = np.cumsum(bits) + before
            self.ranks.append(r)
            before = int(r[-1]) if len(r) else before

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and each key's number."""
        levels, left, seed = [], keys.astype(np.uint64), 1
        while len(left):
            m = max(8, int(GAMMA * len(left)))
            spot = (_mix(left, seed) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(spot, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[spot]]
            seed += 1
        out = cls(levels, np.zeros(len(keys), np.uint32))
        number = out._number(keys)
        out.prints[number] = (_mix(keys, 0) >> np.uint64(32)).astype(np.uint32)
        return out, number

    def _number(self, keys: np.ndarray) -> np.ndarray:
        number, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True), 1):
            spot = (_mix(keys[open_].astype(np.uint64), seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[spot]
            number[open_[hit]] = rank[spot[hit]] - 1
            open_ = open_[~hit]
        return number

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 if it is not in the set (up to a fingerprint's 2^-32)."""
        number = self._number(keys)
        known = number >= 0
        known[known] = self.prints[number[known]] == (_mix(keys[known], 0) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, number, -1)

    def dump(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.prints.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        sizes, at = struct.unpack_from(f"<{n}Q", raw, 4), 4 + 8 * n
        levels = []
        for m in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, "u1", (m + 7) // 8, at), count=m).astype(bool))
            at += (m + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u4", offset=at).copy())


def _bucket(n: int):
    return F.pmod(F.xxhash64("key", F.lit(11)), F.lit(n)).cast("int")


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: keys may run over several shards; a key's first entry points at its consecutive entries."""
    pdf = pdf.sort_values(["key", "shard", "ordinal"], kind="stable")
    keys = pdf["key"].to_numpy(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    mph, number = PerfectHash.build(keys[first].astype(np.uint64))
    spans = np.zeros((len(first), 2), "<u4")
    spans[number, 0], spans[number, 1] = first, np.diff(np.append(first, len(keys)))
    where = np.empty(len(keys), [("shard", "<i4"), ("ordinal", "<i8"), ("n_docs", "<i8")])
    for c in where.dtype.names:
        where[c] = pdf[c].to_numpy()
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "n_keys": [len(first)], "buckets": [int(pdf["buckets"].iloc[0])], "mph": [mph.dump()], "spans": [spans.tobytes()], "entries": [where.tobytes()]})


def write_store(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", n_shards: int | None = None) -> TokenStore:
    """Encodes every text of ``docs`` into the store at URI ``out`` and indexes it."""
    spark = docs.sparkSession
    ship(spark)
    n = n_shards or shuffle_width(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    rows.mapInArrow(lambda b: _write(b, out, tokenizer_path, end_id), _RUNS).write.parquet(f"{out}/runs")
    runs = spark.read.schema(_RUNS).parquet(f"{out}/runs")
    keyed = runs.where("key is not null")
    buckets = max(1, -(-keyed.count() // BUCKET_KEYS))
    (
        keyed.withColumn("bucket", _bucket(buckets)).withColumn("buckets", F.lit(buckets))
        .select("bucket", "buckets", "key", "shard", "ordinal", "n_docs")
        .groupBy("bucket")
        .applyInPandas(_build_bucket, "bucket int, n_keys long, buckets int, mph binary, spans binary, entries binary")
        .write.parquet(f"{out}/index")
    )
    return TokenStore(spark, out)


def _probe(_, keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(index):
        return pd.DataFrame({"key": [], "shard": [], "ordinal": [], "n_docs": []})
    mph = PerfectHash.load(index["mph"].iloc[0])
    spans = np.frombuffer(index["spans"].iloc[0], "<u4").reshape(-1, 2)
    entries = np.frombuffer(index["entries"].iloc[0], [("shard", "<i4"), ("ordinal", "<i8"), ("n_docs", "<i8")])
    k = keys["key"].to_numpy(np.int64)
    number = mph.find(k.astype(np.uint64))
    k, number = k[number >= 0], number[number >= 0]
    first, n = spans[number, 0].astype(np.int64), spans[number, 1].astype(np.int64)
    at = np.repeat(first - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    hit = entries[at]
    return pd.DataFrame({"key": np.repeat(k, n), "shard": hit["shard"], "ordinal": hit["ordinal"], "n_docs": hit["n_docs"]})


def _read_spans(batches: Iterator[pd.DataFrame], out: str, payload: bool) -> Iterator[pd.DataFrame]:
    name, src = None, None
    fs, root = _open(f"{out}/data")
    for b in batches:
        got, held = [], 0
        for file, n, base, key, ordinal, count in zip(b["file"], b["n_shard"], b["base"], b["key"], b["ordinal"], b["n_docs"], strict=True):
            if file != name:
                if src is not None:
                    src.close()
                with fs.open_input_stream(f"{root}/{file}.idx") as f:
                    raw = f.read()
                keys, nulls, starts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u8", n + 1, 9 * n)
                src, name = fs.open_input_file(f"{root}/{file}.bin"), file
                magic, _, width, _ = HEADER.unpack(src.read(HEADER.size))
                if magic != MAGIC:
                    raise ValueError(f"{file}.bin is not a token shard")
            null = key is None or key != key
            for i in range(ordinal, ordinal + count):
                if bool(nulls[i]) != null or (not null and keys[i] != key):
                    continue
                lo, hi = int(starts[i]), int(starts[i + 1])
                src.seek(HEADER.size + lo * width)
                ids = np.frombuffer(src.read((hi - lo) * width), f"<u{width}").astype("<u4").tobytes()
                got.append((None if null else int(key), base + lo, hi - lo, zlib.crc32(ids), ids if payload else None))
                held += len(ids) if payload else 0
                if held > 1 << 24 or len(got) >= 4096:
                    yield _frame(got)
                    got, held = [], 0
        yield _frame(got)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    k, s, n, c, ids = zip(*rows, strict=True) if rows else ([],) * 5
    return pd.DataFrame({"key": pd.array(k, "Int64"), "start": np.array(s, np.int64), "n_tokens": np.array(n, np.int64), "ids_crc32": np.array(c, np.int64), "ids": pd.Series(ids, dtype=object)})


class TokenStore:
    """A written store: keyed and whole reads, both returning DataFrames (key, start, n_tokens, ids_crc32, ids)."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path
        self.runs = spark.read.schema(_RUNS).parquet(f"{path}/runs")

    def shards(self) -> DataFrame:
        """One row per shard: its file, documents and ids before it; as many rows as shards."""
        rows = sorted(self.runs.groupBy("shard", "file", "n_shard").agg(F.sum("n_tokens").alias("t")).collect())
        base, out = 0, []
        for r in rows:
            out.append((r["shard"], r["file"], r["n_shard"], base))
            base += r["t"]
        return self.spark.createDataFrame(out, "shard int, file string, n_shard long, base long")

    def lookup(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, shard, ordinal, n_docs) of each distinct non-null key that the store holds, through the perfect hash."""
        index = self.spark.read.parquet(f"{self.path}/index")
        row = index.select("buckets").first()
        n = row["buckets"] if row else 1
        asked = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct().withColumn("bucket", _bucket(n))
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_probe, "key long, shard int, ordinal long, n_docs long")

    def _read(self, spans: DataFrame, payload: bool) -> DataFrame:
        path = self.path
        return (
            spans.join(F.broadcast(self.shards()), "shard")
            .repartition(shuffle_width(self.spark), "shard")
            .sortWithinPartitions("shard", "ordinal")
            .select("file", "n_shard", "base", "key", "ordinal", "n_docs")
            .mapInPandas(lambda b: _read_spans(b, path, payload), "key long, start long, n_tokens long, ids_crc32 long, ids binary")
        )

    def get(self, keys: DataFrame, key: str = "doc_id", payload: bool = True) -> DataFrame:
        """The documents of these keys."""
        return self._read(self.lookup(keys, key), payload)

    def read_all(self, payload: bool = True) -> DataFrame:
        """Every document: keyed ones through the index, those with a null key through the run table."""
        found = self.lookup(self.runs.select("key"), "key")
        nulls = self.runs.where("key is null").select("key", "shard", "ordinal", "n_docs")
        return self._read(found.unionByName(nulls), payload)
