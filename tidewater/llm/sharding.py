"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring of signed 64-bit hashes.  A key belongs to the arc that ends at
the next point clockwise; if that point's shard is full the key continues clockwise to the next shard with room.

The walk itself needs no row: keys of one arc are interchangeable, so only the *number* of keys per arc takes part.
Spark hashes and orders the rows by arc, the driver walks the arcs (a vector of ``shards x virtual nodes`` counts, however
many rows there are), and the outcome - "ranks lo to hi of this arc go to that shard" - is joined back by arc.  No key,
source or text is ever a grouping key, so repeated rows and hot values cost nothing extra.

Defined results: a null key hashes like any other value; equal keys share an arc and are told apart by an explicit salt;
null text has size 8 and checksum 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.session import materialize, shuffle_width

#: Points a shard owns on the ring.
VIRTUAL_NODES = 128
#: Cells of the lookup table that finds a hash's arc; fixed, independent of the data.
_CELL_BITS = 12


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (point, shard); a shard's points do not depend on how many other shards there are."""

    def point(s: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big", signed=True)

    return sorted((point(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))


def _lookup(points: list[int]) -> list[tuple[int, int, list[int]]]:
    """(cell, points before the cell, points inside it) for each cell of the hash space."""
    width = 1 << (64 - _CELL_BITS)
    out = []
    for cell in range(-(1 << (_CELL_BITS - 1)), 1 << (_CELL_BITS - 1)):
        lo, hi = bisect_left(points, cell * width), bisect_left(points, (cell + 1) * width)
        out.append((cell, lo, points[lo:hi]))
    return out


def with_arc(df: DataFrame, h: Column, points: list[int]) -> DataFrame:
    """Adds ``arc``: index of the first point at or after the hash, clockwise."""
    cells = F.broadcast(df.sparkSession.createDataFrame(_lookup(points), "_cell long, _before int, _inside array<long>"))
    return (
        df.withColumn("_h", h)
        .withColumn("_cell", F.shiftright("_h", 64 - _CELL_BITS))
        .join(cells, "_cell")
        .withColumn("arc", (F.col("_before") + F.size(F.filter("_inside", lambda p: p < F.col("_h")))) % F.lit(len(points)))
        .drop("_cell", "_before", "_inside")
    )


def walk(counts: list[int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """Sends every key clockwise to the first shard with room: (arc, lo, hi, shard, first slot) by rank within the arc.

    First every shard fills up to floor(n / shards); the n mod shards keys left over go on clockwise and each shard takes
    one of them at most, so shard sizes differ by one at most.
    """
    n, size = sum(counts), len(owners)
    placed = [0] * n_shards
    out = []
    waiting = {a: [(a, 0, c)] for a, c in enumerate(counts) if c}
    for limit in (n // n_shards, n // n_shards + 1):
        moving, blocked = waiting, {}
        hops = 0
        while moving and hops <= size:
            nxt: dict[int, list[tuple[int, int, int]]] = {}
            for a in sorted(moving):
                s = owners[a]
                for origin, lo, hi in moving[a]:
                    take = min(limit - placed[s], hi - lo)
                    if take > 0:
                        out.append((origin, lo, lo + take, s, placed[s]))
                        placed[s] += take
                    if lo + max(take, 0) < hi:
                        nxt.setdefault((a + 1) % size, []).append((origin, lo + max(take, 0), hi))
            moving = nxt
            hops += 1
            if all(p >= limit for p in placed):
                blocked = moving
                break
        waiting = blocked
    return out


def shard_rows(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of ``docs``: (key, size, text_crc32, shard, slot); counts per shard differ by one at most.

    ``slot`` numbers a shard's rows from 0 without gaps.
    """
    spark = docs.sparkSession
    marks = ring(n_shards, virtual_nodes)
    body = F.coalesce(F.col(text), F.lit(""))
    small = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc")
    )
    n = shuffle_width(spark)
    order = ["arc", "_h", "key", "crc", "_salt"]
    ordered = (
        with_arc(small, F.xxhash64("key"), [p for p, _ in marks])
        .withColumn("_salt", F.rand(7))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("key", "size", "crc", "arc", F.monotonically_increasing_id().alias("_at"))
    )
    ordered = materialize(ordered, "shard-order").withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    # (partition, arc) counts: at most partitions + arcs rows, as rows are ordered by arc
    tallies = sorted((r["_part"], r["arc"], r["n"], r["lo"]) for r in ordered.groupBy("_part", "arc").agg(F.count("*").alias("n"), F.min("_at").alias("lo")).collect())
    counts = [0] * len(marks)
    shift = []
    for part, arc, rows, lo in tallies:
        shift.append((part, arc, counts[arc] - lo))
        counts[arc] += rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, lo, hi, shard, slot in walk(counts, [s for _, s in marks], n_shards):
        runs.setdefault(arc, []).append((lo, hi, shard, slot))
    plan = [(part, arc, by, runs[arc]) for part, arc, by in shift]
    moves = spark.createDataFrame(plan, "_part long, arc int, _by long, _runs array<struct<lo:long,hi:long,shard:int,slot:long>>")
    rank = F.col("_at") + F.col("_by")
    return (
        ordered.join(F.broadcast(moves), ["_part", "arc"])
        .withColumn("_run", F.filter("_runs", lambda r: (r["lo"] <= rank) & (rank < r["hi"]))[0])
        .select(
            F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("_run.shard").alias("shard"), (F.col("_run.slot") + rank - F.col("_run.lo")).alias("slot")
        )
    )
