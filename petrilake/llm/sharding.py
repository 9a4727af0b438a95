"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 2^32 positions. A key belongs to the first point clockwise of
its own position; when that point's shard is full, the key goes on clockwise to the next shard that is not.
With ``load_factor=None`` the capacities are the exact quotas (they differ by one row at most and add up to the
number of rows), so that balance is guaranteed; a load factor above 1 leaves slack and moves fewer keys.

The walk depends on a key's arc only, not on the key. So the rows are counted by cell (an arc cut by a grid
of `GRID` ranges: at most shards x vnodes + GRID cells, whatever the input), the flow between full and free
shards is settled on those counts, and each row then finds its shard by its rank within its cell. The one
shuffle carries keys and checksums, never texts, and no cell holds more than about 1/GRID of the keys.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 32
GRID = 4096


def _point(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The ring's (position, shard), in clockwise order."""
    return sorted((_point(f"shard {s} point {v}"), s) for s in range(n_shards) for v in range(vnodes))


def quotas(rows: int, n_shards: int, load_factor: float | None) -> list[int]:
    """Rows that each shard may hold."""
    if load_factor is None:
        return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    return [max(1, -int(-load_factor * rows // n_shards))] * n_shards


def settle(cells: list[tuple[int, int, int]], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, bucket, first rank, last rank, shard, slot of the first rank) for the counted cells.

    Keys of a shard's own arcs come first, in ring order; what overflows then walks clockwise, in ring order.
    """
    free, used, out, over = list(capacity), [0] * len(capacity), [], []
    beyond = list(range(1, len(points) + 1))
    beyond[-1] = 0

    def place(arc: int, bucket: int, start: int, n: int, shard: int) -> None:
        out.append((arc, bucket, start, start + n - 1, shard, used[shard]))
        free[shard] -= n
        used[shard] += n

    for arc, bucket, n in sorted(cells):
        shard = points[arc][1]
        if take := min(n, free[shard]):
            place(arc, bucket, 1, take, shard)
        if take < n:
            over.append((arc, bucket, 1 + take, n - take))
    for arc, bucket, start, left in over:
        at = arc
        while left:
            trail = []
            while not free[points[at][1]]:
                trail.append(at)
                at = beyond[at]
            for t in trail:  # full shards stay full: the next walk skips them
                beyond[t] = at
            shard = points[at][1]
            take = min(left, free[shard])
            place(arc, bucket, start, take, shard)
            start, left = start + take, left - take
    return out


def shard(df: DataFrame, key: str, n_shards: int, vnodes: int = 64, load_factor: float | None = None, order: list[str] | None = None) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 within each shard).

    key: the column that is hashed; null is a key like any other. order: columns that break ties between rows
    of one key. Rows that are equal in key and order are interchangeable. An empty table gives an empty result.
    Columns of df named like the result's or the working columns (`_pos`, `_arc`, ...) are dropped first.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "_pos", "_arc", "_bucket", "_rank", "_first", "_last", "_slot", "_cuts", "_next")
    points = ring_points(n_shards, vnodes)
    tokens = [p for p, _ in points]
    step = SPAN // GRID
    # per grid range: the points inside, and the arc that follows the last of them
    grid = [(b, [(tokens[a], a) for a in range(bisect_left(tokens, b * step), bisect_left(tokens, (b + 1) * step))], bisect_left(tokens, (b + 1) * step) % len(tokens)) for b in range(GRID)]
    arcs = spark.createDataFrame(grid, "_bucket int, _cuts array<struct<token: bigint, arc: int>>, _next int")

    pos = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")
    placed = (
        df.withColumn("_pos", pos)
        .withColumn("_bucket", (F.col("_pos") / F.lit(step)).cast("int"))
        .join(F.broadcast(arcs), "_bucket")  # GRID rows
        .withColumn("_arc", F.coalesce(F.expr("get(filter(_cuts, c -> c.token >= _pos), 0).arc"), F.col("_next")))
        .drop("_cuts", "_next")
    )
    cells = [(r[0], r[1], r[2]) for r in placed.groupBy("_arc", "_bucket").count().collect()]  # bounded by the ring, not by df
    flow = settle(cells, points, quotas(sum(c[2] for c in cells), n_shards, load_factor))
    segments = spark.createDataFrame(flow, "_arc int, _bucket int, _first bigint, _last bigint, shard int, _slot bigint")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_bucket").orderBy("_pos", *(order or [key]))).cast("long"))
    return (
        ranked.join(F.broadcast(segments), ["_arc", "_bucket"])  # at most cells + points rows
        .where("_rank between _first and _last")
        .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_first"))
        .drop("_arc", "_bucket", "_pos", "_rank", "_first", "_last", "_slot")
    )
