"""N-gram Jaccard join in the metric space of shingle sets: pivots, regions, triangle-inequality windows.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric, but text sets that share nothing all stand at distance 1 from each other
and from any pivot, so that Voronoi cells of whole documents would leave nearly everything in everyone's boundary. Regions are therefore
cut where the distance can be small: two sets with similarity t share one of their first |x| - ceil(t |x|) + 1 shingles in any common
order, so each such shingle is a region, and a set is replicated into the regions of its first shingles. The order puts frequent
shingles last (by the power of two of their document count, then by hash), so that passages that many documents share make no region.

1. Equal sets become one class.
2. Each region's smallest class is its pivot. Parity sketches bound the distance of every member to the pivot from below (buckets
   whose parities differ each hold an element of one set alone), and where the bound leaves a link possible, the distance is computed from the
   sets. Members within 1 - t of a pivot are linked; a group of near copies is thereby joined with its pivot in one step, without its pairs. Regions of very frequent
   shingles are dealt into cells with a pivot each, and the cells' pivots meet in a region of their own.
3. The region is settled when its members are one component. Otherwise it is joined again: members outside its largest component meet
   the others, and only in the window |d(x, p) - d(y, p)| <= 1 - t that the triangle inequality leaves. What remains is bounded and verified likewise.

So every link between different sets joins its component; pairs inside one component need no check. Counts decide the order only,
so any count gives the exact result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrilake.llm.common import LOWER_BYTES, python_workers, written

#: Shingles of at least so many documents are ordered by their count; at most so many are sent to the tasks (the least count is doubled
#: until they are fewer). Regions of more documents than CELL are dealt into cells.
FREQUENT = 4
MOST_FREQUENT = 1 << 20
CELL = 4096
#: Orders in which the members of a region meet their neighbours.
ORDERS = 16
#: Buckets of the parity sketches, a power of two.
BUCKETS = 1024
HALF = BUCKETS // 128
#: Bytes of texts that are cut into words at a time.
TEXTS = 1 << 16
#: Shingles that a task counts at a time.
BLOCK = 1_000_000
#: Rows up to which a list of ids is broadcast.
BROADCAST_IDS = 1 << 20
#: Fixed odd factors that tell the words of a shingle apart.
_FACTORS = [int.from_bytes(xxhash.xxh3_64_digest(f"word {i}".encode()), "big") | 1 for i in range(64)]


#: A random number for each byte at each of a word's first places.
_PLACES = 32
_LETTERS = np.frombuffer(hashlib.shake_128(b"letters").digest(_PLACES * 256 * 8), np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the text begins, and its 64-bit hash: the sum of its bytes' random numbers, and xxhash's where it is longer than _PLACES."""
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(text):
        to = len(text)
        if at + TEXTS < to and (found := _SPACE.search(text, at + TEXTS)):
            to = found.end()
        raw = np.frombuffer(text, np.uint8, to - at, at)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, length = edges[::2], edges[1::2] - edges[::2]
        if len(start):
            first = np.cumsum(length) - length
            place = np.minimum(np.arange(first[-1] + length[-1]) - np.repeat(first, length), _PLACES - 1)
            h = np.add.reduceat(_LETTERS[(place << 8) | raw[inside]], first)
            for i in np.flatnonzero(length > _PLACES):
                h[i] = xxhash.xxh3_64_intdigest(text[at + start[i] : at + start[i] + length[i]])
            starts.append(start + at)
            hashes.append(h)
        at = to
    return np.concatenate(starts), np.concatenate(hashes)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` words, in their order."""
    out = np.full(max(len(h) - size + 1, 0), size, np.uint64)
    for i in range(size):
        out += h[i : len(out) + i] * np.uint64(_FACTORS[i % 64])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by the plain sort, which is faster."""
    x = np.sort(x)
    on = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=on[1:])
    return x[on]


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; of fewer words the whole sequence; of none nothing."""

    def cut(held: list[bytes]) -> Iterator[np.ndarray]:
        start, h = word_hashes(b" ".join(held).translate(LOWER_BYTES))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in held])).tolist()
        runs = _shingles(h, k)
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            yield _distinct(runs[lo : hi - k + 1]) if hi - lo >= k else _shingles(h[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64)

    held, size = [], 0
    for t in texts:
        held.append((t or "").encode())
        size += len(held[-1])
        if size > TEXTS:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """`shingle_sets` of one text."""
    return next(shingle_sets([text], k))


def _signature(s: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """For each of BUCKETS buckets whether it holds an odd number of the set's elements, as bits of 64-bit numbers."""
    odd = np.bincount((s >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles two sets of that similarity share one of."""
    return n - -(-n * percent // 100) + 1


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles, and the power of two of each one's count.

    All shingles of every set are counted. To spare the shuffle, of those behind the first three tenths of their sets a task hands on only
    what it has met twice, so that their counts are too low by one a task's block at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, behind, size = [], [], 0

        def counted() -> pa.RecordBatch:
            first = np.sort(np.concatenate(held))
            s = np.sort(np.concatenate([first, *behind]))
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
            s, n = s[at], np.diff(at, append=len(s))
            on = n > 1
            if len(first):
                once = s[~on]
                on[~on] = first[np.minimum(np.searchsorted(first, once), len(first) - 1)] == once
            s, n = s[on], n[on]
            return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["shingle", "n"])

        for b in batches:
            for s in shingle_sets(b.column(1).to_pylist(), k):
                held.append(s[: len(s) * 3 // 10 + 1])
                behind.append(s[len(s) * 3 // 10 + 1 :])
                size += len(s)
                if size > BLOCK:
                    yield counted()
                    held, behind, size = [], [], 0
        if held:
            yield counted()

    counts = docs.mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts, least = written(counts, "frequent"), FREQUENT
    while counts.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = counts.where(F.col("n") >= least).toArrow()
    s, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(s)
    return s[by], np.log2(n[by]).astype(np.int8)


PLACED = "doc_id long, sketch array<long>, n long, a long, b long, shingle long, cell int, pos int"


def placed(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Two kinds of rows: doc_id, sketch, n, a, b of each row of docs; and n, a, b, shingle, cell, pos of each different set in the regions
    of its first shingles. n is the set's size, (a, b) its 128-bit signature, pos a shingle's place in the set's order. Cells of dealt regions count from 1."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    cell_bits = CELL.bit_length() - 1
    schema = pa.schema([("doc_id", pa.int64()), ("sketch", pa.list_(pa.int64())), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("shingle", pa.int64()), ("cell", pa.int32()), ("pos", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, power = shared.value

        def levels(s: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            return np.where(often[at] == s, power[at], 0)

        seen: set[tuple[int, int]] = set()  # spares repeated copies; forgetting some is harmless
        for batch in batches:
            sizes, sigs, sketches = [], [], []
            shingles, cells, owner, lengths = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                sig = _signature(s)
                sizes.append(len(s))
                sigs.append(sig)
                sketches.append(parity_sketch(s))
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                if len(seen) > 100_000:
                    seen.clear()
                p = prefix_length(len(s), percent)
                cell = np.zeros(p, np.int64)
                if len(often):
                    level = levels(s[: 2 * p])
                    if np.count_nonzero(level == 0) < p:  # else the first p of them are the first of all
                        level = levels(s)
                    first = np.argsort(level, kind="stable")[:p]  # s is sorted: by level, then by hash
                    s, level = s[first], level[first].astype(np.int64)
                    if level[-1] > cell_bits:
                        cell = np.where(level > cell_bits, (sig[0] & 0x7FFFFFFF) % np.left_shift(1, np.maximum(level - cell_bits, 0)) + 1, 0)
                shingles.append(s[:p])
                cells.append(cell)
                owner.append(len(sizes) - 1)
                lengths.append(p)
            n = np.array(sizes, np.int64)
            a, b = (np.array([x[i] for x in sigs], np.int64) for i in (0, 1))
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.list_(pa.int64())), pa.array(n), pa.array(a), pa.array(b), pa.nulls(len(sizes), pa.int64()), none, none], schema=schema)
            who = np.repeat(np.array(owner, np.int64), lengths)
            pos = np.concatenate([np.empty(0, np.int32), *[np.arange(p, dtype=np.int32) for p in lengths]])
            rows = len(who)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64())), pa.array(n[who]), pa.array(a[who]), pa.array(b[who]), pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(pos)],
                schema=schema,
            )

    return docs.mapInArrow(work, PLACED)


def members(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """(shingle, cell, doc, n, pos, pivot, pivot_n, pivot_pos, near, near_n, near_pos) of the cells with two classes at least, and of all
    cells of a dealt region: a class alone in its cell is the cell's pivot and meets the others there.

    doc, pivot and near are the classes' smallest ids; near is a member's neighbour in one of ORDERS orders, which the region picks.
    """
    by = Window.partitionBy("shingle", "cell").orderBy("a", "b")
    run = regions.select("shingle", "cell", "a", "b", "n", "pos").select("*", F.lag("a").over(by).alias("a0"), F.lag("b").over(by).alias("b0")).where("not (a0 <=> a and b0 <=> b)").drop("a0", "b0")
    first = [F.first(c).over(by).alias(name) for c, name in (("a", "pa"), ("b", "pb"), ("n", "pivot_n"), ("pos", "pivot_pos"))]
    run = run.select("*", *first, F.row_number().over(by).alias("i"), F.lead("a").over(by).isNotNull().alias("more"))
    several = run.where("i > 1 or more or cell > 0").drop("i", "more")
    mixed = Window.partitionBy("shingle", "cell").orderBy(F.xxhash64(F.pmod(F.col("shingle"), F.lit(ORDERS)), "a", "b"), "a", "b")
    several = several.select("*", *[F.lag(c).over(mixed).alias(name) for c, name in (("a", "na"), ("b", "nb"), ("n", "near_n"), ("pos", "near_pos"))])
    own, pivots, nears = (classes.select(F.col("a").alias(a), F.col("b").alias(b), F.col("doc").alias(d)) for a, b, d in (("a", "b", "doc"), ("pa", "pb", "pivot"), ("na", "nb", "near")))
    return several.join(own, ["a", "b"]).join(pivots, ["pa", "pb"]).join(nears, ["na", "nb"], "left").select("shingle", "cell", "doc", "n", "pos", "pivot", "pivot_n", "pivot_pos", "near", "near_n", "near_pos")


def may_link(percent: int, nx: Column, ny: Column, px: Column, py: Column) -> Column:
    """Whether two sets can be alike enough if a shingle at places px and py of their orders is the first that they share."""
    return (F.least(nx - px, ny - py) * (100 + percent) >= percent * (nx + ny)) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(x, y, nx, ny, apart) of pairs of ids: the sets' sizes and a lower bound of the elements that only one of them has."""
    left = pairs.join(sketches.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), "x")
    both = left.join(sketches.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy")), "y")
    return both.select("x", "y", "nx", "ny", F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, c: a + c).cast("long").alias("apart"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, inter, nx, ny) of pairs of ids, from the sets themselves."""
    left = pairs.select("x", "y").join(sets.select(F.col("doc").alias("x"), F.col("set").alias("sx")), "x")
    both = left.join(sets.select(F.col("doc").alias("y"), F.col("set").alias("sy")), "y")
    return both.select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("inter"), F.size("sx").cast("long").alias("nx"), F.size("sy").cast("long").alias("ny"))


def sets_of(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(doc, set) of the ids in pairs(x, y)."""
    ids = written(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc", "set"])

    return written(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(work, "doc long, set array<long>"), "sets")


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of the ids in edges(x, y): the smallest id that each one reaches.

    Smallest labels of neighbours, then the label's own label; a few rounds, each written to the shared folder.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("doc")).agg(F.least(F.min("y"), F.col("doc")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("y"), "component"), "y").groupBy(F.col("x").alias("doc")).agg(F.min("component").alias("near"))
        new = labels.join(near, "doc").select("doc", "component", F.least("component", "near").alias("via"))
        jumped = new.join(labels.select(F.col("doc").alias("via"), F.col("component").alias("far")), "via").select("doc", F.least("via", "far").alias("component"), (F.least("via", "far") < F.col("component")).alias("moved"))
        jumped = written(jumped, "labels")
        labels = jumped.select("doc", "component")
        if not jumped.where("moved").limit(1).count():
            return labels


def join_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row of docs(doc_id, text).

    Two sets are linked when 100 |x & y| >= percent |x | y|. Null and empty texts have empty sets, linked with nothing: they are their own
    component. Rows of one doc_id are one document, linked by any of its sets. A null doc_id joins no component but one it shares
    equal sets with. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    spark = docs.sparkSession
    python_workers(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = written(placed(docs, k, percent, frequent_shingles(docs, k)), "placed")
    signed = rows.where("shingle is null").select("doc_id", "n", "a", "b", "sketch")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("doc")), "classes")
    inside = written(members(rows.where("shingle is not null"), classes), "members")
    sketches = signed.select(F.col("doc_id").alias("doc"), "n", "sketch").where("n > 0")
    linked = F.col("inter") * 100 >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("inter"))
    possible = (F.col("apart") * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    within = 1 - percent / 100

    star = inside.where(may_link(percent, F.col("n"), F.col("pivot_n"), F.col("pos"), F.col("pivot_pos")) & (F.col("doc") != F.col("pivot"))).select(F.col("doc").alias("x"), F.col("pivot").alias("y"))
    beside = inside.where(F.col("near").isNotNull() & may_link(percent, F.col("n"), F.col("near_n"), F.col("pos"), F.col("near_pos")) & (F.col("doc") != F.col("near")))
    star = star.unionByName(beside.select(F.least("doc", "near").alias("x"), F.greatest("doc", "near").alias("y")))
    dealt = inside.where("cell > 0").select("shingle").distinct()
    heads = inside.join(dealt, "shingle", "left_semi").select("shingle", "pivot").distinct()  # cells' pivots
    heads = heads.join(heads.groupBy("shingle").agg(F.min("pivot").alias("head")), "shingle").where("pivot != head").select(F.col("pivot").alias("x"), F.col("head").alias("y"))
    near = written(bounded(star.unionByName(heads).distinct(), sketches), "near")
    close = near.where(possible)
    exact = written(verified(close, sets_of(docs, close, k)), "exact")
    edges = exact.where(linked).select("x", "y")
    found = components(edges)

    bound = near.select("x", "y", (2 * F.col("apart") / (F.col("nx") + F.col("ny") + F.col("apart"))).alias("low"))
    true = exact.select("x", "y", (1 - F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))).alias("d"))
    reach = bound.join(true, ["x", "y"], "left").groupBy(F.col("x").alias("doc"), F.col("y").alias("pivot")).agg(F.min(F.coalesce("d", "low")).alias("low"), F.max(F.coalesce("d", F.lit(1.0))).alias("high"))
    known = inside.join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = known.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("shingle")
    rows = known.join(open_, "shingle", "left_semi").join(reach, ["doc", "pivot"], "left")
    same = F.col("doc") == F.col("pivot")
    rows = written(rows.drop("near", "near_n", "near_pos").withColumn("low", F.when(same, 0.0).otherwise(F.coalesce("low", F.lit(0.0)))).withColumn("high", F.when(same, 0.0).otherwise(F.coalesce("high", F.lit(1.0)))), "open")
    folded = [(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch", F.lit(i + HALF)))).alias(f"s{i}") for i in range(HALF)]  # parities of half as many buckets
    rows = rows.join(sketches.select("doc", *folded), "doc")
    sizes = rows.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    side = lambda x: [F.col(a).alias(b + x) for a, b in (("component", "c"), ("n", "n"), ("pos", "i"), ("pivot", "p"), ("low", "l"), ("high", "h"), *((f"s{i}", f"s{i}") for i in range(HALF)))]
    rest = written(rows.join(largest, "shingle").where("component != largest").select("shingle", "cell", F.col("doc").alias("x"), *side("x"), "largest"), "rest")
    other = rows.select(F.col("shingle").alias("other"), F.col("cell").alias("cell_y"), F.col("doc").alias("y"), *side("y"))
    met = lambda df: F.broadcast(df.where("cell > 0").groupBy("shingle").agg(F.collect_set("cell").alias("met")))  # noqa: E731  # only regions dealt into cells
    rest = rest.join(met(rows), "shingle", "left").withColumn("cell_y", F.explode(F.coalesce("met", F.array("cell")))).drop("met")  # the cells' pairs meet one by one
    other = other.join(met(rest).withColumnRenamed("shingle", "other"), "other", "left").withColumn("cell_x", F.explode(F.coalesce("met", F.array("cell_y")))).drop("met")
    apart = (F.col("px") == F.col("py")) & ((F.col("lx") - F.col("hy") > within + 1e-9) | (F.col("ly") - F.col("hx") > within + 1e-9))
    differ = sum(F.bit_count(F.col(f"s{i}x").bitwiseXOR(F.col(f"s{i}y"))) for i in range(HALF))
    pairs = rest.join(
        other,
        (F.col("shingle") == F.col("other"))
        & (rest["cell"] == F.col("cell_x"))
        & (rest["cell_y"] == other["cell_y"])
        & (F.col("cx") != F.col("cy"))
        & ((F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y")))
        & may_link(percent, F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy"))
        & (differ * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent))
        & ~apart,
    ).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    close = written(bounded(pairs.distinct(), sketches).where(possible), "close")
    again = written(verified(close, sets_of(docs, close, k)).where(linked).select("x", "y"), "again")
    if again.limit(1).count():
        found = components(edges.unionByName(again))
    final = written(classes.join(found, "doc", "left").select("a", "b", F.coalesce("component", "doc").alias("component")), "components")
    return signed.join(final, ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
