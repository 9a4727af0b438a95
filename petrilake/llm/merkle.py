"""A Merkle manifest of a dataset, by time-forward processing.

Rows are leaves, one tree a group; `ARITY` consecutive nodes become their parent, level by level, and the groups' roots likewise give the
dataset's. The tree's nodes are labelled in post-order by (the last leaf that they may cover, their level), so that children come
before parents. A sweep goes through the labels in ascending order: a node takes its children's digests from a priority queue that is
ordered by label, and sends its own to its parent's label. The reversed sweep goes through them in descending order: a node takes its path
to the root and sends each child that path with the child's siblings before it.

What lies outside a task's memory of that queue is Spark's sorted shuffle. A tree is cut into bands, subtrees of `BAND` leaves: rows are
dealt by (tree, band) and sorted by label, a task streams through them and its heap holds a few messages a level, whatever the
size of the table; a band's root is a leaf of the next round, and its path comes back as a row that is sorted in front of the band.
A group of a third of all rows is many bands. Paths are sent a band or a run, never written a leaf.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import python_workers, written

ARITY = 16
HEIGHT = 3
BAND = ARITY**HEIGHT
#: Rows of a batch that a sweep hands on.
ROWS = 2000


def digest(data: str) -> str:
    """Lowercase hex sha256 of hex digests and other ASCII text."""
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]).cast("binary"), 256)


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `at`: their number within the group, from 0, in ascending order of the columns (nulls first).

    Rows are sorted once, over all groups, and cut into ranges; equal rows are dealt by their place in the input, so that no range is
    larger for them. A task counts within its groups, and what earlier ranges hold of a range's first group is added by a
    broadcast of one number a range.
    """
    python_workers(rows.sparkSession, ROWS)
    names = rows.columns
    k = names.index(group)
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in (group, *order, "_tie")]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*names, F.spark_partition_id().alias("_range"))
    schema = rows.select("*", F.lit(0).alias("_range"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("_first")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n, first, begun = None, 0, True, False
        for b in batches:
            at, firsts = [], []
            for g in b.column(k).to_pylist():
                if begun and g != here:
                    n, first = 0, False
                here, begun = g, True
                at.append(n)
                firsts.append(first)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64()), pa.array(firsts, pa.bool_())], [*names, "_range", "at", "_first"])

    done = written(ranged.mapInArrow(count, schema), "places")
    # of each range: how many rows of its first group, of its last group, and whether those are one
    ends = done.groupBy("_range").agg(
        F.min(F.struct(F.when(F.col("_first"), 0).otherwise(1), group))[group].alias("first"),
        F.max(F.struct(F.when(F.col("_first"), 0).otherwise(1), group))[group].alias("last"),
        F.sum(F.col("_first").cast("long")).alias("n_first"),
        F.max(F.struct(F.when(F.col("_first"), 0).otherwise(1), group, "at"))["at"].alias("last_at"),
        F.min("_first").alias("one"),
    )
    offsets, open_group, held = [], None, 0
    for i, r in enumerate(ends.orderBy("_range").collect()):  # one row a range
        start = held if i and r["first"] == open_group else 0
        offsets.append((r["_range"], start))
        open_group, held = r["last"], start + r["n_first"] if r["one"] else r["last_at"] + 1
    if not offsets:
        return done.drop("_range", "_first")
    few = rows.sparkSession.createDataFrame(offsets, "_range int, _start bigint")
    return done.join(F.broadcast(few), "_range").withColumn("at", F.col("at") + F.when(F.col("_first"), F.col("_start")).otherwise(0)).select(*names, "at")


class _Up:
    """The ascending sweep of one band: digests go to their parents' labels."""

    def __init__(self, tree: str | None, band: int):
        self.tree, self.band, self.queue, self.out = tree, band, [], []

    def send(self, level: int, index: int, value: str) -> None:
        heapq.heappush(self.queue, (_last(level + 1, index // ARITY), level + 1, index, value))

    def advance(self, upto: int) -> None:
        """Take the nodes whose last leaf comes before upto."""
        while self.queue and self.queue[0][0] < upto:
            last, level, index, _ = self.queue[0]
            if len(self.queue) == 1 and not index and not self.band and upto >= BAND:
                return  # one node is left of the only band of its tree: the root
            children = []
            while self.queue and self.queue[0][:2] == (last, level):
                children.append(heapq.heappop(self.queue)[3])
            own = digest("".join(children))
            self.out.append((self.tree, self.band, last, level, children, own))
            if level == HEIGHT:
                heapq.heappush(self.queue, (BAND, level + 1, 0, own))
                return
            self.send(level, index // ARITY, own)

    def root(self) -> str:
        self.advance(BAND)
        return self.queue[0][3]


def _last(level: int, index: int) -> int:
    """The last leaf, within the band, that a node may cover: its label's first part."""
    return (index + 1) * ARITY**level - 1


_RUNS = "tree string, band bigint, last bigint, level int, children array<string>, digest string"


def _climb(nodes: DataFrame) -> DataFrame:
    """The inner nodes of nodes(tree, at, digest) in bands, as _RUNS; a band's root once more at level HEIGHT + 1, without children."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None

        def finish(s: _Up) -> list[tuple]:
            value = s.root()
            return [*s.out, (s.tree, s.band, BAND, HEIGHT + 1, [], value)]

        for b in batches:
            done = []
            for tree, band, at, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sweep is None or (sweep.tree, sweep.band) != (tree, band):
                    done += finish(sweep) if sweep else []
                    sweep = _Up(tree, band)
                sweep.advance(at)
                sweep.send(0, at, value)
            if sweep:
                done += sweep.out
                sweep.out = []
            yield from _batches(done)
        if sweep:
            yield from _batches(finish(sweep))

    def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for i in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + ROWS], strict=True), types, strict=True)], ["tree", "band", "last", "level", "children", "digest"])

    python_workers(nodes.sparkSession, ROWS)
    banded = nodes.select("tree", F.expr(f"at div {BAND}").alias("band"), F.pmod("at", F.lit(BAND)).alias("at"), "digest")
    return banded.repartition("tree", "band").sortWithinPartitions("tree", "band", "at").mapInArrow(work, _RUNS)


def ascend(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The rounds of nodes(tree, at, digest), each as its nodes and its written runs; and (tree, digest) of the trees' roots."""
    rounds = []
    while True:
        runs = written(_climb(nodes), "runs")
        rounds.append((nodes, runs))
        nodes = runs.where(F.col("level") > HEIGHT).select("tree", F.col("band").alias("at"), "digest")
        if not nodes.where("at > 0").limit(1).count():
            return rounds, nodes.select("tree", "digest")


def descend(nodes: DataFrame, runs: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes(tree, at, digest, ...) with `path`, from paths(tree, band, path) of the bands' roots.

    A path is the siblings' digests joined before and after the node, for each level up to the root: an array of twice the levels.
    """
    kept = [c for c in nodes.columns if c != "at"]
    own = nodes.select(F.col("tree"), F.expr(f"at div {BAND}").alias("band"), F.pmod("at", F.lit(BAND)).alias("last"), F.lit(0).alias("level"), F.struct(*kept[1:], F.col("at")).alias("row"))
    inner = runs.where(F.col("level") <= HEIGHT).select("tree", "band", "last", "level", "children")
    top = paths.select("tree", "band", F.lit(BAND).cast("long").alias("last"), F.lit(HEIGHT + 1).alias("level"), "path")
    rows = own.unionByName(inner, allowMissingColumns=True).unionByName(top, allowMissingColumns=True)
    rows = rows.select("tree", "band", "last", "level", "row", "children", "path").repartition("tree", "band").sortWithinPartitions("tree", "band", F.desc("last"), F.desc("level"))
    schema = rows.select("tree", "row", "path").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queue, first = None, [], None  # a heap of (-last, -level, path)
        for b in batches:
            keep, out = [], []
            trees, bands, lasts, levels, children, given = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6))
            for i, (tree, band, last, level) in enumerate(zip(trees, bands, lasts, levels, strict=True)):
                if level > HEIGHT:
                    here, queue, first = (tree, band), [], given[i]
                    continue
                if here != (tree, band):
                    raise ValueError(f"no path for band {band} of {tree!r}")
                if first is not None:  # the band's root, at whatever level
                    path, first = first, None
                else:
                    found = heapq.heappop(queue)
                    if found[:2] != (-last, -level):
                        raise ValueError(f"label {(last, level)} of {tree!r} met the message to {found[:2]}")
                    path = found[2]
                if level:
                    digests, start = children[i], (last + 1) // ARITY ** (level - 1) - ARITY
                    for j in range(len(digests)):
                        message = ["".join(digests[:j]), "".join(digests[j + 1 :]), *path]
                        heapq.heappush(queue, (-_last(level - 1, start + j), 1 - level, message))
                else:
                    keep.append(i)
                    out.append(path)
            picked = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(4), pa.array(out, pa.list_(pa.string()))], ["tree", "row", "path"])

    python_workers(nodes.sparkSession, 500)
    return rows.mapInArrow(work, schema).select("tree", "row.*", "path")


def _paths(rounds: list[tuple[DataFrame, DataFrame]], roots: DataFrame) -> DataFrame:
    """The first round's nodes with their paths to roots(tree, path)."""
    paths = roots.select("tree", F.lit(0).cast("long").alias("band"), "path")
    for i, (nodes, runs) in enumerate(reversed(rounds)):
        below = descend(nodes, runs, paths)
        if i == len(rounds) - 1:
            return below
        paths = written(below.select("tree", F.col("at").alias("band"), "path"), "paths")
    raise AssertionError("a tree has a round")


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], carry: str | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, path) of every row: its digest, its group's root, the dataset's, and its siblings up to that.

    fields: the columns of a leaf, in order. carry: a short column that each row keeps. Leaves ascend by key within a group, null keys first, rows of one key by their digests; equal
    rows are interchangeable. Groups ascend bytewise, null first; it is a group like any other. Null fields have a digest of
    their own, empty texts another. Other columns, clashing ones too, are not read. An empty table has no root and gives no row.
    """
    kept = [F.col(carry).alias("_carry")] if carry else []
    leaves = docs.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("tree"), leaf([F.col(f) for f in fields]).alias("digest"), *kept)
    nodes = places(leaves, "tree", ["_key", "digest"]).select("tree", "at", "digest", "_key", *(["_carry"] if carry else []))
    rounds, subroots = ascend(nodes)
    all_ = places(subroots.select(F.lit("").alias("_all"), F.col("tree").alias("_group"), "digest"), "_all", ["_group"]).select(F.col("_all").alias("tree"), "at", "digest", "_group")
    upper, root = ascend(all_)
    names = [F.col("_key").alias(key), F.col("tree").alias(group), *([F.col("_carry").alias(carry)] if carry else [])]
    found = root.first()
    if found is None:
        return nodes.select(*names, F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("path")).limit(0)
    top = root.select("tree", F.array().cast("array<string>").alias("path"))
    groups = written(_paths(upper, top).select(F.col("_group").alias("tree"), "path", "digest"), "group_paths")
    below = _paths(rounds, groups)
    within = F.slice("path", 1, F.size("path") - _depth(upper))  # the rest is the group's own path
    return below.select(*names, F.col("digest").alias("leaf"), folded(F.col("digest"), within).alias("subroot"), F.lit(found.digest).alias("root"), "path")


def _depth(rounds: list[tuple[DataFrame, DataFrame]]) -> int:
    """Entries of the paths in the one tree of the groups: twice its levels."""
    return sum(2 * runs.where(F.col("level") <= HEIGHT).agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for _, runs in rounds)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    levels = F.filter(F.sequence(F.lit(0), F.size(path)), lambda i: (i < F.size(path)) & (i % 2 == 0))
    return F.aggregate(levels, start, lambda a, i: F.sha2(F.concat(F.get(path, i), a, F.get(path, i + 1)).cast("binary"), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(path, "").cast("binary"), 256)
