"""1-safe Petri nets as tables, and their bounded runs by joins.

A transition fires where all its places before are marked and none of its new places after is; a step is a join of the reached
markings with the transitions, which are few and are broadcast. Runs of exactly n steps wait in `w` where all sinks are marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.sources.scratch import settled

#: Runs that may be broadcast to the traces; more are joined by a shuffled product.
MAX_BROADCAST_RUNS = 200_000


@dataclass(frozen=True)
class Net:
    """A net: (tid, label, silent, before, after) of its transitions, and its initial and final places."""

    transitions: tuple[tuple[str, str | None, bool, tuple[str, ...], tuple[str, ...]], ...]
    initial: tuple[str, ...]
    final: tuple[str, ...] = ()

    @property
    def places(self) -> list[str]:
        return sorted({p for t in self.transitions for p in (*t[3], *t[4])} | set(self.initial))

    @property
    def sinks(self) -> list[str]:
        """Places without an arc to a transition; the final marking where none is given."""
        used = {p for t in self.transitions for p in t[3]}
        return [p for p in self.places if p not in used]

    @property
    def labels(self) -> list[str]:
        return sorted({t[1] for t in self.transitions if t[1] is not None and not t[2]})

    def with_wait(self) -> Net:
        """The net with a wait that needs all sinks marked and keeps them so."""
        return Net((*self.transitions, ("w", "w", False, tuple(self.sinks), tuple(self.sinks))), self.initial, self.final or tuple(self.sinks))

    def only(self, tids: list[str]) -> Net:
        """The subnet of some transitions."""
        return Net(tuple(t for t in self.transitions if t[0] in tids), self.initial, self.final or tuple(self.sinks))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The transitions as a table."""
        return spark.createDataFrame([(t[0], t[1], t[2], list(t[3]), list(t[4])) for t in self.transitions], "tid string, label string, silent boolean, before array<string>, after array<string>")


def step(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """Every state joined with what can fire there: the new marking, and the fired transition as tid and label."""
    fresh = F.array_except("after", "before")
    enabled = (F.size(F.array_except("before", "marking")) == 0) & ~F.arrays_overlap(fresh, F.col("marking"))
    return states.join(F.broadcast(transitions), enabled).withColumn("marking", F.array_sort(F.array_union(F.array_except("marking", "before"), "after")))  # a model's transitions


def few(runs: DataFrame) -> DataFrame:
    """runs, marked for broadcast if there are few enough."""
    return F.broadcast(runs) if runs.limit(MAX_BROADCAST_RUNS + 1).count() <= MAX_BROADCAST_RUNS else runs


def start(spark: SparkSession, net: Net) -> DataFrame:
    """The initial marking."""
    return spark.range(1).select(F.array(*[F.lit(p) for p in sorted(net.initial)]).alias("marking"))


def runs(spark: SparkSession, net: Net, n: int, reach_final: bool = False) -> DataFrame:
    """(run, tids): the label sequences of exactly n steps (waits included), each once with one sequence of transitions.

    With reach_final the final places (the sinks where none are given) are marked at the end; other places may be.
    """
    net = net.with_wait()
    table = net.frame(spark)
    states = start(spark, net).select("marking", F.array().cast("array<string>").alias("run"), F.array().cast("array<string>").alias("tids"))
    for _ in range(n):
        states = step(states, table).select("marking", F.concat("run", F.array("label")).alias("run"), F.concat("tids", F.array("tid")).alias("tids"))
        states = states.groupBy("marking", "run").agg(F.min("tids").alias("tids"))
    if reach_final:
        states = states.where(F.size(F.array_except(F.array(*[F.lit(p) for p in net.final or net.sinks]), "marking")) == 0)
    return settled(states.groupBy("run").agg(F.min("tids").alias("tids")), "runs")


def run_levels(spark: SparkSession, net: Net, reach_final: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """(n, runs of exactly n steps) for n = 1, 2, ... without end, each from the states of the one before."""
    net = net.with_wait()
    table, n = net.frame(spark), 0
    states = start(spark, net).select("marking", F.array().cast("array<string>").alias("run"))
    final = F.array(*[F.lit(p) for p in net.final or net.sinks])
    while True:
        states = settled(step(states, table).select("marking", F.concat("run", F.array("label")).alias("run")).distinct(), "states")
        n += 1
        ends = states.where(F.size(F.array_except(final, F.col("marking"))) == 0) if reach_final else states
        yield n, ends.select("run").distinct()


def reachable(spark: SparkSession, net: Net, most: int = 1 << 20) -> DataFrame:
    """(marking): all markings that can be reached, level by level until none is new; an error beyond most of them."""
    table, seen = net.frame(spark), start(spark, net)
    count = 1
    while True:
        seen = settled(seen.unionByName(step(seen, table).select("marking")).distinct(), "markings")
        if (now := seen.count()) == count:
            return seen
        if now > most:
            raise ValueError(f"more than {most} markings can be reached")
        count = now


def depths(arcs: DataFrame, spark: SparkSession, most: int) -> DataFrame:
    """(transition, depth) in a tree of arcs(src, transition, dst) from `init`; a first transition has depth 2."""
    level = arcs.where("src = 'init'").select("transition", "dst", F.lit(2).alias("depth"))
    out = level
    for d in range(3, most + 2):
        level = arcs.join(level.select(F.col("dst").alias("src")), "src").select("transition", "dst", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.select("transition", "depth")
