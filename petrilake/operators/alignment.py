"""Optimal alignments between traces and a net.

A log move and a visible model move cost 1, a silent move and a step of both nothing. `costs` is the plan to use: a net with few
markings becomes one matrix a letter, and a trace of any length is a fold of its letters over the costs of being at each marking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators.nets import Net, few, reachable, step
from petrilake.sources.scratch import settled

#: Markings of a net whose matrices are broadcast; larger nets are searched level by level.
MATRIX_MARKINGS = 200
#: A cost that stands for no way.
FAR = 1 << 28


def graph(spark: SparkSession, net: Net, most: int | None = None) -> tuple[list[tuple[str, ...]], list[tuple[int, int, str | None, bool, str]]] | None:
    """The markings that can be reached, in order, and the arcs (from, to, label, silent, tid) between them by number; None beyond most markings.

    The size of the model, not of the log.
    """
    seen = reachable(spark, net)
    if most is not None and seen.limit(most + 1).count() > most:
        return None
    rows = step(seen.withColumn("from", F.col("marking")), net.frame(spark)).select("from", "marking", "label", "silent", "tid").collect()
    markings = sorted(tuple(r[0]) for r in seen.collect())
    at = {m: i for i, m in enumerate(markings)}
    return markings, sorted((at[tuple(r[0])], at[tuple(r[1])], r[2], r[3], r[4]) for r in rows)


def matrices(spark: SparkSession, net: Net) -> tuple[list[int], list[int], dict[str | None, list[list[int]]]] | None:
    """The costs at the start, those from each marking to the final one (0 or FAR), and for each letter (None: any other) the costs to
    come from each marking (inner) to each (outer) with one letter of the trace; None if the net has too many markings.

    What is made here is the size of the model, not of the log.
    """
    found = graph(spark, net, MATRIX_MARKINGS)
    if found is None:
        return None
    places, arcs = found
    k = len(places)
    near = np.full((k, k), FAR, np.int64)  # model moves alone
    np.fill_diagonal(near, 0)
    for a, b, _, silent, _ in arcs:
        near[a, b] = min(near[a, b], 0 if silent else 1)
    for i in range(k):
        near = np.minimum(near, near[:, i : i + 1] + near[i : i + 1])
    log_move = np.full((k, k), FAR, np.int64)
    np.fill_diagonal(log_move, 1)
    steps = {None: log_move}
    for a, b, label, silent, _ in arcs:
        if not silent:
            steps.setdefault(label, log_move.copy())[a, b] = 0
    then = {x: np.minimum((one[:, :, None] + near[None]).min(axis=1), FAR).T.tolist() for x, one in steps.items()}
    first = near[places.index(tuple(sorted(net.initial)))].tolist()
    final = set(net.final or net.sinks)
    return first, [0 if final <= set(m) else FAR for m in places], then


def costs(variants: DataFrame, net: Net) -> DataFrame:
    """variants(trace, ...) with `cost`: that of the optimal alignment with the net's full runs of any length; null if there is none."""
    found = matrices(variants.sparkSession, net)
    if found is None:
        return variants.join(costs_by_search(variants, net, written=settled), "trace", "left")
    first, last, then = found
    rest = then.pop(None)
    types = "first array<int>, last array<int>, steps map<string, array<array<int>>>, rest array<array<int>>"
    one = variants.sparkSession.createDataFrame([(first, last, then, rest)], types)
    plus = lambda a, b: F.array_min(F.zip_with(a, b, lambda x, y: x + y))
    cell = lambda old, row: F.least(plus(old, row), F.lit(FAR))
    fold = F.aggregate("trace", F.col("first"), lambda old, x: F.transform(F.coalesce(F.element_at("steps", x), F.col("rest")), lambda row: cell(old, row)))
    rows = variants.crossJoin(F.broadcast(one)).withColumn("cost", plus(fold, F.col("last")))  # one row, of the model's size
    return rows.withColumn("cost", F.when(F.col("cost") < FAR, F.col("cost"))).drop("first", "last", "steps", "rest")


def costs_to_runs(variants: DataFrame, full_runs: DataFrame) -> DataFrame:
    """(trace, n_cases, cost): moves on one side only, for the closest of a list of full runs."""
    both = variants.crossJoin(few(full_runs.select("run")))
    return both.groupBy("trace", "n_cases").agg(F.min(D.indel(F.col("run"), F.col("trace"))).alias("cost"))


def costs_by_search(variants: DataFrame, net: Net, most_steps: int | None = None, written=settled) -> DataFrame:
    """(trace, cost) by shortest paths over (trace, position, marking), one join a level, until no level makes a state cheaper.

    For nets with many markings. written cuts the lineage between levels (a function of a DataFrame). most_steps ends the search early.
    """
    spark = variants.sparkSession
    table = net.frame(spark)
    first = F.array(*[F.lit(p) for p in sorted(net.initial)])
    states = variants.select("trace", F.lit(0).alias("pos"), first.alias("marking"), F.lit(0).alias("cost"))
    fresh = F.array_except("after", "before")
    enabled = (F.size(F.array_except("before", "marking")) == 0) & ~F.arrays_overlap(fresh, F.col("marking"))
    moved = F.array_sort(F.array_union(F.array_except("marking", "before"), "after"))
    before, done = None, 0
    while most_steps is None or done < most_steps:
        log_move = states.where(F.col("pos") < F.size("trace")).select("trace", (F.col("pos") + 1).alias("pos"), "marking", (F.col("cost") + 1).alias("cost"))
        fired = states.join(F.broadcast(table), enabled)
        model_move = fired.select("trace", "pos", moved.alias("marking"), (F.col("cost") + F.when(F.col("silent"), 0).otherwise(1)).alias("cost"))
        both = fired.where(~F.col("silent") & (F.get("trace", F.col("pos")) == F.col("label"))).select("trace", (F.col("pos") + 1).alias("pos"), moved.alias("marking"), "cost")
        states = states.unionByName(log_move).unionByName(model_move).unionByName(both).groupBy("trace", "pos", "marking").agg(F.min("cost").alias("cost"))
        states, done = written(states), done + 1
        now = states.agg(F.count("*"), F.sum("cost")).first()
        if now == before:  # no new state, none cheaper
            break
        before = now
    final = F.array(*[F.lit(p) for p in net.final or net.sinks])
    return states.where((F.col("pos") == F.size("trace")) & (F.size(F.array_except(final, F.col("marking"))) == 0)).groupBy("trace").agg(F.min("cost").alias("cost"))


def weighted_cost(run: Column, trace: Column, n: int) -> Column:
    """The least alignment cost where a move at depth or position i alone costs 2^(|trace| + n - i); depths of a run start at 2, positions at 0."""
    power = lambda i: F.pow(F.lit(2.0), F.size(trace) + n - i)
    top = F.concat(F.array(F.lit(0.0)), F.transform(F.sequence(F.lit(1), F.size(trace)), lambda j: F.aggregate(F.sequence(F.lit(0), j - 1), F.lit(0.0), lambda a, i: a + power(i))))

    def row(old, x):
        down = power(x["depth"])
        cell = lambda new, j: F.concat(new, F.array(F.least(F.get(new, j - 1) + power(j - 1), F.get(old, j) + down, F.when(F.get(trace, j - 1) == x["label"], F.get(old, j - 1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(trace)), F.array(F.get(old, F.lit(0)) + down), cell)

    return F.element_at(F.aggregate(run, top, row), -1)


#: What a move on one side weighs against the number of moves.
COSTLY = 1 << 32
SKIP = ">>"


class _Paths:
    """The cheapest way through (position, marking) for one trace at a time: least cost, then fewest moves."""

    def __init__(self, net: Net, markings: list[tuple[str, ...]], arcs: list[tuple[int, int, str | None, bool, str]]):
        k = len(markings)
        self.arcs, self.k = arcs, k
        self.near = np.full((k, k), np.iinfo(np.int64).max // 4, np.int64)
        np.fill_diagonal(self.near, 0)
        for a, b, _, silent, _ in arcs:
            self.near[a, b] = min(self.near[a, b], 1 if silent else COSTLY + 1)
        np.fill_diagonal(self.near, 0)
        for i in range(k):
            self.near = np.minimum(self.near, self.near[:, i : i + 1] + self.near[i : i + 1])
        self.first = markings.index(tuple(sorted(net.initial)))
        final = set(net.final or net.sinks)
        self.ends = [i for i, m in enumerate(markings) if final <= set(m)]
        self.into: dict[int, list[tuple[str, int, str | None, bool]]] = {}
        for a, b, label, silent, tid in arcs:
            self.into.setdefault(b, []).append((tid, a, label, silent))

    def moves(self, trace: list[str]) -> list[tuple[str, str]] | None:
        """(log step, model step) in order, SKIP where a side stands still; None if the model has no full run.

        Among equals, from the end backwards: a step of both, then one of the log, then the model's by name; the first final marking.
        """
        cost = [self.near[self.first]]
        for x in trace:
            here = cost[-1] + COSTLY + 1
            for a, b, label, silent, _ in self.arcs:
                if not silent and label == x:
                    here[b] = min(here[b], cost[-1][a] + 1)
            cost.append((here[:, None] + self.near).min(axis=0))
        if not self.ends:
            return None
        at = min(self.ends, key=lambda m: (cost[-1][m], m))
        if cost[-1][at] >= np.iinfo(np.int64).max // 8:
            return None
        pos, out = len(trace), []
        while pos or at != self.first or cost[0][at]:
            now, ways = cost[pos][at], []
            for tid, a, label, silent in self.into.get(at, ()):
                if pos and not silent and label == trace[pos - 1] and cost[pos - 1][a] + 1 == now:
                    ways.append((0, tid, pos - 1, a))
                if cost[pos][a] + (1 if silent else COSTLY + 1) == now:
                    ways.append((2, tid, pos, a))
            if pos and cost[pos - 1][at] + COSTLY + 1 == now:
                ways.append((1, SKIP, pos - 1, at))
            kind, tid, pos, at = min(ways)
            out.append((SKIP if kind == 2 else trace[pos], tid))
        return out[::-1]


def moves(variants: DataFrame, net: Net) -> DataFrame:
    """(trace, move, log_step, model_step): the moves of an optimal alignment of each variant with the net's full runs of any length.

    log_step is an activity, model_step a transition, either is SKIP where that side stands still; moves count from 1. Of the alignments
    of least cost the one of fewest moves is given, ties as in `_Paths.moves`. A variant without an alignment has no row, nor has an
    empty one whose run needs no step. Nets of more than MATRIX_MARKINGS markings are an error.
    """
    found = graph(variants.sparkSession, net, MATRIX_MARKINGS)
    if found is None:
        raise ValueError(f"the net has more than {MATRIX_MARKINGS} markings")
    paths = _Paths(net, *found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for trace in b.column(0).to_pylist():
                if rows := paths.moves(trace):
                    logs, models = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([trace] * len(rows), pa.list_(pa.string())), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array(logs, pa.string()), pa.array(models, pa.string())], ["trace", "move", "log_step", "model_step"])

    return variants.select("trace").mapInArrow(work, "trace array<string>, move int, log_step string, model_step string")


def aligned_difference(variants: DataFrame, net: Net, n: int) -> DataFrame:
    """variants(trace, ...) with `difference`: the least cost of a full run and the trace's first n symbols in exactly n instants; null if there is none.

    In an instant the run takes a step or waits, anywhere, and the trace gives its next symbol or waits. Equal symbols cost nothing, different
    ones 2, a symbol against a wait or a silent step 1, a step against a wait 1, a silent step against a wait nothing. Waits of both cost 1
    as long as the trace has symbols left, else nothing. Symbols that the net lacks count as waits that use up their place.
    """
    found = graph(variants.sparkSession, net, MATRIX_MARKINGS)
    if found is None:
        raise ValueError(f"the net has more than {MATRIX_MARKINGS} markings")
    markings, arcs = found
    first, labels = markings.index(tuple(sorted(net.initial))), set(net.labels)
    final = set(net.final or net.sinks)
    ends = [i for i, m in enumerate(markings) if final <= set(m)]

    def difference(trace: list[str]) -> int | None:
        trace = trace[:n]
        size = len(trace)
        cost = np.full((size + 1, len(markings)), FAR, np.int64)  # by symbols given and marking
        cost[0, first] = 0
        unknown = np.array([x not in labels for x in trace], bool)
        for _ in range(n):
            new = cost + 1  # both wait
            new[size] = cost[size]
            new[1:] = np.minimum(new[1:], cost[:-1] + 1)  # the run waits
            for a, b, label, silent, _ in arcs:
                new[:, b] = np.minimum(new[:, b], cost[:, a] + (0 if silent else 1))  # the trace waits
                if size:
                    step_ = np.where(unknown, 0, 1) if silent else np.where(unknown, 1, np.where(np.array([x == label for x in trace], bool), 0, 2))
                    new[1:, b] = np.minimum(new[1:, b], cost[:-1, a] + step_)
            cost = new
        best = min((int(cost[size, e]) for e in ends), default=FAR)
        return best if best < FAR else None

    names = variants.columns
    at = names.index("trace")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([difference(t) for t in b.column(at).to_pylist()], pa.int32())], [*names, "difference"])

    return variants.mapInArrow(work, variants.select("*", F.lit(None).cast("int").alias("difference")).schema)
