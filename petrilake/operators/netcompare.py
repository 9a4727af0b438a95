"""Anti-alignment between two models: behaviour of one that the other cannot follow."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators.alignment import FAR, MATRIX_MARKINGS, costs, graph
from petrilake.operators.nets import Net, few, start, step
from petrilake.sources.scratch import settled


def unmatched(first: DataFrame, second: DataFrame, distance: int) -> DataFrame:
    """(run, nearest) of the first model's full runs whose nearest run of the second is further than distance; silent steps cost."""
    plain = lambda c: F.filter(c, lambda x: x != D.WAIT)
    a, b = first.select(plain("run").alias("run")).distinct(), second.select(plain("run").alias("other")).distinct()
    cost = F.size("run") + F.size("other") - 2 * D.common_subsequence(F.col("run"), F.col("other"))
    pairs = a.crossJoin(few(b)).groupBy("run").agg(F.min(cost).alias("nearest"))
    return pairs.where(F.col("nearest") > distance).select(F.array_join("run", " ").alias("run"), "nearest")


def counterexamples(spark: SparkSession, first: Net, second: Net, distance: int, most_steps: int | None = None) -> DataFrame:
    """(run, nearest): full runs of the first net whose nearest full run of the second, of any length, is further than distance.

    A run of the first carries the costs of having come to each marking of the second, at most distance + 1 each: the subset construction
    with costs. Runs that lead to the same marking and the same costs go on alike, so only the first in order of the shortest ones is
    kept; there are finitely many such states, and the search ends when no state is new (or after most_steps steps). So one run
    stands for each way to end beyond distance, `nearest` is exact up to distance + 1, and no row means that there is no counterexample of
    any length. Silent steps cost like others. Nets of more than MATRIX_MARKINGS markings are an error for the second.
    """
    found = graph(spark, second, MATRIX_MARKINGS)
    if found is None:
        raise ValueError(f"the second net has more than {MATRIX_MARKINGS} markings")
    markings, arcs = found
    k, top = len(markings), distance + 1
    near = np.full((k, k), FAR, np.int64)  # steps of the second net alone
    for a, b, *_ in arcs:
        near[a, b] = 1
    np.fill_diagonal(near, 0)
    for i in range(k):
        near = np.minimum(near, near[:, i : i + 1] + near[i : i + 1])
    one = np.full((k, k), FAR, np.int64)
    np.fill_diagonal(one, 1)  # a step of the first net alone
    steps: dict[str | None, np.ndarray] = {None: one}
    for a, b, label, *_ in arcs:
        steps.setdefault(label or "", one.copy())[a, b] = 0
    then = {x: np.minimum((m[:, :, None] + near[None]).min(axis=1), top).T.tolist() for x, m in steps.items()}
    rest = then.pop(None)
    ends = set(second.final or second.sinks)
    last = [i for i, m in enumerate(markings) if ends <= set(m)]
    begin = np.minimum(near[markings.index(tuple(sorted(second.initial)))], top).tolist()
    model = spark.createDataFrame([(then, rest)], "steps map<string, array<array<int>>>, rest array<array<int>>")
    table = replace(first, final=first.final or tuple(first.sinks)).frame(spark)
    cell = lambda row: F.least(F.array_min(F.zip_with("costs", row, lambda x, y: x + y)), F.lit(top))
    moved = F.transform(F.coalesce(F.element_at("steps", F.coalesce("label", F.lit(""))), F.col("rest")), cell)
    fresh = start(spark, first).select("marking", F.array(*[F.lit(int(c)) for c in begin]).alias("costs"), F.array().cast("array<string>").alias("run"))
    seen = fresh = settled(fresh, "compared")
    done = 0
    while most_steps is None or done < most_steps:
        new = step(fresh, table).crossJoin(F.broadcast(model)).select("marking", moved.alias("costs"), F.concat("run", F.array(F.coalesce("label", F.lit("")))).alias("run"))  # one row, of the model's size
        fresh = settled(new.groupBy("marking", "costs").agg(F.min("run").alias("run")).join(seen.select("marking", "costs"), ["marking", "costs"], "left_anti"), "compared")
        done += 1
        if not fresh.limit(1).count():
            break
        seen = settled(seen.unionByName(fresh), "compared")
    final = F.array(*[F.lit(p) for p in first.final or first.sinks])
    closest = F.array_min(F.array(*[F.get("costs", F.lit(i)) for i in last])) if last else F.lit(top)
    full = seen.where(F.size(F.array_except(final, F.col("marking"))) == 0).select(F.array_join("run", " ").alias("run"), closest.alias("nearest"))
    return full.where(F.col("nearest") > distance)


def nearest(runs: DataFrame, second: Net) -> DataFrame:
    """(run, nearest) of runs(run) of a first net: the distance from the nearest full run of the second, of any length; null if it has none.

    A distance between two runs is the cost of an alignment in which no step is silent. Waits of the first do not count.
    """
    loud = replace(second, transitions=tuple((tid, label or "", False, pre, post) for tid, label, _, pre, post in second.transitions))
    plain = runs.select(F.filter("run", lambda x: x != D.WAIT).alias("trace")).distinct()
    return costs(plain, loud).select(F.array_join("trace", " ").alias("run"), F.col("cost").alias("nearest"))
