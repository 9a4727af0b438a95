"""Optima over whole traces, without a list of the model's runs.

A distance by positions adds up, so the run of n steps with the largest or smallest sum over all cases is a longest or shortest path
through (step, marking), where a step's weight is counted once over the log. The log is read once; what goes to the driver is one
number for each position and each label of the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators.alignment import graph
from petrilake.operators.nets import Net

_NONE = ""


def position_costs(variants: DataFrame, labels: list[str], n: int) -> DataFrame:
    """(pos, symbol, cases): the cases whose symbol at each of the first n positions is one of the labels or a wait; with a null symbol, all whose symbol is not silent."""
    rows = variants.select("n_cases", F.posexplode(D.padded(F.col("trace"), n)).alias("pos", "symbol")).where(~D.is_silent(F.col("symbol")))
    known = F.when(F.col("symbol").isin([*labels, D.WAIT]), F.col("symbol")).otherwise(_NONE)
    counts = rows.groupBy("pos", known.alias("symbol")).agg(F.sum("n_cases").alias("cases"))
    return counts.unionByName(counts.groupBy("pos").agg(F.sum("cases").alias("cases")).select("pos", F.lit(None).cast("string").alias("symbol"), "cases")).where(f"symbol is null or symbol <> '{_NONE}'")


def best_sum(variants: DataFrame, net: Net, artefact: str, n: int | None = None) -> DataFrame:
    """(run, distance): the run of n steps whose summed Hamming distance from all cases is largest (anti) or smallest (multi).

    n: the longest trace's length where it is not given, so that no trace is cut. Runs wait where all sinks are marked, and need not
    reach the end. The first run in lexicographic order among equals. No row if the model has no run of n steps.
    """
    spark = variants.sparkSession
    if artefact not in ("anti", "multi"):
        raise ValueError(f"unknown artefact: {artefact}")
    if n is None:
        n = variants.agg(F.coalesce(F.max(F.size("trace")), F.lit(0))).first()[0]
    whole = net.with_wait()
    markings, arcs = graph(spark, whole)
    equal, known = {}, [0] * n
    for pos, symbol, cases in position_costs(variants, whole.labels, n).collect():  # positions times the model's labels
        if symbol is None:
            known[pos] = cases
        else:
            equal[pos, symbol] = cases
    sign = 1 if artefact == "anti" else -1
    out: dict[int, list[tuple[str, int, bool]]] = {}
    for a, b, label, silent, _ in arcs:
        out.setdefault(a, []).append((label, b, silent))
    cost = lambda pos, label, silent: 0 if silent else known[pos] - equal.get((pos, label), 0)
    after: list[dict[int, int]] = [{m: 0 for m in range(len(markings))}]  # the best of the steps from a marking to the end
    for pos in range(n - 1, -1, -1):
        best = {}
        for a, steps in out.items():
            reach = [sign * cost(pos, label, silent) + after[-1][b] for label, b, silent in steps if b in after[-1]]
            if reach:
                best[a] = max(reach)
        after.append(best)
    after.reverse()
    first = markings.index(tuple(sorted(net.initial)))
    if first not in after[0]:
        return spark.createDataFrame([], "run string, distance bigint")
    here, run = {first}, []
    for pos in range(n):
        left = after[pos][next(iter(here))]
        ways = [(label or "", b) for m in here for label, b, silent in out[m] if b in after[pos + 1] and sign * cost(pos, label, silent) + after[pos + 1][b] == left]
        label = min(x + " " for x, _ in ways)[:-1]
        run.append(label)
        here = {b for x, b in ways if x == label}
    return spark.createDataFrame([(" ".join(run), sign * after[0][first])], "run string, distance bigint")
