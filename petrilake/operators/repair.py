"""Repair of a tree-shaped model: every action's model is scored in one job, and the best is kept.

A model and its candidates are small; what grows is the log, which all candidates meet at once as variants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.operators.alignment import weighted_cost
from petrilake.operators.nets import Net
from petrilake.sources.scratch import settled

RUN = "array<struct<label: string, depth: int>>"


def remove(net: Net, tid: str) -> Net | None:
    """The net without a transition, whose places before and after become one; None where the branch can't be closed."""
    _, _, _, (before,), (after,) = next(t for t in net.transitions if t[0] == tid)
    rest = [t for t in net.transitions if t[0] != tid]
    final = net.final or tuple(net.sinks)
    if after in final:
        if sum(after in t[4] for t in net.transitions) > 1:
            if sum(before in t[3] for t in net.transitions) > 1 or before in net.initial:
                return None
            return Net(tuple((i, label, s, pre, (after,) if post == (before,) else post) for i, label, s, pre, post in rest), net.initial, final)
        final = tuple(before if p == after else p for p in final)
    return Net(tuple((i, label, s, (before,) if pre == (after,) else pre, post) for i, label, s, pre, post in rest), net.initial, final)


def add_before(net: Net, label: str, place: str) -> Net:
    """The net with a new transition in front of a place."""
    new, tid = f"{place}+{label}", f"{label}>{place}"
    moved = tuple((i, name, s, pre, tuple(new if p == place else p for p in post)) for i, name, s, pre, post in net.transitions)
    initial = tuple(new if p == place else p for p in net.initial)
    return Net((*moved, (tid, label, False, (new,), (place,))), initial, net.final or tuple(net.sinks))


def add_branch(net: Net, label: str, place: str) -> Net:
    """The net with a new transition from a place to the end."""
    final = net.final or tuple(net.sinks)
    return Net((*net.transitions, (f"{place}>{label}", label, False, (place,), (final[0],))), net.initial, final)


def candidates(net: Net, letters: list[str]) -> list[tuple[str, Net]]:
    """Every action and its model, in a fixed order."""
    final = net.final or tuple(net.sinks)
    out = [(f"remove {t[0]}", m) for t in net.transitions if (m := remove(net, t[0])) is not None]
    for p in net.places:
        for x in sorted(x for x in letters if x is not None):
            out.append((f"add {x} before {p}", add_before(net, x, p)))
            if p not in final:
                out.append((f"branch {x} at {p}", add_branch(net, x, p)))
    return out


def branches(net: Net) -> list[list[tuple[str, int]]]:
    """The visible (label, depth) of each way from the start to the end that enters no place twice; a first transition has depth 2.

    An error for a net that is no tree of single places.
    """
    if any(len(t[3]) != 1 or len(t[4]) != 1 for t in net.transitions):
        raise ValueError("transitions of a tree have one place before and one after")
    final, out = net.final or tuple(net.sinks), []
    todo = [(net.initial[0], 2, [], {net.initial[0]})]
    while todo:
        place, depth, run, seen = todo.pop()
        if place in final:
            out.append(run)
        for _, label, silent, pre, post in net.transitions:
            if pre == (place,) and post[0] not in seen:
                todo.append((post[0], depth + 1, run if silent else [*run, (label, depth)], seen | {post[0]}))
    return out


class Costs:
    """The costs of branches against the variants, each branch scored once: (branch, trace, n_cases, cost) in written tables."""

    def __init__(self, spark: SparkSession, variants: DataFrame, n: int):
        self.spark, self.variants, self.n = spark, variants, n
        self.known: dict[tuple, int] = {}
        self.tables: list[DataFrame] = []

    def add(self, found: list[tuple]) -> None:
        """Score the branches that are new."""
        new = [b for b in dict.fromkeys(found) if b not in self.known]
        if not new:
            return
        first = len(self.known)
        self.known |= {b: first + i for i, b in enumerate(new)}
        runs = self.spark.createDataFrame([(self.known[b], list(b)) for b in new], f"branch int, run {RUN}")
        each = self.variants.crossJoin(F.broadcast(runs)).select("branch", "trace", "n_cases", weighted_cost(F.col("run"), F.col("trace"), self.n).alias("cost"))  # the models' new branches
        self.tables.append(settled(each, "branch_costs"))

    def scores(self, models: list[tuple[str, Net]]) -> DataFrame:
        """(action, fitness): the summed cost of all cases against each model, each by its cheapest branch; 0 is a perfect fit."""
        named = [(name, [tuple(b) for b in branches(m)]) for name, m in models]
        self.add([b for _, found in named for b in found])
        uses = self.spark.createDataFrame([(name, self.known[b]) for name, found in named for b in found], "action string, branch int")
        costs = reduce(DataFrame.unionByName, self.tables) if self.tables else self.variants.selectExpr("0 as branch", "trace", "n_cases", "0D as cost").limit(0)
        each = costs.join(F.broadcast(uses), "branch").groupBy("action", "trace", "n_cases").agg(F.min("cost").alias("cost"))  # the models' branches
        return each.groupBy("action").agg(F.sum(F.col("cost") * F.col("n_cases")).alias("fitness"))


def scores(spark: SparkSession, models: list[tuple[str, Net]], variants: DataFrame, n: int) -> DataFrame:
    """(action, fitness) of the models; see `Costs.scores`."""
    return Costs(spark, variants, n).scores(models)


def repair(spark: SparkSession, net: Net, letters: list[str], variants: DataFrame, n: int, most_rounds: int | None = None) -> tuple[Net, list[tuple[str, float]]]:
    """The model after the best action of each round, until none lowers the fitness; and the actions taken.

    A round scores only the branches that no model before had. most_rounds ends the search early, if given.
    """
    costs = Costs(spark, variants, n)
    start = costs.scores([("", net)]).first()
    history: list[tuple[str, float]] = []
    if start is None:  # no variants, or no branch
        return net, history
    best = start.fitness
    while best > 0 and (most_rounds is None or len(history) < most_rounds):
        models = candidates(net, letters)
        found = costs.scores(models).orderBy("fitness", "action").first()
        if found is None or found.fitness >= best:
            break
        net, best = dict(models)[found.action], found.fitness
        history.append((found.action, found.fitness))
    return net, history
