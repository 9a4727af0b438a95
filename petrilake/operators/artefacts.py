"""Anti-alignments, multi-alignments and the measures that rest on them.

The traces meet the model's runs as variants with their numbers of cases; the runs, a bounded set, are broadcast after a count.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators.nets import Net, few, reachable, start, step
from petrilake.sources.scratch import settled


def run_distances(runs: DataFrame, variants: DataFrame, n: int, distance: str) -> DataFrame:
    """(run, trace, n_cases, distance) of every run and variant, traces cut to n."""
    cut = variants.withColumn("trace", D.prefix(F.col("trace"), n)).groupBy("trace").agg(F.sum("n_cases").alias("n_cases"))
    both = cut.crossJoin(few(runs))
    if distance == "hamming":
        found = D.hamming(F.col("run"), D.padded(F.col("trace"), n))
    elif distance == "edit":
        found = D.indel(F.col("run"), F.col("trace"))
    else:
        raise ValueError(f"unknown distance: {distance}")
    return both.select("run", "trace", "n_cases", found.alias("distance"))


def summarise(pairs: DataFrame) -> DataFrame:
    """(run, least, most, total): each run's distances from the log; total counts every case."""
    return pairs.groupBy(F.array_join("run", " ").alias("run")).agg(F.min("distance").alias("least"), F.max("distance").alias("most"), F.sum(F.col("distance") * F.col("n_cases")).alias("total"))


def best(pairs: DataFrame, artefact: str, objective: str) -> DataFrame:
    """(run, distance): the optimum, and the first run in order that has it.

    anti: the run furthest from the log, by its least distance (min) or the sum over the cases (sum). multi: the closest, by its largest
    distance (min) or the sum.
    """
    value = {"anti": {"min": "least", "sum": "total"}, "multi": {"min": "most", "sum": "total"}}[artefact][objective]
    return summarise(pairs).select("run", F.col(value).cast("long").alias("distance")).orderBy(F.desc("distance") if artefact == "anti" else F.asc("distance"), "run").limit(1)


def with_distances(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(trace, n_cases, distance) from the one run of found."""
    return pairs.join(F.broadcast(found.select("run")), F.array_join(pairs.run, " ") == found.run).select(F.array_join("trace", " ").alias("trace"), "n_cases", "distance")  # one row


def _share(kind: str, max_d: int):
    length = F.size(F.filter("run", lambda x: x != D.WAIT))
    return {"edit": F.col("distance") / (length + F.size("trace")), "hamming": F.col("distance") / F.greatest(length, F.size("trace")), "bounded": F.col("distance") / F.lit(max_d)}[kind]


def precision(pairs: DataFrame, found: DataFrame, n: int, kind: str, max_d: int) -> DataFrame:
    """1 minus the least distance from the found run, in shares of both lengths (edit), the longer one (hamming) or max_d (bounded)."""
    rows = pairs.join(F.broadcast(found.select(F.col("run").alias("best"))), F.array_join(pairs.run, " ") == F.col("best"))  # one row
    return rows.agg(F.round(1 - F.min(_share(kind, max_d)), 9).alias("precision"))


def anti_precision(pairs: DataFrame, kind: str, max_d: int) -> DataFrame:
    """(precision) from the anti-alignment by least distance; both are taken in one grouping, so that each distance is made once."""
    rows = pairs.groupBy(F.array_join("run", " ").alias("run")).agg(F.min("distance").alias("least"), F.min(_share(kind, max_d)).alias("share"))
    return rows.orderBy(F.desc("least"), "run").limit(1).select(F.round(1 - F.col("share"), 9).alias("precision"))


#: Lengths of runs that one pass explores, and the states beyond which it takes a single one.
LEVELS, MANY_STATES = 4, 10_000


class _Rows:
    """Full runs of n = 1, 2, ... steps with their distances from whole traces.

    A written table holds, for each visible word of the runs so far and each trace, the distances from the word to all the trace's
    prefixes. Longer runs only extend the rows of the words that they grew from; waits and silent steps take the row as it is.
    """

    def __init__(self, spark: SparkSession, net: Net, variants: DataFrame):
        net = net.with_wait()
        self.table, self.n, self.levels = net.frame(spark), 0, LEVELS
        self.final = F.array(*[F.lit(p) for p in net.final or net.sinks])
        empty = F.array().cast("array<string>")
        self.states = start(spark, net).select("marking", empty.alias("run"), empty.alias("base"), empty.alias("more"))
        self.rows = variants.select("trace").distinct().select(empty.alias("word"), "trace", F.sequence(F.lit(0), F.size(D.visible(F.col("trace")))).alias("row"))

    def furthest(self) -> list[tuple[int, int, float]]:
        """(n, length without waits, share of distance of the nearest whole trace) of the next lengths' furthest runs from the traces cut to n."""
        levels, states = [], self.states
        for n in range(self.n + 1, self.n + self.levels + 1):
            grown = F.when(D.is_silent(F.col("label")) | (F.col("label") == D.WAIT), F.col("more")).otherwise(F.concat("more", F.array("label")))
            states = step(states, self.table).select("marking", F.concat("run", F.array("label")).alias("run"), "base", grown.alias("more"))
            levels.append(states.withColumn("n", F.lit(n)))
        self.n += self.levels
        found = settled(reduce(DataFrame.unionByName, levels).distinct(), "states").withColumn("word", F.concat("base", "more"))
        words = found.groupBy("word").agg(F.min(F.struct(F.size("more").alias("k"), "base", "more")).alias("w")).select("word", "w.base", "w.more")
        old = self.rows.withColumnRenamed("word", "base")
        fold = F.aggregate("more", F.col("row"), lambda row, x: D.indel_row(row, D.visible(F.col("trace")), x))
        self.rows = settled(old.join(few(words), "base").select("word", "trace", fold.alias("row")), "rows")
        last = found.where(F.col("n") == self.n)
        self.states = last.select("marking", "run", F.col("word").alias("base"), F.array().cast("array<string>").alias("more"))
        self.levels = LEVELS if last.limit(MANY_STATES + 1).count() <= MANY_STATES else 1

        ends = found.where(F.size(F.array_except(self.final, F.col("marking"))) == 0).select("n", "run", "word").distinct()
        cut = F.get("row", F.size(D.visible(F.slice("trace", F.lit(1), F.col("n")))))
        size = F.size(F.filter("run", lambda x: x != D.WAIT))
        both = size + F.size("trace")
        share = F.when(both == 0, 0.0).otherwise(F.element_at("row", -1) / F.greatest(both, F.lit(1)))
        each = self.rows.join(few(ends), "word").groupBy("n", F.array_join("run", " ").alias("run"), size.alias("size")).agg(F.min(cut).alias("least"), F.min(share).alias("share"))
        first = each.groupBy("n").agg(F.min(F.struct((-F.col("least")).alias("near"), "run", "size", "share")).alias("b"))
        return sorted(tuple(r) for r in first.select("n", "b.size", "b.share").collect())  # a row a length


def epsilon_precision(spark: SparkSession, net: Net, variants: DataFrame, epsilon: float, most_trials: int = 10) -> DataFrame:
    """(precision): 1 minus the largest share of distance of a full anti-alignment of n = 2, 3, ... steps, discounted by (1 + epsilon)^length.

    The anti-alignment of n steps is the furthest run from the traces cut to n; its share is that of its nearest whole trace. No longer
    run can do better once n reaches -ln(m) / ln(1 + epsilon) for some discounted share m; the search also ends after most_trials lengths
    without a larger one. A model without a full run and a log without traces give 1.
    """
    best, trials, end = 0.0, 0, math.inf
    final = F.array(*[F.lit(p) for p in net.final or net.sinks])
    full = reachable(spark, net).where(F.size(F.array_except(final, F.col("marking"))) == 0).limit(1).count()
    search = _Rows(spark, net, variants) if full and variants.limit(1).count() else None
    while search is not None and search.n < end and trials < most_trials:
        for n, size, share in search.furthest():
            if n < 2:
                continue
            if n - 1 >= end or trials >= most_trials:
                break
            m = min(1.0, share) / (1 + epsilon) ** size
            if m > 0:
                end = min(end, math.floor(-math.log(m) / math.log(1 + epsilon)))
            best, trials = max(best, m), trials + 1 if m <= best else 0
    return spark.range(1).select(F.round(F.lit(1 - best), 9).alias("precision"))
