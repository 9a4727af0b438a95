"""Event logs: traces, variants, prefixes, samples, and the net that a log spells out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.functions.distances import prefix
from petrilake.operators.nets import Net


def traces(events: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """(case_id, trace): each case's activities in order. The order is sorted inside, whatever the input's."""
    rows = events.groupBy(F.col(case).alias("case_id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(activity).alias("_a")))).alias("e"))
    return rows.select("case_id", F.transform("e", lambda x: x["_a"]).alias("trace"))


def variants(log: DataFrame) -> DataFrame:
    """(trace, n_cases): equal traces as one; what follows works on these, weighted by their cases."""
    return log.groupBy("trace").agg(F.count("*").alias("n_cases"))


def prefixes(log: DataFrame, n: int) -> DataFrame:
    """Traces cut to n symbols."""
    return log.withColumn("trace", prefix(F.col("trace"), n))


def alphabet(log: DataFrame) -> DataFrame:
    """The activities of a log."""
    return log.select(F.explode("trace").alias("activity")).distinct()


def head(log: DataFrame, n: int) -> DataFrame:
    """The n traces of the smallest case ids."""
    return log.orderBy("case_id").limit(n)


def sample(log: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n traces, the same ones for the same seed."""
    return log.orderBy(F.md5(F.concat(F.lit(f"{seed} "), F.coalesce(F.col("case_id").cast("string"), F.lit(""))).cast("binary")), "case_id").limit(n)


def known_or_wait(log: DataFrame, labels: list[str]) -> DataFrame:
    """Traces with the labels that a model lacks as waits."""
    return log.withColumn("trace", F.transform("trace", lambda x: F.when(x.isin(labels), x).otherwise("w")))


def one_hot(log: DataFrame, transitions: DataFrame, n: int) -> DataFrame:
    """(case_id, pos, tid): the transitions that each of the first n positions may be, matched by label."""
    rows = log.select("case_id", F.posexplode(prefix(F.col("trace"), n)).alias("pos", "activity"))
    return rows.join(F.broadcast(transitions.where("not silent").select("tid", F.col("label").alias("activity"))), "activity").select("case_id", (F.col("pos") + 1).alias("pos"), "tid")  # a model's transitions


def to_net(log: DataFrame, n: int) -> DataFrame:
    """(src, transition, dst): one branch of places a variant, all from `init` to `end`, cut at n symbols."""
    cut = prefixes(log, n).select("trace").distinct().where(F.size("trace") > 0).withColumn("key", F.array_join("trace", " "))
    rows = cut.select("key", F.size("trace").alias("size"), F.posexplode("trace").alias("i", "activity"))
    place = F.concat("key", F.lit("/"), F.col("i").cast("string"))
    before = F.concat("key", F.lit("/"), (F.col("i") - 1).cast("string"))
    return rows.select(F.when(F.col("i") == 0, F.lit("init")).otherwise(before).alias("src"), F.concat("activity", F.lit("@"), place).alias("transition"), F.when(F.col("i") == F.col("size") - 1, F.lit("end")).otherwise(place).alias("dst"))


def follows_net(log: DataFrame) -> Net:
    """The net of what follows what: a place behind each activity, and a way to the end behind those that close a case.

    Its size is that of the alphabet squared, whatever the log's.
    """
    near = F.transform("trace", lambda x, i: F.struct(F.coalesce(F.get("trace", i - 1), F.lit("")).alias("src"), x.alias("dst"), (i == F.size("trace") - 1).alias("closes")))
    rows = sorted(tuple(r) for r in log.select(F.explode(near).alias("e")).select("e.*").distinct().collect())
    ways = {(f"{a}>{b}", b, False, (f"after {a}",), (f"after {b}",)) for a, b, _ in rows} | {(f"{a}>{b}|", b, False, (f"after {a}",), ("end",)) for a, b, closes in rows if closes}
    return Net(tuple(sorted(ways)), ("after ",), ("end",))


def follows(log: DataFrame) -> DataFrame:
    """(src, dst, n): how often one activity directly follows another. Neighbours within a trace need no shuffle but the counts'."""
    near = F.zip_with(F.slice("trace", F.lit(1), F.greatest(F.size("trace") - 1, F.lit(0))), F.slice("trace", F.lit(2), F.greatest(F.size("trace"), F.lit(1))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return log.select(F.explode(near).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("n"))
