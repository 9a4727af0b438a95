"""Event logs and models from and to files: XES, PNML and QDIMACS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.operators.nets import Net

_TEXT = "struct<_key: string, _value: string>"
_EVENT = f"struct<string: array<{_TEXT}>, date: array<struct<_key: string, _value: timestamp>>>"
XES_SCHEMA = f"string array<{_TEXT}>, event array<{_EVENT}>"


def _value(entries: str, key: str) -> str:
    return f"get(filter({entries}, x -> x._key = '{key}'), 0)._value"


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, pos, activity, instance, lifecycle, ts): the events of XES logs; .gz files are read as they are.

    The files are split by trace elements. Traces without events give no rows; missing attributes are null.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(XES_SCHEMA).load(path)
    events = traces.select(F.expr(_value("string", "concept:name")).alias("case_id"), F.posexplode("event").alias("pos", "e"))
    return events.select(
        "case_id",
        "pos",
        F.expr(_value("e.string", "concept:name")).alias("activity"),
        F.expr(_value("e.string", "concept:instance")).alias("instance"),
        F.expr(_value("e.string", "lifecycle:transition")).alias("lifecycle"),
        F.expr(_value("e.date", "time:timestamp")).alias("ts"),
    )


def write_xes(log: DataFrame, path: str) -> None:
    """Write (case_id, trace) as XES trace elements, one file a partition."""
    name = lambda key, value: F.struct(F.lit(key).alias("_key"), value.alias("_value"))
    rows = log.select(F.array(name("concept:name", F.col("case_id").cast("string"))).alias("string"), F.transform("trace", lambda a: F.struct(F.array(name("concept:name", a)).alias("string"))).alias("event"))
    rows.write.format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)


def read_pnml(spark: SparkSession, path: str) -> DataFrame:
    """(file, places, initial, transitions, labels, silent, sources, targets): one row a PNML file, arrays in the file's order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "(<pnml|<net)[^>]*?( id=\"[^\"]*\")?[^>]*>", "$1$2>").alias("x"))
    named = F.map_from_arrays(F.expr("xpath(x, '//transition[name/text/text()]/@id')"), F.expr("xpath(x, '//transition/name/text/text()')"))
    hidden = F.expr("xpath(x, '//transition[toolspecific/@activity=\"$invisible$\"]/@id')")
    ids = F.expr("xpath(x, '//transition/@id')")
    return raw.select(
        "file",
        F.expr("xpath(x, '//place/@id')").alias("places"),
        F.expr("xpath(x, '//place[number(initialMarking/text) > 0]/@id')").alias("initial"),
        ids.alias("transitions"),
        F.transform(ids, lambda t: F.element_at(named, t)).alias("labels"),
        F.transform(ids, lambda t: F.array_contains(hidden, t)).alias("silent"),
        F.expr("xpath(x, '//arc/@source')").alias("sources"),
        F.expr("xpath(x, '//arc/@target')").alias("targets"),
    )


def load_net(spark: SparkSession, path: str) -> Net:
    """The model of one PNML file; its sinks are the final places. Silent: marked invisible, or a label with tau or skip."""
    row = read_pnml(spark, path).first()
    arcs = list(zip(row.sources, row.targets, strict=True))
    out = []
    for tid, label, invisible in zip(row.transitions, row.labels, row.silent, strict=True):
        silent = bool(invisible) or not label or "tau" in label or "skip" in label
        out.append((tid, label or "tau", silent, tuple(s for s, t in arcs if t == tid), tuple(t for s, t in arcs if s == tid)))
    return Net(tuple(out), tuple(row.initial))


def write_qdimacs(clauses: DataFrame, forall: list[int], exists: list[int], path: str) -> None:
    """Write clauses(clause_id, lits) as QDIMACS text in one file, headed by the quantifiers. The clauses are sorted by id."""
    spark = clauses.sparkSession
    n, most = clauses.agg(F.count("*"), F.coalesce(F.max(F.array_max(F.transform("lits", F.abs))), F.lit(0))).first()
    most = max([most, *forall, *exists])
    head = [(i, line) for i, line in enumerate([f"p cnf {most} {n}", "a " + " ".join(map(str, [*forall, 0])), "e " + " ".join(map(str, [*exists, 0]))], -3)]
    lines = spark.createDataFrame(head, "k long, value string").unionByName(clauses.select(F.col("clause_id").cast("long").alias("k"), F.concat(F.array_join(F.transform("lits", lambda x: x.cast("string")), " "), F.lit(" 0")).alias("value")))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(path)


def read_certificate(spark: SparkSession, path: str) -> DataFrame:
    """(lit): the literals of a solver's certificate, from its lines with `V`."""
    rows = spark.read.text(path).where(F.col("value").rlike("^(c )?V"))
    return rows.select(F.explode(F.split(F.trim(F.regexp_replace("value", "^(c )?Vc?|[^0-9\\- ]", "")), " +")).alias("lit")).where("lit != '' and lit != '0'").select(F.col("lit").cast("int"))
