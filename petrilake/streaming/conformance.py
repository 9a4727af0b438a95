"""Conformance while events still arrive: keyed state that folds each event into its case's cost of being at each marking."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from petrilake.operators.alignment import FAR, MATRIX_MARKINGS, matrices
from petrilake.operators.nets import Net
from petrilake.sources.scratch import folder

#: What stands for an event without a place in the order: it comes before all others.
FIRST = -(1 << 63)


def running_costs(events: DataFrame, net: Net, case: str, activity: str, order: str) -> DataFrame:
    """(case_id, n_events, cost, prefix_cost, late) of each case after each batch in which it has events.

    events is a stream; order is a whole number. cost is that of the optimal alignment of the events so far with the net's full runs, null
    if there is none; prefix_cost that with any run, however far it gets. An event that comes in a later batch than one behind it in order
    is late: it is counted and left out. Events of one place in the order are folded by batch, then by activity (null first), repeated ones
    each. A case's state is a number a marking; one batch's events of a case meet in one task, so the trigger bounds them.
    Nets of more than MATRIX_MARKINGS markings are an error.
    """
    found = matrices(events.sparkSession, net)
    if found is None:
        raise ValueError(f"the net has more than {MATRIX_MARKINGS} markings")
    first, last, then = found
    steps = {x: np.array(rows, np.int64) for x, rows in then.items()}
    end = np.array(last, np.int64)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        costs, n, latest, late = state.get if state.exists else (first, 0, FIRST, 0)
        now, was = np.array(costs, np.int64), latest
        rows = [r for part in parts for r in zip(part["place"].tolist(), part["activity"].tolist(), strict=True)]
        for place, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            if place < was:
                late += 1
                continue
            matrix = steps.get(x)
            now = np.minimum(((steps[None] if matrix is None else matrix) + now[None]).min(axis=1), FAR)
            n, latest = n + 1, max(latest, place)
        state.update((now.tolist(), n, latest, late))
        cost = int((now + end).min())
        yield pd.DataFrame({"case": [key[0]], "n_events": [n], "cost": pd.array([cost if cost < FAR else None], "Int32"), "prefix_cost": pd.array([int(now.min())], "Int32"), "late": [late]})

    rows = events.select(F.col(case).cast("string").alias("case"), F.coalesce(F.col(order).cast("long"), F.lit(FIRST)).alias("place"), F.col(activity).cast("string").alias("activity"))
    out = "case string, n_events long, cost int, prefix_cost int, late long"
    kept = "costs array<int>, n long, latest long, late long"
    after = rows.groupBy("case").applyInPandasWithState(fold, out, kept, "update", GroupStateTimeout.NoTimeout)
    return after.withColumn("case", F.col("case").cast(events.schema[case].dataType)).withColumnRenamed("case", "case_id")


def conformance(spark: SparkSession, path: str, net: Net, case: str, activity: str, order: str, files: int = 64) -> DataFrame:
    """The last (case_id, n_events, cost, prefix_cost, late) of each case, when the stream of Parquet files at path has been read to its present end.

    A batch takes at most so many files. What a batch gives is written in the shared folder under its number, so that one that runs again
    replaces it.
    """
    place = folder(spark, "conformance")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern the path may be one file
    costs = running_costs(stream, net, case, activity, order)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    query = costs.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    types = costs.schema.add("batch", "long")
    rows = spark.read.schema(types).parquet(f"{place}/rows") if query.lastProgress else spark.createDataFrame([], types)
    return rows.groupBy("case_id").agg(F.max_by(F.struct("n_events", "cost", "prefix_cost", "late"), "batch").alias("r")).select("case_id", "r.*")
