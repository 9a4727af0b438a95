"""The stream of costs against whole traces' alignments, and the precision's search against a list of all runs."""

import math
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_model2 import MODEL, SMALL, TRACES, log_of
from test_whole import fire

from petrilake.operators import alignment, artefacts
from petrilake.operators.nets import Net
from petrilake.plans.models import CHAT
from petrilake.streaming.conformance import conformance

#: What each file brings, as (case, place, activity); one file is one batch.
BATCHES = [
    [(1, 0, "system"), (1, 1, "user"), (2, 5, "user"), (3, 0, "user"), (3, 0, "user"), (None, 0, "robot")],
    [(1, 2, "assistant"), (2, 4, "system"), (2, 5, "assistant"), (3, 1, None), (4, None, "assistant"), (4, 0, "user")],
    [(4, None, "user"), (4, 1, "assistant"), (2, 6, "user"), (2, 3, "user")] + [(5, i, ("user", "assistant")[i % 2]) for i in range(300)],
]
#: The events of each case as they are folded, and how many were late.
FOLDED = {1: (["system", "user", "assistant"], 0), 2: (["user", "assistant", "user"], 2), 3: (["user", "user", None], 0), 4: (["assistant", "user", "assistant"], 1), 5: (["user", "assistant"] * 150, 0), None: (["robot"], 0)}


@pytest.fixture
def files(tmp_path):
    for i, rows in enumerate(BATCHES):
        case, place, activity = zip(*rows, strict=True)
        pq.write_table(pa.table({"c": pa.array(case, pa.int64()), "p": pa.array(place, pa.int32()), "a": pa.array(activity, pa.string()), "cost": ["other"] * len(rows)}), f := tmp_path / f"{i}.parquet")
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    return str(tmp_path)


def test_stream_equals_alignments(spark, files):
    got = {r.case_id: r for r in conformance(spark, files, CHAT, "c", "a", "p", files=1).collect()}
    assert set(got) == set(FOLDED)
    log = spark.createDataFrame([(trace, 1) for trace, _ in FOLDED.values()], "trace array<string>, n_cases long")
    costs = {tuple(r.trace): r.cost for r in alignment.costs(log, CHAT).collect()}
    for case, (trace, late) in FOLDED.items():
        r = got[case]
        assert (r.n_events, r.cost, r.late) == (len(trace), costs[tuple(trace)], late)
        assert r.prefix_cost <= r.cost
    assert (got[1].prefix_cost, got[4].prefix_cost, got[5].prefix_cost) == (0, 1, 0)


def test_stream_in_one_batch_sorts_all(spark, files):
    """Nothing is late within a batch; a model without an end has no cost."""
    got = {r.case_id: r for r in conformance(spark, files, CHAT, "c", "a", "p").collect()}
    assert all(r.late == 0 for r in got.values()) and got[2].n_events == 5
    dead = Net((("a", "user", False, ("x",), ("y",)), ("b", "b", False, ("z",), ("f",))), ("x",), ("f",))
    assert {(r.case_id, r.cost, r.prefix_cost) for r in conformance(spark, files, dead, "c", "a", "p").collect()} >= {(1, None, 2), (3, None, 2)}


def test_stream_of_nothing(spark, tmp_path):
    pq.write_table(pa.table({"c": pa.array([], pa.int64()), "p": pa.array([], pa.int32()), "a": pa.array([], pa.string())}), tmp_path / "none.parquet")
    assert conformance(spark, str(tmp_path / "none.parquet"), CHAT, "c", "a", "p").count() == 0


def indel(s, t):
    row = list(range(len(t) + 1))
    for x in s:
        new = [row[0] + 1]
        for j, y in enumerate(t, 1):
            new.append(row[j - 1] if x == y else min(new[-1], row[j]) + 1)
        row = new
    return row[-1]


def plain_precision(net, words, epsilon, most_trials):
    net, best, trials, end, n = net.with_wait(), 0.0, 0, math.inf, 1
    states = {(frozenset(net.initial), ())}
    seen = lambda run: [x for x in run if x != "w" and "tau" not in x]
    while True:
        states = {(after, (*run, label)) for marking, run in states for _, label, _, after in fire(net, marking)}
        if n >= 2:
            if n - 1 >= end or trials >= most_trials:
                return round(1 - best, 9)
            ends = {run for marking, run in states if set(net.final) <= marking}
            if ends:
                _, run = min((-min(indel(seen(r), t[:n]) for t in words), " ".join(r)) for r in ends)
                run = run.split()
                size = sum(x != "w" for x in run)
                m = min(1.0, min(indel(seen(run), t) / (len(t) + size) for t in words)) / (1 + epsilon) ** size
                end = min(end, math.floor(-math.log(m) / math.log(1 + epsilon))) if m > 0 else end
                best, trials = max(best, m), trials + 1 if m <= best else 0
        n += 1


@pytest.mark.parametrize(("net", "words", "epsilon", "trials"), [(MODEL, TRACES, 0.2, 2), (MODEL, TRACES, 0.5, 9), (SMALL, ["a", "abcd", "afgh", "abibcd", "", "xyzxyz"], 0.3, 2)])
def test_precision_by_kept_rows_equals_all_runs(spark, net, words, epsilon, trials):
    got = artefacts.epsilon_precision(spark, net, log_of(spark, words), epsilon, trials).first().precision
    assert got == pytest.approx(plain_precision(net, words, epsilon, trials), abs=1e-9)


def test_precision_of_nothing(spark):
    assert artefacts.epsilon_precision(spark, CHAT, log_of(spark, ["a"]).limit(0), 0.1).first().precision == 1
    dead = Net((("a", "a", False, ("x",), ("y",)), ("b", "b", False, ("z",), ("f",))), ("x",), ("f",))
    assert artefacts.epsilon_precision(spark, dead, log_of(spark, ["a"]), 0.1).first().precision == 1
