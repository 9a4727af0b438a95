"""Whole-trace sums, alignment moves, comparison instant by instant, net comparison and repair against plain searches."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_model2 import MODEL, SMALL, TRACES, log_of

from petrilake.functions import distances as D
from petrilake.operators import alignment, artefacts, clustering, logs, netcompare, nets, repair, subnets, wholetrace
from petrilake.operators.nets import Net
from petrilake.plans.models import CHAT, SHORT, TREE


def fire(net, marking):
    """(tid, label, silent, next marking) of what can fire."""
    for tid, label, silent, pre, post in net.transitions:
        if set(pre) <= marking and not (set(post) - set(pre)) & marking:
            yield tid, label, silent, frozenset(marking - set(pre) | set(post))


def full_runs(net, most):
    """The sequences of transitions, of at most so many steps, that mark the final places."""
    final, todo, out = set(net.final or net.sinks), [(frozenset(net.initial), ())], []
    for _ in range(most + 1):
        out += [run for marking, run in todo if final <= marking]
        todo = [(after, (*run, (tid, label, silent))) for marking, run in todo for tid, label, silent, after in fire(net, marking)]
    return out


@pytest.fixture(scope="module")
def log(spark):
    return log_of(spark, TRACES)


@pytest.mark.parametrize(("net", "words"), [(MODEL, TRACES), (SMALL, ["a", "abcd", "afgh", "abibcd", "", "xyzxyz"])])
@pytest.mark.parametrize("artefact", ["anti", "multi"])
def test_sums_equal_enumeration(spark, net, words, artefact):
    table = log_of(spark, words).withColumn("n_cases", F.size("trace") + 1)
    for n in (None, 5):
        size = n or max(map(len, words))
        pairs = artefacts.run_distances(nets.runs(spark, net, size), table, size, "hamming")
        want = artefacts.best(pairs, artefact, "sum").first()
        assert wholetrace.best_sum(table, net, artefact, n).first() == want


def test_sums_of_odd_logs(spark):
    empty = log_of(spark, ["a"]).limit(0)
    assert wholetrace.best_sum(empty, MODEL, "anti").first() == ("", 0)
    assert wholetrace.best_sum(log_of(spark, ["tau"]).withColumn("trace", F.array(F.lit("tau"), F.lit(None).cast("string"))), MODEL, "anti").first().distance == 0
    stuck = Net((("a", "a", False, ("x",), ("y",)), ("b", "b", False, ("z",), ("f",))), ("x",), ("f",))
    assert wholetrace.best_sum(log_of(spark, ["aaa"]), stuck, "anti").count() == 0
    with pytest.raises(ValueError, match="unknown artefact"):
        wholetrace.best_sum(empty, MODEL, "other")
    long_ = wholetrace.best_sum(log_of(spark, ["SGFDDDD" * 60]), MODEL, "multi").first()
    assert len(long_.run.split()) == 420


def test_moves_are_optimal_alignments(spark, log):
    cost = {"".join(r.trace): r.cost for r in alignment.costs(log, MODEL).collect()}
    label = {t[0]: (t[1], t[2]) for t in MODEL.transitions}
    found = {}
    for r in alignment.moves(log, MODEL).orderBy("move").collect():
        found.setdefault("".join(r.trace), []).append((r.move, r.log_step, r.model_step))
    assert set(found) == set(TRACES)
    for trace, rows in found.items():
        assert [m for m, _, _ in rows] == list(range(1, len(rows) + 1))
        assert "".join(x for _, x, _ in rows if x != ">>") == trace
        marking = frozenset(MODEL.initial)
        for tid in (t for _, _, t in rows if t != ">>"):
            marking = {t: after for t, _, _, after in fire(MODEL, marking)}[tid]
        assert set(MODEL.sinks) <= marking
        assert all(x == ">>" or t == ">>" or label[t][0] == x for _, x, t in rows)
        assert sum(t == ">>" or (x == ">>" and not label[t][1]) for _, x, t in rows) == cost[trace]


def test_moves_of_odd_traces(spark):
    rows = [["user", "assistant"] * 200, [], ["robot"], [None, "user", "assistant"]]
    table = spark.createDataFrame([(t, 1) for t in rows], "trace array<string>, n_cases long")
    got = alignment.moves(table, CHAT).where("log_step = '>>' or model_step = '>>'").select(F.size("trace").alias("n"), "log_step", "model_step").collect()
    assert sorted((r.n, r.log_step or "", r.model_step) for r in got if r.model_step == ">>") == [(1, "robot", ">>"), (3, "", ">>")]
    assert {r.model_step for r in got} == {">>", "c2", "c5"}
    dead = Net((("a", "a", False, ("x",), ("y",)), ("b", "b", False, ("z",), ("f",))), ("x",), ("f",))
    assert alignment.moves(table, dead).count() == 0


def plain_difference(net, trace, n):
    """The least cost over all full runs of at most n steps and all ways to spread both sides over n instants."""
    trace, labels, best = trace[:n], set(net.labels), None
    for run in full_runs(net, n):
        cost = {(0, 0): 0}
        for _ in range(n):
            new = {}
            for (i, j), c in cost.items():
                ways = [(i, j, 0 if j == len(trace) else 1)]
                if i < len(run):
                    _, label, silent = run[i]
                    ways.append((i + 1, j, 0 if silent else 1))
                    if j < len(trace):
                        own = trace[j] in labels
                        ways.append((i + 1, j + 1, (1 if own else 0) if silent else (0 if label == trace[j] else 2) if own else 1))
                if j < len(trace):
                    ways.append((i, j + 1, 1))
                for a, b, more in ways:
                    new[a, b] = min(new.get((a, b), 99), c + more)
            cost = new
        end = cost.get((len(run), len(trace)))
        if end is not None and (best is None or end < best):
            best = end
    return best


@pytest.mark.parametrize("n", [4, 5, 8])
def test_aligned_difference(spark, n):
    words = [*TRACES, "", "SXGF", "GGGG"]
    got = {"".join(r.trace): r.difference for r in alignment.aligned_difference(log_of(spark, words), MODEL, n).collect()}
    assert got == {w: plain_difference(MODEL, w, n) for w in words}


def test_inner_waits_matter(spark):
    """SGDDDF fits S G D D D F A but for one step; with the last instants taken, the run must wait inside."""
    table = log_of(spark, ["SGFXXDD", "SXXGFD"])
    for r in alignment.aligned_difference(table, MODEL, 8).collect():
        assert r.difference == plain_difference(MODEL, "".join(r.trace), 8)
    assert alignment.aligned_difference(log_of(spark, ["SG"]), MODEL, 2).first().difference is None  # no full run is so short


A_B = Net((("a", "a", False, ("s",), ("p",)), ("b", "b", False, ("p",), ("e",)), ("c", "c", False, ("p",), ("s",))), ("s",), ("e",))
A_B_SHORT = Net((("a", "a", False, ("s",), ("p",)), ("b", "b", False, ("p",), ("e",)), ("t", "tau", True, ("s",), ("e",))), ("s",), ("e",))


def indel(s, t):
    row = list(range(len(t) + 1))
    for x in s:
        old, row = row, [row[0] + 1]
        for j, y in enumerate(t):
            row.append(old[j] if x == y else min(old[j + 1], row[j]) + 1)
    return row[-1]


@pytest.mark.parametrize(("first", "second"), [(A_B, A_B_SHORT), (A_B_SHORT, A_B), (SHORT, CHAT), (MODEL, SMALL), (A_B, A_B)])
@pytest.mark.parametrize("d", [0, 2])
def test_net_against_net(spark, first, second, d):
    words = lambda net, most: {tuple(label for _, label, _ in r) for r in full_runs(net, most)}
    others = words(second, 13)
    near = {u: min(indel(u, v) for v in others) for u in words(first, 7)}
    runs = spark.createDataFrame([(list(u),) for u in near], "run array<string>")
    assert {tuple(r.run.split(" ")): r.nearest for r in netcompare.nearest(runs, second).collect()} == near
    got = {tuple(r.run.split(" ")): r.nearest for r in netcompare.counterexamples(spark, first, second, d).collect()}
    assert bool(got) == any(x > d for x in near.values())
    assert all(got[u] == d + 1 < near[u] + 1 for u in got if u in near)
    assert min((len(u) for u in got), default=0) == min((len(u) for u, x in near.items() if x > d), default=0)


def plain_fitness(branches, log_rows, n):
    def cost(run, trace):
        power = lambda i: 2.0 ** (len(trace) + n - i)
        row = [0.0, *itertools.accumulate(power(j) for j in range(len(trace)))]
        for label, depth in run:
            old, row = row, [row[0] + power(depth)]
            for j, x in enumerate(trace):
                row.append(min(old[j + 1] + power(depth), row[j] + power(j), old[j] if x == label else float("inf")))
        return row[-1]

    return sum(k * min(cost(b, t) for b in branches) for t, k in log_rows)


def test_repair_runs_to_its_end(spark):
    rows = [(("user", "assistant"), 5), (("user", "assistant", "user", "assistant"), 3), (("system", "user"), 2), (("assistant",), 1)]
    table = spark.createDataFrame([(list(t), k) for t, k in rows], "trace array<string>, n_cases long")
    letters = ["user", "assistant", "system"]
    net, history = repair.repair(spark, TREE, letters, table, 6)
    here, best, want = TREE, plain_fitness(repair.branches(TREE), rows, 6), []
    while best:
        found = min((plain_fitness(repair.branches(m), rows, 6), name) for name, m in repair.candidates(here, letters) if repair.branches(m))
        if found[0] >= best:
            break
        here, best = dict(repair.candidates(here, letters))[found[1]], found[0]
        want.append((found[1], found[0]))
    assert history == want and len(want) > 3 and net == here
    assert repair.repair(spark, TREE, letters, table, 6, 2)[1] == want[:2]
    assert repair.repair(spark, TREE, letters, table.limit(0), 6) == (TREE, [])


def test_agreement_and_arcs(spark):
    first = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (9, 1)], "case_id long, cluster_id int")
    second = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "case_id long, cluster_id int")
    assert clustering.agreement(first, second).first().jaccard == pytest.approx(1 / 4)
    chosen = spark.createDataFrame([(1, ["n12"]), (2, ["n7", "gone"])], "cluster_id int, subnet array<string>")
    got = sorted(tuple(r) for r in clustering.subnet_arcs(chosen, MODEL).collect())
    assert got == [(1, "n12", "n6"), (1, "n4", "n12"), (1, "n5", "n12"), (2, "n1", "n7"), (2, "n7", "n2"), (2, "n7", "n3")]


def test_too_many_activities(spark, monkeypatch):
    monkeypatch.setattr(clustering, "MOST_ACTIVITIES", 2)
    free = spark.createDataFrame([(["a", "b", "c"],)], "trace array<string>")
    with pytest.raises(ValueError, match="activities"):
        clustering.near_words(free, free.withColumn("id", F.lit(1)), 1)


def test_sample_is_stable(spark):
    log = spark.range(50).select(F.col("id").alias("case_id"), F.array(F.lit("a")).alias("trace"))
    ids = lambda seed: [r.case_id for r in logs.sample(log.repartition(7), 10, seed).collect()]
    assert ids(1) == ids(1) != ids(2) and len(set(ids(1))) == 10
    assert D.WAIT == "w"


def test_principal_parts_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("".join(rng.choice(list("abcde"), rng.integers(0, 9))), int(rng.integers(1, 5))) for _ in range(25)]
    rows = sorted(dict(rows).items())
    table = spark.createDataFrame([(i, list(w), n) for i, (w, n) in enumerate(rows)], "id long, trace array<string>, n_cases long")
    grams = [sorted({w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)}) for w, _ in rows]
    names = sorted({g for own in grams for g in own})
    matrix = np.array([[g in own for g in names] for own in grams], float)
    weights = np.array([n for _, n in rows], float)
    _, values, right = np.linalg.svd(matrix * np.sqrt(weights)[:, None], full_matrices=False)
    found, got = clustering.principal_parts(clustering.gram_entries(table), 3)
    assert got == pytest.approx(values[:3].tolist(), rel=1e-6)
    want = matrix @ right[:3].T
    coordinates = {r.id: r.f for r in found.collect()}
    for j in range(3):
        sign = 1 if (want[:, j] * weights).sum() >= 0 else -1
        for i, (w, _) in enumerate(rows):
            assert coordinates.get(i, [0.0] * 3)[j] == pytest.approx(sign * want[i, j], abs=1e-4)
    one = table.where("id = 1")
    assert clustering.principal_parts(clustering.gram_entries(one), 4)[1][1:] == pytest.approx([0, 0, 0], abs=1e-6)  # of rank one


def test_super_instances(spark):
    words = ["abab", "abab", "abba", "", "xyz", "xyzz", "xyz", "xyz"]
    log = spark.createDataFrame([(10 + i, list(w)) for i, w in enumerate(words)], "case_id long, trace array<string>")
    rows = clustering.super_instances(log, 2, parts=2).collect()
    cluster = {r.case_id: r.cluster for r in rows}
    assert len(rows) == 8 and len({cluster[i] for i in (14, 15, 16, 17)}) == 1 and len({cluster[i] for i in (10, 11, 12)}) == 1 and cluster[10] != cluster[14]
    assert sum(r.is_medoid for r in rows) == 2 and 14 in {r.case_id for r in rows if r.is_medoid}
    assert clustering.super_instances(log.limit(0), 2).count() == 0


@pytest.mark.parametrize(("most", "transitions", "distance"), [(2, 5, 0), (2, 5, 2), (3, 5, 0), (3, 4, 1), (1, 8, 1)])
def test_subnets_by_search(spark, log, most, transitions, distance):
    full = nets.runs(spark, MODEL, 10, True)
    covered = clustering.coverage(log, full, clustering.subnets(full, transitions), distance)
    want = clustering.best_subnets(covered, most)
    score = lambda sets: sum(max([0, *(100 - 2 * r.cost for r in rows.get(w, ()) if r.subnet in sets)]) for w in TRACES) - sum(map(len, sets)) - 2 * sum(len(set(a) & set(b)) for a, b in itertools.combinations(sets, 2))
    rows = {}
    for r in covered.collect():
        rows.setdefault("".join(r.trace), []).append(r)
    got, found = subnets.best_subnets(log, MODEL, distance, transitions, most)
    assert got == score(want) and len(found) <= most and all(len(s) <= transitions for s in found)


def large_net(blocks):
    """Blocks in a row, each a choice of two concurrent pairs and a silent way around: 9 transitions a block."""
    out = []
    for i in range(blocks):
        s, e = f"s{i}", f"s{i + 1}"
        for side in "ab":
            a = f"{side}{i}"
            out.append((f"{a}split", "tau", True, (s,), (f"{a}l", f"{a}r")))
            out += [(f"{a}{w}", f"{a}{w}".upper(), False, (f"{a}{w}",), (f"{a}{w}done",)) for w in "lr"]
            out.append((f"{a}join", "tau", True, (f"{a}ldone", f"{a}rdone"), (e,)))
        out.append((f"skip{i}", "tau", True, (s,), (e,)))
    return Net(tuple(out), ("s0",), (f"s{blocks}",))


def test_subnets_of_a_large_net(spark):
    net = large_net(10)  # 90 transitions
    traces = []
    for way in ("a" * 10, "b" * 10, "ab" * 5):
        for turned in (False, True):
            traces.append([x for i, side in enumerate(way) if not (turned and i == 4) for x in ((f"{side}{i}r".upper(), f"{side}{i}l".upper()) if turned else (f"{side}{i}l".upper(), f"{side}{i}r".upper()))])
    traces.append(traces[0][:7] + ["NOISE"] + traces[0][7:])
    table = spark.createDataFrame([(t, 2 + i) for i, t in enumerate(traces)], "trace array<string>, n_cases long")
    began = time.monotonic()
    score, found = subnets.best_subnets(table, net, 1, 41, 3)
    assert time.monotonic() - began < 60
    assert len(found) == 3 and sorted(len(s) for s in found) == [41, 41, 41]
    cases = sum(2 + i for i in range(7))
    shared = sum(len(set(a) & set(b)) for a, b in itertools.combinations(found, 2))
    assert score == 100 * cases - 2 * 8 - sum(map(len, found)) - 2 * shared
    with pytest.raises(ValueError, match="sample"):
        subnets.best_subnets(spark.createDataFrame([([str(i)], 1) for i in range(65)], "trace array<string>, n_cases long"), net, 1, 41, 3)
    assert subnets.best_subnets(table.limit(0), net, 1, 41, 3) == (0, [])
