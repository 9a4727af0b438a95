"""Known values of two small models and their logs."""

import pytest
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators import alignment, artefacts, clustering, nets, repair
from petrilake.operators.nets import Net
from petrilake.plans.models import CHAT
from petrilake.sources.scratch import settled

MODEL = Net(
    (
        ("n7", "S", False, ("n1",), ("n2", "n3")),
        ("n8", "C", False, ("n2",), ("n4",)),
        ("n9", "F", False, ("n2",), ("n4",)),
        ("n10", "G", False, ("n3",), ("n5",)),
        ("n11", "B", False, ("n3",), ("n5",)),
        ("n12", "A", False, ("n4", "n5"), ("n6",)),
        ("tau", "tau", True, ("n4", "n5"), ("n6",)),
        ("n14", "D", False, ("n5",), ("n5",)),
    ),
    ("n1",),
)
TRACES = ["SCG", "SCGD", "SBFA", "SFBA", "SFFA", "SGFDD", "SGFDDDD", "SDDD", "GCFSDD"]
SMALL = Net(
    (
        ("a", "a", False, ("n1",), ("n2", "n3")), ("b", "b", False, ("n2",), ("n4",)), ("c", "c", False, ("n3",), ("n5",)), ("d", "d", False, ("n4", "n5"), ("n6",)),
        ("e", "e", False, ("n4", "n5"), ("n6",)), ("f", "f", False, ("n2", "n3"), ("n7",)), ("g", "g", False, ("n7",), ("n8",)), ("h", "h", False, ("n8",), ("n6",)), ("i", "i", False, ("n4",), ("n2",)),
    ),
    ("n1",),
)


def log_of(spark, words):
    return spark.createDataFrame([(list(w), 1) for w in words], "trace array<string>, n_cases long")


@pytest.fixture(scope="module")
def log(spark):
    return log_of(spark, TRACES)


@pytest.fixture(scope="module")
def edit(spark, log):
    return settled(artefacts.run_distances(nets.runs(spark, MODEL, 8), log, 8, "edit"))


@pytest.fixture(scope="module")
def hamming(spark, log):
    return settled(artefacts.run_distances(nets.runs(spark, MODEL, 8), log, 8, "hamming"))


def test_runs(spark):
    assert nets.runs(spark, MODEL, 8).count() == 190
    assert nets.runs(spark, MODEL, 8, True).count() == 160
    assert nets.reachable(spark, MODEL).count() == 6
    assert nets.reachable(spark, SMALL).count() == 8


def test_optima(edit, hamming):
    value = lambda pairs, *how: artefacts.best(pairs, *how).first().distance
    assert value(edit, "anti", "min") == value(hamming, "anti", "min") == 4
    assert (value(edit, "anti", "sum"), value(hamming, "anti", "sum")) == (67, 56)
    assert (value(edit, "multi", "sum"), value(hamming, "multi", "sum")) == (29, 18)
    found = artefacts.best(edit, "multi", "min").first()
    assert (found.run, found.distance) == ("S G F D tau w w w", 4)
    assert value(hamming, "multi", "min") == 4


def test_precision(edit, hamming):
    best = artefacts.best(edit, "anti", "min")
    assert artefacts.precision(edit, best, 8, "bounded", 14).first().precision == pytest.approx(0.7142857142857143, abs=1e-9)
    assert artefacts.precision(edit, best, 8, "edit", 14).first().precision in (0.6, 0.666666667)
    assert len(best.first().run.split()) == 8


def test_small_anti_alignment(spark):
    log = log_of(spark, ["a", "abcd", "afgh", "abibcd"])
    for n, d in ((4, 3), (6, 4), (8, 6)):
        pairs = artefacts.run_distances(nets.runs(spark, SMALL, n, True), log, n, "edit")
        assert artefacts.best(pairs, "anti", "min").first().distance == d


def test_alignment_both_ways(spark, log):
    expected = dict(zip(TRACES, [0, 0, 0, 0, 2, 0, 0, 2, 3], strict=True))
    by_runs = alignment.costs_to_runs(log, nets.runs(spark, MODEL, 9, True))
    assert {"".join(r.trace): r.cost for r in by_runs.collect()} == expected
    few = log.where(F.array_join("trace", "").isin("SFFA", "SBFA", "SDDD"))
    searched = alignment.costs_by_search(few, MODEL, 8, settled)
    assert {"".join(r.trace): r.cost for r in searched.collect()} == {"SFFA": 2, "SBFA": 0, "SDDD": 2}


@pytest.mark.parametrize(("most", "score", "sizes"), [(0, 389, [2, 2, 2, 3]), (2, 773, [1, 3, 5])])
def test_clusters(spark, log, most, score, sizes):
    full = nets.runs(spark, MODEL, 8, True)
    covered = clustering.coverage(log, full, clustering.subnets(full, 5), most)
    pair = clustering.best_pair(covered)
    assert pair.first().score == score
    if most:
        counts = clustering.assign(log, covered, pair).groupBy("cluster_id").count().collect()
        assert sorted(r["count"] for r in counts) == sizes


@pytest.mark.parametrize(("most", "sizes"), [(0, [2, 2, 2, 3]), (2, [1, 3, 5])])
def test_sampled_clusters(spark, log, most, sizes):
    found, chosen = clustering.sampled_clusters(log, MODEL, 9, 8, most, 5, 2)
    counts = {r.cluster_id: r["count"] for r in found.groupBy("cluster_id").count().collect()}
    assert sorted(counts.values()) == sizes and None in counts and found.count() == 9
    assert all(len(s) <= 5 for s in chosen)


def test_three_clusters(spark, log):
    covered = clustering.coverage(log, nets.runs(spark, MODEL, 8, True), clustering.subnets(nets.runs(spark, MODEL, 8, True), 5), 0)
    two, three = clustering.best_subnets(covered, 2), clustering.best_subnets(covered, 3)
    assert len(two) == 2 and len(three) == 3
    assert clustering.best_subnets(covered.limit(0), 2) == []


def test_alignment_of_any_length(spark):
    chat = log_of(spark, [])
    rows = [["user", "assistant"] * 4, ["user", "assistant"] * 40, ["system"], [], ["user"], ["user", "robot", "assistant"], ["assistant", "user"]]
    chat = spark.createDataFrame([(t, 1) for t in rows], chat.schema)
    got = {tuple(r.trace): r.cost for r in alignment.costs(chat, CHAT).collect()}
    assert [got[tuple(t)] for t in rows] == [0, 0, 0, 0, 1, 1, 2]
    short = chat.where(F.size("trace") < 9)
    assert {tuple(r.trace): r.cost for r in alignment.costs_by_search(short, CHAT).collect()} == {k: c for k, c in got.items() if len(k) < 9}
    dead = Net((("a", "a", False, ("x",), ("y",)), ("b", "b", False, ("z",), ("f",))), ("x",), ("f",))
    assert [r.cost for r in alignment.costs(chat.limit(1), dead).collect()] == [None]


def test_alignment_matrices(spark, log, monkeypatch):
    want = {"".join(r.trace): r.cost for r in alignment.costs_to_runs(log, nets.runs(spark, MODEL, 9, True)).collect()}
    assert {"".join(r.trace): r.cost for r in alignment.costs(log, MODEL).collect()} == want
    monkeypatch.setattr(alignment, "MATRIX_MARKINGS", 2)  # searched level by level
    assert {"".join(r.trace): r.cost for r in alignment.costs(log, MODEL).collect()} == want


def test_near_words(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    free, taken = [list(w) for w in ("", "a", "abc", "abcd", "bbbb", "xyz", "abca")], [list(w) for w in ("ab", "abd", "bbb", "b")]
    f = spark.createDataFrame([(t,) for t in free], "trace array<string>")
    t = spark.createDataFrame([(t, i) for i, t in enumerate(taken)], "trace array<string>, id int")
    for k in (0, 1, 2):
        want = {tuple(a): min(i for i, b in enumerate(taken) if edits(a, b) <= k) for a in free if any(edits(a, b) <= k for b in taken)}
        assert {tuple(r.trace): r.id for r in clustering.near_words(f, t, k).collect()} == want


def test_repair_of_odd_nets():
    loop = Net((("a", "a", False, ("p",), ("q",)), ("b", "b", False, ("q",), ("p",)), ("c", "c", False, ("q",), ("r",))), ("p",), ("r",))
    assert repair.branches(loop) == [[("a", 2), ("c", 3)]]
    with pytest.raises(ValueError, match="tree"):
        repair.branches(MODEL)
    assert repair.candidates(loop, [None, "x"])


def test_distances(spark):
    rows = spark.createDataFrame([(list("abc"), list("acd")), ([], list("ab")), (list("ab"), []), (["a", "tau", "w"], ["a"]), (["skip"], ["b"])], "s array<string>, t array<string>")
    assert [r[0] for r in rows.select(D.indel(F.col("s"), F.col("t"))).collect()] == [2, 2, 2, 0, 1]
    padded = rows.select(D.padded(F.col("s"), 3).alias("s"), D.padded(F.col("t"), 3).alias("t"))
    assert [r[0] for r in padded.select(D.hamming(F.col("s"), F.col("t"))).collect()] == [2, 2, 2, 0, 0]


def test_unknown_distance(spark, log):
    with pytest.raises(ValueError, match="unknown distance"):
        artefacts.run_distances(nets.runs(spark, MODEL, 2), log, 2, "other")
