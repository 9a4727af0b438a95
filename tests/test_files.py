import gzip

from petrilake.operators import logs, nets, repair
from petrilake.plans.models import TREE
from petrilake.sources import files

XES = """<?xml version="1.0"?><log>
<trace><string key="concept:name" value="c1"/><event><string key="concept:name" value="A"/><string key="lifecycle:transition" value="complete"/><date key="time:timestamp" value="2020-01-01T00:00:00.000+00:00"/></event>
<event><string key="concept:name" value="B"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="C"/></event></trace></log>"""
PNML = """<?xml version="1.0"?><pnml><net id="n"><page id="p">
<place id="p1"><name><text>Start</text></name><initialMarking><text>1</text></initialMarking></place><place id="p2"><name><text>End</text></name></place>
<transition id="t1"><name><text>A</text></name></transition><transition id="t2"><name><text>tau</text></name><toolspecific tool="x" version="1" activity="$invisible$"/></transition>
<arc id="a1" source="p1" target="t1"/><arc id="a2" source="t1" target="p2"/><arc id="a3" source="p1" target="t2"/><arc id="a4" source="t2" target="p2"/></page></net></pnml>"""


def test_xes(spark, tmp_path):
    for name, data in (("a.xes", XES.encode()), ("b.xes.gz", gzip.compress(XES.encode()))):
        (tmp_path / name).write_bytes(data)
        rows = files.read_xes(spark, str(tmp_path / name))
        assert sorted((r.case_id, r.pos, r.activity) for r in rows.collect()) == [("c1", 0, "A"), ("c1", 1, "B"), ("c2", 0, "C")]
    log = logs.traces(rows, "case_id", "activity", ["pos"])
    files.write_xes(log, str(tmp_path / "out"))
    again = logs.traces(files.read_xes(spark, str(tmp_path / "out")), "case_id", "activity", ["pos"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, log.collect()))


def test_pnml(spark, tmp_path):
    (tmp_path / "n.pnml").write_text(PNML)
    net = files.load_net(spark, str(tmp_path / "n.pnml"))
    assert net.initial == ("p1",) and net.sinks == ["p2"]
    assert [(t[1], t[2]) for t in net.transitions] == [("A", False), ("tau", True)]
    assert sorted("".join(r.run) for r in nets.runs(spark, net, 2, True).collect()) == ["Aw", "tauw"]


def test_qdimacs(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, -2]), (2, [3])], "clause_id int, lits array<int>")
    files.write_qdimacs(rows, [1], [2, 3], str(tmp_path / "q"))
    text = next((tmp_path / "q").glob("part-*")).read_text().split("\n")
    assert text[:5] == ["p cnf 3 2", "a 1 0", "e 2 3 0", "1 -2 0", "3 0"]
    (tmp_path / "cert").write_text("s cnf 0\nV 1 -3 0\n")
    assert sorted(r.lit for r in files.read_certificate(spark, str(tmp_path / "cert")).collect()) == [-3, 1]


def test_repair(spark):
    log = spark.createDataFrame([(["system", "user", "assistant"], 5), (["user"], 3)], "trace array<string>, n_cases long")
    start = repair.scores(spark, [("", TREE)], log, 6).first().fitness
    net, history = repair.repair(spark, TREE, ["user", "assistant", "system"], log, 6, most_rounds=2)
    assert history and history[-1][1] < start
    assert repair.scores(spark, [("", net)], log, 6).first().fitness == history[-1][1]


def test_stream(spark, tmp_path):
    from conftest import DATA

    from petrilake.streaming.events import windowed_activities

    stream = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(DATA + "/events.parquet*")
    q = windowed_activities(stream).writeStream.outputMode("complete").format("memory").queryName("acts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("acts").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
