"""Preference ranking, phrase mining and the Merkle manifest: plain versions, and nulls, ties, repeated rows, long texts, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from petrilake.llm import merkle, phrases, preference, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Preference ranking


def test_figures():
    x = dict(zip(preference.NAMES, preference.figures("The THE the\n\nends.\nthe THE the"), strict=True))
    assert x["log_words"] == pytest.approx(np.log1p(7)) and x["same_word"] == 0 and x["upper_words"] == pytest.approx(2 / 7)
    assert x["same_lines"] == 0 and x["breaks"] == pytest.approx(3 / 30) and x["distinct_words"] == pytest.approx(np.log1p(4) / np.log1p(7))
    assert preference.figures("a a b\na a b")[preference.NAMES.index("same_word")] == pytest.approx(2 / 6)
    assert np.isfinite(preference.figures(None)).all() and (preference.figures(None) == preference.figures("")).all()
    long_ = "word " * 700_000  # several blocks
    assert preference.figures(long_)[preference.NAMES.index("same_word")] == pytest.approx(699_999 / 700_000)
    assert np.isfinite(preference.figures("x" * 3_000_000)).all()


def test_newton_finds_the_least_loss(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(400, 5)) + np.array([1.0, 0, 0, -0.5, 0.2])
    scale = np.array([1.0, 2.0, 0.5, 1.0, 1.0])
    table = spark.createDataFrame([(r.tolist(),) for r in z], "z array<double>")
    w = preference._newton(table, scale, len(z))
    loss = lambda v: np.mean(np.log1p(np.exp(-(z / scale) @ v))) + preference.RIDGE / 2 * (v @ v)
    for i in range(5):
        for d in (1e-2, -1e-2):
            assert loss(w) < loss(w + d * np.eye(5)[i])


def test_ranking(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 80))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad and rnd.random() < 0.8 else w for w in words), 0 if bad else 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    ranking = preference.fit(table.select("doc_id", "text"), table.where("doc_id % 3 > 0").select("doc_id", "label"))
    odd = spark.createDataFrame([(None, None, 5), (1, "", 5), (1, "", 5), (2, "word " * 50_000, 5)], "doc_id long, text string, score int")
    got = preference.score(table.drop("label"), ranking).join(table.select("doc_id", "label"), "doc_id").where("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.97
    assert all((r.score >= preference.CUT) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got)
    strange = preference.score(odd, ranking).collect()
    assert len(strange) == 4 and len({r.score for r in strange if not r.text}) == 1
    assert preference.score(odd.limit(0), ranking).columns == ["doc_id", "text", "score", "predicted"]


def test_ranking_without_pairs(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (1, 0), (9, 0), (None, 0), (2, None)], "doc_id long, label int")
    assert preference.fit(table, labels) is None  # an id with two labels has the larger one; 9 is no document
    assert {r.score for r in preference.score(table, None).collect()} == {0.5}


def test_labels_are_bounded(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert 300 < preference.sampled(labels, 500).count() < 700
    rows = labels.select("doc_id", "label", F.array(F.lit(1.0)).alias("x")).where("doc_id < 600")
    assert 1500 < preference.pairs(rows, 2000).count() < 2700


def test_ranking_learns_from_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        bad = int(rng.random() < 0.3)
        words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(rng.integers(5, 40))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 + 0.3 * bad else w for w in words), 1 - bad))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    ranking = preference.fit(table.select("doc_id", "text"), table.select("doc_id", "label"))
    x = preference._with_bends(np.stack([preference.figures(t) for _, t, _ in rows]))
    label, w = np.array([r[2] for r in rows]), np.array(ranking.weights)
    z = (x - np.array(ranking.mean)) / np.array(ranking.scale)
    pair = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])  # over 100,000
    slope = preference.RIDGE * w - (pair / (1 + np.exp(pair @ w))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-5  # the least loss of all pairs
    assert ranking.threshold == pytest.approx(np.sort(z @ w)[(label == 0).sum()], abs=1e-9)


def test_pulls_of_bins():
    rng = np.random.default_rng(7)
    t, s = rng.normal(size=300) * 5, rng.normal(size=200) * 5
    at = np.floor(t / preference.WIDTH)
    centres = (np.unique(at) + 0.5) * preference.WIDTH
    moments = np.stack([((t[at == k] - c)[:, None] ** np.arange(preference.MOMENTS + 1)).sum(0) for k, c in zip(np.unique(at), centres, strict=True)])
    places = (np.floor(s / preference.WIDTH) + 0.5) * preference.WIDTH
    got = ((s - places)[:, None] ** np.arange(preference.MOMENTS + 1) * preference._pulls(places, centres, moments)[0]).sum(1)
    assert np.abs(got - (1 / (1 + np.exp(s[:, None] - t[None]))).sum(1)).max() < 1e-7


def test_ranked_value(spark):
    v = [3.5, -1e300, 0.0, -0.0, 2.0, 2.0, 2.0000000000000004, -7.25, 1e-320, -1e-320, 5e8]
    values = spark.createDataFrame([(x,) for x in v], "v double")
    assert [preference.ranked_value(values, i) for i in range(len(v))] == sorted(v)


def test_held_out_quality(spark):
    larger = DATA.replace("sf0.001", "sf0.01")  # 80 held-out labels
    found = queries.op11_preference(spark, larger)
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == r.quality for r in held]) >= 0.96
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.98
    assert found.count() == spark.read.parquet(f"{larger}/documents.parquet").count()


# Phrases


def plain_phrases(rows, longest, least, best):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", [Counter(), 0])
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            own[1] += len(words)
            for k in range(1, longest + 1):
                own[0].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, (f, n) in counts.items():
        phrases_ = [p for p, a in f.items() if a >= least and len(p) > 1]
        found = []
        for p in phrases_:
            if any(len(q) > len(p) and 100 * f[q] >= 80 * f[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in phrases_):
                continue
            cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    vocabulary = ["The", "a", "é", "Strong", "tea", "漢字", "x-y", "…", "of", "state", "affairs", "and"]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randrange(0, 12)):
            parts.append(rnd.choice(["strong tea", "state of affairs", "THE state", "tea tea tea tea", "é 漢字"]) if rnd.random() < 0.4 else rnd.choice(vocabulary))
            parts.append(rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ";", "\x0b"]))
        rows.append((rnd.choice(["en", "de", None]), "".join(parts)))
    return [*rows, ("en", None), ("en", ""), ("xx", "..."), *[("en", "one copy of a line")] * 40, ("fr", "tea " * 20_000)]


@pytest.mark.parametrize(("limits", "least", "best"), [({}, 5, 2000), ({"WORDS": 6, "BLOCK": 5, "PRINTS": 3, "BYTES": 200, "PLACES": 50, "FEW": 0}, 5, 2000), ({}, 2, 7)])
def test_phrases(spark, monkeypatch, limits, least, best):
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    rows = corpus() if not limits else [r for r in corpus() if r[0] != "fr"]
    table = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, a int").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine(table, 4, least, best=best).collect())
    want = plain_phrases(rows, 4, least, best)
    assert got == want and len(want) > 10


def test_no_phrases(spark):
    schema = "lang string, text string"
    for rows in ([], [("en", "a b")], [(None, None)], [("en", "a. " * 50)]):
        assert phrases.mine(spark.createDataFrame(rows, schema), 4, 30).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_trie(n):
    rng = np.random.default_rng(n)
    keys = np.unique((rng.zipf(1.5, n) % 500 + 1) << 32 | rng.integers(1, 400, n))
    trie = phrases.build(keys)
    assert trie.advance(keys >> 32, keys & 0xFFFFFFFF).tolist() == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(1, 700, 5000) << 32 | rng.integers(1, 700, 5000), keys)
    assert (trie.advance(other >> 32, other & 0xFFFFFFFF) == -1).all()


def test_large_numbers(spark):
    rows = [("en", ["a", "b"], 4 * 10**12, [10**13, 4 * 10**12], [10**13, 4 * 10**12])]
    level = spark.createDataFrame(rows, "lang string, words array<string>, a long, heads array<bigint>, tails array<bigint>")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    assert phrases._ranked([level], totals, (80, 100), 10, 2_000_000).first().score == 2_000_000 * 4 * 10**12 // (2 * 10**13)


# Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    """rows: (key, group, text); (key, leaf) to (subroot, root, path) for rows of distinct (key, leaf)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for key, group, text in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, sha(field(key) + field(text))))

    def tree(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for leaf, i in enumerate(at):
                start = i // 16 * 16
                paths[leaf] += ["".join(level[start:i]), "".join(level[i + 1 : start + 16])]
                at[leaf] = i // 16
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], paths

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    each = {g: (sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])])) for g in order}
    root, tops = tree([each[g][1] for g in order])
    return sorted((g is not None, g or "", has, key, leaf, subroot, root, path + top) for (g, (leaves, subroot, paths)), top in zip(each.items(), tops, strict=True) for (has, key, leaf), path in zip(leaves, paths, strict=True))


def got_manifest(table):
    rows = merkle.manifest(table, "doc_id", "source", ["doc_id", "text"]).collect()
    return sorted((r.source is not None, r.source or "", r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.path) for r in rows)


MERKLE = "doc_id long, source string, text string"


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 2], [4096], [4097, 30], [300, 0, 5000, 1]])
def test_manifest(spark, sizes):
    rows = [(7 * i, None if g == 1 else f"s{g}é", f"text {i % 90}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, MERKLE).repartition(5)
    assert got_manifest(table) == plain_manifest(rows)


def test_many_groups(spark):
    rows = [(i, f"s{i % 700}", None) for i in range(900)]
    assert got_manifest(spark.createDataFrame(rows, MERKLE)) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", "x"), (None, "a", None), (None, None, ""), (3, "a", "x"), (3, "a", "y"), (3, "a", "y"), (3, "a", "y"), (-5, "", "漢" * 200_000)] + [(9, "hot", "same")] * 50
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], MERKLE + ", path string, at int")
    assert got_manifest(table) == plain_manifest(rows)
    empty = merkle.manifest(table.limit(0), "doc_id", "source", ["doc_id", "text"])
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "leaf", "subroot", "root", "path"]


def test_tampering_shows(spark):
    table = spark.createDataFrame([(i, f"s{i % 3}", f"Text {i}") for i in range(100)], MERKLE)
    changed = merkle.leaf([F.col("doc_id"), F.lower("text")])
    found = merkle.manifest(table.withColumn("new", F.when(F.col("doc_id") % 10 == 0, changed)), "doc_id", "source", ["doc_id", "text"], carry="new")
    rows = found.select("doc_id", (merkle.folded(F.coalesce("new", "leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("true")).collect()
    assert all(r.true for r in rows) and all(r.ok == (r.doc_id % 10 > 0) for r in rows)


@pytest.mark.parametrize("name", ["op12_phrases", "op13_merkle"])
def test_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.sql(f"select {columns} from ({queries.ORACLES[name]})").fetchall())
