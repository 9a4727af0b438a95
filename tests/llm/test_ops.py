"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain

from petrilake.llm import bpe, chunks, decontaminate, licenses, linededup, ngram_join, ppm, quality, sharding, token_files, url_filter
from petrilake.llm.common import scratch_path

RND = random.Random(5)
VOCABULARY = ["".join(RND.choice(["th", "an", "er", "é", "ó", "st", "X"]) for _ in range(RND.randrange(1, 4))) for _ in range(300)]


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


SHARED = [prose(12) for _ in range(3)]
BASE = prose(120)
ITEMS = [(7, prose(30)), (8, prose(4)), (9, None), (10, ""), (11, "Ünique-word"), (None, prose(20)), (7, prose(15))]
TEXTS = [
    None, "", " \n\t ", "one", "three little words", BASE, BASE, BASE.upper(), BASE + " and more", "x " + BASE + " y z", prose(60) + "\n" + SHARED[0] + "\n" + prose(3),
    SHARED[0] + "\n" + SHARED[1], "\n".join(SHARED), "  " + SHARED[0].upper() + "\t\n" + SHARED[1], prose(80) + " " + ITEMS[0][1] + ", " + prose(5), "... " + ITEMS[1][1], "ünique word ÜNIQUE", ITEMS[0][1] + ITEMS[6][1],
    prose(9000), "a a a a a a b\n" * 12, prose(100).replace(" ", "### "), "é" * 3000, "漢字 かな 😀  \u00a0 x", "line\n\nline\n \nline", prose(200),
]
for _ in range(12):  # near copies of one text
    w = BASE.split()
    w[RND.randrange(len(w))] = RND.choice(VOCABULARY)
    TEXTS.append(" ".join(w))
ROWS = list(enumerate(TEXTS))
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lines(docs, none, spark):
    want = plain.kept_lines(ROWS)
    got = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("mine")).withColumn("_drop", F.lit(1))).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == want and any(d for _, _, d in want.values())
    assert linededup.dedup_lines(none).count() == 0
    same = spark.createDataFrame([(1, SHARED[0]), (1, SHARED[0]), (None, SHARED[0]), (2, SHARED[0])], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_dropped) for r in linededup.dedup_lines(same).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize(("docs_of", "most"), [(1, 2), (4, 1000)])
def test_lines_hot(docs, monkeypatch, docs_of, most):
    monkeypatch.setattr(linededup, "HOT_DOCS", docs_of)
    monkeypatch.setattr(linededup, "HOT_LINES", most)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).collect()}
    assert got == plain.kept_lines(ROWS)


def test_jaccard(docs, none, spark):
    want = plain.jaccard_components(ROWS)
    got = ngram_join.join_components(docs.withColumn("n", F.lit(1)).withColumn("a", F.lit(2))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10
    assert ngram_join.join_components(none).count() == 0
    again = spark.createDataFrame([(3, BASE), (3, BASE), (None, BASE), (4, None), (None, None)], SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.join_components(again).collect()) == [(0, 0), (0, 3), (3, 3), (3, 3), (4, 4)]


def test_shingles_of_many_texts(monkeypatch):
    def plain_set(text: str | None) -> set[tuple[str, ...]]:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    rnd = random.Random(6)
    long_ = [rnd.choice("abc") * rnd.randrange(1, 50) for _ in range(3000)]  # words longer and shorter than the table of places
    texts = [*TEXTS, None, "", " \t\x0b", "One", "x" * 5000 + " y", "x" * 4999 + "z y", "ab\0 ab \x0c c d É é", " ".join(long_)]
    for block in (1 << 16, 64):  # together, and in pieces
        monkeypatch.setattr(ngram_join, "TEXTS", block)
        got = list(ngram_join.shingle_sets(texts, 5))
        assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
        assert len(set(np.concatenate(got).tolist())) == len(set.union(*map(plain_set, texts)))  # one hash a shingle, in whichever text
        assert all((ngram_join.shingle_set(t, 5) == s).all() for t, s in zip(texts, got, strict=True))


def test_frequent_shingles(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    s, power = ngram_join.frequent_shingles(docs.coalesce(1), 5)
    counts = Counter(x for t in TEXTS for x in ngram_join.shingle_set(t, 5).tolist())
    assert dict(zip(s.tolist(), power.tolist(), strict=True)) == {x: n.bit_length() - 1 for x, n in counts.items() if n > 1}


def test_jaccard_cells(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)  # every region of the copies is dealt into cells
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    got = ngram_join.join_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard_components(ROWS)


def test_jaccard_cells_occur(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    copies = docs.where("doc_id >= 25").coalesce(1)  # near copies of one text
    cells = ngram_join.placed(copies, 5, 80, ngram_join.frequent_shingles(copies, 5)).where("shingle is not null")
    assert cells.where("cell > 0").count() > 0
    assert cells.groupBy("shingle", "cell").count().agg(F.max("count")).first()[0] < copies.count()


def test_jaccard_lone_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 1)  # about as many cells as texts
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    short = [" ".join(f"{RND.randrange(1 << 30):x}" for _ in range(8)) for _ in range(6)]
    rows = list(enumerate([*short, *[f"{t} end{i}" for t in short for i in range(7)], *TEXTS[25:]]))  # 4 of 5 shingles shared
    got = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard_components(rows)


def test_random_near_copies(spark):
    rows = []
    for i in range(150):
        w = prose(40).split() if i % 10 == 0 else rows[-1][1].split()
        for _ in range(RND.randrange(0, 3)):
            w[RND.randrange(len(w))] = RND.choice(VOCABULARY)
        rows.append((i, " ".join(w)))
    got = ngram_join.join_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.jaccard_components(rows)


def test_contamination(docs, none, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain.contamination(ROWS, [x for x in ITEMS if x[0] is not None])
    got = decontaminate.find_contamination(docs.withColumn("items", F.lit(3)), items).collect()
    assert {r.doc_id: (r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) for r in got} == want
    assert sum(bool(x[1]) for x in want.values()) >= 3
    assert decontaminate.find_contamination(none, items).count() == 0
    assert {r.n_words for r in decontaminate.find_contamination(docs.where("doc_id = 4"), items.limit(0)).collect()} == {3}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, items).collect()}
    assert all(cut[i] == t for i, t in ROWS if not want[i][1])
    assert all(not x[1] for x in plain.contamination([(i, cut[i]) for i in (14, 15)], [x for x in ITEMS if x[0] is not None]).values())


def test_contamination_in_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.find_contamination(docs, items).collect()
    want = plain.contamination(ROWS, [x for x in ITEMS if x[0] is not None])
    assert {r.doc_id: (sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) for r in got} == {i: x[1:] for i, x in want.items()}


def test_fm_index():
    for _ in range(20):
        runs = [[RND.randrange(1, 5) for _ in range(RND.randrange(1, 40))] for _ in range(RND.randrange(1, 8))]
        s = np.array([x for r in runs for x in (*r, 0)])
        index = decontaminate.FmIndex(s, 4)
        for n in (1, 2, 3):
            p = np.array([[RND.randrange(1, 5) for _ in range(n)] for _ in range(10)])
            lo, hi = index.search(p)
            for k in range(10):
                found = sorted(index.locate(np.arange(lo[k], hi[k])).tolist())
                assert found == [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[k]).all()]


def test_quality(docs, none):
    lang = lambda i: None if i % 7 == 0 else "xx" if i == 5 else "en"
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.when(F.col("doc_id") == 5, "xx").otherwise("en"))).withColumn("kept", F.lit("mine"))
    got = {r.doc_id: r for r in quality.judge(rows).collect()}
    assert len(got) == len(ROWS)
    want = plain.quality_distances([(i, lang(i), t) for i, t in ROWS])
    for i, t in ROWS:
        r = got[i]
        assert (r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (t, *plain.base_quality(t))
        if want[i][0] is None:
            assert r.word_distance is r.class_distance is None and r.kept == (not r.base_failed)
        else:
            assert (r.word_distance, r.class_distance) == pytest.approx(want[i], abs=1e-7)
            assert r.kept == (not r.base_failed and (r.n_words < 80 or r.word_distance <= 0.4 and r.class_distance <= 0.32))
    assert got[24].kept and not got[20].kept  # prose stays, symbols in every word go
    assert quality.judge(none.withColumn("lang", F.lit("en"))).count() == 0


def test_quality_rare_languages(spark):
    greek = lambda n: " ".join("".join(RND.choice("αβγδεηικλμνοπρσςτυω") for _ in range(RND.randrange(2, 9))) for _ in range(n))
    rows = [(i, "en", prose(100)) for i in range(1100)] + [(2000, "el", greek(1200)), (2001, "ru", greek(300)), (2002, None, greek(300)), (2003, "en", greek(300))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string"), columns=["doc_id"]).collect()}
    assert got[2000].kept and got[2000].class_distance == pytest.approx(0, abs=1e-6)  # under 0.1 % of the documents, but enough words
    assert got[2001].kept and got[2001].class_distance is None and got[2002].kept  # no reference to diverge from
    assert not got[2003].kept and got[2003].class_distance > 0.7
    docs = spark.createDataFrame(rows[:200], "doc_id long, lang string, text string")
    other = {r.doc_id: r.kept for r in quality.judge(docs.unionByName(docs.sparkSession.createDataFrame([(3000, "en", greek(200))], docs.schema)), refs=quality.references(docs)).collect()}
    assert not other.pop(3000) and other == {r.doc_id: r.kept for r in quality.judge(docs).collect()}


def test_js_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.25, 0.75], [0.5, 0.5])], "p array<double>, q array<double>")
    got = [r[0] for r in rows.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    m = [0.375, 0.625]
    third = math.sqrt(sum(a * math.log2(a / x) / 2 for a, x in zip([0.25, 0.75, 0.5, 0.5], m + m, strict=True)))
    assert got == pytest.approx([1, 0, third])


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe(docs, none):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    coded = bpe.encode(docs.withColumn("ids", F.lit(1)), PATH, public_tokenizers.PATTERN)
    for r in bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and r.decoded == (r.text or "").encode()
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_round_trip(docs, none, spark, tmp_path):
    coded = bpe.encode(docs.withColumn("round_trip", F.lit(1)).withColumn("x", F.lit("x")), PATH, public_tokenizers.PATTERN, ["x", "doc_id"], round_trip=True)
    assert coded.columns == ["x", "doc_id", "ids", "n_tokens", "round_trip"]
    want = {(r.doc_id, bytes(r.ids), r.n_tokens, r.decoded == (r.text or "").encode()) for r in bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()}
    got = coded.collect()
    assert {(r.doc_id, bytes(r.ids), r.n_tokens, r.round_trip) for r in got} == want and {r.x for r in got} == {"x"}
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN, ["doc_id"], round_trip=True).count() == 0
    broken = tmp_path / "broken.tiktoken"  # a and b have one rank, which decodes to b
    broken.write_text("".join(f"{base64.b64encode(bytes([x])).decode()} {98 if x == 97 else x}\n" for x in range(256)) + f"{base64.b64encode(b'yz').decode()} 256\n")
    rows = spark.createDataFrame([(1, "b c"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in bpe.encode(rows, str(broken), public_tokenizers.PATTERN, ["doc_id"], round_trip=True).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_bpe_odd_texts():
    import tiktoken

    assert chunks.PATTERN == public_tokenizers.PATTERN
    coder = bpe.coder(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for _ in range(1500):
        t = "".join(RND.choice(" \n\t ab'sé漢1?.   \r😀\u00a0\x1c\x85\u2028Z") for _ in range(RND.randrange(0, 80)))
        assert "".join(chunks.cut(t)) == t
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == library.encode_ordinary(t)


def test_token_files(docs, none, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # the other way, added=False; the next test has the library's default
    folder = scratch_path(spark, "tokens")
    odd = spark.createDataFrame([(100, "a  b \n\n c<|endoftext|>  "), (101, "\r\n x'll 12é ")], SCHEMA)
    manifest = token_files.write_tokens(docs.unionByName(odd), path, folder, sequence=64, added=False)
    got = sorted(token_files.read_documents(manifest, folder).collect(), key=lambda r: r.doc_id)
    start = 0
    for (i, t), r in zip([*ROWS, *[tuple(x) for x in odd.collect()]], got, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = manifest.orderBy("shard").first()
    reader = token_files.ShardReader(folder, shard.shard)
    n = -(-shard.n_ids // 64)
    masks = [sum(reader.sequence_at(k)[1].to_pylist()) for k in range(n)]
    assert masks[:-1] == [64] * (n - 1) and sum(masks) == shard.n_ids
    empty = token_files.write_tokens(none, path, scratch_path(spark, "tokens"))
    assert empty.count() == 0


def test_tokenizer_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), token_files.CachedTokenizer(path)
    texts = ["".join(RND.choice(" \n\t ab'sé漢1?.   \r😀\u00a0\x1c\x85\u2028Z") for _ in range(RND.randrange(0, 80))) for _ in range(3000)] + ["a<|endoftext|> b", "<|endoftext|>", "a <|endoftext|\n>"]
    for i in range(0, len(texts), 50):
        got = coder.encode(texts[i : i + 50])
        for t, ids in zip(texts[i : i + 50], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_added_tokens(spark, tmp_path):
    from petrilake.llm import queries
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a<|endoftext|>b"), (2, "plain text"), (3, " <|endoftext|> <|endoftext|>\n"), (4, None), (5, "<|endoftext")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, str(tmp_path)).collect()}
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()} and 50256 in ids[1]


def test_shards(spark, none):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("shard"))
    got = sharding.shard(rows, "doc_id", 24).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 3000 and {len(s) for s in slots.values()} == {125} and all(sorted(s) == list(range(125)) for s in slots.values())
    more = {r.doc_id: r.shard for r in sharding.shard(rows, "doc_id", 25, load_factor=1.25).collect()}
    fewer = {r.doc_id: r.shard for r in sharding.shard(rows, "doc_id", 24, load_factor=1.25).collect()}
    assert max(Counter(fewer.values()).values()) <= -(-3000 * 1.25 // 24)
    assert sum(more[i] != fewer[i] for i in more) < 0.25 * 3000  # dealing anew by modulo would move 0.96
    same = spark.createDataFrame([(1,)] * 50 + [(None,)] * 50, "doc_id long")
    assert {r["count"] for r in sharding.shard(same, "doc_id", 4).groupBy("shard").count().collect()} == {25}
    assert sharding.shard(none.select("doc_id"), "doc_id", 24).count() == 0


def test_sharding_against_a_ring_walked_by_rows(spark):
    keys = [*range(-40, 900), *(k * 7919 for k in range(200)), *[None] * 30, *[5] * 200]  # a null key and a key of many rows
    rows = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, tie long").repartition(7)
    for shards, vnodes, factor in ((24, 64, None), (25, 64, None), (24, 64, 1.25), (3, 2, None), (1, 1, 1.0), (5, 1, 1.1)):
        got = {(r.doc_id, r.tie): (r.shard, r.slot) for r in sharding.shard(df, "doc_id", shards, vnodes, factor, order=["doc_id", "tie"]).collect()}
        n = len(rows)
        capacity = [n // shards + (s < n % shards) for s in range(shards)] if factor is None else [-int(-factor * n // shards)] * shards
        assert got == plain.ring(rows, shards, vnodes, capacity)


def test_sharding_by_exact_quotas_moves_few_rows(spark):
    ids = spark.range(40000).withColumnRenamed("id", "doc_id")
    old, new = ({r.doc_id: r.shard for r in sharding.shard(ids, "doc_id", n).collect()} for n in (24, 25))
    assert max(Counter(new.values()).values()) - min(Counter(new.values()).values()) <= 1
    moved = [i for i in old if old[i] != new[i]]
    assert len(moved) < 0.09 * len(old)  # at least 0.04 go to the new shard
    assert sum(new[i] != 24 for i in moved) < 0.05 * len(old)


def test_ppm(docs, none):
    got = {r.doc_id: r for r in ppm.score(docs.withColumn("score", F.lit("mine"))).collect()}
    tokens = lambda t: [*plain.words(plain.low(t or "")), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in ROWS}
    counts = Counter(w for i, t in ROWS if not held[i] for w in tokens(t))
    n, v = counts.total(), len(counts)
    for i, t in ROWS:
        w, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert ppm.score(none).count() == 0


def test_ppm_is_a_distribution():
    """After any context the probabilities of all symbols sum to 1, and the trie's answer is that of a plain version."""
    texts = [t.encode() for t in (prose(40), prose(40), "abracadabra")]
    keys, n = np.unique(ppm._keys(texts)[0], return_counts=True)
    branches, sums = [], []
    for order in range(ppm.ORDER, -1, -1):
        kept = n >= 2 if order > 2 else n >= 1
        branches.append((keys[kept], n[kept].astype(float)))
        contexts = np.unique(keys[kept] >> 8)
        sums.append((contexts, np.array([n[keys >> 8 == c].sum() for c in contexts], float)))
        keys, at = np.unique(keys & ((1 << 8 * order) - 1), return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
    trie = ppm.Trie(branches[::-1], sums[::-1])
    for ctx in (b"abrac", b"zzzzz", b" the ", b"\xff\xff\xff\xff\xff", texts[0][3:8]):
        base = int.from_bytes(ctx, "big") << 8
        assert (10 ** trie.log10(np.array([base | s for s in range(256)]))).sum() == pytest.approx(1)


def plain_ppm(trained, text):
    """The log10 probability of a text by contexts of up to 5 bytes, from counts of all of them."""
    spell = lambda t: [ppm.END] * ppm.ORDER + list(t) + [ppm.END]
    after = {}
    for s in map(spell, trained):
        for i in range(ppm.ORDER, len(s)):
            for order in range(ppm.ORDER + 1):
                after.setdefault(tuple(s[i - order : i]), Counter())[s[i]] += 1
    total, s = 0.0, spell(text)
    for i in range(ppm.ORDER, len(s)):
        gone = set()
        for order in range(ppm.ORDER, -1, -1):
            seen = {x: n for x, n in after.get(tuple(s[i - order : i]), {}).items() if x not in gone}
            mass = sum(seen.values()) + len(seen)
            if s[i] in seen:
                total += math.log10(seen[s[i]] / mass)
                break
            if seen:
                total += math.log10(len(seen) / mass)
            gone |= seen.keys()
        else:
            total -= math.log10(max(1, 256 - len(gone)))
    return total


@pytest.mark.parametrize("most", [8, 1 << 21])
def test_ppm_keeps_rare_branches(spark, monkeypatch, most):
    monkeypatch.setattr(ppm, "HOT", most, raising=False)
    monkeypatch.setattr(ppm, "BRANCHES", most, raising=False)
    monkeypatch.setattr(ppm, "CHUNK", 100, raising=False)
    rows = [(i, prose(25) + " " + "".join(chr(RND.randrange(0x400, 0x450)) for _ in range(8)) + " zq" * (i % 3)) for i in range(40)] + [(None, None), (50, "")]
    trained = [ppm.plain(t) for i, t in rows if not ppm.is_held_out(i)]
    got = ppm.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        assert r.score == pytest.approx(plain_ppm(trained, ppm.plain(dict(rows)[r.doc_id])))


def test_ppm_learns(spark):
    rows = [(i, prose(60)) for i in range(300)]
    got = ppm.score(spark.createDataFrame(rows, SCHEMA)).where("held_out")
    score, base, size = got.agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    bits = -score / math.log10(2) / sum(len(t.encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2)
    assert size > 20 and bits < 2.5 and score < base * 0.5  # far below the 8 bits of a byte


def test_urls(spark):
    urls = [
        "https://a.com/x", "http://Example.COM/en/1", "https://www.example.com/en/?q", "http://b.net/es/1#top", "http://b.net/fr/", "http://b.net/frx", None, "no scheme", "x://", "http://HOST?x/y", "http://b.org/es/",
        "http://notexample.com/en/", "http://sub.www.example.com/en/9",
    ]
    html = '<a href="http://b.net/es/1">x</a> <a href="https://bad.site/1">'
    pages = spark.createDataFrame([(i, u, html if i == 10 else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow")
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block") and got[5][2] is None
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("host", "", None, "allow")
    assert got[11][2] == "com/" and got[12][2:] == ("www.example.com/en/", "allow")
    scores = {r.host: r for r in url_filter.host_scores(pages).collect()}
    assert scores["b.org"].distrust > 0  # it links to a blocked host
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_urls_far_hosts(spark):
    link = lambda h: f'<a href="//{h}/1">'
    rows = [(i, f"http://h{i}.io/1", link(f"h{i + 1}.io")) for i in range(8)] + [(8, "http://h8.io/1", '<a href="http://b.net/es/1">'), (9, "http://b.net/es/1", "")]
    rows += [(10 + i, f"http://lone{i}.io/", link(f"other{i}.io")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scores = {r.host: r.distrust for r in url_filter.host_scores(pages).collect()}
    for i in range(9):  # one link each way: the distrust at so many hops from the only blocked host
        assert scores[f"h{i}.io"] == pytest.approx(0.15 * 0.85 ** (9 - i), rel=0.05)


@pytest.mark.parametrize("most", [0, 500_000])
def test_urls_spread_against_plain(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", most)  # 0: ranks are joined, edges in parts
    monkeypatch.setattr(url_filter, "EDGES", 2)
    rnd = random.Random(8)
    hosts = [f"h{i}.io" for i in range(30)] + ["b.net", "c.net", "good.com", "fine.com", "sub.h1.io", "deep.sub.h1.io"]
    sample = rnd.sample(hosts[:30], 30)
    to = {h: rnd.sample(sample, 2) for h in hosts}
    for h in sample[:5]:
        to[h] = ["b.net", "c.net"]  # they link to blocked hosts
    to["good.com"] = to["fine.com"] = sample[5:10]  # trusted hosts vouch for these
    rows, links = [], Counter()
    for i, h in enumerate(hosts):
        for path in ["/es/1", "/es/2"] if h.endswith(".net") else ["/x"]:
            rows.append((len(rows), f"https://{h}{path}", "".join(f'<a href="http://{x.upper()}/">' for x in to[h] if x != h)))
            links.update((h, x) for x in to[h] if x != h)
    for a, b in (("deep.sub.h1.io", "sub.h1.io"), ("sub.h1.io", "h1.io")):
        links.update([(a, b), (b, a)])
    rows += [(100, "https://h2.io/z", None), (100, "https://h2.io/z", None), (101, "https://nowhere.io/", "")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, verdict string")
    count = Counter(u.split("/")[2] for _, u, _ in rows)
    kind = lambda end: {h: n for h, n in count.items() if h.endswith(end)}
    want = plain.spread_verdicts(links, kind(".com"), kind(".net"), count)
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    free = [r for r in got if r.rule is None]
    for r in free:
        trust, distrust, verdict = want[r.host]
        assert (r.trust, r.distrust) == (pytest.approx(trust, rel=0.03, abs=1e-9), pytest.approx(distrust, rel=0.03, abs=1e-9))
        if abs(distrust - max(trust, 0.5)) > 0.05:
            assert r.verdict == verdict
    by = {r.host: r.verdict for r in free}
    assert all(by[h] == "block" for h in sample[:5]) and by["nowhere.io"] == "allow" and all(by[h] == "allow" for h in sample[5:10])
    assert {r.verdict for r in got if r.rule} == {"allow", "block"}


def test_licences(spark):
    files = spark.createDataFrame(
        [
            (1, "/a/LICENSE", "Licensed under the Apache License, Version 2.0.", True), (2, "/a/b/x.py", "code\ncode", False), (3, "/a/b/c/y.py", "# Released under the MIT License.\ncode", False),
            (4, "/z/q", None, False), (5, None, "", False), (6, "/a/d/COPYING", "This work is licensed under the GNU General Public License, version 3.", True), (7, "/a/d/e/f", "we use the same license as they do", False), (8, "top", "All rights reserved.", True), (9, "", "", False),
        ],
        "id long, path string, text string, is_licence_file boolean",
    )
    got = {r.id: (r.own_licence, r.licence, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got[1] == ("Apache-2.0", "Apache-2.0", None) and got[2] == (None, "Apache-2.0", "/a") and got[3][0] == "MIT"
    assert got[6][0] == "GPL-3.0" and got[7] == (None, "GPL-3.0", "/a/d") and got[5] == (None, None, None)
    assert got[4][1] == got[9][1] == "LicenseRef-proprietary"  # the top's licence file
    assert licenses.scan(files.limit(0)).count() == 0


def licence_texts():
    t = {name: texts for name, texts in licenses.TEMPLATES.items()}
    mit, bsd2, bsd3, gpl = t["MIT"][-1], t["BSD-2-Clause"][-1], t["BSD-3-Clause"][-1], t["GPL-3.0"][2]

    def wrap(text, width, prefix=""):
        lines, line = [], ""
        for word in text.split():
            if len(line) + len(word) > width:
                lines.append(line.strip())
                line = ""
            line += " " + word
        return "\n".join(prefix + x for x in [*lines, line.strip()])

    gnu = wrap(gpl, 60, " * ")
    return [
        ("MIT", wrap("Copyright (c) 2020 Some Person " + mit, 70)), ("BSD-2-Clause", wrap(bsd2, 60)), ("BSD-3-Clause", wrap(bsd3, 60)), ("BSD-2-Clause", wrap(bsd2, 60, "// ") + "\nint main() {}\n"),
        ("GPL-3.0", "/*\n" + gnu + "\n *\n * It comes without a warranty of any kind.\n */\ncode"), ("GPL-2.0", gnu.replace("version 3", "version 2") + "\ncode"), ("LGPL-3.0", wrap(t["LGPL-3.0"][0], 50, "# ") + "\n#\n\ncode"),
        ("GPL-3.0", "This work is licensed under the GNU General Public\nLicense, version 3. See LICENSE for the full text of it."), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + prose(300)),
        ("Apache-2.0", prose(40) + "\n\n\n" + wrap(t["Apache-2.0"][3], 40) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"), (None, prose(50) + " license " + prose(50)), (None, "The software works as is. " * 50), (None, "\n" * 5000 + "x"), (None, "- \n" * 3000), (None, "漢" * 5000 + "a"),
        # wrapped over many lines within one paragraph of other lines, with another holder's name, and with blank lines around
        ("BSD-2-Clause", "first words of prose\nCopyright (c) 2021 Some Person\nAll rights reserved.\n" + wrap(bsd2, 60) + "\nand other\nlines follow here"), ("BSD-2-Clause", "Copyright (c) 2021\nAll rights reserved.\n" + wrap(bsd2.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "SOME PERSON"), 60) + "\nother lines\n" * 3),
        ("MIT", "this part reads a file\n" * 7 + wrap(t["MIT"][3], 40) + "\nand this one writes it\n" * 7), ("BSD-3-Clause", "some words before it\n" * 5 + wrap(bsd3, 60) + "\nsome words after it" * 5), ("MIT", "other prose\n\n" + wrap(t["MIT"][3], 50) + "\n\nother prose"),
        (None, "Nicht, berenzu mit. Mit.\nMit mit einß."), (None, "... . .. mit... -- ..."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.\n" + prose(3000)), ("CC-BY-4.0", "\n\n \nLicensed under CC BY 4.0."), (None, ""), (None, None),
    ]


def test_rights_reserved_above_a_licence(spark):
    bsd, mit = licenses.TEMPLATES["BSD-2-Clause"][-1], licenses.TEMPLATES["MIT"][-1]
    above = "Copyright (c) 2021 Some Person\nAll rights reserved.\n\n"
    rows = [(1, above + bsd + "\n\nfirst words of other prose\nand more of it\n" * 3), (2, above + bsd.replace("the copyright holder", "Some Person") + "\n"), (3, above + mit), (4, above + "nothing else stands here")]
    got = {r.id: r.licence for r in licenses.own_licences(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-2-Clause", 3: "MIT", 4: "LicenseRef-proprietary"}


def test_licences_against_all_cosines(spark):
    texts = licence_texts()
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    files = spark.createDataFrame([*rows, *rows[:3], (None, texts[0][1])], "id long, text string")  # repeated rows, a null id
    for threshold in (0.8, 0.5):
        got = {r.id: r for r in licenses.own_licences(files, threshold).collect()}
        assert None not in got
        for i, (name, text) in enumerate(texts):
            want = plain.own_licence(text or "", licenses.TEMPLATES, threshold)
            have = got.get(i) and (got[i].licence, got[i].score, got[i].opens)
            assert (have is None) == (want is None), text
            assert want is None or (have[0], have[2]) == (want[0], want[2]) and abs(have[1] - want[1]) < 1e-6, text
            assert threshold < 0.8 or (have and have[0]) == name, (name, have)


def test_licences_of_hot_directories_repeats_and_other_columns(spark):
    notice = "Released under the MIT License."
    rows = [(i, f"/hot/{i}", "x", None, "a") for i in range(300)] + [(900, "/hot/0a", notice, None, "b"), (900, "/hot/0a", notice, None, "b"), (None, "/hot/q", notice, None, "c"), (901, "/cold/in/it", "x", None, "d"), (902, "/cold/L", "All rights reserved.", True, "e"), (903, "/none/x", "x\n" + notice, None, "f"), (904, None, "x", None, "g")]
    files = spark.createDataFrame(rows, "id long, path string, text string, is_licence_file boolean, dir string")
    expect = {i: ("MIT", "/hot") for i in range(300)} | {900: ("MIT", None), None: ("MIT", "/hot"), 901: ("LicenseRef-proprietary", "/cold"), 902: ("LicenseRef-proprietary", None), 903: ("MIT", None), 904: (None, None)}
    hot = licenses.HOT
    try:
        for licenses.HOT in (hot, 0.5, 2.0):  # all by broadcast, some, none
            got = licenses.scan(files).collect()
            assert len(got) == len(rows) and {r.id: (r.licence, r.inherited_from) for r in got} == expect
    finally:
        licenses.HOT = hot
