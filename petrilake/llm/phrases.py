"""Phrase collocations of whole texts, counted by double-array tries.

Texts become arrays of word numbers: words of fewer than `least` occurrences, ends of pieces and ends of texts are 0, since no phrase of
`least` occurrences crosses them. Level by level, a phrase of k words is the pair of the phrases of k - 1 words at two neighbouring
places, so a place's state at level k follows from two states of level k - 1. A level takes four passes of those arrays:

1. fingerprints of all pairs of states are counted, summed on both sides of a shuffle, and those of fewer than `least` are ruled out;
2. the pairs behind the other fingerprints are listed: the level's candidates. Both parts of each are frequent, so none is missed (Apriori);
3. candidates are built into double-array tries and broadcast, a bounded block at a time; a task advances the states of all places of
   a batch at once, `base[left] + right`, and adds up the accepting states by bincount; the tasks' counts are summed;
4. the frequent ones' tries give every place its state for the next level.

Nothing is broadcast that grows with the data: words, fingerprints and tries go in blocks of fixed sizes, and words beyond the first
block, which are all rarer than those in it, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrilake.llm.common import LOWER_BYTES, python_workers, written

#: Words, fingerprints and candidates that are broadcast at a time, about.
WORDS = 1 << 20
PRINTS = 1 << 22
BLOCK = 1 << 20
#: Bytes of text, and places, that a task works on at a time.
BYTES = 2 << 20
PLACES = 1 << 19
#: Rows of phrases that are broadcast to each other.
FEW = 200_000
#: Counts that stand in one row between a shard and their sum.
CHUNK = 1 << 10

_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
#: Fixed classes of bytes: 1 ends a word, 2 ends a piece too.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def cut(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of texts in order; for each the text that it is in, and whether a piece ends between it and the one before."""
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _CLASS[buf]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    first = np.ones(len(begins), bool)
    first[1:] = breaks[begins[1:]] != breaks[begins[:-1]]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(buf[inside].tobytes()))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return words, np.searchsorted(starts, begins, "right") - 1, first


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """(langs, texts) of rows of about `size` bytes together."""
    langs, texts, held = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            langs.append(lang)
            texts.append((text or "").encode())
            held += len(texts[-1])
            if held >= size:
                yield langs, texts
                langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _by_lang(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, list[bytes]]]:
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, a) of the words with `least` occurrences in docs(lang, text), and with a null word those of all words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches, BYTES):
            for lang, own in _by_lang(langs, texts):
                found = pc.value_counts(cut(own)[0])
                words, counts = found.field(0), found.field(1)
                words, counts = pa.concat_arrays([words, pa.nulls(1, pa.string())]), pa.concat_arrays([counts, pa.array([pc.sum(counts).as_py() or 0], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, counts], ["lang", "word", "a"])

    found = docs.mapInArrow(work, "lang string, word string, a bigint").groupBy("lang", "word").agg(F.sum("a").alias("a"))
    return written(found.where((F.col("a") >= least) | F.col("word").isNull()), "words")


def encode(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(ids binary) of docs(lang, text): the numbers of words(id, lang, word, a) as little-endian 32-bit integers, 0 for others and between pieces.

    One row is a block of texts of one language. Words beyond the `WORDS` most frequent ones are joined by the places where they stand.
    """
    spark = docs.sparkSession
    total = words.count()
    known, rest = words, None
    if total > WORDS:
        bound = words.agg(F.percentile_approx("a", F.lit(1 - WORDS / total), 1_000_000)).first()[0]
        known, rest = words.where(F.col("a") > bound), words.where(F.col("a") <= bound)
    table = known.select("lang", "word", "id").toArrow().combine_chunks()  # at most about WORDS
    own = lambda lang: table.filter(pc.equal(table["lang"], lang))
    by_lang = {lang: own(lang) for lang in pc.unique(table["lang"]).to_pylist()}
    sent = spark.sparkContext.broadcast({k: (t["word"].combine_chunks().cast(pa.string()), t["id"].to_numpy().astype(np.int32)) for k, t in by_lang.items()})
    more = rest is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches, BYTES):
            for lang, own in _by_lang(langs, texts):
                found, _, first = cut(own)
                known_words, numbers = sent.value.get(lang, (pa.array([], pa.string()), np.zeros(0, np.int32)))
                place = np.arange(len(first)) + np.cumsum(first)
                ids = np.zeros(len(first) + int(first.sum()) + 1, "<i4")
                at = pc.index_in(found, value_set=known_words)
                hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                ids[place[hit]] = numbers[at.filter(pa.array(hit)).to_numpy()]
                lost = np.flatnonzero(~hit) if more else np.zeros(0, np.int64)
                ends = pa.array([0, len(lost)], pa.int32())
                late = [pa.ListArray.from_arrays(ends, pa.array(place[lost])), pa.ListArray.from_arrays(ends, found.take(pa.array(lost)))]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([lang], pa.string()), *late], ["ids", "lang", "places", "words"])

    found = docs.mapInArrow(work, "ids binary, lang string, places array<bigint>, words array<string>")
    if not more:
        return written(found.select("ids"), "encoded")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "encoded")
    lost = found.select("row", "lang", F.explode(F.arrays_zip("places", "words")).alias("w")).select("row", "lang", F.col("w.places").alias("place"), F.col("w.words").alias("word"))
    back = lost.join(rest.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("late"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, late in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<i4").copy()
                if late:
                    ids[[x["place"] for x in late]] = [x["id"] for x in late]
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return written(found.join(back, "row", "left").select("ids", "late").mapInArrow(put, "ids binary"), "encoded")


def _pairs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    """left << 32 | right of neighbouring states, both of a phrase, of about PLACES places at a time."""
    held, n = [], 0
    for b in batches:
        for raw in b.column(column).to_pylist():
            ids = np.frombuffer(raw, "<i4")
            held.append(ids)
            held.append(np.zeros(1, "<i4"))
            n += len(ids)
            if n >= PLACES:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    ids = np.concatenate(parts)
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return ids[both].astype(np.int64) << 32 | ids[both + 1]


def _prints(keys: np.ndarray) -> np.ndarray:
    """32-bit fingerprints of pairs."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)


def candidates(states: DataFrame, least: int) -> DataFrame:
    """(key) of the pairs of states(ids) whose fingerprint has `least` occurrences, once each; a key is left << 32 | right."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _pairs(batches):
            prints, counts = np.unique(_prints(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(counts)], ["print", "n"])

    hot = written(states.mapInArrow(count, "print bigint, n bigint").groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("print"), "prints")
    parts = max(1, -(-hot.count() // PRINTS))
    found = []
    for part in range(parts):
        own = _sorted(hot.where(F.pmod("print", F.lit(parts)) == part))  # about PRINTS
        sent = states.sparkSession.sparkContext.broadcast(own)

        def listed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for keys in _pairs(batches) if len(own) else ():
                prints = _prints(keys)
                at = np.minimum(np.searchsorted(own, prints), len(own) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[own[at] == prints]))], ["key"])

        found.append(states.mapInArrow(listed, "key bigint"))
    return written(reduce(DataFrame.union, found).distinct(), "candidates")


@dataclass(frozen=True)
class Trie:
    """A double array: from a left state, `base[left] + right` is the pair's cell if `check` has left there; `value` is its number."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def advance(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of the pairs, all at once; -1 where the trie has none."""
        cell = self.base[np.minimum(left, len(self.base) - 1)] + right
        inside = (left < len(self.base)) & (cell >= 0) & (cell < len(self.check))
        cell = np.where(inside, cell, 0)
        return np.where(inside & (self.check[cell] == left), self.value[cell], -1)


def build(keys: np.ndarray) -> Trie:
    """The trie of sorted distinct keys; a pair's number is its place among them.

    Lefts are placed by first fit, those with most rights first. Lefts with a single right fill the gaps.
    """
    left, right = keys >> 32, keys & 0xFFFFFFFF
    lefts, starts, sizes = np.unique(left, return_index=True, return_counts=True)
    base = np.zeros((int(lefts[-1]) + 1) if len(lefts) else 1, np.int32)
    room = int(2 * len(keys) + (right.max() if len(keys) else 0) + 1024)
    free_cells = lambda n: np.full(n, -1, np.int32)
    check, value = free_cells(room), free_cells(room)
    hint = 0
    many = np.flatnonzero(sizes > 1)
    for i in many[np.argsort(-sizes[many], kind="stable")]:
        own = right[starts[i] : starts[i] + sizes[i]]
        own_base, tries = hint - int(own[0]), 0
        while True:
            cells = own + own_base
            if cells[-1] >= len(check):
                grown = max(len(check), int(cells[-1]) + 1 - len(check))
                check, value = np.concatenate([check, free_cells(grown)]), np.concatenate([value, free_cells(grown)])
            taken = check[cells] >= 0
            if not taken.any():
                break
            tries += 1
            own_base += 1 if tries < 64 else tries  # the first free run need not be found, only a free one
        while hint < len(check) and check[hint] >= 0:
            hint += 1
        base[lefts[i]] = own_base
        check[cells], value[cells] = lefts[i], np.arange(starts[i], starts[i] + sizes[i])
    one = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(check < 0)[: len(one)]
    if len(free) < len(one):
        extra = np.arange(len(check), len(check) + len(one) - len(free))
        check, value = np.concatenate([check, free_cells(len(extra))]), np.concatenate([value, free_cells(len(extra))])
        free = np.concatenate([free, extra])
    base[lefts[one]] = free - right[starts[one]]
    check[free], value[free] = lefts[one], starts[one]
    used = np.flatnonzero(check >= 0)
    last = int(used[-1]) + 1 if len(used) else 1
    return Trie(base, check[:last], value[:last])


def _counted(states: DataFrame, keys: np.ndarray) -> DataFrame:
    """(key, a): how often each of the sorted keys stands in states."""
    sent = states.sparkSession.sparkContext.broadcast((build(keys), keys))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, keys = sent.value
        counts = np.zeros(len(keys), np.int64)
        for pairs in _pairs(batches):
            found = trie.advance(pairs >> 32, pairs & 0xFFFFFFFF)
            counts += np.bincount(found[found >= 0], minlength=len(keys))
        chunks = range(0, len(keys), CHUNK)
        parts = [pa.array(np.arange(len(chunks)), pa.int64()), pa.array([counts[i : i + CHUNK].tobytes() for i in chunks], pa.binary())]
        yield pa.RecordBatch.from_arrays(parts, ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, here, total = sent.value[1], None, None

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[here * CHUNK : here * CHUNK + len(total)]), pa.array(total)], ["key", "a"])

        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if chunk != here:
                    if here is not None:
                        yield summed()
                    here, total = chunk, np.zeros(len(raw) // 8, np.int64)
                total += np.frombuffer(raw, np.int64)
        if here is not None:
            yield summed()

    shards = states.mapInArrow(work, "chunk bigint, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    return shards.mapInArrow(add, "key bigint, a bigint")


def _stated(states: DataFrame, sent: Broadcast, first: int, done: bool) -> DataFrame:
    """states(ids, next) with the numbers of the trie's pairs, from first on, put into next; the last time as (ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for b in batches:
            out = []
            for raw, so_far in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<i4")
                new = np.frombuffer(so_far, "<i4").copy() if so_far is not None else np.zeros(len(ids), "<i4")
                both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                found = trie.advance(ids[both].astype(np.int64), ids[both + 1].astype(np.int64))
                new[both[found >= 0]] = first + found[found >= 0]
                out.append(new.tobytes())
            new_ids = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([new_ids] if done else [b.column(0), new_ids], ["ids"] if done else ["ids", "next"])

    return written(states.mapInArrow(work, "ids binary" if done else "ids binary, next binary"), "states")


def _numbers(rows: DataFrame, sent: Broadcast, first: int) -> DataFrame:
    """rows(key, a) with `id`: the trie's numbers of the keys, from first on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + sent.value.advance(keys >> 32, keys & 0xFFFFFFFF), pa.int64())], ["key", "a", "id"])

    return rows.mapInArrow(work, "key bigint, a bigint, id bigint")


def _sorted(rows: DataFrame) -> np.ndarray:
    """The only column of a bounded number of rows."""
    return np.sort(rows.toArrow().column(0).to_numpy())


def _parts(rows: DataFrame) -> list[DataFrame]:
    """rows(key, ...) dealt to parts of about BLOCK."""
    parts = max(1, -(-rows.count() // BLOCK))
    return [rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) for part in range(parts)]


def level(states: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(id, l, r, a) of the frequent pairs of states(ids), and the states of the next level (none for the last)."""
    python_workers(states.sparkSession, 4)  # a row is BYTES of text
    counted = [_counted(states, _sorted(part.select("key"))) for part in _parts(candidates(states, least))]
    frequent = written(reduce(DataFrame.union, counted).where(F.col("a") >= least), "frequent")
    halves = [F.shiftright("key", 32).alias("l"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("r"), "a"]
    if last:
        return frequent.select(F.lit(0).cast("long").alias("id"), *halves), None
    numbered, after, first = [], states.select("ids", F.lit(None).cast("binary").alias("next")), 1
    parts = _parts(frequent)
    for i, part in enumerate(parts):
        keys = _sorted(part.select("key"))
        sent = states.sparkSession.sparkContext.broadcast(build(keys))
        numbered.append(_numbers(part, sent, first))
        after = _stated(after, sent, first, i == len(parts) - 1)
        first += len(keys)
        if first >= 1 << 31:
            raise ValueError("more frequent phrases of one length than 32 bits number")
    return written(reduce(DataFrame.union, numbered).select("id", *halves), "phrases"), after


def _joined_to(rows: DataFrame, parts: DataFrame, side: str) -> DataFrame:
    """rows with the columns of parts(id, ...) for their l or r, as a struct of that name; few parts are broadcast."""
    named = parts.select(F.col("id").alias(side), F.struct(*[c for c in parts.columns if c != "id"]).alias(f"{side}_"))
    return rows.join(F.broadcast(named) if parts.count() <= FEW else named, side)


def mine(docs: DataFrame, longest: int = 4, least: int = 30, contained: tuple[int, int] = (80, 100), best: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `longest` words of each lang of docs(lang, text).

    A phrase has `least` occurrences (a), overlapping ones too, and none crosses the end of a piece or a text; n counts all words of the
    lang. Its score is floor(scale * a / (l + r)) for the cut of the lowest score, the earliest of equals. A phrase within a longer one of
    contained[0] / contained[1] of its occurrences at least is dropped. Ranks go by score, a (both falling) and the phrase's bytes.

    Null texts are as empty, a null lang is `und`, repeated rows count each time. Other columns are not read. Languages
    without a phrase, and an empty table, give no row.
    """
    python_workers(docs.sparkSession, 200)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = word_counts(docs, least)
    totals = counts.where("word is null").select("lang", F.col("a").alias("n"))
    words = counts.where("word is not null")
    words = written(_numbered(words), "numbered")
    states: DataFrame | None = encode(docs, words)
    phrases = [words.select("id", "lang", F.array("word").alias("words"), F.array("a").alias("heads"), F.array("a").alias("tails"))]
    edges = []
    for k in range(2, longest + 1):
        found, states = level(states, least, k == longest)
        rows = _joined_to(_joined_to(found, phrases[-1], "l"), phrases[-1], "r")
        whole = [F.concat("l_.words", F.slice("r_.words", -1, 1)).alias("words"), F.concat("l_.heads", F.array("a")).alias("heads"), F.concat("r_.tails", F.array("a")).alias("tails")]
        rows = written(rows.select("id", "a", F.col("l_.lang").alias("lang"), *whole), "joined")
        phrases.append(rows.drop("a"))
        edges.append(rows)
        if not rows.limit(1).count():
            break
    return _ranked(edges, totals, contained, best, scale)


def _numbered(words: DataFrame) -> DataFrame:
    """words with `id`: numbers from 1 on, without gaps beyond those of the ranges that they are dealt to."""
    spread = written(words.repartition("lang", "word").withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "spread")
    sizes = spread.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("_low")).orderBy("_range").collect()  # one row a range
    starts, total = [], 1
    for r in sizes:
        starts.append((r["_range"], total - r["_low"]))
        total += r["n"]
    if not starts:
        return spread.select(F.lit(0).cast("long").alias("id"), *words.columns)
    few = words.sparkSession.createDataFrame(starts, "_range int, _shift bigint")
    return spread.join(F.broadcast(few), "_range").select((F.col("_at") + F.col("_shift")).alias("id"), *words.columns)


def _ranked(levels: list[DataFrame], totals: DataFrame, contained: tuple[int, int], best: int, scale: int) -> DataFrame:
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products may pass 64 bits
    rows, longer = [], []
    for k, found in enumerate(levels, 2):
        rows.append(found.select("lang", "words", "a", "heads", "tails"))
        for size in range(2, k):  # all parts of two or more words
            for i in range(1, k - size + 2):
                longer.append(found.select("lang", F.slice("words", i, size).alias("words"), F.col("a").alias("longer")))
    every = reduce(DataFrame.union, rows)
    if longer:
        within = reduce(DataFrame.union, longer).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
        every = every.join(within, ["lang", "words"], "left").where(F.col("longer").isNull() | (wide(F.lit(contained[1])) * wide(F.col("longer")) < wide(F.lit(contained[0])) * wide(F.col("a"))))
    size = F.size("words")
    cut_at = lambda j: F.struct(j.alias("k"), F.get("heads", j - 1).alias("l"), F.get("tails", size - j - 1).alias("r"))
    cuts = every.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.explode(F.transform(F.sequence(F.lit(1), size - 1), cut_at)).alias("c")).select("lang", "phrase", "a", "c.*")
    scored = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(20,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = lowest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's rows meet only after each part has given its best
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= best).drop("_part", "_rank")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return some.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
