"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `ORDER` bytes with the counts of what follows them in the training
documents. A byte's probability is that of its longest known context; where the context does not hold it, an escape
(estimated by the number of distinct symbols in the context) leads to the next shorter context, from which
the symbols of the longer one are excluded. A document's score is the summed log10 probability of its bytes and its end, from the
pretrained trie; its text is its tokens, A-Z lower-cased, with one space between them.

Counting is one shuffle of (context and symbol, count) with sums on the map side; shorter contexts follow from the longest by dropping
their first byte. No branch is left out: the trie is a table, dealt by the last `NEAR` bytes of the context, so that a task has all branches of
those contexts and of the longer ones that end in them; the branches of shorter contexts, at most 256^`NEAR` by their length, are broadcast.
A task scores each key that the documents hold, training ones or not, once. The most frequent keys, `HOT` at most, are broadcast with their
log10 probability, and the occurrences of the others are joined with it. The unigram baseline is split likewise: words of at least 1 / `WORDS` of
the tokens are broadcast, the occurrences of rarer ones are joined with their counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import LOWER_BYTES, python_workers, written

ORDER = 5
NEAR = 3
#: Keys whose probability is broadcast, at most; keys that a task scores at a time.
HOT = 1 << 21
CHUNK = 1 << 20
WORDS = 1 << 20
#: A byte that UTF-8 never has: the end of a document and what stands before its start.
END = 0xFF
#: Bytes that are counted or scored at a time, and rows that a counting task holds before it hands them on.
BLOCK = 1 << 20
HELD = 4 << 20


def is_held_out(doc_id) -> bool:
    """The contract's fold: crc32 of the id as text, modulo 7, is 2. A null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and their ends: ORDER bytes before it and the byte, as one number; and the texts' first places."""
    pad = bytes([END]) * ORDER
    buf = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    sizes = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    key = np.zeros(len(buf) - ORDER, np.int64)
    for j in range(ORDER + 1):
        key <<= 8
        key |= buf[j : j + len(key)]
    keep = np.ones(len(key), bool)
    for j in range(1, ORDER + 1):
        keep[starts[1:] - j] = False  # windows over two texts
    return key[keep], np.concatenate([[0], np.cumsum(sizes - ORDER)[:-1]])


def plain(text: str | None) -> bytes:
    """A text's tokens, A-Z lower-cased, with one space between them."""
    return b" ".join((text or "").encode().translate(LOWER_BYTES).split())


def _blocks(texts: list[bytes]) -> Iterator[list[int]]:
    block, size = [], 0
    for i, t in enumerate(texts):
        block.append(i)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def count_branches(docs: DataFrame) -> DataFrame:
    """(key, n, held) of the longest contexts: how often each key stands in the training documents and in the held-out ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], ([], []), 0

        def merged() -> pa.RecordBatch:
            nonlocal keys, counts, size
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = [pa.array(np.bincount(at, np.concatenate(c)).astype(np.int64)) for c in counts]
            keys, counts, size = [], ([], []), 0
            return pa.RecordBatch.from_arrays([pa.array(k), *n], ["key", "n", "held"])

        for b in batches:
            rows = [(is_held_out(d), plain(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            for held in (False, True):
                texts = [t for out, t in rows if out == held]
                for block in _blocks(texts):
                    k, n = np.unique(_keys([texts[i] for i in block])[0], return_counts=True)
                    keys.append(k)
                    counts[held].append(n)
                    counts[not held].append(np.zeros(len(k), np.int64))
                    size += len(k)
            if size >= HELD:
                whole = merged()
                if whole.num_rows > HELD // 2:
                    yield whole
                else:
                    keys, size = [whole.column(0).to_numpy()], whole.num_rows
                    counts = ([whole.column(1).to_numpy()], [whole.column(2).to_numpy()])
        if keys:
            yield merged()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "key long, n long, held long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the 64-bit hash of each training token; the end of a text is token 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_word(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not is_held_out(d):
                    seen.update((t or "").encode().translate(LOWER_BYTES).split())
                    ends += 1
                    if len(seen) > 400_000:
                        yield counted()
                        seen.clear()
        yield counted()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([ends], pa.int64())], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _word(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63) or 1


class Lookup:
    """A hash table of distinct non-negative numbers: their places in the array it is made from."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.places = np.zeros(1 << self.bits, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while todo.size:
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[todo[free]]  # of several the last one stays
            mine = self.slots[slot] == keys[todo]
            self.places[slot[mine]] = todo[mine]
            todo, slot = todo[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(keys)
        there = self.slots[slot]
        out = np.where(there == keys, self.places[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[todo]
        while todo.size:
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.places[slot[hit]]
            go = ~hit & (there >= 0)
            todo, slot = todo[go], slot[go]
        return out


class Trie:
    """Contexts and branches by order, and what the escape from each context excludes."""

    def __init__(self, branches: list[tuple[np.ndarray, np.ndarray]], sums: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """branches: for each order from 0 the sorted keys (context and symbol) and their counts; sums: where branches are left out,
        the sorted contexts of each order that have branches, and how often they stand in the training texts, all branches included."""
        self.branches, self.contexts = branches, []
        for order, (keys, n) in enumerate(branches):
            ctx, at = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(at, n, len(ctx))
            pruned = sums[order][1] - total if sums else np.zeros(len(ctx))
            kinds = np.bincount(at, minlength=len(ctx)).astype(float)
            excluded = np.zeros(len(ctx))
            if order:  # what the symbols of this context count in the next shorter one
                shorter_keys, shorter_n = branches[order - 1]
                places = np.searchsorted(shorter_keys, keys & ((1 << 8 * order) - 1))
                excluded = np.bincount(at, shorter_n[places], len(ctx))
            self.contexts.append((ctx, total, kinds, excluded, pruned))
        self.tables: list | None = None

    def _lookups(self) -> list:
        if self.tables is None:
            self.tables = [(Lookup(k), Lookup(c[0])) for (k, _), c in zip(self.branches, self.contexts, strict=True)]
        return self.tables

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        who = np.arange(len(keys))
        gone_n, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for order in range(len(self.branches) - 1, -1, -1):
            if not who.size:
                return out
            by_branch, by_context = self._lookups()[order]
            key = keys[who] & ((1 << 8 * (order + 1)) - 1)
            _, total, kinds, excluded, pruned = self.contexts[order]
            context = by_context.find(key >> 8)
            known = context >= 0
            who, key, context, gone_n, gone_kinds, unknown = who[known], key[known], context[known], gone_n[known], gone_kinds[known], (who[~known], gone_n[~known], gone_kinds[~known])
            branch = by_branch.find(key)
            escape = kinds[context] - gone_kinds + pruned[context]
            mass = total[context] - gone_n + escape
            hit = branch >= 0
            out[who[hit]] += np.log10(self.branches[order][1][branch[hit]] / mass[hit])
            miss = ~hit & (escape > 0)
            out[who[miss]] += np.log10(escape[miss] / mass[miss])
            on = ~hit
            who = np.concatenate([who[on], unknown[0]])
            gone_n = np.concatenate([excluded[context[on]], unknown[1]])
            gone_kinds = np.concatenate([kinds[context[on]], unknown[2]])
        seen = float(self.contexts[0][2].sum()) if self.contexts else 0.0
        out[who] -= np.log10(max(1.0, 256.0 - seen))
        return out


def _shorter(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The branches of that order, from those of a longer one."""
    k, at = np.unique(keys & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return k, np.bincount(at, n, len(k))


def score_keys(branches: DataFrame) -> DataFrame:
    """(key, log, bits) of each key in branches(key, n, held): its log10 probability by the whole trie, and the binary digits of its occurrences."""
    found = branches.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << 8 * NEAR) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 256^NEAR rows at most
    k, n = found.column("key").to_numpy(), found.column("n").to_numpy().astype(float)
    shared = branches.sparkSession.sparkContext.broadcast([_shorter(k, n, order) for order in range(NEAR)])

    def scored(key: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        seen = n > 0
        trie = Trie([*shared.value, *[_shorter(key[seen], n[seen].astype(float), order) for order in range(NEAR, ORDER + 1)]])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(trie.log10(key)), pa.array(np.frexp(total)[1].astype(np.int32))], ["key", "log", "bits"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, enough = [], 0, CHUNK
        for b in batches:
            parts.append([b.column(i).to_numpy() for i in range(3)])
            size += b.num_rows
            if size >= enough:
                whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
                near = (whole[0] >> 8) & ((1 << 8 * NEAR) - 1)
                cut = int(np.searchsorted(near, near[-1]))  # the last context may go on
                if cut:
                    yield scored(*[x[:cut] for x in whole])
                parts, size = [[x[cut:] for x in whole]], size - cut
                enough = max(CHUNK, 2 * size)
        if size:
            yield scored(*[np.concatenate(x) for x in zip(*parts, strict=True)])

    near = F.shiftright("key", 8).bitwiseAND((1 << 8 * NEAR) - 1).alias("near")
    partitions = max(1, int(branches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = branches.select(near, "key", "n", (F.col("n") + F.col("held")).alias("total")).repartition(partitions, "near").sortWithinPartitions("near")
    return dealt.select("key", "n", "total").mapInArrow(work, "key long, log double, bits int")


class Hot:
    """The keys that are broadcast, and their log10 probabilities."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        self.keys, self.logs = keys, logs
        self.table: Lookup | None = None

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The sum of each text's hot keys, and its other keys with their occurrences."""
        self.table = self.table or Lookup(self.keys)
        out, cold, owners = np.zeros(len(texts)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for block in _blocks(texts):
            keys, starts = _keys([texts[i] for i in block])
            place = self.table.find(keys)
            left = np.flatnonzero(place < 0)
            logs = self.logs[place] if len(self.logs) else np.zeros(len(keys))
            logs[left] = 0
            out[block] = np.add.reduceat(logs, starts)
            cold.append(keys[left])
            owners.append(np.array(block)[np.searchsorted(starts, left, "right") - 1])
        key, owner = np.concatenate(cold), np.concatenate(owners)
        by = np.lexsort((key, owner))
        key, owner = key[by], owner[by]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)])
        times = np.diff(np.append(first, len(key)))
        ends = pa.array(np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32))
        return out, pa.ListArray.from_arrays(ends, pa.array(key[first])), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))


def hottest(scores: DataFrame) -> tuple[Hot, int]:
    """The most frequent keys, HOT at most, and the binary digits from which a key's occurrences make it one."""
    sizes = dict(scores.groupBy("bits").count().collect())
    least, size = 64, 0
    while least > 1 and size + sizes.get(least - 1, 0) <= HOT:
        least -= 1
        size += sizes.get(least, 0)
    found = scores.where(F.col("bits") >= least).select("key", "log").toArrow()
    return Hot(found.column("key").to_numpy(), found.column("log").to_numpy()), least


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: their end is their only token. Null ids are held out. Repeated rows are scored alike, each for itself.
    Without training documents every token is unknown and every byte equally likely. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    python_workers(spark)
    scores = written(score_keys(written(count_branches(docs), "branches")), "keys")
    found, least = hottest(scores)
    hot = spark.sparkContext.broadcast(found)
    words = written(count_words(docs), "words")
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= max(1, n_all) / WORDS).toArrow()  # at most WORDS rows
    common = spark.sparkContext.broadcast(dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True)))
    rare_exists = n_kinds > frequent.num_rows
    base = n_all + n_kinds + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = common.value
        known: dict[bytes, int | None] = {}
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                raw = [plain(t) for t in part.column(1).to_pylist()]
                tokens, n_known, sums, rare, rare_n = [], [], [], [], []
                for t in raw:
                    seen = Counter(t.split(b" ") if t else ())
                    logs, hits, left, left_n = 0.0, 0, [], []
                    for w, k in seen.items():
                        c = known.get(w)
                        if c is None:
                            h = _word(w)
                            c = counts.get(h)
                            if c is None:
                                left.append(h)
                                left_n.append(k)
                                continue
                            known[w] = c
                        logs += k * np.log10((c + 1) / base)
                        hits += k
                    end = counts.get(0, 0)
                    tokens.append(seen.total() + 1)
                    n_known.append(hits + (end > 0))
                    sums.append(logs + np.log10((end + 1) / base))
                    rare.append(left)
                    rare_n.append(left_n)
                ids = part.column(0)
                logs10, cold, cold_n = hot.value.score(raw)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([is_held_out(d) for d in ids.to_pylist()]), pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64())), pa.array(logs10), cold, cold_n],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare", "rare_n", "score", "cold", "cold_n"],
                )

    first = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<long>, rare_n array<long>, score double, cold array<long>, cold_n array<long>")
    whole = written(first.withColumn("row", F.monotonically_increasing_id()), "scored")  # a written row keeps its number
    tail = whole.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    counted = words.where(F.col("n") < max(1, n_all) / WORDS) if rare_exists else words.limit(0)
    tail = tail.join(counted, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(base))).alias("more"))
    cold = whole.select("row", F.explode(F.arrays_zip("cold", "cold_n")).alias("c")).select("row", F.col("c.cold").alias("key"), F.col("c.cold_n").alias("k"))
    cold = cold.join(scores.where(F.col("bits") < least).select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("k") * F.col("log")).alias("cold_score"))
    return whole.join(tail, "row", "left").join(cold, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("cold_score", F.lit(0.0))).alias("score"))
