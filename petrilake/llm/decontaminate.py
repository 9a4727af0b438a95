"""Benchmark decontamination with an FM-index per shard of the training text.

Each task indexes its documents shard by shard (a shard is closed at `SHARD_BYTES` of text) and looks all benchmark windows
up at once by backward search: the ranks come from a wavelet matrix over the shard's Burrows-Wheeler transform, the places of the occurrences from sampled suffix positions, and the spans of a document are merged.

Words outside the benchmark are one break symbol, and so is the border of two words that are neighbours in no window. A run between
breaks that is shorter than the shortest window holds no occurrence and is left out of the index; this drops no occurrence.
Nothing is shuffled: a shard needs the documents of one task only, so a document group of any size is harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import python_workers

SHARD_BYTES = 8 << 20
#: Words of benchmark text that one pass over the documents looks up; the benchmark is taken in blocks of that size.
BLOCK_WORDS = 500_000
SAMPLE = 16

#: Fixed value of the contract: bytes of words. A-Z are lower-cased; 0-9, a-z and all bytes of other code points stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased; null has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


class Windows:
    """A block of benchmark items as distinct windows over a vocabulary of its own."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.shortest = min((len(w) for w in found), default=0)
        lengths = np.array([len(w) for w in found], np.int64)
        self.groups = [(n, np.flatnonzero(lengths == n), np.array([w for w in found if len(w) == n], np.int64)) for n in sorted(set(lengths.tolist()))]
        base = self.base = len(self.vocabulary) + 1
        self.neighbours = np.unique(np.array([a * base + b for w in found for a, b in zip(w, w[1:], strict=False)], np.int64))


class FmIndex:
    """The index of a sequence of runs of symbols from 1 to top; 0 ends each run."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        start = symbols + len(ends)  # each end is a symbol of its own, below all others, so that no comparison leaves its run
        start[ends] = np.arange(len(ends))
        order, rank = self._ranks(start)
        step = 1
        while rank.max() < n - 1:
            beyond = np.zeros(n, np.int64)
            beyond[: n - step] = rank[step:] + 1
            order, rank = self._ranks(rank * (n + 1) + beyond)
            step *= 2
        self.order = order
        self.bwt = symbols[order - 1]  # of the first suffix: the last symbol, an end
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, level = [], [], self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = level >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = level[np.argsort(bit, kind="stable")]
        begins = np.zeros(n, bool)
        begins[0] = True
        begins[ends[:-1] + 1] = True
        begins[::SAMPLE] = True
        self.sampled = begins[order]  # run starts too: the walk never meets an end
        at = np.flatnonzero(self.sampled)
        self.place = np.full(n, -1, np.int64)
        self.place[at] = order[at]

    @staticmethod
    def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        return order, rank

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places of the transform, by the wavelet matrix."""
        low, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = symbol >> (self.bits - 1 - level) & 1
            one_low, one_at = ones[low], ones[at]
            low, at = np.where(bit, zeros + one_low, low - one_low), np.where(bit, zeros + one_at, at - one_at)
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that start with each pattern, by backward search."""
        last = patterns[:, -1]
        first, end = self.below[last], self.below[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(first < end)
            if not live.size:
                break
            symbol = patterns[live, k]
            first[live] = self.below[symbol] + self.rank(symbol, first[live])
            end[live] = self.below[symbol] + self.rank(symbol, end[live])
        return first, np.maximum(first, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by walking to sampled ones."""
        out, at, steps, who = np.full(len(rows), -1, np.int64), rows.copy(), 0, np.arange(len(rows))
        while who.size:
            here = self.sampled[at]
            out[who[here]] = self.place[at[here]] + steps
            who, at = who[~here], at[~here]
            symbol = self.bwt[at]
            at = self.below[symbol] + self.rank(symbol, at)
            steps += 1
        return out


def search_shard(texts: list[str | None], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text its number of words, the merged (first, last) word spans and the items of the windows it holds."""
    get, ids, sizes = windows.vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))
    flat = np.concatenate(ids)
    begin = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)[:-1]])
    near = np.zeros(len(flat) + 1, bool)  # near[i]: words i - 1 and i stand together in some window
    if len(windows.neighbours) and len(flat) > 1:
        both = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        key = flat[both] * windows.base + flat[both + 1]
        at = np.minimum(np.searchsorted(windows.neighbours, key), len(windows.neighbours) - 1)
        near[both[windows.neighbours[at] == key] + 1] = True
    first = np.flatnonzero((flat > 0) & ~near[:-1])
    last = np.flatnonzero((flat > 0) & ~near[1:])
    long = last - first + 1 >= max(1, windows.shortest)
    first, last = first[long], last[long]

    change = np.zeros(len(flat) + 1, np.int64)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    if len(first) and windows.groups:
        length = last - first + 2  # with its end
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(starts - first, length)  # of each indexed symbol in flat
        symbols = flat[place]
        symbols[starts + length - 1] = 0
        index = FmIndex(symbols, windows.base - 1)
        for n, which, patterns in windows.groups:
            lo, hi = index.search(patterns)
            count = hi - lo
            rows = np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]) - lo, count)
            at = place[index.locate(rows)]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            hits.append((at, np.repeat(which, count)))
    hit = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    span_first, span_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip((np.searchsorted(begin, span_first, "right") - 1).tolist(), span_first.tolist(), span_end.tolist(), strict=True):
        spans.setdefault(d, []).append((a - int(begin[d]), b - 1 - int(begin[d])))
    items: dict[int, set[int]] = {}
    for at, which in hits:
        pairs = np.unique(np.stack([np.searchsorted(begin, at, "right") - 1, which]), axis=1)
        for d, w in pairs.T.tolist():
            items.setdefault(d, set()).update(windows.items[w])
    for d, n in enumerate(sizes):
        yield n, spans.get(d, []), items.get(d, set())


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two lists of spans as one, without overlaps or spans that touch."""
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def benchmark_blocks(benchmark: DataFrame, size: int) -> Iterator[Windows]:
    """The benchmark in blocks of about BLOCK_WORDS words, each small enough to be sent to every task."""
    items: list[tuple[int, list[bytes]]] = []
    total = 0
    for r in benchmark.where("item_id is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        words = words_of(r[1])
        if words:
            items.append((r[0], words))
            total += len(words)
        if total >= BLOCK_WORDS:
            yield Windows(items, size)
            items, total = [], 0
    if items:
        yield Windows(items, size)


#: A pass over a task's batches.
Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _search(docs: DataFrame, windows: Windows) -> Pass:
    """Adds to the columns n_words, spans and items of docs what this block of the benchmark has."""
    names = docs.columns
    text, n_words, old_spans, old_items = (names.index(c) for c in ("text", "n_words", "spans", "items"))
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search_shard([t for b in held for t in b.column(text).to_pylist()], shared.value)
        for b in held:
            ns, spans, items = [], [], []
            for s0, i0 in zip(b.column(old_spans).to_pylist(), b.column(old_items).to_pylist(), strict=True):
                n, s, i = next(found)
                ns.append(n)
                spans.append([{"first": x, "last": y} for x, y in _merge([(x["first"], x["last"]) for x in s0], s)])
                items.append(sorted(set(i0) | i))
            columns = list(b.columns)
            columns[n_words], columns[old_spans], columns[old_items] = pa.array(ns, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                held.append(part)
                size += sum(len(x or "") for x in part.column(text).to_pylist())
                if size >= SHARD_BYTES:
                    yield from searched(held)
                    held, size = [], 0
        if held:
            yield from searched(held)

    return work


def _in_turn(passes: list[Pass]) -> Pass:
    """All passes by the same worker, so that a task takes one however many there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in passes:
            batches = f(batches)
        return batches

    return work


def _searches(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, list[Pass]]:
    """docs with empty results, and the passes that fill them."""
    python_workers(docs.sparkSession)
    docs = docs.drop("n_words", "spans", "items")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.from_json(F.lit("[]"), "array<struct<first: int, last: int>>"), "items": F.array().cast("array<bigint>")})
    out = out.select(*docs.columns, "n_words", "spans", "items")
    passes = [_search(out, windows) for windows in benchmark_blocks(benchmark, window)]
    return out, passes or [_search(out, Windows([], window))]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with n_words, spans (merged first and last word of what the benchmark holds) and items (their ids, sorted).

    A window is `window` consecutive words of an item, or the whole item if it has fewer words but not none. Null texts have no
    words; items without an id or without words are left out; items that repeat an id count as one. An empty benchmark finds nothing.
    Each row of docs is searched for itself. Columns of docs named like the results are replaced.
    """
    out, passes = _searches(docs, benchmark, window)
    return out.mapInArrow(_in_turn(passes), out.schema)


def cut_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    plain = raw.translate(WORD_BYTES)
    places, at, word, out = [], 0, 0, []
    wanted = {i for s in spans for i in (s["first"], s["last"])}
    found: dict[int, tuple[int, int]] = {}
    for w in plain.split():
        at = plain.index(w, at)
        if word in wanted:
            found[word] = (at, at + len(w))
        at += len(w)
        word += 1
    places = [(found[s["first"]][0], found[s["last"]][1]) for s in spans]
    before = 0
    for a, b in places:
        out.append(raw[before:a])
        before = b
    out.append(raw[before:])
    return b"".join(out).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with the benchmark's spans cut out of their texts; clean documents stay as they are."""
    found, passes = _searches(docs, benchmark, window)
    names, text, spans = docs.columns, found.columns.index("text"), found.columns.index("spans")
    places = [found.columns.index(c) for c in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[text] = pa.array([cut_spans(t, s) for t, s in zip(b.column(text).to_pylist(), b.column(spans).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([columns[i] for i in places], names)

    return found.mapInArrow(_in_turn([*passes, work]), docs.schema)
