"""Byte-level BPE encoding and decoding over a segment tree.

For each match of the pattern a segment tree over its byte positions holds the smallest pair rank, the leftmost one among
equals. A merge takes the root, joins two live neighbours and updates the three leaves that this changes, each in
as many steps as the tree is high. Short pieces are merged side by side, one numpy tree a row; long ones have a tree of
their own, so that a piece of n bytes takes n log n steps whatever its content.

Words repeat, so each task keeps what it has encoded in a bounded cache, which has no influence on the result.
Spark hands tasks to idle workers in turn, so that each worker that ever ran beside others comes to hold a full cache: a task
takes few workers for that reason, and `encode` can check its ids itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.chunks import PATTERN as CUT_PATTERN
from petrilake.llm.chunks import Recent, cut, spliced
from petrilake.llm.common import python_workers

#: Bytes up to which pieces share a numpy tree; entries of the cache; bytes of text that are encoded at a time.
SIDE_BY_SIDE = 64
CACHE = 150_000
BLOCK = 1 << 20
INF = np.int64(1) << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file's ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Encodes and decodes with one table of ranks; made once a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.by_cut = ranks, regex.compile(pattern), pattern == CUT_PATTERN
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {i: t for t, i in ranks.items()}
        pairs = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.cuts, self.pieces = Recent(CACHE), Recent(CACHE)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], INF)

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of at most SIDE_BY_SIDE bytes, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(p) for p in pieces])
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        rows, shift = len(pieces), np.int64(width.bit_length())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        stride = width + 1  # position `width` stands for the end
        ids = np.zeros((rows, stride), np.int64)
        ids[:, :width] = self.byte_id[raw]
        inside = np.arange(width) < lengths[:, None]
        pos = np.arange(width, dtype=np.int64)
        after = np.where(np.arange(stride)[None, :] + 1 < lengths[:, None], np.arange(stride)[None, :] + 1, width).astype(np.int64)
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int64), (rows, stride)).copy()

        leaf = np.full((rows, width), INF, np.int64)
        has = inside[:, :-1] & inside[:, 1:]
        rank = self._rank(ids[:, : width - 1][has], ids[:, 1:width][has])
        block = leaf[:, :-1]
        block[has] = np.where(rank < INF, rank << shift | np.broadcast_to(pos[:-1], has.shape)[has], INF)
        tree = np.full((rows, 2 * width), INF, np.int64)
        tree[:, width:] = leaf
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2

        dead = np.zeros((rows, stride), bool)
        flat_ids, flat_after, flat_before, flat_tree, flat_dead = ids.ravel(), after.ravel(), before.ravel(), tree.ravel(), dead.ravel()
        live = np.flatnonzero(tree[:, 1] < INF)
        while live.size:
            root = tree[live, 1]
            at, new, base, tbase = root & ((np.int64(1) << shift) - 1), root >> shift, live * stride, live * (2 * width)
            right = flat_after[base + at]
            beyond, left = flat_after[base + right], flat_before[base + at]
            flat_ids[base + at] = new
            flat_after[base + at] = beyond
            flat_before[base + beyond] = at  # the end's entry is never read
            flat_dead[base + right] = True
            flat_tree[tbase + width + right] = INF
            rank = np.where(beyond < width, self._rank(new, flat_ids[base + beyond]), INF)
            flat_tree[tbase + width + at] = np.where(rank < INF, rank << shift | at, INF)
            has = left >= 0
            rank = self._rank(flat_ids[base[has] + left[has]], new[has])
            flat_tree[tbase[has] + width + left[has]] = np.where(rank < INF, rank << shift | left[has], INF)
            nodes = np.concatenate([width + at, width + right, width + left[has]]) >> 1
            owner = np.concatenate([tbase, tbase, tbase[has]])
            for _ in range(width.bit_length() - 1):
                flat_tree[owner + nodes] = np.minimum(flat_tree[owner + 2 * nodes], flat_tree[owner + 2 * nodes + 1])
                nodes >>= 1
            live = live[tree[live, 1] < INF]

        keep = inside & ~dead[:, :width]
        out, ends = ids[:, :width][keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _alone(self, piece: bytes) -> bytes:
        """The same for a piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        shift, inf, pairs = width.bit_length(), int(INF), self.pairs
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> int:
            rank = pairs.get(ids[i] << 20 | ids[after[i]]) if after[i] < n else None
            return inf if rank is None else rank << shift | i

        tree = [inf] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < inf:
            at, new = tree[1] & ((1 << shift) - 1), tree[1] >> shift
            right = after[at]
            ids[at], ids[right], after[at] = new, -1, after[right]
            if after[at] < n:
                before[after[at]] = at
            changed = [(at, leaf(at)), (right, inf)]
            if before[at] >= 0:
                changed.append((before[at], leaf(before[at])))
            for i, value in changed:
                k = width + i
                tree[k] = value
                while k > 1:
                    k >>= 1
                    low = min(tree[2 * k], tree[2 * k + 1])
                    if tree[k] == low:
                        break
                    tree[k] = low
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces."""
        out, groups = {}, {}
        for p in pieces:
            if (whole := self.ranks.get(p)) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(p) > SIDE_BY_SIDE:
                out[p] = self._alone(p)
            else:
                groups.setdefault((len(p) - 1).bit_length(), []).append(p)
        for group in groups.values():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                out.update(zip(part, self._side_by_side(part), strict=True))
        return out

    def _encode_cuts(self, cuts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(c) for c in cuts]
        pieces = [p for ps in split for p in ps]

        def coded(new: list[str]) -> list[bytes]:
            raw = [p.encode() for p in new]
            found = self.encode_pieces(raw)
            return [found[r] for r in raw]

        return spliced(split, self.pieces.values(pieces, coded))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cuts = [cut(t) for t in texts] if self.by_cut else [[t] if t else [] for t in texts]
        return spliced(cuts, self.cuts.values([c for cs in cuts for c in cs], self._encode_cuts))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_made: dict[tuple[str, str], SegmentTreeBpe] = {}


def coder(path: str, pattern: str) -> SegmentTreeBpe:
    """The worker's coder for a vocabulary file."""
    if (path, pattern) not in _made:
        _made[path, pattern] = SegmentTreeBpe(read_ranks(path), pattern)
    return _made[path, pattern]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    start, block, size = 0, [], 0
    for i, t in enumerate(texts):
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK:
            yield start, block
            start, block, size = i + 1, [], 0
    if block:
        yield start, block


def encode(docs: DataFrame, vocabulary: str, pattern: str, columns: list[str] | None = None, round_trip: bool = False) -> DataFrame:
    """docs with `ids` (little-endian unsigned 32-bit integers) and `n_tokens` of each whole text.

    vocabulary: the path of a .tiktoken file that every worker can open. A null text is an empty one: no ids. Other columns
    (or those named, in their order) stay; `ids` and `n_tokens` of docs are replaced. With round_trip, so is `round_trip`:
    whether the ids decode to the text, found by the worker that encodes it, without a second one for the task.
    """
    python_workers(docs.sparkSession, 500)
    made = {"ids": F.lit(b""), "n_tokens": F.lit(0).cast("long")} | ({"round_trip": F.lit(True)} if round_trip else {})
    docs = docs.drop(*made)
    names = docs.columns if columns is None else columns
    header, kept = [*names, *made], len(names)
    if columns is not None:
        docs = docs.select(*dict.fromkeys([*columns, "text"]))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            for start, block in _blocks(b.column(at).to_pylist()):
                ids = bpe.encode(block)
                out = [*b.slice(start, len(block)).columns[:kept], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if round_trip:
                    out.append(pa.array([bpe.decode(x) == t.encode() for x, t in zip(ids, block, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, header)

    return docs.mapInArrow(work, (docs if "text" in names else docs.drop("text")).withColumns(made).schema)


def decode(rows: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """rows with `decoded`, the bytes that `ids` stand for (null for null)."""
    rows = rows.drop("decoded")
    names = rows.columns
    at = names.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else bpe.decode(x) for x in b.column(at).to_pylist()], pa.binary())], [*names, "decoded"])

    return rows.mapInArrow(work, rows.withColumn("decoded", F.lit(b"")).schema)
