"""Token ids as Arrow stream files of fixed-size lists.

A data set is a folder of shards in ascending order of the documents. Each shard has two Arrow IPC stream files:

* ``ids-NNNNN.arrows``: batches of equal-length sequences, `ids` a fixed-size list of `sequence` unsigned integers (16 bits wide
  where the vocabulary fits, else 32) and `mask` one of as many bits (1: a token, 0: padding, at the shard's end only). Every sequence of a memory-mapped
  file is found by arithmetic and read without a copy.
* ``docs-NNNNN.arrows``: `doc_id`, `first` (position within the shard's run of ids) and `n_tokens` of its documents, in order.

A task writes under a name of its own attempt and renames at the end, so that a repeated or a speculative task leaves
one whole file. What the shards hold in total is a few numbers a shard, kept in a manifest table.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrilake.llm.chunks import Recent, cut, spliced
from petrilake.llm.common import python_workers

#: Entries of a worker's cache; cuts that the library encodes as one text; sequences of one batch of a file.
CACHE = 400_000
TOGETHER = 1000
SEQUENCES = 64


def ids_schema(sequence: int, vocabulary: int) -> pa.Schema:
    """The schema of the sequences of a vocabulary of that size."""
    return pa.schema([("ids", pa.list_(pa.uint16() if vocabulary <= 1 << 16 else pa.uint32(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class CachedTokenizer:
    """The tokenizers library's encoding, asked once for each distinct cut of the texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.spelling = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.spelling.encode_special_tokens = True
        self.vocabulary = self.library.get_vocab_size()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Recent(CACHE)
        names = self.library.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # whether a token starts with a space or a line end, as the vocabulary spells them
        self.opens[[i for name, i in names.items() if name[0] in "\u0120\u010a"]] = True

    def _encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut. Cuts whose only space or line end is their first character are encoded as one text:
        no match reaches over two of them, and a cut's ids start where the next token that opens with one stands."""
        single = [c[0] in " \n" and c.count(" ") + c.count("\n") == 1 and len(c) > 1 and not c[1].isspace() and not c[-1].isspace() for c in cuts]
        plain, rest = [c for c, s in zip(cuts, single, strict=True) if s], [c for c, s in zip(cuts, single, strict=True) if not s]
        done = []
        for e, n in zip(self.spelling.encode_batch_fast(["".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)], add_special_tokens=False), range(0, len(plain), TOGETHER), strict=True):
            ids = np.array(e.ids, "<u4")
            first = np.flatnonzero(self.opens[ids]) * 4
            if len(first) != len(plain[n : n + TOGETHER]):
                raise ValueError("the vocabulary joins words over a space")
            raw = ids.tobytes()
            done += [raw[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(raw)], strict=True)]
        plain_ids, rest_ids = iter(done), (np.array(e.ids, "<u4").tobytes() for e in self.spelling.encode_batch_fast(rest, add_special_tokens=False))
        return [next(plain_ids if s else rest_ids) for s in single]

    def encode(self, texts: list[str], added: bool = True) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; added: the vocabulary's added tokens have ids of their own."""
        whole = {i for i, t in enumerate(texts) if added and any(a in t for a in self.added)}
        cuts = [[] if i in whole else cut(t) for i, t in enumerate(texts)]
        ids = spliced(cuts, self.memo.values([c for cs in cuts for c in cs], self._encode_cuts))
        for i in whole:
            ids[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return ids


_made: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _made:
        _made[path] = CachedTokenizer(path)
    return _made[path]


class ShardWriter:
    """Writes one shard: a run of ids cut into sequences, and its documents."""

    def __init__(self, folder: str, shard: int, sequence: int, vocabulary: int) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.schema = ids_schema(sequence, vocabulary)
        self.sequence, self.left, self.total, self.rows = sequence, b"", 0, 0
        self.names = [f"{root}/{kind}-{shard:05d}.arrows" for kind in ("ids", "docs")]
        self.mine = [f"{root}/.{uuid.uuid4().hex}.{kind}" for kind in ("ids", "docs")]
        self.store.create_dir(root, recursive=True)
        self.sinks = [self.store.open_output_stream(n) for n in self.mine]
        self.files = [pa.ipc.new_stream(s, schema) for s, schema in zip(self.sinks, (self.schema, DOCS), strict=True)]

    def _put(self, ids: bytes, padding: int = 0) -> None:
        flat = np.frombuffer(ids + b"\0" * (4 * padding), "<u4")
        mask = np.ones(len(flat), bool)
        if padding:
            mask[-padding:] = False
        width = self.schema.field("ids").type.value_type
        for i in range(0, len(flat), n := self.sequence * SEQUENCES):
            part = [pa.FixedSizeListArray.from_arrays(pa.array(x[i : i + n], t), self.sequence) for x, t in ((flat.astype(width.to_pandas_dtype()), width), (mask, pa.bool_()))]
            self.files[0].write_batch(pa.RecordBatch.from_arrays(part, schema=self.schema))

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        """Documents in order, each with all its ids."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        first = self.total + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first), pa.array(sizes)], schema=DOCS))
        self.total, self.rows = self.total + int(sizes.sum()), self.rows + len(sizes)
        run = b"".join([self.left, *ids])
        whole = len(run) // (4 * self.sequence) * 4 * self.sequence
        self._put(run[:whole])
        self.left = run[whole:]

    def close(self) -> None:
        if self.left:
            self._put(self.left, self.sequence - len(self.left) // 4)
        for f, s in zip(self.files, self.sinks, strict=True):
            f.close()
            s.close()
        for mine, name in zip(self.mine, self.names, strict=True):
            self.store.move(mine, name)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, sequence: int = 2048, end_id: int = 0, shards: int | None = None, added: bool = True) -> DataFrame:
    """Write the ids of every whole text of docs(doc_id, text), in ascending doc_id order; the manifest of what was written.

    The manifest has shard, start (ids in the shards before), n_docs and n_ids. A null text is an empty one; every document
    ends with end_id. A null doc_id comes first. Rows of one doc_id are all written, in the order of their texts' hashes.
    With added, the vocabulary's added tokens are read in texts as the library does by default; without, they are spelled like other text.
    """
    spark = docs.sparkSession
    python_workers(spark, 500)
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, out, end = _tokenizer(vocabulary), TaskContext.get().partitionId(), None, end_id.to_bytes(4, "little")
        for b in batches:
            if not b.num_rows:
                continue
            out = out or ShardWriter(folder, shard, sequence, tokenizer.vocabulary)
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 4 << 20 or i == len(texts) - 1:
                    out.add(doc_ids[start : i + 1], [x + end for x in tokenizer.encode(texts[start : i + 1], added)])
                    start, size = i + 1, 0
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out.rows], pa.int64()), pa.array([out.total], pa.int64())], ["shard", "n_docs", "n_ids"])

    manifest = f"{folder}/manifest"
    dealt.mapInArrow(work, "shard int, n_docs long, n_ids long").write.mode("overwrite").parquet(manifest)
    rows = spark.read.schema("shard int, n_docs long, n_ids long").parquet(manifest)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return rows.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids")


class ShardReader:
    """Random access to one shard; slices share the file's memory where the store can map it."""

    def __init__(self, folder: str, shard: int) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        ids, docs = (f"{root}/{kind}-{shard:05d}.arrows" for kind in ("ids", "docs"))
        source = pa.memory_map(ids) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(ids)
        with pa.ipc.open_stream(source) as r:
            self.batches = [(b.column(0).flatten().to_numpy(), b.column(1).flatten()) for b in r]
            self.sequence = r.schema.field("ids").type.list_size
        with store.open_input_file(docs) as f, pa.ipc.open_stream(f) as r:
            self.docs = r.read_all()
        self.ends = np.cumsum([len(ids) for ids, _ in self.batches], dtype=np.int64)

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask (bits) of the shard's i-th sequence, without a copy."""
        k = int(np.searchsorted(self.ends, i * self.sequence, "right"))
        at = i * self.sequence - (int(self.ends[k - 1]) if k else 0)
        ids, mask = self.batches[k]
        return ids[at : at + self.sequence], mask.slice(at, self.sequence)

    def tokens(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from a position of the shard's run, in pieces that share the file's memory."""
        k = int(np.searchsorted(self.ends, first, "right"))
        while n > 0:
            at = first - (int(self.ends[k - 1]) if k else 0)
            piece = self.batches[k][0][at : at + n]
            yield piece
            first, n, k = first + len(piece), n - len(piece), k + 1


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    spark: SparkSession = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = ShardReader(folder, shard)
                for docs in reader.docs.to_batches():
                    sums = []
                    for first, size in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in reader.tokens(first, size):
                            crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                        sums.append(crc)
                    begin = docs.column(1).to_numpy() + start
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(begin), docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "start").repartition(n, "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
