"""Line dedup: lines that several documents hold stay in one of them.

Each document emits the 128-bit hashes of its normalised lines, once each. A two-step aggregation counts distinct
documents per hash, so that a line of a third of all documents is summed where it is read. The most common lines, `HOT_LINES` at
most, are broadcast with the document that keeps them, and their occurrences are spread by document; the others join by hash, none with
more rows than the least hot one. The hashes to drop go back to their documents by doc_id, and each document is put together again from
the lines that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import LOWER_BYTES, WS, python_workers, written

#: Lines that are broadcast, at most; lines of fewer documents than HOT_DOCS are not.
HOT_LINES = 200_000
HOT_DOCS = 1000


def line_key(line: str) -> str:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(WS).encode().translate(LOWER_BYTES).decode()


def _hashes(text: str, min_chars: int) -> list[bytes | None]:
    """For each line its key's hash, or None where the key is too short to count."""
    lines = text.encode().translate(LOWER_BYTES).decode().split("\n")
    return [xxhash.xxh3_128_digest(k.encode()) if len(k := x.strip(WS)) >= min_chars else None for x in lines]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line): each counted line of each row, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {h for h in _hashes(t or "", min_chars) if h}
                ids += [d] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "line"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, line binary")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with a new `text`, and `n_lines` (before) and `n_dropped`.

    Keys of at least min_chars code points that at least min_docs documents hold lose all their lines, except in the
    largest doc_id that holds them. Null and empty texts are one empty line, which stays (so a null becomes empty). Rows
    of one doc_id are one document. A null doc_id is a document of its own that is smaller than any other. Other columns
    stay, but `n_lines`, `n_dropped`, `_drop` and `_id` of docs are replaced or dropped.
    """
    python_workers(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "_drop", "_id")
    lines = line_hashes(docs, min_chars)
    common = lines.groupBy("line", "doc_id").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    common, least = written(common.where(F.col("n") >= min_docs), "common"), HOT_DOCS
    while (hot := common.where(F.col("n") >= least)).count() > HOT_LINES:
        least *= 2
    marked = lines.join(F.broadcast(hot.select("line", F.col("keeper").alias("hot_keeper"), F.lit(True).alias("is_hot"))), "line", "left")
    spread = F.when(F.col("is_hot"), F.concat("line", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"."))).otherwise(F.col("line"))  # longer than any hash
    others = common.where(F.col("n") < least).select(F.col("line").alias("key"), "keeper", F.lit(True).alias("is_common"))
    found = marked.withColumn("key", spread).join(others, "key", "left").where("is_hot or is_common").withColumn("keeper", F.when(F.col("is_hot"), F.col("hot_keeper")).otherwise(F.col("keeper")))
    drops = found.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_drop"))
    both = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    names = docs.columns
    at, kept = names.index("text"), [c for c in names if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                if drop:
                    gone = set(drop)
                    stay = [x for x, h in zip(lines, _hashes(t or "", min_chars), strict=True) if h not in gone]
                else:
                    stay = lines
                texts.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [b.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, "text", "n_lines", "n_dropped"])

    schema = docs.select(*kept, F.col("text").cast("string"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return both.mapInArrow(work, schema).select(*names, "n_lines", "n_dropped")
