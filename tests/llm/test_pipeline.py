"""The pipeline against its stages' plain versions, on the smallest table."""

import os
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain
from conftest import DATA

import __spark_entry__ as entry
import corpus_pipeline
from petrilake.llm import bpe, quality


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_pipeline(spark):
    import tiktoken

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(table).where("kept").select("doc_id").collect()}
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect() if r.doc_id in kept]
    assert 0 < len(docs) < table.count()
    docs = [(i, x[0]) for i, x in plain.kept_lines(docs).items()]
    groups = plain.jaccard_components(docs)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = plain.contamination(docs, items)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.frombuffer(got[i].ids, "<u4").tolist()
        assert got[i].round_trip and got[i].n_tokens == len(ids)
        if not hits[i][1]:
            assert ids == library.encode_ordinary(t)
        else:
            assert len(plain.bench_words(library.decode(ids))) <= hits[i][0] - hits[i][1] + 1


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, DATA).columns == docs.columns


@pytest.mark.parametrize("k", [3, 4])
def test_one_worker_a_task(spark, k):
    """Workers that a task runs side by side are kept, and each comes to hold a full cache."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = corpus_pipeline.STAGES[k][1](spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


EXTRA = {"_id": 1, "classes": "x", "n_words": 2.5, "spans": None, "n_lines": "y", "kept": True, "component_id": 3, "_drop": "z", "a.b": "dot"}


@pytest.mark.parametrize("k", range(4))
def test_stages_of_odd_rows(spark, k):
    """Nulls, empty and long texts, repeated rows, ties and clashing columns; extra columns come through unchanged."""
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    words = [f"word{i * 7919 % 1009}" for i in range(400)]
    prose = "\n".join(" ".join(words[i : i + 10]) for i in range(0, 400, 10))
    rows = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (None, prose), (None, None), (5, "x" * 200_000 + "\n" + prose), (6, f"{' '.join(words[::-1])}\n{benchmark}"), (7, " ".join(words[200:] + words[:100]))]
    table = spark.createDataFrame([(i, t, None, "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table.select("*", *[F.lit(v).cast("string" if v is None else type(v).__name__.replace("str", "string").replace("float", "double").replace("bool", "boolean")).alias(c) for c, v in EXTRA.items()])
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    for r in got:
        assert [r[5 + i] for i in range(len(EXTRA))] == list(EXTRA.values())
    ids = sorted((r.doc_id for r in got), key=str)
    if k == 0:
        assert None in ids and {1, 2, 5, 7} <= set(ids) and not {3, 4} & set(ids)
    elif k == 1:
        assert len(got) == len(rows) and [r.text for r in got if r.doc_id == 2] == [r.text for r in got if r.doc_id == 2][:1] * 2
        texts = {r.doc_id: r.text for r in got}
        assert texts[1] == "" and texts[2] == "" and texts[5].endswith(prose)  # the largest id keeps the lines
        assert texts[3] == texts[4] == ""
    elif k == 2:
        assert ids.count(1) == 1 and not {2, 5} & set(ids) and {3, 4, 6, 7} <= set(ids) and None in ids
    else:
        assert len(got) == len(rows) and all(benchmark not in (r.text or "") for r in got)
        assert [r.text for r in got if r.doc_id == 1] == [prose] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
