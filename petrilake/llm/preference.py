"""Quality by pairwise ranking: a Bradley-Terry model of preference pairs.

A document's strength is a weighted sum of figures of its text; a document of label 1 is preferred to one of label 0 with the
probability that the logistic function gives for the difference of their strengths. `fit` learns the weights from all pairs of all labelled
rows by logistic loss, and sets the threshold where as many strengths are below it as labels are 0. `score` is then one pass over all texts,
without a shuffle.

The pairs are as many as the product of both labels' rows, but are never made: a row's pull is a function of its strength alone, the sum of the
logistic function over all rows of the other label. Those are counted in narrow bins of strength with their moments, from which
the function follows as a polynomial a bin. So a Newton step is two passes over the labelled rows' figures.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import python_workers, written

#: The score of a document whose strength is the threshold's.
CUT = 0.3
#: Weight of the squared weights in the loss of all pairs, the Newton steps at most, and the change that ends them.
RIDGE, STEPS, STILL = 1e-2, 25, 1e-4
#: Width of the bins of strength, and the highest moment in them: the pull of a row is right to about (WIDTH / pi) ** (MOMENTS + 1).
WIDTH, MOMENTS = 1 / 16, 5
#: Characters that are cut into words at a time.
BLOCK = 1 << 20

NAMES = [
    "log_chars", "log_words", "word_length", "long_words", "upper", "upper_words", "digits", "stops", "cries", "symbols", "other_marks", "spaces", "breaks", "not_ascii",
    "byte_entropy", "same_char", "same_word", "distinct_words", "top_word", "word_entropy", "same_lines", "short_lines", "marked_words",
]
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:", "cries": b"!?", "symbols": b"#*$%&|<>@^~=+_\\/{}[]", "other_marks": b"\"'()-`", "spaces": b" \t", "breaks": b"\n\r"}
_MASKS = np.array([[b in bytes_ for b in range(256)] for bytes_ in _CLASSES.values()] + [[b >= 128 for b in range(256)]], np.float64)
_SPACE = re.compile(r"\s")
_MARKED = re.compile(r"[^\w\s][^\w\s]$")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK characters that end at white space, if there is any."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log2(p)).sum())


def figures(text: str | None) -> np.ndarray:
    """The figures of NAMES of one whole text; a null is as empty. White space is Python's."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(len(raw), 1)
    shares = _MASKS @ counts / n
    words: Counter[str] = Counter()
    total = letters = long_ = upper = same = marked = 0
    before = None
    for piece in _pieces(text or ""):
        for w in (found := piece.split()):
            if w == before:
                same += 1
            before = w
        words.update(found)
    for w, k in words.items():
        total += k
        letters += k * len(w)
        long_ += k * (len(w) > 12)
        upper += k * (len(w) > 1 and w.isupper())
        marked += k * (_MARKED.search(w) is not None)
    m = max(total, 1)
    kinds = np.fromiter(words.values(), np.int64, len(words))
    lines = Counter((text or "").split("\n"))
    lines.pop("", None)
    all_lines = max(sum(lines.values()), 1)
    return np.array(
        [
            math.log1p(len(text or "")), math.log1p(total), letters / m, long_ / m, shares[0], upper / m, *shares[1:],
            _entropy(counts), float((raw[1:] == raw[:-1]).sum()) / n, same / m, math.log1p(len(words)) / math.log1p(m), float(kinds.max()) / m if total else 0.0, _entropy(kinds),
            (all_lines - len(lines)) / all_lines if lines else 0.0, sum(k for x, k in lines.items() if len(x) < 20) / all_lines, marked / m,
        ]
    )


def _with_bends(x: np.ndarray) -> np.ndarray:
    """The figures and their square roots, so that small shares count too."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def figure_rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(*keep, x array<double>) of each row."""
    python_workers(docs.sparkSession)
    schema = docs.select(*keep, F.array(F.lit(0.0)).alias("x")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _with_bends(np.stack([figures(t.as_py()) for t in b.column(b.num_columns - 1)])) if b.num_rows else np.zeros((0, 2 * len(NAMES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*keep, "x"])

    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(work, schema)


@dataclass(frozen=True)
class Ranking:
    """What a fit found: the figures' means and scales, their weights, and the strength at the threshold."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        s = self.strengths(x) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def label_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of all labelled ids; an id with several labels has the largest, null labels are none."""
    return labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """`label_rows` of about `most` ids, drawn by a hash of the id: for a fit that is asked to be a bounded one."""
    one = written(label_rows(labels), "labels")
    share = most / max(one.count(), 1)
    return one if share >= 1 else one.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))


def pairs(rows: DataFrame, most: int) -> DataFrame:
    """(z): the differences of figures of about `most` pairs of a row of label 1 and one of label 0, met by random keys.

    Each row of label 1 is copied as often as needed, each copy draws one of as many keys as there are rows of label 0; so a copy meets
    one row on average, and no key holds many.
    """
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return rows.limit(0).select(F.col("x").alias("z"))
    copies = max(1, -(-most // good))
    left = rows.where("label = 1").select("doc_id", "x", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("c")).select("x", F.pmod(F.xxhash64("doc_id", "c"), F.lit(bad)).alias("key"))
    right = rows.where("label = 0").select(F.col("x").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit("other")), F.lit(bad)).alias("key"))
    return left.join(right, "key").select(F.zip_with("x", "y", lambda a, b: a - b).alias("z"))


def _newton(z: DataFrame, scale: np.ndarray, n: int) -> np.ndarray:
    """The weights (of scaled figures) that minimise the mean logistic loss of the pairs and RIDGE times half the squared weights."""
    d = len(scale)
    w = np.zeros(d)

    def sums(at: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + d * d)
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, d) / scale
                p = 1 / (1 + np.exp(np.clip(x @ at, -500, 500)))  # of the pair's order being the other one
                total[:d] -= p @ x
                total[d:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        return work

    for _ in range(STEPS):
        found = np.zeros(d + d * d)
        for i, v in z.mapInArrow(sums(w), "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # the size of the model
            found[i] = v
        gradient, hessian = found[:d] / n + RIDGE * w, found[d:].reshape(d, d) / n + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < STILL:
            break
    return w


def _derivatives(z: np.ndarray) -> np.ndarray:
    """The logistic function at z and its derivatives up to MOMENTS, each one over its order's factorial."""
    p, of = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.polynomial.Polynomial([0, 1])
    out = []
    for m in range(MOMENTS + 1):
        out.append(of(p) / math.factorial(m))
        of = of.deriv() * np.polynomial.Polynomial([0, 1, -1])
    return np.stack(out)


def _pulls(at: np.ndarray, centres: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sum of the logistic function of t - s over all t in bins: its coefficients in s's distance from each place of `at`, and
    the sum of the function's slopes between centres, which is a weight that leaves the second derivatives' sum positive."""
    coefficients, slopes = np.zeros((len(at), MOMENTS + 1)), np.zeros(len(at))
    for i in range(0, len(at), 256):
        d = _derivatives(centres[None, :] - at[i : i + 256, None])
        slopes[i : i + 256] = d[1] @ moments[:, 0]
        for k in range(MOMENTS + 1):
            coefficients[i : i + 256, k] = (-1) ** k * sum(math.comb(m, k) * (d[m] @ moments[:, m - k]) for m in range(k, MOMENTS + 1))
    return coefficients, slopes


def _summed(rows: DataFrame, work, keys: str) -> pa.Table:
    """Sums of v, which a task hands on once a key."""
    names = [k.split()[0] for k in keys.split(",")]
    return rows.mapInArrow(work, f"{keys}, v double").groupBy(*names).agg(F.sum("v").alias("v")).toArrow()


def _newton_all(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The weights (of scaled figures) that minimise the mean logistic loss of all pairs of rows(label, x) of label 1 and 0, and RIDGE times
    half the squared weights. The driver holds the bins of strength: about as many as the strengths' range has, whatever the rows."""
    d = len(scale)
    w = np.zeros(d)
    rows = rows.select(F.col("label").cast("int"), "x")

    def batch(b: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (b.column(1).flatten().to_numpy().reshape(-1, d) - mean) / scale
        return b.column(0).to_numpy(), x, x @ w

    def binned(w: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                label, x, s = batch(b, w)
                at = np.floor(s / WIDTH)
                e = s - (at + 0.5) * WIDTH
                values = np.concatenate([e[:, None] ** np.arange(MOMENTS + 1), x], axis=1)
                kinds, which = np.unique(np.stack([label, at.astype(np.int64)], axis=1), axis=0, return_inverse=True)
                sums = np.zeros((len(kinds), values.shape[1]))
                np.add.at(sums, which.ravel(), values)
                for kind, v in zip(map(tuple, kinds.tolist()), sums, strict=True):
                    total[kind] = total[kind] + v if kind in total else v
            if total:
                kinds, n = np.array(list(total)), MOMENTS + 1 + d
                i = np.tile(np.arange(n, dtype=np.int32), len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kinds[:, 0], n).astype(np.int32)), pa.array(np.repeat(kinds[:, 1], n)), pa.array(i), pa.array(np.concatenate(list(total.values())))], ["label", "bin", "i", "v"])

        return work

    def pulled(w: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], good: float):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + d * d)
            for b in batches:
                label, x, s = batch(b, w)
                for side, (centres, coefficients, slopes) in enumerate(sides):
                    on = label == side
                    at = np.searchsorted((centres[1:] + centres[:-1]) / 2, s[on])  # the nearest centre
                    p = ((s[on] - centres[at])[:, None] ** np.arange(MOMENTS + 1) * coefficients[at]).sum(1)
                    total[:d] += (-p if side else good - p) @ x[on]
                    total[d:] += (x[on].T @ (x[on] * slopes[at][:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        return work

    for _ in range(STEPS):
        found = _summed(rows, binned(w), "label int, bin long, i int")
        label, bins, i, v = (c.to_numpy() for c in found.columns)
        centres, sums = [], []
        for side in (0, 1):
            kinds, which = np.unique(bins[label == side], return_inverse=True)
            centres.append((kinds + 0.5) * WIDTH)
            sums.append(np.zeros((len(kinds), MOMENTS + 1 + d)))
            sums[-1][which, i[label == side]] = v[label == side]
        moments, first = [x[:, : MOMENTS + 1] for x in sums], [x[:, MOMENTS + 1 :] for x in sums]
        bad, good = (m[:, 0].sum() for m in moments)
        sides = [(centres[k], *_pulls(centres[k], centres[1 - k], moments[1 - k])) for k in (0, 1)]
        both = np.zeros((d, d))
        for k in range(0, len(centres[1]), 256):
            both += first[1][k : k + 256].T @ (_derivatives(centres[0][None, :] - centres[1][k : k + 256, None])[1] @ first[0])
        found = _summed(rows, pulled(w, sides, good), "i int")
        total = np.zeros(d + d * d)
        total[found.column("i").to_numpy()] = found.column("v").to_numpy()
        n = good * bad
        gradient, hessian = total[:d] / n + RIDGE * w, (total[d:].reshape(d, d) - both - both.T) / n + RIDGE * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < STILL:
            break
    return w


def ranked_value(values: DataFrame, rank: int) -> float:
    """The value that `rank` of values(v double) are before in ascending order, exactly: its bits are found 16 at a time by counts."""
    low, low_rank = 0, rank

    def counted(bits: int, prefix: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << 16, np.int64)
            for b in batches:
                k = (b.column(0).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
                k = np.where(k < 0, ~k, k ^ np.int64(-(1 << 63))).view(np.uint64)  # in the order of the values
                if bits < 48:
                    k = k[k >> np.uint64(bits + 16) == np.uint64(prefix)]
                total += np.bincount((k >> np.uint64(bits) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

        return work

    for bits in (48, 32, 16, 0):
        found = values.mapInArrow(counted(bits, low), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow().sort_by("i")
        after = np.cumsum(found.column("n").to_numpy())
        at = int(np.searchsorted(after, low_rank, "right"))
        low_rank -= int(after[at - 1]) if at else 0
        low = low << 16 | found.column("i")[at].as_py()
    k = np.array([low], np.uint64).view(np.int64)
    return float(np.where(k < 0, k ^ np.int64(-(1 << 63)), ~k).view(np.float64)[0])


def fit(docs: DataFrame, labels: DataFrame, labelled: int | None = None, most_pairs: int | None = None) -> Ranking | None:
    """Learn from docs(doc_id, text) and labels(doc_id, label of 0 or 1). None where the labels leave no pair.

    All labelled rows and all their pairs count; only who gives `labelled` or `most_pairs` has about so many drawn by hashes. Labels of
    unknown documents are left out; a document that stands in several rows counts with each.
    """
    some = (label_rows(labels) if labelled is None else sampled(labels, labelled)).where("label in (0, 1)")
    rows = written(figure_rows(docs.where("doc_id is not null"), "doc_id", "text", ["doc_id"]).join(some, "doc_id").select("doc_id", "label", "x"), "figures")
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not count.get(0) or not count.get(1):
        return None
    d = 2 * len(NAMES)
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()  # the figures
    mean, scale = np.zeros(d), np.ones(d)
    for i, m, s in each:
        mean[i], scale[i] = m, s if s > 1e-9 else 1.0
    if most_pairs is None:
        w = _newton_all(rows, mean, scale)
    else:
        z = written(pairs(rows, most_pairs), "pairs")
        if not (n := z.count()):
            return None
        w = _newton(z, scale, n)
    found = Ranking(tuple(mean), tuple(scale), tuple(w), 0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(found.strengths(b.column(0).flatten().to_numpy().reshape(-1, d)))], ["v"])

    strengths = written(rows.select("x").mapInArrow(work, "v double"), "strengths")
    return replace(found, threshold=ranked_value(strengths, count[0]))


def score(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """docs with `score` (0 to 1; 0.5 without a ranking) and `predicted` (1 where the score is CUT at least, else 0).

    Null and empty texts have the score of an empty text. Every row is scored, repeated ones too; a null id is no matter. Other columns
    stay, those named `score` and `predicted` are replaced. An empty table gives an empty result.
    """
    python_workers(docs.sparkSession)
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    at, names = docs.columns.index("text"), docs.columns
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if ranking and b.num_rows:
                s = ranking.scores(_with_bends(np.stack([figures(t.as_py()) for t in b.column(at)])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(work, schema)
