"""Clusters of traces around subnets, and the comparison of two clusterings."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.operators.alignment import costs
from petrilake.operators.nets import Net, few, runs
from petrilake.sources.scratch import settled

#: Activities that are spelled as one character each.
MOST_ACTIVITIES = 1 << 14


def subnets(full_runs: DataFrame, most_transitions: int) -> DataFrame:
    """(subnet): the transition sets of full runs and all their unions, of at most so many transitions; waits do not count.

    Bounded by the model: at most the subsets of its transitions. Unions are added until there is no new one.
    """
    sets = full_runs.select(F.array_sort(F.array_distinct(F.filter("tids", lambda t: t != "w"))).alias("subnet")).where(F.size("subnet") <= most_transitions).distinct()
    grown = sets = settled(sets, "subnets")
    count = grown.count()
    while True:
        more = grown.crossJoin(few(sets.withColumnRenamed("subnet", "other"))).select(F.array_sort(F.array_union("subnet", "other")).alias("subnet"))
        grown = settled(grown.unionByName(more.where(F.size("subnet") <= most_transitions)).distinct(), "subnets")
        if (now := grown.count()) == count:
            return grown
        count = now


def coverage(variants: DataFrame, full_runs: DataFrame, nets: DataFrame, most_distance: int) -> DataFrame:
    """(subnet, trace, n_cases, cost): the variants within most_distance of a full run that uses the subnet only."""
    own = F.filter("tids", lambda t: t != "w")
    inside = nets.join(few(full_runs.select("run", own.alias("own"))), F.size(F.array_except("own", "subnet")) == 0).select("subnet", "run")
    each = variants.crossJoin(few(full_runs.select("run"))).select("trace", "n_cases", "run", D.indel(F.col("run"), F.col("trace")).alias("cost")).where(F.col("cost") <= most_distance)
    return settled(each.join(few(inside), "run").groupBy("subnet", "trace", "n_cases").agg(F.min("cost").alias("cost")), "coverage")


def best_pair(covered: DataFrame) -> DataFrame:
    """(first, second, score, clustered): the two subnets that score best.

    100 for each clustered case, -2 for each of its differences, -2 for each transition of both, -1 for each of either. Only sums of
    pairs of subnets are compared, never pairs of traces.
    """
    left = covered.select(F.col("subnet").alias("first"), "trace", "n_cases", F.col("cost").alias("c1"))
    right = covered.select(F.col("subnet").alias("second"), "trace", F.col("cost").alias("c2"))
    alone = covered.groupBy("subnet").agg(F.sum("n_cases").alias("cases"), F.sum(F.col("n_cases") * F.col("cost")).alias("cost"))
    shared = left.join(right, "trace").where("first < second").groupBy("first", "second").agg(F.sum("n_cases").alias("both"), F.sum(F.col("n_cases") * F.greatest("c1", "c2")).alias("dearer"))
    a, b = alone.select(F.col("subnet").alias("first"), F.col("cases").alias("n1"), F.col("cost").alias("s1")), alone.select(F.col("subnet").alias("second"), F.col("cases").alias("n2"), F.col("cost").alias("s2"))
    pairs = a.join(few(b), F.col("first") < F.col("second")).join(shared, ["first", "second"], "left")
    clustered = F.col("n1") + F.col("n2") - F.coalesce("both", F.lit(0))
    score = 100 * clustered - 2 * (F.col("s1") + F.col("s2") - F.coalesce("dearer", F.lit(0))) - 2 * F.size(F.array_intersect("first", "second")) - F.size("first") - F.size("second")
    return pairs.select("first", "second", score.alias("score"), clustered.alias("clustered")).orderBy(F.desc("score"), "first", "second").limit(1)


def assign(variants: DataFrame, covered: DataFrame, pair: DataFrame) -> DataFrame:
    """(trace, n_cases, cluster_id, cost): 1 or 2, the cheaper of the pair's subnets; null where neither covers the variant."""
    chosen = pair.select(F.explode(F.array(F.struct(F.lit(1).alias("id"), F.col("first").alias("subnet")), F.struct(F.lit(2).alias("id"), F.col("second").alias("subnet")))).alias("c")).select("c.id", "c.subnet")
    own = covered.join(F.broadcast(chosen), "subnet").groupBy("trace").agg(F.min(F.struct("cost", "id")).alias("b"))  # two rows
    return variants.join(own, "trace", "left").select("trace", "n_cases", F.col("b.id").alias("cluster_id"), F.col("b.cost").alias("cost"))


def best_subnets(covered: DataFrame, most: int) -> list[list[str]]:
    """The set of at most so many subnets that scores best (as in `best_pair`), the first in order among equals; none if nothing is covered.

    All sets are compared, so their number grows with the model's subnets to the power of most.
    """
    sizes = covered.select("subnet").distinct()
    sets = grown = sizes.select(F.array("subnet").alias("subnets"))
    for _ in range(most - 1):
        grown = grown.crossJoin(few(sizes)).where(F.element_at("subnets", -1) < F.col("subnet")).select(F.concat("subnets", F.array("subnet")).alias("subnets"))
        sets = sets.unionByName(grown)
    rows = sets.select("subnets", F.explode("subnets").alias("subnet")).join(covered, "subnet").groupBy("subnets", "trace").agg(F.first("n_cases").alias("n"), F.min("cost").alias("cost"))
    gain = rows.groupBy("subnets").agg(F.sum(F.col("n") * (100 - 2 * F.col("cost"))).alias("gain"))
    at = lambda f: F.aggregate("subnets", F.lit(0), f)
    shared = at(lambda a, s: a + F.aggregate(F.filter("subnets", lambda t: t < s), F.lit(0), lambda b, t: b + F.size(F.array_intersect(s, t))))
    score = F.col("gain") - 2 * shared - at(lambda a, s: a + F.size(s))
    found = gain.withColumn("score", score).orderBy(F.desc("score"), "subnets").select("subnets").first()
    return [list(s) for s in found.subnets] if found else []


def spelling(traces: DataFrame) -> Column:
    """The column `trace` as a word of one character an activity, by its rank in the alphabet of traces; a null activity, or one that is not there, is `?`.

    More than MOST_ACTIVITIES are an error.
    """
    letters = traces.select(F.explode("trace").alias("activity")).distinct()
    found = [r[0] for r in letters.where("activity is not null").orderBy("activity").limit(MOST_ACTIVITIES + 1).collect()]  # an alphabet
    if len(found) > MOST_ACTIVITIES:
        raise ValueError(f"more than {MOST_ACTIVITIES} activities")
    spelled = F.create_map(*[F.lit(x) for i, a in enumerate(found) for x in (a, chr(0x4E00 + i))]) if found else F.create_map(F.lit(""), F.lit(""))
    return F.array_join(F.transform("trace", lambda x: F.coalesce(F.element_at(spelled, x), F.lit("?"))), "")


def near_words(free: DataFrame, taken: DataFrame, most_distance: int) -> DataFrame:
    """(trace, id) of each trace of free within most_distance edits (Levenshtein) of a trace of taken(trace, id): the smallest id.

    Two words so close share one of the words that so many deletions leave of them: those are the key of the join, and pairs that meet
    are compared. Activities are spelled as in `spelling`.
    """
    word = spelling(free.select("trace").unionByName(taken.select("trace")))

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("key", F.array("word"))
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        for _ in range(most_distance):
            rows = rows.withColumn("key", F.array_distinct(F.concat("key", F.flatten(F.transform("key", cut)))))
        return rows.withColumn("key", F.explode("key"))

    left = keyed(free.select("trace", word.alias("word"))).select("key", "trace", "word")
    right = keyed(taken.select(word.alias("word"), "id").groupBy("word").agg(F.min("id").alias("id"))).select("key", F.col("word").alias("near"), "id")
    return left.join(right, "key").where(F.levenshtein("word", "near", most_distance) >= 0).groupBy("trace").agg(F.min("id").alias("id"))


def absorb(clustered: DataFrame, most_distance: int) -> DataFrame:
    """clustered with variants that no subnet covers taken into the cluster of a covered variant within most_distance (Levenshtein).

    Both sides are variants; the smallest cluster id within reach counts. Empty traces and activities of one side only take part.
    """
    free, taken = clustered.where("cluster_id is null"), clustered.where("cluster_id is not null").select("trace", F.col("cluster_id").alias("id"))
    got = near_words(free, taken, most_distance).withColumnRenamed("id", "got")
    return clustered.join(got, "trace", "left").withColumn("cluster_id", F.coalesce("cluster_id", "got")).drop("got")


def sampled_clusters(variants: DataFrame, net: Net, sample: int, n: int, most_distance: int, most_transitions: int, most_clusters: int, most_fruitless: int = 1) -> tuple[DataFrame, list[list[str]]]:
    """(trace, n_cases, cluster_id), and the subnets of the clusters from 1 on; null where no cluster takes the variant.

    Rounds of: sample variants, choose at most most_clusters subnets for them, and let each cluster absorb the variants within
    most_distance edits of one of its own, else those whose alignment with its subnet costs no more. What is absorbed leaves the log.
    The rounds end when no variant is left, or after most_fruitless rounds that cluster nothing.
    """
    full = runs(variants.sparkSession, net, n, True)
    nets = subnets(full, most_transitions)
    rest, parts, chosen, fruitless, turn = settled(variants.select("trace", "n_cases"), "rest"), [], [], 0, 0
    while fruitless < most_fruitless and (left := rest.count()):
        some = rest.orderBy(F.xxhash64("trace", F.lit(turn)), "trace").limit(sample)
        turn += 1
        covered = coverage(some, full, nets, most_distance)
        found = best_subnets(covered, most_clusters)
        if not found:
            fruitless = fruitless + 1 if left > sample else most_fruitless  # the same sample again would find nothing either
            continue
        ids = variants.sparkSession.createDataFrame([(len(chosen) + i, s) for i, s in enumerate(found, 1)], "id int, subnet array<string>")
        own = covered.join(F.broadcast(ids), "subnet").groupBy("trace").agg(F.min(F.struct("cost", "id")).alias("b")).select("trace", F.col("b.id").alias("id"))  # most_clusters rows
        own = settled(own, "own")
        near = settled(own.unionByName(near_words(rest.join(own, "trace", "left_anti"), own, most_distance)), "near")
        open_ = rest.join(near, "trace", "left_anti").select("trace")
        aligned = None
        for i, s in enumerate(found, 1):
            each = costs(open_, net.only(s)).where(F.col("cost") <= most_distance).select("trace", F.struct("cost", F.lit(len(chosen) + i).alias("id")).alias("b"))
            aligned = each if aligned is None else aligned.unionByName(each)
        got = settled(near.unionByName(aligned.groupBy("trace").agg(F.min("b").alias("b")).select("trace", F.col("b.id").alias("id"))), "got")
        parts.append(rest.join(got, "trace").select("trace", "n_cases", F.col("id").alias("cluster_id")))
        rest = settled(rest.join(got, "trace", "left_anti"), "rest")
        chosen += found
    out = rest.withColumn("cluster_id", F.lit(None).cast("int"))
    for part in parts:
        out = out.unionByName(part)
    return out, chosen


def jaccard_index(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(jaccard): pairs that both clusterings put together, of the pairs that either does; from counts, without the pairs."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = rows.groupBy(first, second).agg(F.count("*").alias("n"))
    cells = both.agg(pairs(F.col("n")).alias("n11"))
    a, b = (both.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias(name)) for k, name in ((first, "a"), (second, "b")))
    return cells.crossJoin(a).crossJoin(b).select(F.round(F.col("n11") / (F.col("a") + F.col("b") - F.col("n11")), 9).alias("jaccard"))  # one row each


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(jaccard) of two clusterings (case_id, cluster_id), over the cases that both have; see `jaccard_index`."""
    a, b = first.select("case_id", F.col("cluster_id").alias("c1")), second.select("case_id", F.col("cluster_id").alias("c2"))
    return jaccard_index(a.join(b, "case_id"), "c1", "c2")


def subnet_arcs(clusters: DataFrame, net: Net) -> DataFrame:
    """(cluster_id, src, dst): the arcs of the subnets of clusters(cluster_id, subnet), from places to transitions and from those to places."""
    table = net.frame(clusters.sparkSession)
    before = table.select("tid", F.explode("before").alias("src"), F.col("tid").alias("dst"))
    after = table.select("tid", F.col("tid").alias("src"), F.explode("after").alias("dst"))
    used = clusters.select("cluster_id", F.explode("subnet").alias("tid"))
    return used.join(F.broadcast(before.unionByName(after)), "tid").select("cluster_id", "src", "dst")  # a model's arcs


def gram_entries(variants: DataFrame, longest: int = 3) -> DataFrame:
    """(id, n_cases, gram): the runs of one to `longest` activities that each variant holds, once each; id numbers the variants."""
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("trace"), F.lit(1))), lambda i: i + k - 1 <= F.size("trace")), lambda i: F.slice("trace", i, k))))
    return variants.select("id", "n_cases", F.explode(F.array_distinct(grams)).alias("gram"))


def _sums(rows: DataFrame, columns: list) -> np.ndarray:
    """The sums of all products of two of the columns, as a square matrix; a handful of numbers."""
    k = len(columns)
    found = rows.agg(*[F.sum(columns[i] * columns[j]).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = found[f"{i}_{j}"] or 0.0
    return out


def _turned(columns: list, matrix: np.ndarray) -> list:
    """The columns times a small matrix."""
    return [reduce(lambda a, b: a + b, [c * float(matrix[i, j]) for i, c in enumerate(columns)]) for j in range(matrix.shape[1])]


def principal_parts(entries: DataFrame, parts: int = 5, most_turns: int = 60, still: float = 1e-10) -> tuple[DataFrame, list[float]]:
    """(id, f array<double>): each variant's coordinates on the first singular vectors of the matrix of entries(id, n_cases, gram), and the singular values.

    A variant is a row of ones for its grams, counted n_cases times; nothing is centred. A block of vectors is multiplied by the matrix and
    back in two aggregations a turn and made orthonormal by its products, until the values stand still. Grams and variants are joined,
    never laid out as columns, and neither is capped. Signs are those that make the sum of a part's coordinates positive. Parts
    beyond the matrix's rank are 0.
    """
    entries = settled(entries, "entries")
    names = [f"v{j}" for j in range(parts)]
    start = [(F.pmod(F.xxhash64(F.array_join("gram", "\x00"), F.lit(j)), F.lit(1 << 20)) / F.lit(1 << 19) - 1).alias(v) for j, v in enumerate(names)]
    vectors = entries.select("gram").distinct().select("gram", *start)
    before, values = None, np.zeros(parts)
    forth = lambda v: entries.join(v, "gram").groupBy("id").agg(F.first("n_cases").alias("n"), *[F.sum(c).alias(c) for c in names])
    for _ in range(most_turns):
        rows = forth(vectors)
        back = settled(entries.select("id", "gram").join(rows, "id").groupBy("gram").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in names]), "vectors")
        eigen, turn = np.linalg.eigh(_sums(back, [F.col(c) for c in names]))
        alive = eigen > 1e-13 * max(eigen.max(), 1e-300)
        turn = turn * np.where(alive, 1 / np.sqrt(np.where(alive, eigen, 1.0)), 0.0)
        vectors = back.select("gram", *[c.alias(v) for c, v in zip(_turned([F.col(c) for c in names], turn), names, strict=True)])
        values = np.sort(np.where(alive, eigen, 0.0))[::-1] ** 0.25  # of the matrix times its transpose, twice
        if before is not None and np.abs(values - before).max() <= still * max(values.max(), 1e-300):
            break
        before = values
    rows = settled(forth(vectors), "parts")
    weighted = [F.sqrt("n") * F.col(c) for c in names]
    eigen, turn = np.linalg.eigh(_sums(rows, weighted))
    turn = turn[:, ::-1]
    turned = _turned([F.col(c) for c in names], turn)
    signs = [1.0 if (x or 0) >= 0 else -1.0 for x in rows.agg(*[F.sum(c * F.col("n")).alias(f"s{j}") for j, c in enumerate(turned)]).first()]
    return rows.select("id", F.array(*[c * s for c, s in zip(turned, signs, strict=True)]).alias("f")), np.sqrt(np.maximum(eigen[::-1], 0)).tolist()


def super_instances(log: DataFrame, k: int, parts: int = 5, seed: int = 7) -> DataFrame:
    """(case_id, cluster, is_medoid): k-means over the first principal parts of binary 1- to 3-grams; a medoid is the case nearest its centre.

    Cases of one variant share its cluster; the smallest case id among equals is the medoid. Empty traces stand at 0.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    variants = settled(log.groupBy("trace").agg(F.count("*").alias("n_cases"), F.min("case_id").alias("case")).withColumn("id", F.monotonically_increasing_id()), "variants")
    found, _ = principal_parts(gram_entries(variants), parts)
    rows = variants.join(found, "id", "left").withColumn("f", F.coalesce("f", F.array(*[F.lit(0.0)] * parts)))
    rows = settled(rows, "instances")
    if not rows.limit(1).count():
        return rows.select(F.col("case").alias("case_id"), F.lit(0).alias("cluster"), F.lit(False).alias("is_medoid"))
    model = KMeans(k=k, seed=seed, maxIter=100, weightCol="n_cases").fit(rows.select(array_to_vector("f").alias("features"), "n_cases"))
    centres = [F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]
    far = lambda c: F.aggregate(F.zip_with("f", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))
    placed = rows.select("trace", "case", nearest.alias("near")).select("trace", "case", "near.cluster", "near.d")
    medoids = placed.groupBy("cluster").agg(F.min(F.struct("d", "case")).alias("m")).select("cluster", F.col("m.case").alias("medoid"))
    named = placed.join(F.broadcast(medoids), "cluster").select("trace", "cluster", "medoid")  # k rows
    return log.join(named, "trace").select("case_id", "cluster", (F.col("case_id") == F.col("medoid")).alias("is_medoid"))
