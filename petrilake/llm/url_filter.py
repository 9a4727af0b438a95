"""URL filters: explicit rules first, then trust and distrust that spread over the host graph.

Host edges are the absolute and protocol-relative links of pages and the domain hierarchy (a host and its parent domain vouch for each
other, up to the registered domain). Trust is a personalised PageRank from hosts of allowed pages along the edges; distrust starts at hosts of
blocked pages and runs against the edges, since a page that links to a blocked host is suspect and a blocked host's
targets are not. With each goes the usual rank, of a walk over the same edges that starts at all pages alike. A host's trust and distrust are
held against its usual ranks, so that what decides does not depend on the number of hosts: 1 is what an average page's neighbourhood has.
A host is blocked when its distrust exceeds `threshold` times its trust, and `evidence`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilake.llm.common import lower_ascii, written

#: Fixed values of the contract: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Ranks are settled when none changes by more than this share of itself in a block of ROUNDS rounds.
SETTLED = 0.01
ROUNDS = 5
#: Hosts whose ranks are broadcast; more are joined, where a host's edges are dealt by EDGES of them.
BROADCAST_HOSTS = 500_000
EDGES = 100_000


def host_of(url):
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url):
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host, path, rules=RULES):
    """The longest rule that fits, as struct(rule, verdict), or null. The rules are a parameter, not data."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, and each host with its parent domains both ways."""
    hosts = pages.select(host_of(F.col("url")).alias("src"), F.col("html"))
    links = (
        hosts.where("src != ''")
        .select("src", F.explode(F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'<>\\s]+)"), 1)).alias("url"))
        .select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
        .where("dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    names = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    labels = F.split("host", "\\.")
    up = (
        names.withColumn("l", labels)
        .select(F.explode(F.expr("transform(sequence(1, greatest(size(l) - 1, 1)), i -> struct(array_join(slice(l, i, size(l)), '.') as child, array_join(slice(l, i + 1, size(l)), '.') as parent))")).alias("e"))
        .select("e.child", "e.parent")
        .where("instr(parent, '.') > 0")
        .distinct()
    )
    tree = up.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    back = up.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("weight"))
    return links.unionByName(tree).unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _shares(edges: DataFrame) -> DataFrame:
    """(against, host, part, dst, share): what each host hands on along its edges, and against them; edges of one host in parts of about EDGES."""
    back = edges.select(F.lit(1).alias("against"), F.col("dst").alias("host"), F.col("src").alias("dst"), "weight")
    both = edges.select(F.lit(0).alias("against"), F.col("src").alias("host"), "dst", "weight").unionByName(back)
    out = both.groupBy("against", "host").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / EDGES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    dealt = both.join(out, ["against", "host"])
    return dealt.select("against", "host", "parts", part.alias("part"), "dst", (F.col("weight") / F.col("out")).alias("share"))


def host_scores(pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust, usual_trust, usual_distrust) of all hosts that a walk has reached.

    The seeds' weights are pages, and those of each walk sum to 1. A host without an edge hands nothing on; giving its rank back to
    the seeds would multiply all ranks of a walk by one number. Only host-level rows move, never pages. Without a number of rounds
    they go on until the ranks are settled and no further host is reached.
    """
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    judged = judged.select("host", matching_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    marks = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).cast("double")
    counts = written(judged.groupBy("host").agg(marks("allow").alias("allowed"), marks("block").alias("blocked"), F.count("*").cast("double").alias("n")), "hosts")
    totals = counts.agg(*[F.greatest(F.sum(c), F.lit(1.0)).alias(f"all_{c}") for c in ("allowed", "blocked", "n")])
    each = counts.crossJoin(F.broadcast(totals)).select("host", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("allowed", "blocked", "n")])  # one row broadcast
    rank_of = lambda against, mark: F.struct(F.lit(against).alias("against"), F.col(mark).alias("mark"), F.col("n").alias("usual"))
    seeds = each.select("host", F.explode(F.array(rank_of(0, "allowed"), rank_of(1, "blocked"))).alias("r"))
    seeds = written(seeds.select("r.against", "host", *[((1 - damping) * F.col(f"r.{c}")).alias(c) for c in ("mark", "usual")]), "seeds")
    shares = written(_shares(host_edges(pages)), "edges")
    few = shares.select("host").unionByName(seeds.select("host")).distinct().count() <= BROADCAST_HOSTS
    parted = shares.where("parts > 1").select("against", "host", "parts").distinct()  # hosts with more than EDGES edges

    def moved(rank: DataFrame) -> DataFrame:
        if few:
            met = shares.join(F.broadcast(rank), ["against", "host"])
        else:
            dealt = rank.join(parted, ["against", "host"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            met = shares.join(dealt, ["against", "host", "part"])
        return met.select("against", F.col("dst").alias("host"), *[(damping * F.col("share") * F.col(c)).alias(c) for c in ("mark", "usual")])

    rank, done, before = seeds, 0, None
    while rounds is None or done < rounds:
        for _ in range(ROUNDS if rounds is None else min(ROUNDS, rounds - done)):
            rank = moved(rank).unionByName(seeds).groupBy("against", "host").agg(F.sum("mark").alias("mark"), F.sum("usual").alias("usual"))
            done += 1
        rank = written(rank, "rank")
        if before is not None and rounds is None:
            pairs = rank.join(before.select("against", "host", F.col("mark").alias("mark0"), F.col("usual").alias("usual0")), ["against", "host"], "left")
            change = [F.when(F.col(c) > 0, (F.col(c) - F.coalesce(f"{c}0", F.lit(0.0))) / F.col(c)) for c in ("mark", "usual")]
            if (pairs.agg(F.max(F.greatest(*change))).first()[0] or 0.0) <= SETTLED:
                break
        before = rank
    one = lambda against, c: F.sum(F.when(F.col("against") == against, F.col(c)).otherwise(0.0))
    return rank.groupBy("host").agg(one(0, "mark").alias("trust"), one(1, "mark").alias("distrust"), one(0, "usual").alias("usual_trust"), one(1, "usual").alias("usual_distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0, evidence: float = 0.5, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, trust, distrust and verdict of every page; trust and distrust relative to the usual ranks.

    A null url, or one without ://, has an empty host and path; no rule and no edge fits it, and it is allowed. A null html has no
    links. Hosts that distrust does not reach are allowed. Repeated rows are judged alike, each counts as a page. Other columns of pages
    are dropped. An empty table gives an empty result.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    scores = written(host_scores(pages, rules, damping, rounds), "scores")
    kinds = ["trust", "distrust", "usual_trust", "usual_distrust"]
    sums = scores.agg(*[F.sum(k).alias(f"all_{k}") for k in kinds], F.count("*").alias("hosts"))
    share = lambda k: F.when(F.col(f"all_{k}") > 0, F.col(k) / F.col(f"all_{k}")).otherwise(0.0)
    relative = lambda k: F.when(share(f"usual_{k}") > 0, share(k) / share(f"usual_{k}")).otherwise(0.0).alias(k)
    found = written(scores.crossJoin(F.broadcast(sums)).select("host", relative("trust"), relative("distrust")), "relative")  # one row broadcast
    found = F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found
    spread = F.when((F.col("distrust") > threshold * F.col("trust")) & (F.col("distrust") > evidence), "block").otherwise("allow")
    return base.join(found, "host", "left").select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce(F.col("_rule.verdict"), spread).alias("verdict"))
