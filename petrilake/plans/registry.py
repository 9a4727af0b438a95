"""Every query over event logs and process models by name, with its SQL.

Users' events and conversations are the logs; the models in `models` are what they are compared with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilake.functions import distances as D
from petrilake.functions.numbering import families
from petrilake.operators import alignment, artefacts, clustering, logs, netcompare, nets, repair, subnets, wholetrace
from petrilake.plans import oracle as O
from petrilake.plans.models import CHAT, SHOP, SHORT, TREE
from petrilake.session import table
from petrilake.streaming import conformance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Steps of a run (the size of runs that users' traces are cut to), and the largest distance that is looked at.
STEPS = 6
MOST = 2 * STEPS
#: Steps of runs that meet conversations, which have up to 8 turns and are never cut: two silent steps and two spare ones more.
WHOLE = 12


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace a user."""
    return logs.traces(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace a conversation."""
    return logs.traces(table(spark, sf_dir, "conversations"), "conv_id", "role", ["turn"])


def spelled(df: DataFrame) -> DataFrame:
    return df.withColumn("trace", F.array_join("trace", " "))


# The log


@query(f"WITH {O.CHATS} SELECT case_id, array_to_string(trace, ' ') AS trace FROM log")
def project_traces(spark, sf_dir):
    return spelled(chat_log(spark, sf_dir))


@query(f"WITH {O.EVENTS} SELECT case_id, array_to_string(list_concat(trace[1:{STEPS}], list_transform(range(0, greatest(0, {STEPS} - len(trace))), lambda i: 'w')), ' ') AS trace FROM log")
def trace_prefix_padded(spark, sf_dir):
    return events_log(spark, sf_dir).select("case_id", F.array_join(D.padded(F.col("trace"), STEPS), " ").alias("trace"))


@query(f"WITH {O.CHATS} SELECT array_to_string(trace, ' ') AS trace, count(*) AS n_cases FROM log GROUP BY 1")
def variants(spark, sf_dir):
    return spelled(logs.variants(chat_log(spark, sf_dir)))


@query("SELECT DISTINCT event_type AS activity FROM events")
def log_alphabet(spark, sf_dir):
    return logs.alphabet(events_log(spark, sf_dir))


@query(f"WITH {O.CHATS} SELECT case_id, array_to_string(trace, ' ') AS trace FROM log ORDER BY case_id LIMIT 20")
def head_n_traces(spark, sf_dir):
    return spelled(logs.head(chat_log(spark, sf_dir), 20))


@query(f"WITH {O.CHATS} SELECT case_id, array_to_string(trace, ' ') AS trace FROM log ORDER BY md5('1 ' || case_id), case_id LIMIT 20")
def hash_sample_traces(spark, sf_dir):
    return spelled(logs.sample(chat_log(spark, sf_dir), 20, seed=1))


@query(f"WITH {O.CHATS}, {O.net(CHAT)} SELECT case_id, CAST(i AS INTEGER) AS pos, tid FROM (SELECT case_id, trace, unnest(range(1, least(len(trace), {WHOLE}) + 1)) AS i FROM log) JOIN net ON label = trace[i]")
def lambda_onehot(spark, sf_dir):
    return logs.one_hot(chat_log(spark, sf_dir), CHAT.frame(spark), WHOLE)


@query(f"WITH {O.EVENTS} SELECT case_id, array_to_string(list_transform(trace, lambda x: CASE WHEN x IN ('signup', 'view', 'purchase') THEN x ELSE 'w' END), ' ') AS trace FROM log")
def unknown_label_to_wait(spark, sf_dir):
    return spelled(logs.known_or_wait(events_log(spark, sf_dir), ["signup", "view", "purchase"]))


_LOG_NET = f"""cut AS (SELECT DISTINCT trace[1:{WHOLE}] AS trace FROM log WHERE len(trace) > 0),
steps AS (SELECT array_to_string(trace, ' ') AS k, len(trace) AS size, trace, unnest(range(0, len(trace))) AS i FROM cut),
arcs AS (SELECT CASE WHEN i = 0 THEN 'init' ELSE k || '/' || (i - 1) END AS src, trace[i + 1] || '@' || k || '/' || i AS transition, CASE WHEN i = size - 1 THEN 'end' ELSE k || '/' || i END AS dst FROM steps)"""


@query(f"WITH {O.CHATS}, {_LOG_NET} SELECT * FROM arcs")
def log_to_net_arcs(spark, sf_dir):
    return logs.to_net(chat_log(spark, sf_dir), WHOLE)


@query(f"WITH {O.CHATS}, {_LOG_NET} SELECT DISTINCT dst AS place FROM arcs WHERE dst NOT IN (SELECT src FROM arcs)")
def sink_places(spark, sf_dir):
    arcs = logs.to_net(chat_log(spark, sf_dir), WHOLE)
    return arcs.select(F.col("dst").alias("place")).distinct().join(arcs.select(F.col("src").alias("place")), "place", "left_anti")


@query(f"WITH RECURSIVE {O.CHATS}, {_LOG_NET}, d(transition, dst, depth) AS (SELECT transition, dst, 2 FROM arcs WHERE src = 'init' UNION ALL SELECT a.transition, a.dst, d.depth + 1 FROM d JOIN arcs a ON a.src = d.dst) SELECT transition, depth FROM d")
def transition_depth(spark, sf_dir):
    return nets.depths(logs.to_net(chat_log(spark, sf_dir), WHOLE), spark, WHOLE)


@query(f"WITH {O.EVENTS}, f AS (SELECT trace[i] AS src, trace[i + 1] AS dst FROM (SELECT trace, unnest(range(1, len(trace))) AS i FROM log)) SELECT src, dst, count(*) AS n FROM f GROUP BY src, dst")
def directly_follows(spark, sf_dir):
    return logs.follows(events_log(spark, sf_dir))


_NUMBERING = f"""WITH {O.CHATS}, a AS (SELECT row_number() OVER (ORDER BY role) - 1 AS a, role FROM (SELECT DISTINCT role FROM conversations)),
p AS (SELECT role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, conv_id FROM conversations),
s AS (SELECT (SELECT max(i) + 1 FROM p) AS most, (SELECT count(*) FROM a) AS kinds)
SELECT conv_id AS case_id, 1 + conv_id * most * kinds + i * kinds + a AS var, 'lambda_jia [' || conv_id || ', ' || i || ', ' || a || ']' AS name FROM p JOIN a ON a.role = p.role, s"""


@query(_NUMBERING)
def variable_numbering(spark, sf_dir):
    """The number and the name of the variable of each position's activity, and back from the number; the bounds are the log's."""
    log = chat_log(spark, sf_dir)
    roles = sorted(r[0] for r in logs.alphabet(log).collect())  # an alphabet
    most = log.agg(F.max(F.size("trace"))).first()[0] or 1
    letters = spark.createDataFrame(list(enumerate(roles)), "a int, role string")
    family = families(lambda_jia=[(0, 1 << 31), (0, most), (0, max(1, len(roles)))])["lambda_jia"]
    rows = log.select("case_id", F.posexplode("trace").alias("i", "role")).join(F.broadcast(letters), "role")
    numbered = rows.select("case_id", family.number(F.col("case_id"), F.col("i"), F.col("a")).alias("var"))
    return numbered.withColumn("name", family.label(F.col("var")))


# Runs and distances


@query(O.query(O.CHATS, O.runs(CHAT, WHOLE), O.variants(None), select=f"SELECT array_to_string(r.run, ' ') AS run, CAST(coalesce(sum(n_cases), 0) AS BIGINT) AS n_cases FROM runs r LEFT JOIN variants v ON {O.VISIBLE('r.run')} = v.trace GROUP BY 1"))
def model_runs(spark, sf_dir):
    """The model's runs, and how many cases are exactly what each one shows."""
    found = nets.runs(spark, CHAT, WHOLE).select("run", D.visible(F.col("run")).alias("trace"))
    return found.join(logs.variants(chat_log(spark, sf_dir)), "trace", "left").groupBy(F.array_join("run", " ").alias("run")).agg(F.coalesce(F.sum("n_cases"), F.lit(0)).alias("n_cases"))


def _pairs(spark, sf_dir, log, model, distance):
    n = WHOLE if model is CHAT else STEPS
    return artefacts.run_distances(nets.runs(spark, model, n), logs.variants(log(spark, sf_dir)), n, distance)


def _flat(pairs):
    return pairs.select(F.array_join("run", " ").alias("run"), F.array_join("trace", " ").alias("trace"), "n_cases", F.col("distance").cast("long").alias("distance"))


_FLAT = "SELECT array_to_string(run, ' ') AS run, array_to_string(trace, ' ') AS trace, n_cases, CAST(distance AS BIGINT) AS distance FROM pairs"
_HAMMING = (O.EVENTS, O.runs(SHOP, STEPS), O.variants(STEPS), O.hamming_pairs(STEPS))
_EDIT = (O.EVENTS, O.runs(SHOP, STEPS), O.variants(STEPS), O.indel_pairs())
_CHAT_EDIT = (O.CHATS, O.runs(CHAT, WHOLE), O.variants(WHOLE), O.indel_pairs())


@query(O.query(O.CHATS, O.runs(CHAT, WHOLE), O.variants(WHOLE), O.hamming_pairs(WHOLE), select=_FLAT))
def hamming_run_trace(spark, sf_dir):
    return _flat(_pairs(spark, sf_dir, chat_log, CHAT, "hamming"))


@query(O.query(*_CHAT_EDIT, select=_FLAT))
def indel_run_trace(spark, sf_dir):
    return _flat(_pairs(spark, sf_dir, chat_log, CHAT, "edit"))


_WORD = "array_to_string(list_transform(trace, lambda x: x[1]), '')"


_LETTERS = """ranks AS (SELECT role, chr(CAST(96 + row_number() OVER (ORDER BY role) AS INTEGER)) AS letter FROM (SELECT DISTINCT role FROM conversations)),
letters AS (SELECT map(list(role ORDER BY role), list(letter ORDER BY role)) AS m FROM ranks),
w AS (SELECT trace, n_cases, array_to_string(list_transform(trace, lambda x: map_extract(m, x)[1]), '') AS word FROM variants, letters),
c AS (SELECT word AS common FROM w ORDER BY n_cases DESC, word LIMIT 1)"""


@query(f"WITH {O.CHATS}, {O.variants(None)}, {_LETTERS} SELECT array_to_string(trace, ' ') AS trace, CAST(levenshtein(word, common) AS INTEGER) AS distance FROM w, c")
def levenshtein_variants(spark, sf_dir):
    """Each variant's edit distance from the most frequent one, one letter a role."""
    log = logs.variants(chat_log(spark, sf_dir))
    words = log.withColumn("word", clustering.spelling(log))
    common = words.orderBy(F.desc("n_cases"), "word").limit(1).select(F.col("word").alias("common"))
    return spelled(words.crossJoin(F.broadcast(common)).select("trace", D.edit(F.col("word"), F.col("common")).alias("distance")))  # one row


# Artefacts and measures


def _best(name, parts, log, model, distance, artefact, objective):
    value = {"anti": {"min": "least", "sum": "total"}, "multi": {"min": "most", "sum": "total"}}[artefact][objective]

    def f(spark, sf_dir):
        return artefacts.best(_pairs(spark, sf_dir, log, model, distance), artefact, objective)

    f.__name__ = name
    return query(O.query(*parts, O.best(value, artefact == "anti"), select="SELECT run, distance FROM best"))(f)


_best("anti_hamming_min", _HAMMING, events_log, SHOP, "hamming", "anti", "min")
_best("anti_edit_min", _EDIT, events_log, SHOP, "edit", "anti", "min")
_best("anti_hamming_sum", _HAMMING, events_log, SHOP, "hamming", "anti", "sum")
_best("anti_sum", _EDIT, events_log, SHOP, "edit", "anti", "sum")
_best("multi_minimax", _CHAT_EDIT, chat_log, CHAT, "edit", "multi", "min")
_best("multi_hamming_minimax", _HAMMING, events_log, SHOP, "hamming", "multi", "min")
_best("multi_sum", _CHAT_EDIT, chat_log, CHAT, "edit", "multi", "sum")
_best("exact_sum", _EDIT, events_log, SHOP, "edit", "multi", "sum")


@query(O.query(*_CHAT_EDIT, O.best("most", False), select="SELECT array_to_string(trace, ' ') AS trace, n_cases, CAST(p.distance AS BIGINT) AS distance FROM pairs p JOIN best b ON array_to_string(p.run, ' ') = b.run"))
def traces_with_distances(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, chat_log, CHAT, "edit")
    return artefacts.with_distances(pairs, artefacts.best(pairs, "multi", "min")).withColumn("distance", F.col("distance").cast("long"))


@query(O.query(*_HAMMING, O.best("least", True), select=f"SELECT run, least(distance, {MOST}) AS min_distance, CAST(len(list_filter(string_split(run, ' '), lambda x: x <> 'w')) AS INTEGER) AS size_of_run FROM best"))
def min_distance_and_size(spark, sf_dir):
    """The least distance of the anti-alignment, at most the largest looked at, and its length without waits."""
    found = artefacts.best(_pairs(spark, sf_dir, events_log, SHOP, "hamming"), "anti", "min")
    return found.select("run", F.least("distance", F.lit(MOST)).alias("min_distance"), F.size(F.filter(F.split("run", " "), lambda x: x != "w")).alias("size_of_run"))


def _precision(name, parts, distance, kind, share):
    def f(spark, sf_dir):
        return artefacts.anti_precision(_pairs(spark, sf_dir, events_log, SHOP, distance), kind, MOST)

    f.__name__ = name
    length = "len(list_filter(p.run, lambda x: x <> 'w'))"
    return query(O.query(*parts, O.best("least", True), select=f"SELECT round(1 - min({share.format(u=length)}), 9) AS precision FROM pairs p JOIN best b ON array_to_string(p.run, ' ') = b.run"))(f)


_precision("precision_edit", _EDIT, "edit", "edit", "p.distance / ({u} + len(trace))")
_precision("precision_hamming", _HAMMING, "hamming", "hamming", "p.distance / greatest({u}, len(trace))")
_precision("precision_bounded", _EDIT, "edit", "bounded", f"p.distance / {MOST}.0")

#: How much less a longer run's distance counts, how many lengths may bring nothing, and the longest runs of the SQL.
EPSILON, TRIALS, LONGEST = 0.1, 4, 14


def _epsilon_sql() -> str:
    """The shares of all lengths up to LONGEST, and the search's rules as a recursive table over them."""
    parts, names = [O.CHATS, O.variants(None)], []
    for n in range(2, LONGEST + 1):
        parts += [O.runs(CHAT, n, True, f"runs{n}"), f"v{n} AS (SELECT trace[1:{n}] AS trace FROM log GROUP BY 1)", O.indel_pairs(f"v{n}, runs{n}", keep="run, trace", name=f"p{n}")]
        parts.append(f"b{n} AS (SELECT run, min(distance) AS least FROM p{n} GROUP BY run ORDER BY least DESC, array_to_string(run, ' ') LIMIT 1)")
        parts.append(O.indel_pairs(f"variants, b{n}", keep="run, trace", name=f"w{n}"))
        size = "len(list_filter(run, lambda x: x <> 'w'))"
        names.append(f"SELECT {n} AS n, least(1.0, min(distance / ({size} + len(trace)))) / pow({1 + EPSILON}, any_value({size})) AS m FROM w{n}")
    parts.append(f"shares AS ({' UNION ALL '.join(names)})")
    ends = f"CASE WHEN s.m > 0 THEN least(ends, floor(-ln(s.m) / ln({1 + EPSILON}))) ELSE ends END"
    parts.append(f"search(n, best, trials, ends) AS (SELECT 1, 0.0::DOUBLE, 0, 99999::DOUBLE UNION ALL SELECT s.n, greatest(best, s.m), CASE WHEN s.m <= best THEN trials + 1 ELSE 0 END, {ends} FROM search JOIN shares s ON s.n = search.n + 1 WHERE search.n < ends AND trials < {TRIALS})")
    return O.query(*parts, select="SELECT round(1 - max(best), 9) AS precision FROM search")


@query(_epsilon_sql())
def precision_epsilon(spark, sf_dir):
    """1 minus the largest discounted distance of the full anti-alignments of 2, 3, ... steps from whole conversations."""
    return artefacts.epsilon_precision(spark, CHAT, logs.variants(chat_log(spark, sf_dir)), EPSILON, TRIALS)


# Whole traces


def _whole_sum(name, artefact):
    def f(spark, sf_dir):
        return wholetrace.best_sum(logs.variants(events_log(spark, sf_dir)), SHOP, artefact)

    f.__name__ = name
    return query(O.query(O.EVENTS, O.best_sum(SHOP, artefact == "anti"), select="SELECT run, distance FROM best"))(f)


_whole_sum("anti_hamming_sum_whole", "anti")
_whole_sum("multi_hamming_sum_whole", "multi")


def _moves(name, log, model, sql_log):
    def f(spark, sf_dir):
        return spelled(alignment.moves(logs.variants(log(spark, sf_dir)), model))

    f.__name__ = name
    return query(O.query(sql_log, O.variants(None), O.token_arcs(model), O.alignments(model.initial[0], model.sinks), O.MOVES, select=O.MOVE_ROWS))(f)


_moves("alignment_moves", chat_log, CHAT, O.CHATS)
_moves("alignment_moves_whole", events_log, SHOP, O.EVENTS)


@query(O.query(O.EVENTS, O.variants(None), O.token_arcs(SHOP), O.alignments(SHOP.initial[0], SHOP.sinks), select=f"SELECT array_to_string(v.trace, ' ') AS trace, n_cases, CAST(s.c // {O.COSTLY} AS INTEGER) AS cost FROM variants v JOIN ids ON ids.trace = v.trace LEFT JOIN best ON best.id = ids.id"))
def alignment_cost_whole(spark, sf_dir):
    """The optimal alignment of every user's whole trace with the full journeys of any length."""
    return spelled(alignment.costs(logs.variants(events_log(spark, sf_dir)), SHOP))


#: Instants of a comparison that conversations of 8 turns fill but for two, so that steps and turns have to share them.
INSTANTS = 10


@query(O.query(O.CHATS, O.variants(None), O.differences(CHAT, INSTANTS), select="SELECT array_to_string(trace, ' ') AS trace, n_cases, difference FROM differences"))
def aligned_difference(spark, sf_dir):
    """Every variant against the model, instant by instant: either side may wait anywhere."""
    return spelled(alignment.aligned_difference(logs.variants(chat_log(spark, sf_dir)), CHAT, INSTANTS))


@query(O.query(*_CHAT_EDIT, O.best("most", False), select="SELECT CAST(i AS INTEGER) AS instant, label FROM (SELECT unnest(string_split(run, ' ')) AS label, unnest(range(1, len(string_split(run, ' ')) + 1)) AS i FROM best)"))
def run_with_instants(spark, sf_dir):
    """The multi-alignment of the conversations, one row an instant."""
    found = artefacts.best(_pairs(spark, sf_dir, chat_log, CHAT, "edit"), "multi", "min")
    return found.select(F.posexplode(F.split("run", " ")).alias("i", "label")).select((F.col("i") + 1).alias("instant"), "label")


_TREE_EDIT = (O.CHATS, O.runs(TREE, WHOLE), O.variants(WHOLE), O.indel_pairs())


@query(O.query(*_TREE_EDIT, O.best("least", True), select="SELECT round(1 - min(p.distance / (len(list_filter(p.run, lambda x: x <> 'w')) + len(trace))), 9) AS precision FROM pairs p JOIN best b ON array_to_string(p.run, ' ') = b.run"))
def repair_precision(spark, sf_dir):
    """The precision of the tree that is repaired; distances may be twice the steps."""
    pairs = artefacts.run_distances(nets.runs(spark, TREE, WHOLE), logs.variants(chat_log(spark, sf_dir)), WHOLE, "edit")
    return artefacts.anti_precision(pairs, "edit", 2 * WHOLE)


# Alignments and clusters

#: A full run within distance 1 of a conversation of 8 turns has 11 steps at most, silent ones included.
_FULL_EDIT = (O.CHATS, O.runs(CHAT, WHOLE, True), O.variants(None), O.indel_pairs(keep="run, tids, trace, n_cases"))

_SEARCH = f"""{O.net(CHAT)},
costs(trace, pos, marking, cost) AS (SELECT trace, 0, {O.items(CHAT.initial)}, 0 FROM variants UNION
  SELECT trace, pos, marking, cost FROM (
    SELECT trace, pos + 1 AS pos, marking, cost + 1 AS cost FROM costs WHERE pos < len(trace)
    UNION ALL SELECT trace, pos, {O.MOVED} AS marking, cost + CASE WHEN {O.SILENT('label')} THEN 0 ELSE 1 END FROM costs, net WHERE list_has_all(marking, before)
    UNION ALL SELECT trace, pos + 1, {O.MOVED}, cost FROM costs, net WHERE list_has_all(marking, before) AND NOT {O.SILENT('label')} AND label = trace[pos + 1]) WHERE cost <= len(trace))"""


@query(O.query(O.CHATS, O.variants(None), _SEARCH, select=f"SELECT array_to_string(v.trace, ' ') AS trace, n_cases, CAST(min(cost) AS INTEGER) AS cost FROM variants v JOIN costs c ON c.trace = v.trace WHERE pos = len(v.trace) AND list_has_all(marking, {O.items(CHAT.sinks)}) GROUP BY 1, 2"))
def alignment_cost(spark, sf_dir):
    """The optimal alignment of every variant with the model's full runs of any length; its SQL searches for shortest paths."""
    return spelled(alignment.costs(logs.variants(chat_log(spark, sf_dir)), CHAT))


@query(O.query(O.CHATS, O.variants(None), _SEARCH, select=f"SELECT case_id, CAST(len(l.trace) AS BIGINT) AS n_events, CAST(min(cost) FILTER (WHERE list_has_all(marking, {O.items(CHAT.sinks)})) AS INTEGER) AS cost, CAST(min(cost) AS INTEGER) AS prefix_cost, CAST(0 AS BIGINT) AS late FROM log l JOIN costs c ON c.trace = l.trace WHERE pos = len(l.trace) GROUP BY case_id, l.trace"))
def online_conformance(spark, sf_dir):
    """Every conversation's cost against the model after its last turn, read as a stream that keeps a cost a marking."""
    return conformance.conformance(spark, f"{sf_dir}/conversations.parquet", CHAT, "conv_id", "role", "turn")


_POWER = f"pow(2.0, len(t) + {STEPS} - ({{i}}))"
_FITNESS = f"""p AS (SELECT row_number() OVER () AS id, trace AS t, n_cases, s, list_transform(range(0, len(trace) + 1), lambda j: coalesce(list_sum(list_transform(range(0, j), lambda k: pow(2.0, len(trace) + {STEPS} - k))), 0.0)) AS w
  FROM variants, (VALUES (['system', 'user', 'assistant']), (['user', 'assistant'])) r(s)),
dp(id, i, cells) AS (SELECT id, 0, w FROM p UNION ALL
  SELECT id, i + 1, list_transform(range(1, len(c) + 1), lambda j: w[j] + list_min(list_transform(range(1, j + 1), lambda k: c[k] - w[k])))
  FROM (SELECT d.id, d.i, w, list_transform(range(1, len(t) + 2), lambda j: CASE WHEN j > 1 AND t[j - 1] = s[i + 1] THEN least(cells[j] + {_POWER.format(i="i + 2")}, cells[j - 1]) ELSE cells[j] + {_POWER.format(i="i + 2")} END) AS c
        FROM dp d JOIN p ON d.id = p.id WHERE d.i < len(s)))"""


@query(O.query(O.CHATS, O.variants(None), _FITNESS, select="SELECT array_to_string(t, ' ') AS trace, n_cases, min(cells[len(cells)]) AS cost FROM p JOIN dp ON p.id = dp.id AND dp.i = len(s) GROUP BY t, n_cases"))
def fitness_prefix_weighted(spark, sf_dir):
    """Each variant's least cost of moves on one side against the tree, where early moves cost more."""
    depth = {"d1": 2, "d2": 3, "d3": 4, "d4": 2, "d5": 3}
    runs = nets.runs(spark, TREE, 3, True).select(F.transform(F.filter("tids", lambda t: t != "w"), lambda t: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in ((k, label) for k, label, *_ in TREE.transitions) for x in kv]), t).alias("label"), F.element_at(F.create_map(*[F.lit(x) for kv in depth.items() for x in kv]), t).alias("depth"))).alias("run"))
    both = logs.variants(chat_log(spark, sf_dir)).crossJoin(F.broadcast(runs))  # two runs
    return spelled(both.groupBy("trace", "n_cases").agg(F.min(alignment.weighted_cost(F.col("run"), F.col("trace"), STEPS)).alias("cost")))


_CLUSTER = (
    *_FULL_EDIT,
    "sets0 AS (SELECT DISTINCT list_sort(list_distinct(list_filter(tids, lambda t: t <> 'w'))) AS subnet FROM runs)",
    "sets AS (SELECT subnet FROM sets0 WHERE len(subnet) <= 4)",
    "subnets(subnet) AS (SELECT subnet FROM sets UNION SELECT list_sort(list_distinct(list_concat(a.subnet, b.subnet))) FROM subnets a, sets b WHERE len(list_distinct(list_concat(a.subnet, b.subnet))) <= 4)",
    "covered AS (SELECT subnet, trace, n_cases, min(distance) AS cost FROM pairs, subnets WHERE list_has_all(subnet, list_filter(tids, lambda t: t <> 'w')) AND distance <= 1 GROUP BY ALL)",
)


def _covered(spark, sf_dir):
    full = nets.runs(spark, CHAT, WHOLE, True)
    log = logs.variants(chat_log(spark, sf_dir))
    return log, clustering.coverage(log, full, clustering.subnets(full, 4), 1)


@query(O.query(*_CLUSTER, select="SELECT array_to_string(subnet, ' ') AS subnet, array_to_string(trace, ' ') AS trace, n_cases, CAST(cost AS INTEGER) AS cost FROM covered"))
def cluster_coverage(spark, sf_dir):
    return spelled(_covered(spark, sf_dir)[1]).withColumn("subnet", F.array_join("subnet", " "))


_PAIRS = (
    *_CLUSTER,
    "alone AS (SELECT subnet, sum(n_cases) AS n, sum(n_cases * cost) AS s FROM covered GROUP BY subnet)",
    "shared AS (SELECT a.subnet AS s1, b.subnet AS s2, sum(a.n_cases) AS n, sum(a.n_cases * greatest(a.cost, b.cost)) AS dear FROM covered a JOIN covered b ON a.trace = b.trace AND a.subnet < b.subnet GROUP BY ALL)",
    "scores AS (SELECT a.subnet AS s1, b.subnet AS s2, a.n + b.n - coalesce(x.n, 0) AS clustered, 100 * (a.n + b.n - coalesce(x.n, 0)) - 2 * (a.s + b.s - coalesce(x.dear, 0)) - 2 * len(list_intersect(a.subnet, b.subnet)) - len(a.subnet) - len(b.subnet) AS score FROM alone a JOIN alone b ON a.subnet < b.subnet LEFT JOIN shared x ON x.s1 = a.subnet AND x.s2 = b.subnet)",
    "pair AS (SELECT * FROM scores ORDER BY score DESC, s1, s2 LIMIT 1)",
)


@query(O.query(*_PAIRS, select="SELECT array_to_string(s1, ' ') AS first, array_to_string(s2, ' ') AS second, CAST(score AS BIGINT) AS score, CAST(clustered AS BIGINT) AS clustered, CAST(len(list_intersect(s1, s2)) AS INTEGER) AS common FROM pair"))
def cluster_score(spark, sf_dir):
    """The two subnets that score best, and how many transitions they share."""
    pair = clustering.best_pair(_covered(spark, sf_dir)[1])
    return pair.select(F.array_join("first", " ").alias("first"), F.array_join("second", " ").alias("second"), F.col("score").cast("long").alias("score"), F.col("clustered").cast("long").alias("clustered"), F.size(F.array_intersect("first", "second")).alias("common"))


_ASSIGN = (*_PAIRS, "own AS (SELECT trace, min(cost * 10 + CASE WHEN subnet = s1 THEN 1 ELSE 2 END) AS k FROM covered, pair WHERE subnet = s1 OR subnet = s2 GROUP BY trace)", "assigned AS (SELECT v.trace, v.n_cases, CAST(k % 10 AS INTEGER) AS cluster_id, CAST(k // 10 AS INTEGER) AS cost FROM variants v LEFT JOIN own ON own.trace = v.trace)")


def _assigned(spark, sf_dir):
    log, covered = _covered(spark, sf_dir)
    return clustering.assign(log, covered, clustering.best_pair(covered))


@query(O.query(*_ASSIGN, select="SELECT array_to_string(trace, ' ') AS trace, n_cases, cluster_id, cost FROM assigned"))
def cluster_assignment(spark, sf_dir):
    return spelled(_assigned(spark, sf_dir))


@query(O.query(*_ASSIGN, select="SELECT coalesce(cluster_id, 0) AS cluster_id, CAST(sum(n_cases) AS BIGINT) AS n_cases FROM assigned GROUP BY 1"))
def cluster_sizes(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy(F.coalesce("cluster_id", F.lit(0)).alias("cluster_id")).agg(F.sum("n_cases").alias("n_cases"))


_NEAR = f"levenshtein({_WORD.replace('trace', 'a.trace')}, {_WORD.replace('trace', 'b.trace')})"


@query(O.query(*_ASSIGN, select=f"SELECT array_to_string(a.trace, ' ') AS trace, a.n_cases, coalesce(a.cluster_id, min(b.cluster_id)) AS cluster_id FROM assigned a LEFT JOIN assigned b ON a.cluster_id IS NULL AND b.cluster_id IS NOT NULL AND {_NEAR} <= 1 GROUP BY a.trace, a.n_cases, a.cluster_id"))
def absorb_variants(spark, sf_dir):
    """The assignment after variants within one edit of a clustered one have joined its cluster."""
    return spelled(clustering.absorb(_assigned(spark, sf_dir), 1).select("trace", "n_cases", "cluster_id"))


_EITHER = "SELECT score FROM scores UNION ALL SELECT 100 * n - 2 * s - len(subnet) FROM alone"


@query(O.query(*_PAIRS, select=f"SELECT CAST(max(score) AS BIGINT) AS score FROM ({_EITHER})"))
def subnets_by_search(spark, sf_dir):
    """The best score of at most two subnets around the variants of conversations, by branch and bound over sets of transitions."""
    score, _ = subnets.best_subnets(logs.variants(chat_log(spark, sf_dir)), CHAT, 1, 4, 2)
    return spark.createDataFrame([(score,)], "score bigint")


@query(O.query(*_PAIRS, select="SELECT cluster_id, subnet, src, tid, dst FROM (SELECT 1 AS cluster_id, s1 AS subnet FROM pair UNION ALL SELECT 2, s2 FROM pair) c, (SELECT tid, p AS src, tid AS dst FROM (SELECT tid, unnest(before) AS p FROM runs_net) UNION ALL SELECT tid, tid, p FROM (SELECT tid, unnest(after) AS p FROM runs_net)) arcs WHERE list_contains(subnet, tid)").replace("cluster_id, subnet, src, tid, dst FROM", "cluster_id, src, dst FROM"))
def cluster_arcs(spark, sf_dir):
    """The arcs of the two clusters' subnets, from places to transitions and on."""
    pair = clustering.best_pair(_covered(spark, sf_dir)[1])
    chosen = pair.select(F.explode(F.array(F.struct(F.lit(1).alias("cluster_id"), F.col("first").alias("subnet")), F.struct(F.lit(2).alias("cluster_id"), F.col("second").alias("subnet")))).alias("c")).select("c.*")
    return clustering.subnet_arcs(chosen, CHAT)


@query(O.query(*_ASSIGN, select="SELECT l.case_id FROM log l JOIN assigned a ON a.trace = l.trace WHERE a.cluster_id IS NULL OR a.cost > 0"))
def unclustered_cases(spark, sf_dir):
    """The cases that no cluster takes without a difference."""
    taken = _assigned(spark, sf_dir).where("cluster_id is not null and cost = 0").select("trace")
    return chat_log(spark, sf_dir).join(taken, "trace", "left_anti").select("case_id")


@query(
    O.query(
        *_ASSIGN,
        "cells AS (SELECT coalesce(a.cluster_id, 0) AS c1, least(len(l.trace), 5) AS c2, count(*) AS n FROM log l JOIN assigned a ON a.trace = l.trace GROUP BY ALL)",
        "n11 AS (SELECT sum(n * (n - 1) / 2) AS n11 FROM cells), ones AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM cells GROUP BY c1)), twos AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM cells GROUP BY c2))",
        select="SELECT round(n11 / (a + b - n11), 9) AS jaccard FROM n11, ones, twos",
    )
)
def clusterings_jaccard(spark, sf_dir):
    """How far two clusterings of the cases agree, that around subnets and that by length, joined by case."""
    log = chat_log(spark, sf_dir)
    first = log.join(_assigned(spark, sf_dir).select("trace", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id")), "trace").select("case_id", "cluster_id")
    second = log.select("case_id", F.least(F.size("trace"), F.lit(5)).alias("cluster_id"))
    return clustering.agreement(first, second)


@query()
def cluster_rounds(spark, sf_dir):
    """Rounds of clustering a sample of 10 variants around two subnets and absorbing others; null: no cluster."""
    found, _ = clustering.sampled_clusters(logs.variants(chat_log(spark, sf_dir)), CHAT, 10, WHOLE, 1, 4, 2, 2)
    return spelled(found)


@query("WITH n AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), c AS (SELECT sum(n * (n - 1) / 2) AS n11 FROM n), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM n GROUP BY quality)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM n GROUP BY toxic)) SELECT round(n11 / (a + b - n11), 9) AS jaccard FROM c, a, b")
def jaccard_index(spark, sf_dir):
    return clustering.jaccard_index(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH {O.CHATS}, g AS (SELECT case_id, array_to_string(trace[i:i + k - 1], ' ') AS gram FROM (SELECT case_id, trace, k, unnest(range(1, len(trace) - k + 2)) AS i FROM log, (VALUES (1), (2), (3)) s(k))) SELECT gram, count(DISTINCT case_id) AS n_cases FROM g GROUP BY gram")
def ngram_features(spark, sf_dir):
    """In how many cases each run of one to three activities stands."""
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("trace"), F.lit(1))), lambda i: i + k - 1 <= F.size("trace")), lambda i: F.array_join(F.slice("trace", i, k), " "))))
    return chat_log(spark, sf_dir).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_cases"))


@query()
def super_instances(spark, sf_dir):
    return clustering.super_instances(chat_log(spark, sf_dir), 4)


@query()
def clustering_study(spark, sf_dir):
    """How far the clusters around subnets and those of the super-instances agree on the cases, with both numbers of clusters."""
    log = chat_log(spark, sf_dir)
    found, _ = clustering.sampled_clusters(logs.variants(log), CHAT, 10, WHOLE, 1, 4, 2, 2)
    first = log.join(found.select("trace", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id")), "trace").select("case_id", "cluster_id")
    second = clustering.super_instances(log, 4).select("case_id", F.col("cluster").alias("cluster_id"))
    count = lambda c, name: c.agg(F.countDistinct("cluster_id").alias(name))
    return clustering.agreement(first, second).crossJoin(count(first, "subnets")).crossJoin(count(second, "instances"))  # one row each


_FOLLOWS = f"""turns AS (SELECT role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
arrows AS (SELECT DISTINCT coalesce(before, '') AS src, role AS dst FROM turns),
ends AS (SELECT DISTINCT coalesce(before, '') AS src, role FROM turns WHERE after IS NULL),
paths(n, here, path) AS (SELECT 0, '', []::VARCHAR[] UNION ALL SELECT n + 1, dst, list_append(path, dst) FROM paths JOIN arrows ON src = here WHERE n < {STEPS + 1}),
second AS (SELECT DISTINCT list_append(path, role) AS other FROM paths JOIN ends ON src = here)"""


@query(O.query(O.CHATS, O.runs(SHORT, STEPS, True), "first AS (SELECT DISTINCT list_filter(run, lambda x: x <> 'w') AS run FROM runs)", _FOLLOWS, O.indel_pairs("first, second", s="run", t="other", keep="run, other", plain=True), select="SELECT array_to_string(run, ' ') AS run, CAST(min(distance) AS INTEGER) AS nearest FROM pairs GROUP BY 1 HAVING min(distance) > 0"))
def nets_anti_alignment(spark, sf_dir):
    """Full runs of a model that the net of what follows what in the log cannot follow."""
    net = logs.follows_net(chat_log(spark, sf_dir))
    second = None
    for n, runs in nets.run_levels(spark, net, True):
        second = runs if second is None else second.unionByName(runs)
        if n == STEPS + 2:  # longer runs equal none of the first
            break
    return netcompare.unmatched(nets.runs(spark, SHORT, STEPS, True), second, 0)


#: The net of what follows what as arcs: its places are the roles, the start and the end.
_FOLLOW_ARCS = f"""arcs AS (SELECT dst AS tid, dst AS label, src AS a, dst AS b, {O.COSTLY} + 1 AS c, true AS visible FROM arrows UNION ALL SELECT role || '|', role, src, '$', {O.COSTLY} + 1, true FROM ends)"""


@query(O.query(O.CHATS, O.runs(SHORT, STEPS, True), "first AS (SELECT DISTINCT list_filter(run, lambda x: x <> 'w') AS run FROM runs)", _FOLLOWS, _FOLLOW_ARCS, O.alignments("", ["$"], "SELECT run AS trace FROM first"), select=f"SELECT array_to_string(trace, ' ') AS run, CAST(s.c // {O.COSTLY} AS INTEGER) AS nearest FROM ids LEFT JOIN best ON best.id = ids.id"))
def nets_nearest(spark, sf_dir):
    """The distance of each full run of a model from the nearest full run, however long, of the net of what follows what in the log."""
    return netcompare.nearest(nets.runs(spark, SHORT, STEPS, True), logs.follows_net(chat_log(spark, sf_dir)))


@query()
def nets_counterexamples(spark, sf_dir):
    """Runs of a model, of any length, that the net of what follows what cannot follow: one for each way to end so."""
    return netcompare.counterexamples(spark, SHORT, logs.follows_net(chat_log(spark, sf_dir)), 0)


# Repair

ROLES = ["assistant", "system", "user"]


def _run_sql(run) -> str:
    return "([" + ", ".join(f"'{x}'" for x, _ in run) + "]::VARCHAR[], [" + ", ".join(str(d) for _, d in run) + "]::INTEGER[])"


def _repair_sql() -> str:
    rows = ", ".join(f"('{name}', {_run_sql(run)[1:-1]})" for name, m in repair.candidates(TREE, ROLES) for run in repair.branches(m))
    fitness = _FITNESS.replace("n_cases, s, list_transform", "n_cases, action, s, depth, list_transform").replace("(VALUES (['system', 'user', 'assistant']), (['user', 'assistant'])) r(s)", f"(VALUES {rows}) r(action, s, depth)")
    for x in ("i + 2",):
        fitness = fitness.replace(f"({x})", "(depth[i + 1])")
    fitness = fitness.replace("SELECT d.id, d.i, w,", "SELECT d.id, d.i, depth, w,")
    return O.query(O.CHATS, O.variants(None), fitness, "each AS (SELECT action, t, n_cases, min(cells[len(cells)]) AS cost FROM p JOIN dp ON p.id = dp.id AND dp.i = len(s) GROUP BY ALL)", "scores AS (SELECT action, CAST(sum(cost * n_cases) AS DOUBLE) AS fitness FROM each GROUP BY action)", select="SELECT action, fitness FROM scores")


def _scores(spark, sf_dir):
    log = logs.variants(chat_log(spark, sf_dir))
    letters = [r[0] for r in logs.alphabet(log).collect()]  # an alphabet
    return repair.scores(spark, repair.candidates(TREE, letters), log, STEPS)


@query(_repair_sql())
def repair_candidates(spark, sf_dir):
    """What every repair of the tree would make of its fitness."""
    return _scores(spark, sf_dir)


@query(_repair_sql() + " ORDER BY fitness, action LIMIT 1")
def repair_best_action(spark, sf_dir):
    return _scores(spark, sf_dir).orderBy("fitness", "action").limit(1)


@query()
def repair_model(spark, sf_dir):
    """The actions of the repair of the tree, and the fitness after each."""
    log = logs.variants(chat_log(spark, sf_dir))
    _, history = repair.repair(spark, TREE, [r[0] for r in logs.alphabet(log).collect()], log, STEPS)  # an alphabet
    return spark.createDataFrame([(i, action, float(fitness)) for i, (action, fitness) in enumerate(history, 1)], "round int, action string, fitness double")
