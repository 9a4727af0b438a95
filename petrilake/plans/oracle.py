"""Pieces of DuckDB SQL: traces, nets, bounded runs and distances, written apart from the Spark plans."""

from __future__ import annotations

from petrilake.operators.nets import Net

EVENTS = "log AS (SELECT user_id AS case_id, list(event_type ORDER BY ts, event_id) AS trace FROM events GROUP BY user_id)"
CHATS = "log AS (SELECT conv_id AS case_id, list(role ORDER BY turn) AS trace FROM conversations GROUP BY conv_id)"
SILENT = lambda x: f"({x} IS NULL OR {x} LIKE '%tau%' OR {x} LIKE '%skip%')"
#: The marking after a transition of a net whose places no firing would fill twice.
MOVED = "list_sort(list_distinct(list_concat(list_filter(marking, lambda x: NOT list_contains(before, x)), after)))"
VISIBLE = lambda xs: f"list_filter({xs}, lambda x: NOT {SILENT('x')} AND x <> 'w')"


def items(names) -> str:
    """A list of texts."""
    return "[" + ", ".join(f"'{i}'" for i in names) + "]::VARCHAR[]"


def net(model: Net, name: str = "net") -> str:
    """The transitions of a model as a common table."""
    rows = ", ".join(f"('{t}', '{label}', {items(before)}, {items(after)})" for t, label, _, before, after in model.transitions)
    return f"{name}(tid, label, before, after) AS (VALUES {rows})"


def runs(model: Net, n: int, reach_final: bool = False, name: str = "runs") -> str:
    """The runs of exactly n steps, waits included, by a recursive table; with one transition sequence each."""
    whole = model.with_wait()
    final = f"AND list_has_all(marking, {items(model.final or model.sinks)})" if reach_final else ""
    fresh = "list_filter(after, lambda x: NOT list_contains(before, x))"
    return f"""{net(whole, name + "_net")},
{name}_steps(n, marking, run, tids) AS (
  SELECT 0, {items(sorted(model.initial))}, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT n + 1, list_sort(list_distinct(list_concat(list_filter(marking, lambda x: NOT list_contains(before, x)), after))), list_append(run, label), list_append(tids, tid)
  FROM {name}_steps, {name}_net
  WHERE n < {n} AND list_has_all(marking, before) AND NOT list_has_any({fresh}, marking)),
{name} AS (SELECT run, min(tids) AS tids FROM {name}_steps WHERE n = {n} {final} GROUP BY run)"""


def variants(n: int | None) -> str:
    """Variants of the log, cut to n symbols."""
    cut = f"trace[1:{n}]" if n else "trace"
    return f"variants AS (SELECT {cut} AS trace, count(*) AS n_cases FROM log GROUP BY ALL)"


def hamming_pairs(n: int) -> str:
    """pairs(run, trace, n_cases, distance) by positions."""
    t = f"coalesce(trace[i], 'w')"
    case = f"CASE WHEN {SILENT('run[i]')} OR {SILENT(t)} OR run[i] = {t} THEN 0 ELSE 1 END"
    return f"pairs AS (SELECT run, trace, n_cases, list_sum(list_transform(range(1, {n + 1}), lambda i: {case})) AS distance FROM variants, runs)"


def indel_pairs(left: str = "variants, runs", s: str = "run", t: str = "trace", keep: str = "run, trace, n_cases", plain: bool = False, name: str = "pairs") -> str:
    """The insert and delete distance of s and t, a row of the table of common subsequences at a time."""
    first, second = (s, t) if plain else (VISIBLE(s), VISIBLE(t))
    cell = "CASE WHEN j = 0 THEN 0 ELSE greatest(cells[j + 1], cells[j] + CASE WHEN t[j] = s[i + 1] THEN 1 ELSE 0 END) END"
    return f"""{name}_in AS (SELECT row_number() OVER () AS id, {keep}, {first} AS s, {second} AS t FROM {left}),
{name}_dp(id, i, cells) AS (
  SELECT id, 0, list_transform(range(0, len(t) + 1), lambda j: 0) FROM {name}_in
  UNION ALL
  SELECT id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))
  FROM (SELECT d.id, d.i, list_transform(range(0, len(t) + 1), lambda j: {cell}) AS c FROM {name}_dp d JOIN {name}_in p ON d.id = p.id WHERE d.i < len(p.s))),
{name} AS (SELECT {keep}, len(s) + len(t) - 2 * cells[len(cells)] AS distance FROM {name}_in p JOIN {name}_dp d ON p.id = d.id AND d.i = len(p.s))"""


SUMMARY = "summary AS (SELECT array_to_string(run, ' ') AS run, min(distance) AS least, max(distance) AS most, sum(distance * n_cases) AS total FROM pairs GROUP BY 1)"


def best(value: str, furthest: bool) -> str:
    """The optimum and its first run."""
    return f"{SUMMARY}, best AS (SELECT run, CAST({value} AS BIGINT) AS distance FROM summary ORDER BY distance {'DESC' if furthest else 'ASC'}, run LIMIT 1)"


def query(*parts: str, select: str) -> str:
    """Common tables and what is selected from them."""
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


#: What a move on one side weighs against the number of moves, in SQL as in the plan.
COSTLY = 1 << 32


def token_arcs(model: Net) -> str:
    """arcs(tid, label, a, b, c) of a net whose transitions have one place before and one after: c weighs a move of the model alone."""
    return f"{net(model)},\narcs AS (SELECT tid, label, before[1] AS a, after[1] AS b, CASE WHEN {SILENT('label')} THEN 1 ELSE {COSTLY} + 1 END AS c, NOT {SILENT('label')} AS visible FROM net)"


def alignments(initial: str, finals: list[str], traces: str = "SELECT trace FROM variants") -> str:
    """dp(id, pos, p, c): the least weight to have come to each place behind each position of each trace, and best(id, s) at the end.

    Needs arcs. A position is one step of the recursion: a move of the log or of both, then any moves of the model alone.
    """
    return f"""ids AS (SELECT row_number() OVER (ORDER BY trace) AS id, trace FROM ({traces})),
places AS (SELECT a AS p FROM arcs UNION SELECT b FROM arcs),
near_steps(a, b, c, k) AS (SELECT p, p, 0::BIGINT, 0 FROM places UNION ALL SELECT n.a, arcs.b, min(n.c + arcs.c), n.k + 1 FROM near_steps n JOIN arcs ON arcs.a = n.b WHERE n.k < (SELECT count(*) FROM places) GROUP BY n.a, arcs.b, n.k),
near AS (SELECT a, b, min(c) AS c FROM near_steps GROUP BY a, b),
steps AS (SELECT p AS a, p AS b, NULL::VARCHAR AS label, {COSTLY} + 1 AS c FROM places UNION ALL SELECT a, b, label, 1 FROM arcs WHERE visible),
dp(id, pos, p, c) AS (SELECT id, 0, b, near.c FROM ids, near WHERE near.a = '{initial}'
  UNION ALL SELECT d.id, d.pos + 1, near.b, min(d.c + s.c + near.c) FROM dp d JOIN ids ON ids.id = d.id JOIN steps s ON s.a = d.p AND (s.label IS NULL OR s.label = trace[d.pos + 1]) JOIN near ON near.a = s.b WHERE d.pos < len(trace) GROUP BY d.id, d.pos, near.b),
best AS (SELECT dp.id, min({{'c': c, 'p': p}}) AS s FROM dp JOIN ids ON ids.id = dp.id WHERE pos = len(trace) AND list_contains({items(finals)}, p) GROUP BY dp.id)"""


#: The moves of one cheapest alignment each, from the end backwards; needs `alignments`.
MOVES = f"""moves AS (SELECT 0 AS kind, tid, a, b, label, 1 AS d, 1 AS c FROM arcs WHERE visible UNION ALL SELECT 1, '>>', p, p, NULL::VARCHAR, 1, {COSTLY} + 1 FROM places UNION ALL SELECT 2, tid, a, b, NULL::VARCHAR, 0, c FROM arcs),
back(id, k, pos, p, kind, tid) AS (SELECT best.id, 0, len(trace), s.p, -1, '' FROM best JOIN ids ON ids.id = best.id
  UNION ALL SELECT id, k + 1, m.pos, m.p, m.kind, m.tid FROM (
    SELECT b.id, b.k, min({{'kind': m.kind, 'tid': m.tid, 'pos': prev.pos, 'p': prev.p}}) AS m FROM back b JOIN ids ON ids.id = b.id JOIN dp here ON here.id = b.id AND here.pos = b.pos AND here.p = b.p
    JOIN moves m ON m.b = b.p AND (m.label IS NULL OR m.label = trace[b.pos]) JOIN dp prev ON prev.id = b.id AND prev.pos = b.pos - m.d AND prev.p = m.a WHERE prev.c + m.c = here.c GROUP BY b.id, b.k))"""

MOVE_ROWS = "SELECT array_to_string(trace, ' ') AS trace, CAST(max(k) OVER (PARTITION BY back.id) - k + 1 AS INTEGER) AS move, CASE WHEN kind = 2 THEN '>>' ELSE trace[pos + 1] END AS log_step, tid AS model_step FROM back JOIN ids ON ids.id = back.id WHERE k > 0"


def best_sum(model: Net, furthest: bool) -> str:
    """best(run, distance) of the run, as long as the longest trace, of the largest or smallest summed distance by positions."""
    sign, whole = ("-" if furthest else ""), model.with_wait()
    fresh = "list_filter(after, lambda x: NOT list_contains(before, x))"
    return f"""longest AS (SELECT max(len(trace)) AS n FROM log), {net(whole)},
cells AS (SELECT i AS pos, coalesce(trace[i + 1], 'w') AS x, count(*) AS cases FROM (SELECT trace, unnest(range(0, n)) AS i FROM log, longest) GROUP BY ALL),
known AS (SELECT pos, sum(cases) AS cases FROM cells WHERE NOT {SILENT('x')} GROUP BY pos),
price AS (SELECT known.pos, label, before, after, CASE WHEN {SILENT('label')} THEN 0 ELSE known.cases - coalesce(cells.cases, 0) END AS p FROM known CROSS JOIN net LEFT JOIN cells ON cells.pos = known.pos AND x = label),
walk(pos, marking, s) AS (SELECT 0::BIGINT, {items(sorted(model.initial))}, {{'v': 0::HUGEINT, 'r': ''}}
  UNION ALL SELECT pos + 1, marking, min(s) FROM (SELECT w.pos, {MOVED} AS marking, {{'v': (w.s.v + {sign}p)::HUGEINT, 'r': w.s.r || label || ' '}} AS s FROM walk w JOIN price ON price.pos = w.pos AND list_has_all(w.marking, before) AND NOT list_has_any({fresh}, w.marking)) GROUP BY pos, marking),
best AS (SELECT trim(s.r) AS run, CAST({sign}s.v AS BIGINT) AS distance FROM (SELECT min(s) AS s FROM walk, longest WHERE pos = n))"""


def differences(model: Net, n: int) -> str:
    """differences(trace, n_cases, difference): the instant by instant comparison of each variant with the full runs in n instants."""
    fresh = "list_filter(after, lambda x: NOT list_contains(before, x))"
    known = f"list_contains({items(model.labels)}, trace[pos + 1])"
    step = f"CASE WHEN gives THEN CASE WHEN tid = '' THEN 1 WHEN silent THEN CASE WHEN {known} THEN 1 ELSE 0 END WHEN NOT {known} THEN 1 WHEN label = trace[pos + 1] THEN 0 ELSE 2 END WHEN tid = '' THEN CASE WHEN pos = len(trace) THEN 0 ELSE 1 END WHEN silent THEN 0 ELSE 1 END"
    return f"""{net(model)},
options AS (SELECT tid, label, before, after, {SILENT('label')} AS silent, gives FROM (SELECT * FROM net UNION ALL SELECT '', '', []::VARCHAR[], []::VARCHAR[]), (VALUES (true), (false)) g(gives)),
ids AS (SELECT row_number() OVER (ORDER BY trace) AS id, trace[1:{n}] AS trace, trace AS whole, n_cases FROM variants),
instants(i, id, pos, marking, c) AS (SELECT 0, id, 0, {items(sorted(model.initial))}, 0 FROM ids
  UNION ALL SELECT i + 1, id, pos, marking, min(c) FROM (SELECT i, d.id, pos + CASE WHEN gives THEN 1 ELSE 0 END AS pos, {MOVED} AS marking, c + {step} AS c FROM instants d JOIN ids ON ids.id = d.id JOIN options ON list_has_all(marking, before) AND NOT list_has_any({fresh}, marking) WHERE i < {n} AND (NOT gives OR pos < len(trace))) GROUP BY ALL),
ended AS (SELECT instants.id, min(c) AS c FROM instants JOIN ids ON ids.id = instants.id WHERE i = {n} AND pos = len(trace) AND list_has_all(marking, {items(model.final or model.sinks)}) GROUP BY instants.id),
differences AS (SELECT whole AS trace, n_cases, CAST(c AS INTEGER) AS difference FROM ids LEFT JOIN ended ON ended.id = ids.id)"""
