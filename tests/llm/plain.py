"""Plain versions of the operators' rules, to compare with."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

LOW = {i: i + 32 for i in range(65, 91)}
WS = " \t\n\x0b\x0c\r"


def low(text):
    return text.translate(LOW)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_lines(docs):
    """{doc_id: (text, lines, dropped)} of (doc_id, text) pairs with different ids."""
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(k := low(line.strip(WS))) >= 20:
                holders[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(k := low(x.strip(WS))) < 20 or len(holders[k]) < 3 or max(holders[k]) == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def shingles(text, k=5):
    w = words(low(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add(item)
    out = {}
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if got := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(found))
    return out


def base_quality(text):
    t = text or ""
    w = words(t)
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for j in range(len(w) - 2):
        if c[w[j], w[j + 1], w[j + 2]] > 1:
            covered |= {j, j + 1, j + 2}
    lines = [x for x in t.split("\n") if words(x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def js_distance(p, q):
    halves = sum(a * math.log2(2 * a / (a + b)) for x, y in zip(p, q, strict=True) for a, b in ((x, y), (y, x)) if a > 0)
    return math.sqrt(max(halves / 2, 0))


def quality_distances(rows, word_share=0.005, min_reference=1000):
    """{doc_id: (word_distance, class_distance)} of (doc_id, lang, text) rows; None where the language has no reference."""
    patterns = ["[a-z]", "[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[^a-zA-Z0-9#*$%&|<>\x20\x09-\x0D\x80-\U0010ffff]", r"[\x80-\U0010ffff]"]
    classes = lambda t: [len(re.findall(p, t)) for p in patterns]
    share = lambda k: [x / max(sum(k), 1) for x in k]
    refs = {}
    for lang in {x for _, x, _ in rows if x is not None}:
        texts = [t or "" for _, x, t in rows if x == lang]
        c = Counter(w for t in texts for w in words(t))
        if c.total() >= min_reference:
            common = {w: n / c.total() for w, n in c.items() if n >= word_share * c.total()}
            refs[lang] = common, share([sum(k) for k in zip(*map(classes, texts), strict=True)])
    out = {}
    for i, lang, t in rows:
        w, c = words(t), Counter(words(t))
        if lang not in refs:
            out[i] = None, None
        elif not w:
            out[i] = 0, 0
        else:
            common, ref = refs[lang]
            q = [c[x] / len(w) for x in common]
            out[i] = js_distance([*common.values(), max(1 - sum(common.values()), 0)], [*q, 1 - sum(q)]), js_distance(ref, share(classes(t)))
    return out


def walk(edges, seeds, damping=0.85, rounds=400):
    """The ranks of a walk over {(src, dst): weight} that starts at {host: weight} and gives what it has at a dead end back to the seeds."""
    out = Counter()
    for (src, _), w in edges.items():
        out[src] += w
    total = sum(seeds.values())
    seeds = {h: w / total for h, w in seeds.items()} if total else {}
    rank = dict(seeds)
    for _ in range(rounds):
        lost = damping * sum(r for h, r in rank.items() if not out[h])
        new = Counter({h: (1 - damping + lost) * w for h, w in seeds.items()})
        for (src, dst), w in edges.items():
            new[dst] += damping * w / out[src] * rank.get(src, 0)
        rank = new
    return rank


def spread_verdicts(edges, allowed, blocked, pages, threshold=1.0, evidence=0.5):
    """{host: (trust, distrust, verdict)} relative to the usual ranks, from {host: pages} of each kind."""
    back = {(b, a): w for (a, b), w in edges.items()}
    ratio = lambda mark, usual, h: mark.get(h, 0) / usual[h] if usual.get(h, 0) > 0 else 0.0
    t, d, ut, ud = walk(edges, allowed), walk(back, blocked), walk(edges, pages), walk(back, pages)
    out = {}
    for h in pages:
        x, y = ratio(t, ut, h), ratio(d, ud, h)
        out[h] = x, y, "block" if y > threshold * x and y > evidence else "allow"
    return out


def own_licence(text, templates, threshold=0.8, lengths=(0.65, 0.8, 1.0, 1.25)):
    """(licence, score, opens) of a text's best piece by all cosines with all templates, or None."""
    def terms(x):
        return [t for t in (t.rstrip(".") for t in re.split(r"[^a-z0-9.\-]+", x.lower())) if t]

    rows = [(name, Counter(terms(t))) for name, ts in templates.items() for t in ts]
    df = Counter(t for _, c in rows for t in c)

    def vector(c):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        size = sum(x * x for x in v.values())
        return {t: x / math.sqrt(size) for t, x in v.items()}, size

    known = [(name, *vector(c), sum(c.values())) for name, c in rows]
    lines = text.split("\n")
    found = [(2, 0, 0, 0, text, None)]
    stop = next((i for i, x in enumerate(lines) if not re.search(r'^[ \t]*(#|//|/\*|\*|--|;|<!--|%|"|$)', x)), 0)
    if stop:
        found.append((1, 0, 0, 0, "\n".join(lines[:stop]), None))
    blocks = [[]]
    for line in lines:
        if re.search("[A-Za-z0-9]", line):
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    for b, block in enumerate(blocks):
        parts = [x for x in re.split("\n|(?<=[.;]) +", "\n".join(block)) if terms(x)]
        counts = [len(terms(x)) for x in parts]
        spans = {(0, len(parts)): None}  # of the template's number of terms that the run is for
        for i in range(len(parts)):
            for size in {n for *_, n in known}:
                for share in lengths:
                    end, held = i, 0
                    while end < len(parts) and held < size * share:
                        held += counts[end]
                        end += 1
                    if spans.get((i, end - i), ()) is not None:
                        spans.setdefault((i, end - i), set()).add(size)
        found += [(0, b, i, n, " ".join(parts[i : i + n]), sizes) for (i, n), sizes in spans.items()]
    best = None
    for kind, b, i, n, piece, sizes in found:
        if c := Counter(terms(piece)):
            v, _ = vector(c)
            for name, w, size, count in known:
                score = round(sum(x * w.get(t, 0) for t, x in v.items()), 9)
                if score >= threshold and (sizes is None or count in sizes) and len(v.keys() & w.keys()) >= min(2, len(w)):
                    most = round(size * (score * score - threshold * threshold), 4)
                    best = max(best or (), (most, kind, score, -b, -i, name, kind > 0 or (b == 0 and i == 0)), key=lambda x: (x[5:6] != ("LicenseRef-proprietary",), *x[:6]))
    return best and (best[5], best[2], best[6])


def ring(rows, shards, vnodes, capacity):
    """{row: (shard, slot)} of different (key, tie) rows on a ring, walked one row at a time.

    First each row in ring order goes to the shard of the next point, while that has room; then, in the same order, each row left
    goes on from point to point to the first shard with room.
    """
    def at(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    points = sorted((at(f"shard {s} point {v}"), s) for s in range(shards) for v in range(vnodes))

    def arc(pos):
        return next((i for i, (p, _) in enumerate(points) if p >= pos), 0)

    spots = []
    for key, tie in rows:
        pos = at("null" if key is None else str(key))
        spots.append((arc(pos), pos, (key is not None, key or 0), tie, (key, tie)))
    spots.sort()
    out, held, left = {}, Counter(), []

    def put(row, shard):
        out[row] = (shard, held[shard])
        held[shard] += 1

    for a, *_, row in spots:
        if held[points[a][1]] < capacity[points[a][1]]:
            put(row, points[a][1])
        else:
            left.append((a, row))
    for a, row in left:
        while held[points[a][1]] >= capacity[points[a][1]]:
            a = (a + 1) % len(points)
        put(row, points[a][1])
    return out
