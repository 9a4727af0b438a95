"""Clusters of traces around subnets of nets with many transitions: transition sets as bits, and branch and bound over what they cover.

For each variant the sets of transitions that some full run close to it uses are found by a search through (position, marking, set),
in tasks, one variant at a time; interleavings of concurrent steps come to the same set, and a set that holds another one of no larger cost
is left out. The best few subnets for a bounded sample of variants are then unions of such sets, chosen by branch and bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from petrilake.operators.alignment import graph
from petrilake.operators.nets import Net

#: Variants that `best_cover` takes, at most: a search for the best subnets is one of a sample.
MOST_VARIANTS = 64


def _beaten(found: list[tuple[int, int]], cost: int, bits: int) -> bool:
    return any(c <= cost and b & ~bits == 0 for c, b in found)


def transition_sets(variants: DataFrame, net: Net, most_distance: int, most_transitions: int) -> DataFrame:
    """(trace, n_cases, sets array<struct<cost, bits binary>>): the least sets of transitions of the full runs within most_distance of each variant.

    A visible step alone and a symbol alone cost 1. Bits are little-endian, by the place of a transition in the net. A set has at most
    most_transitions; none is given of which a part costs no more. Runs may have any length; a net's markings are those of a model.
    """
    markings, arcs = graph(variants.sparkSession, net)
    number = {t[0]: i for i, t in enumerate(net.transitions)}
    first = markings.index(tuple(sorted(net.initial)))
    final = set(net.final or net.sinks)
    ends = [i for i, m in enumerate(markings) if final <= set(m)]
    out: dict[int, list[tuple[int, str | None, bool, int]]] = {}
    for a, b, label, silent, tid in arcs:
        out.setdefault(a, []).append((b, label, silent, 1 << number[tid]))
    width = (len(net.transitions) + 7) // 8

    def search(trace: list[str]) -> list[tuple[int, int]]:
        ahead = [(0, 0, 0, first)]  # (cost, size, bits, marking)
        for pos in range(len(trace) + 1):
            seen: dict[int, list[tuple[int, int]]] = {}
            heapq.heapify(ahead)
            while ahead:
                cost, _, bits, at = heapq.heappop(ahead)
                if _beaten(seen.setdefault(at, []), cost, bits):
                    continue
                seen[at].append((cost, bits))
                for to, _, silent, bit in out.get(at, ()):
                    more, grown = cost + (not silent), bits | bit
                    if more <= most_distance and grown.bit_count() <= most_transitions:
                        heapq.heappush(ahead, (more, grown.bit_count(), grown, to))
            if pos == len(trace):
                break
            for at, found in seen.items():
                for cost, bits in found:
                    if cost < most_distance:
                        ahead.append((cost + 1, bits.bit_count(), bits, at))
                    for to, label, silent, bit in out.get(at, ()):
                        if not silent and label == trace[pos] and (bits | bit).bit_count() <= most_transitions:
                            ahead.append((cost, (bits | bit).bit_count(), bits | bit, to))
        least: list[tuple[int, int]] = []
        for cost, bits in sorted((x for e in ends for x in seen.get(e, ())), key=lambda x: (x[0], x[1].bit_count(), x[1])):
            if not _beaten(least, cost, bits):
                least.append((cost, bits))
        return least

    kind = pa.list_(pa.struct([("cost", pa.int32()), ("bits", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"cost": c, "bits": s.to_bytes(width, "little")} for c, s in search(t)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], ["trace", "n_cases", "sets"])

    return variants.select("trace", "n_cases").mapInArrow(work, "trace array<string>, n_cases bigint, sets array<struct<cost: int, bits: binary>>")


def best_cover(options: list[tuple[int, list[tuple[int, int]]]], most: int, most_transitions: int) -> tuple[int, list[int]]:
    """(score, sets): at most so many sets, of so many transitions, that score best for options (cases, [(cost, bits)]) of each variant.

    A case within a set scores 100 less 2 for each difference; a set costs 1 for each transition, two sets 2 for each that they share. The
    bound of a branch is what it has, less what its sets cost already, and the best that each variant left could add.
    """
    rows = []
    for cases, sets in options:
        worth = [(cases * (100 - 2 * c), bits) for c, bits in sets if c < 50]
        if worth:
            rows.append(sorted(worth, key=lambda x: (-x[0], x[1].bit_count(), x[1])))
    rows.sort(key=lambda r: -r[0][0])
    left = [0]
    for r in reversed(rows):
        left.append(left[-1] + r[0][0])
    left.reverse()
    price = lambda sets: sum(s.bit_count() for s in sets) + 2 * sum((s & t).bit_count() for i, s in enumerate(sets) for t in sets[:i])
    best: tuple[int, list[int]] = (0, [])
    known: dict[tuple[int, tuple[int, ...]], int] = {}

    def branch(i: int, sets: tuple[int, ...], gain: int) -> None:
        nonlocal best
        score = gain - price(sets)
        if score > best[0]:
            best = (score, sorted(sets))
        if i == len(rows) or score + left[i] <= best[0]:
            return
        key = (i, tuple(sorted(sets)))
        if known.get(key, -1) >= gain:
            return
        known[key] = gain
        ways: dict[tuple[int, ...], int] = {sets: gain}
        for worth, bits in rows[i]:
            for j in range(min(len(sets) + 1, most)):
                grown = (*sets, bits) if j == len(sets) else (*sets[:j], sets[j] | bits, *sets[j + 1 :])
                if grown[j].bit_count() > most_transitions:
                    continue
                grown = tuple(sorted(grown))
                ways[grown] = max(ways.get(grown, 0), gain + worth)
        for grown, more in sorted(ways.items(), key=lambda x: (price(x[0]) - x[1], x[0])):
            branch(i + 1, grown, more)

    branch(0, (), 0)
    return best


def best_subnets(variants: DataFrame, net: Net, most_distance: int, most_transitions: int, most: int) -> tuple[int, list[list[str]]]:
    """(score, subnets): the at most so many subnets, of at most most_transitions each, that score best for a sample of variants.

    The score is that of `best_cover`. More than MOST_VARIANTS variants are an error: sample them.
    """
    rows = transition_sets(variants, net, most_distance, most_transitions).limit(MOST_VARIANTS + 1).collect()  # a sample
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants; sample them")
    rows.sort(key=lambda r: r.trace)
    options = [(r.n_cases, [(s.cost, int.from_bytes(s.bits, "little")) for s in r.sets]) for r in rows]
    score, sets = best_cover(options, most, most_transitions)
    return score, [[t[0] for i, t in enumerate(net.transitions) if s >> i & 1] for s in sets]
