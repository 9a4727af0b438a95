"""Distances between a model run and a trace, as columns: array functions only, so that they stay in the JVM.

`w` marks waiting; a silent symbol is null, `tau` or anything that contains `tau` or `skip`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WAIT = "w"


def is_silent(symbol: Column) -> Column:
    """Whether a symbol of a run leaves no trace."""
    return symbol.isNull() | F.coalesce(symbol.contains("tau") | symbol.contains("skip"), F.lit(False))


def visible(symbols: Column) -> Column:
    """A sequence without waits and silent symbols."""
    return F.filter(symbols, lambda x: ~is_silent(x) & (x != WAIT))


def prefix(trace: Column, n: int) -> Column:
    """The first n symbols."""
    return F.slice(trace, 1, n)


def padded(trace: Column, n: int) -> Column:
    """The first n symbols, filled up with waits."""
    return F.concat(prefix(trace, n), F.array_repeat(F.lit(WAIT), F.greatest(F.lit(0), F.lit(n) - F.size(trace))))


def hamming(run: Column, trace: Column) -> Column:
    """Positions at which two sequences of one length differ; a silent symbol of either takes its position for free."""
    return F.aggregate(F.zip_with(run, trace, lambda s, t: F.when(is_silent(s) | is_silent(t) | (s == t), 0).otherwise(1)), F.lit(0), lambda a, x: a + x)


def common_subsequence(s: Column, t: Column) -> Column:
    """The length of the longest common subsequence, one row of the table at a time."""

    def row(old: Column, x: Column) -> Column:
        step = lambda new, j: F.concat(new, F.array(F.greatest(F.get(new, j - 1), F.get(old, j), F.get(old, j - 1) + F.when(F.get(t, j - 1) == x, 1).otherwise(0))))
        return F.when(F.size(t) == 0, old).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), F.array(F.lit(0)), step))

    return F.element_at(F.aggregate(s, F.array_repeat(F.lit(0), F.size(t) + 1), row), -1)


def indel(run: Column, trace: Column) -> Column:
    """Insertions and deletions between the visible symbols (no substitution): |s| + |t| - 2 LCS."""
    s, t = visible(run), visible(trace)
    return F.size(s) + F.size(t) - 2 * common_subsequence(s, t)


def indel_row(row: Column, trace: Column, x: Column) -> Column:
    """The insertions and deletions from a word and x to each prefix of a visible trace, where row holds those from the word alone."""
    down = F.get(row, F.lit(0)) + 1
    cell = lambda new, j: F.concat(new, F.array(F.least(F.get(new, j - 1) + 1, F.get(row, j) + 1, F.when(F.get(trace, j - 1) == x, F.get(row, j - 1)))))
    return F.when(F.size(trace) == 0, F.array(down)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(trace), F.lit(1))), F.array(down), cell))


def edit(a: Column, b: Column) -> Column:
    """Levenshtein distance with substitution of symbol sequences; both must be encoded as one character a symbol."""
    return F.levenshtein(a, b)
