"""Cutting texts where no match of the byte-level pattern can reach across, so that each distinct cut is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: the pattern for which `cut` holds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RUN = re.compile(r"[ \n](?:\s|\Z)")
_BETWEEN = re.compile(r"(?<=\S)(?=[ \n]\S)")


def cut(text: str) -> list[str]:
    """Cuts that make up the text again; encoding each by PATTERN is encoding the text.

    Before a single space or line end that another character follows every match ends: no alternative has a space but as its
    first character, or a line end at all, but in a run of white space, whose last character stands alone there.
    """
    if not text:
        return []
    if _RUN.search(text):
        return _BETWEEN.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    cuts = [p if p[0] == "\n" else " " + p for p in rest]
    return [first, *cuts] if first else cuts


class Recent:
    """A bounded cache of two generations: what is asked for again outlives what is not. It never changes a result."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def keep(self, used: dict) -> None:
        """Remember a block's entries."""
        self.new.update(used)
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}

    def values(self, keys: list, make: Callable[[list], list]) -> list:
        """The value of each key, repeated or not; make gives those of the different keys that are not known."""
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        unknown = [i for i, v in enumerate(out) if v is None]
        if unknown:
            missing = []
            for k in {keys[i] for i in unknown}:
                if (v := old.get(k)) is None:
                    missing.append(k)
                else:
                    new[k] = v
            new.update(zip(missing, make(missing), strict=True))
            for i in unknown:
                out[i] = new[keys[i]]
            self.keep({})
        return out


def spliced(parts: list[list[str]], values: list[bytes]) -> list[bytes]:
    """The values of each list's parts, joined; values has one for each part of all lists in turn."""
    out, at = [], 0
    for p in parts:
        out.append(b"".join(values[at : at + len(p)]))
        at += len(p)
    return out
