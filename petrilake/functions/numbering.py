"""Dense numbers of indexed variable families: row-major, from 1, half-open bounds; and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """A family of variables: name, first number and the bounds of its indices."""

    name: str
    first: int
    bounds: tuple[tuple[int, int], ...]

    @property
    def widths(self) -> tuple[int, ...]:
        return tuple(hi - lo for lo, hi in self.bounds)

    @property
    def end(self) -> int:
        """The number after the last one."""
        size = 1
        for w in self.widths:
            size *= w
        return self.first + size

    def number(self, *index: Column) -> Column:
        """The number of the variable at these indices."""
        at = F.lit(0).cast("long")
        for i, (lo, _), w in zip(index, self.bounds, self.widths, strict=True):
            at = at * w + (i - lo)
        return at + self.first

    def index(self, number: Column) -> list[Column]:
        """The indices of a number."""
        rest, out = number - self.first, []
        for (lo, _), w in reversed(list(zip(self.bounds, self.widths, strict=True))):
            out.append((rest % w + lo).cast("int"))
            rest = F.floor(rest / w)
        return out[::-1]

    def label(self, number: Column) -> Column:
        """The variable's name with its indices."""
        return F.concat(F.lit(self.name + " ["), F.array_join(F.array(*[i.cast("string") for i in self.index(number)]), ", "), F.lit("]"))


def families(**bounds: list[tuple[int, int]]) -> dict[str, Family]:
    """Families one after another, in the order given."""
    out, first = {}, 1
    for name, b in bounds.items():
        out[name] = Family(name, first, tuple(b))
        first = out[name].end
    return out
