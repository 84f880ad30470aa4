"""Range fragments of a table by its key: owner of a key, and fragments a predicate can touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fragment:
    name: str
    lower: int | None  # inclusive; None: no bound
    upper: int | None  # exclusive
    node: str = ""

    def holds(self, key: int) -> bool:
        return (self.lower is None or key >= self.lower) and (self.upper is None or key < self.upper)


def from_bounds(parts: list[tuple[str, int | None, str]]) -> list[Fragment]:
    """parts: (name, values less than, node) in rising order; None for the last is no bound."""
    out, lower = [], None
    for name, upper, node in parts:
        if (out and out[-1].upper is None) or (lower is not None and upper is not None and upper <= lower):
            raise ValueError("bounds must rise, and only the last may be open")
        out.append(Fragment(name, lower, upper, node))
        lower = upper
    return out


def owner(fragments: list[Fragment], key: int) -> Fragment:
    return next(f for f in fragments if f.holds(key))


def owner_column(fragments: list[Fragment], key: Column) -> Column:
    """Name of the owner, to write a table with partitionBy."""
    out = None
    for f in fragments:
        inside = (F.lit(True) if f.lower is None else key >= f.lower) & (F.lit(True) if f.upper is None else key < f.upper)
        out = F.when(inside, f.name) if out is None else out.when(inside, f.name)
    return out


def touched(fragments: list[Fragment], op: str, low: int, high: int | None = None) -> list[Fragment]:
    def meets(f: Fragment) -> bool:
        above = f.lower is None or {"=": f.lower <= low, "<": f.lower < low, "<=": f.lower <= low, "between": high is not None and f.lower <= high}.get(op, True)
        below = f.upper is None or {"=": low < f.upper, ">": low < f.upper - 1, ">=": low < f.upper, "between": low < f.upper}.get(op, True)
        return above and below

    return [f for f in fragments if meets(f)]


def prune(table: DataFrame, column: str, fragments: list[Fragment]) -> DataFrame:
    """Rows of the fragments, by a filter on the column the table is partitioned by."""
    return table.filter(F.col(column).isin(*(f.name for f in fragments)))
