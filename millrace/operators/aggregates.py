"""Mergeable aggregates: partial results by slice that combine into windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


#: How the partial results of each kind combine.
HOW = {"sum": ("sum",), "count": ("sum",), "min": ("min",), "max": ("max",), "avg": ("sum", "sum")}


@dataclass(frozen=True)
class Agg:
    """``partial`` columns over rows, ``merge`` of each over partials, and the final expression over the merged ones."""

    kind: str
    column: str | Column

    def _value(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    def names(self, name: str) -> list[str]:
        """Columns for the partial results of the aggregate of that name."""
        return [f"__{name}_{i}" for i in range(len(self.partials()))]

    def partials(self) -> list[Column]:
        v = self._value()
        return {"sum": [F.sum(v)], "count": [F.count(v)], "min": [F.min(v)], "max": [F.max(v)], "avg": [F.sum(v), F.count(v)]}[self.kind]

    def merged(self, names: list[str]) -> list[Column]:
        return [getattr(F, how)(n) for how, n in zip(HOW[self.kind], names, strict=True)]

    def again(self, names: list[str]) -> dict[str, Agg]:
        """Aggregates that combine the partial results under their own names."""
        return {n: Agg(how, n) for how, n in zip(HOW[self.kind], names, strict=True)}

    def joined(self, first: list[Column], second: list[Column]) -> list[Column]:
        """Two partial results as one; a null one holds nothing."""
        ways = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
        return [ways[how](a, b) for how, a, b in zip(HOW[self.kind], first, second, strict=True)]

    def final(self, names: list[str]) -> Column:
        if self.kind == "avg":
            return F.try_divide(F.col(names[0]), F.col(names[1]))
        return F.col(names[0])

    def whole(self) -> Column:
        v = self._value()
        return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[self.kind](v)


def sum_of(column: str | Column) -> Agg:
    return Agg("sum", column)


def count_of(column: str | Column = "__ts") -> Agg:
    return Agg("count", column)


def min_of(column: str | Column) -> Agg:
    return Agg("min", column)


def max_of(column: str | Column) -> Agg:
    return Agg("max", column)


def avg_of(column: str | Column) -> Agg:
    return Agg("avg", column)


def partial(groups: GroupedData, aggs: dict[str, Agg], *more: Column) -> DataFrame:
    """Partial results per group."""
    return groups.agg(*[c.alias(p) for n, a in aggs.items() for c, p in zip(a.partials(), a.names(n), strict=True)], *more)


def merged(groups: GroupedData, aggs: dict[str, Agg], keys: list[str], *more: Column) -> DataFrame:
    """Final results per group of partial ones."""
    out = groups.agg(*[c.alias(p) for n, a in aggs.items() for c, p in zip(a.merged(a.names(n)), a.names(n), strict=True)], *more)
    kept = [c for c in out.columns if c not in keys and not any(c in a.names(n) for n, a in aggs.items())]
    return out.select(*keys, *[a.final(a.names(n)).alias(n) for n, a in aggs.items()], *kept)


def as_column(a: Agg | Column) -> Column:
    return a.whole() if isinstance(a, Agg) else a
