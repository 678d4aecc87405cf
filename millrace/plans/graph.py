"""The logical dataflow: nodes and edges, checks, topology and printing."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    """An operator. ``params`` holds its options; ``build`` turns its inputs' DataFrames into its own."""

    id: int
    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict, compare=False)
    build: Callable | None = field(default=None, compare=False, repr=False)
    parallelism: int = 1

    @property
    def is_window(self) -> bool:
        return self.kind in ("Window", "WindowJoin")


@dataclass(frozen=True)
class Edge:
    """``partition``: Forward, Keyed (its rows are dealt by key) or Broadcast (every task of the target gets all rows, if they are few)."""

    id: int
    source: int
    target: int
    partition: str = "Forward"


@dataclass(frozen=True)
class ValidationResult:
    errors: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return not self.errors


def validate(nodes: list[Node], edges: list[Edge]) -> ValidationResult:
    if not nodes:
        return ValidationResult(("graph has no operators",))
    known = {n.id for n in nodes}
    errors = [f"edge {e.id} names operator {x}, which isn't in the graph" for e in edges for x in (e.source, e.target) if x not in known]
    if not errors and len(_sorted(nodes, edges)) < len(nodes):
        errors.append("graph has a cycle")
    return ValidationResult(tuple(errors))


def _sorted(nodes: list[Node], edges: list[Edge]) -> list[int]:
    """Operators after their inputs, the least id first among those that are ready; short if there is a cycle."""
    waiting = {n.id: sum(e.target == n.id for e in edges) for n in nodes}
    ready, out = sorted(i for i, w in waiting.items() if not w), []
    while ready:
        i = ready.pop(0)
        out.append(i)
        for e in edges:
            if e.source == i:
                waiting[e.target] -= 1
                if not waiting[e.target]:
                    ready.append(e.target)
        ready.sort()
    return out


class DataflowGraph:
    """Frozen operators and edges."""

    def __init__(self, nodes: list[Node], edges: list[Edge]):
        if not (found := validate(nodes, edges)):
            raise ValueError("; ".join(found.errors))
        self.nodes, self.edges = tuple(nodes), tuple(edges)

    def op(self, key: int | str) -> Node:
        """By id, or the first of that name."""
        for n in self.nodes:
            if key in (n.id, n.name):
                return n
        raise KeyError(key)

    def edge(self, edge_id: int) -> Edge:
        return next((e for e in self.edges if e.id == edge_id), None) or self._missing(edge_id)

    @staticmethod
    def _missing(key):
        raise KeyError(key)

    def sources_of(self, op: int) -> list[int]:
        return [e.source for e in self.edges if e.target == op]

    def targets_of(self, op: int) -> list[int]:
        return [e.target for e in self.edges if e.source == op]

    def in_degree_of(self, op: int) -> int:
        return len(self.sources_of(op))

    def out_degree_of(self, op: int) -> int:
        return len(self.targets_of(op))

    def roots(self) -> list[int]:
        return [n.id for n in self.nodes if not self.in_degree_of(n.id)]

    def leaves(self) -> list[int]:
        return [n.id for n in self.nodes if not self.out_degree_of(n.id)]

    def topological_order(self) -> list[int]:
        return _sorted(list(self.nodes), list(self.edges))

    def to_json(self) -> str:
        ops = [{"id": n.id, "name": n.name, "type": n.kind, "parallelism": n.parallelism} for n in self.nodes]
        links = [{"id": e.id, "source": e.source, "target": e.target, "partition": e.partition} for e in self.edges]
        return json.dumps({"operators": ops, "edges": links}, indent=2)

    def to_graphviz(self) -> str:
        lines = [f'  op{n.id} [label="{n.name}\\n{n.kind} x{n.parallelism}"];' for n in self.nodes]
        lines += [f'  op{e.source} -> op{e.target} [label="{e.partition}"];' for e in self.edges]
        return "\n".join(["digraph dataflow {", "  rankdir=LR;", *lines, "}"])

    def stages(self) -> list[list[int]]:
        """Operators by stage: a stage ends with a window, whose result is shuffled to the next."""
        depth: dict[int, int] = {}
        for i in self.topological_order():
            depth[i] = max([depth[s] + self.op(s).is_window for s in self.sources_of(i)], default=0)
        return [[i for i in self.topological_order() if depth[i] == d] for d in range(max(depth.values()) + 1)]

    def channels(self) -> list[tuple[int, int]]:
        """Edges that cross stages."""
        at = {i: k for k, ids in enumerate(self.stages()) for i in ids}
        return [(e.source, e.target) for e in self.edges if at[e.source] != at[e.target]]

    def stages_to_json(self) -> str:
        parts = [{"stage": k, "operators": [{"id": i, "name": self.op(i).name, "type": self.op(i).kind} for i in ids]} for k, ids in enumerate(self.stages())]
        return json.dumps({"pipelines": parts, "channels": [{"from": a, "to": b} for a, b in self.channels()]}, indent=2)

    def stages_to_graphviz(self) -> str:
        lines, crossing = [], set(self.channels())
        for k, ids in enumerate(self.stages()):
            lines += [f"  subgraph cluster_{k} {{", f'    label="stage {k}";', *[f'    op{i} [label="{self.op(i).name}"];' for i in ids], "  }"]
        lines += [f"  op{e.source} -> op{e.target}{' [style=dashed]' if (e.source, e.target) in crossing else ''};" for e in self.edges]
        return "\n".join(["digraph execution {", *lines, "}"])
