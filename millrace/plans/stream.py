"""The fluent builder: a graph whose nodes know how to build DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from millrace.functions.shapes import takes
from millrace.operators import basic, joins, watermark, windows
from millrace.operators.aggregates import Agg
from millrace.operators.rows import as_stream
from millrace.plans.graph import DataflowGraph, Edge, Node, ValidationResult, validate
from millrace.plans.window_spec import WindowSpec


class GraphBuilder:
    """``source`` starts streams; handles append to the graph; ``build`` checks and freezes it."""

    def __init__(self):
        self._nodes: list[Node] = []
        self._edges: list[Edge] = []

    def _add(self, name: str, kind: str, inputs: list[int], build: Callable, partition: str | list[str] = "Forward", **params) -> Stream:
        node = Node(len(self._nodes) + 1, name, kind, params, build)
        self._nodes.append(node)
        for k, i in enumerate(inputs):
            self._edges.append(Edge(len(self._edges), i, node.id, partition if isinstance(partition, str) else partition[k]))
        return Stream(self, node.id)

    def source(self, rows: DataFrame | Callable[[], DataFrame], ts: str | Column, seq: str | Column, name: str = "source", limit: int | None = None) -> Stream:
        """A DataFrame (or a function that makes one) with its event time (long ticks) and arrival order. ``limit``: only so many first rows are pulled."""
        if callable(rows):
            takes(rows, 0, "a source function", gives=True)

        def build(params: dict, _inputs: list[DataFrame]) -> DataFrame:
            df = as_stream(rows() if callable(rows) else rows, ts, seq)
            if limit is not None:
                df = df.orderBy("__seq").limit(limit)
            if "lateness" in params:
                df = watermark.stamp(df, params["lateness"], params["interval"])
            return df

        return self._add(name, "Source", [], build)

    def validate(self) -> ValidationResult:
        return validate(self._nodes, self._edges)

    def build(self) -> DataflowGraph:
        return DataflowGraph(self._nodes, self._edges)


class Stream:
    """A handle on an operator's output."""

    def __init__(self, builder: GraphBuilder, op: int, keys: tuple[str, ...] = (), shared: bool = False):
        self.builder, self.id, self.keys, self.shared = builder, op, keys, shared

    def _next(self, name: str, kind: str, build: Callable, partition: str = "Forward", **params) -> Stream:
        out = self.builder._add(name, kind, [self.id], lambda p, inputs: build(inputs[0]), partition, **params)
        out.keys = self.keys
        return out

    def with_watermark(self, lateness: int, interval: int = 100) -> Stream:
        """Watermarks that trail the largest event time by ``lateness``, after every ``interval`` rows. Sources only."""
        node = self.builder._nodes[self.id - 1]
        if node.kind != "Source":
            raise ValueError("a watermark belongs to a source")
        if lateness < 0 or interval < 1:
            raise ValueError("lateness must not be negative, interval must be positive")
        self.builder._nodes[self.id - 1] = replace(node, params={**node.params, "lateness": lateness, "interval": interval})
        return self

    def with_parallelism(self, n: int) -> Stream:
        """This operator's rows in ``n`` partitions, by key after ``key_by``; 1 leaves it to the plan."""
        if n < 1:
            raise ValueError("parallelism must be positive")
        node = self.builder._nodes[self.id - 1]
        self.builder._nodes[self.id - 1] = replace(node, parallelism=n, params={"keys": list(self.keys), **node.params})
        return self

    def broadcast(self) -> Stream:
        """As an input of a join: sent whole to every task, if it is found small when the graph is compiled."""
        return Stream(self.builder, self.id, self.keys, True)

    def map(self, func: Callable | None = None, schema: str | None = None, *, ts: Column | None = None, keep: bool = False, **columns: Column) -> Stream:
        """New payload columns by expression; or ``func`` over pandas batches with the payload's ``schema``."""
        if func is not None:
            takes(func, 1, "a map function", gives=True)
            return self._next("map", "Map", lambda df: basic.map_rows(df, func, schema))
        return self._next("map", "Map", lambda df: basic.map_columns(df, columns, ts, keep))

    def filter(self, predicate: Column | Callable) -> Stream:
        if not isinstance(predicate, Column):
            takes(predicate, 1, "a predicate", gives=True)
        return self._next("filter", "Filter", lambda df: basic.filter_rows(df, predicate))

    def key_by(self, *columns: str) -> Stream:
        """Windows after this are per key."""
        return Stream(self.builder, self.id, tuple(columns))

    def window(self, spec: WindowSpec) -> WindowedStream:
        return WindowedStream(self, spec)

    def session(self, gap: int, **aggs: Agg | Column) -> Stream:
        return self._next("session", "Window", lambda df: windows.session_aggregate(df, gap, aggs, list(self.keys)), "Keyed", gap=gap, aggs=aggs, keys=list(self.keys))

    def rolling(self, **aggs: Agg | Column) -> Stream:
        return self._next("rolling", "Map", lambda df: windows.rolling(df, aggs, list(self.keys)), "Keyed")

    def _joined(self, other: Stream, kind: str, name: str, build: Callable, keys: tuple[joins.Key, joins.Key], func: Callable | None, schema: str | None, columns: dict[str, Column], **params) -> Stream:
        for k in keys:
            if not isinstance(k, (str, Column)):
                takes(k, 1, "a key selector", gives=True)
        if func is not None:
            takes(func, 2, "a join function", gives=True)
        made = columns if func is None else (func, schema)
        edges = ["Broadcast" if s.shared else "Forward" for s in (self, other)]
        return self.builder._add(name, kind, [self.id, other.id], lambda p, i: build(*i, *keys, made), edges, made=made, keys=keys, **params)

    def window_join(self, other: Stream, left_key: joins.Key, right_key: joins.Key, spec: WindowSpec, func: Callable | None = None, schema: str | None = None, *, ts: Column | None = None, **columns: Column) -> Stream:
        """Pairs of equal keys in a common window. Keys: columns, or functions of a batch of rows. Result: ``columns`` over ``l.`` and ``r.``, or ``func`` of the left and right rows of a batch of pairs."""
        if spec.kind != "time":
            raise ValueError("a window join needs a time window")
        build = lambda a, b, lk, rk, made: joins.window_join(a, b, lk, rk, spec, made, ts, self._late() or other._late())
        return self._joined(other, "WindowJoin", "window_join", build, (left_key, right_key), func, schema, columns, spec=spec, ts=ts)

    def interval_join(self, other: Stream, left_key: joins.Key, right_key: joins.Key, lower: int, upper: int, func: Callable | None = None, schema: str | None = None, *, ts: Column | None = None, **columns: Column) -> Stream:
        """Pairs of equal keys whose times differ by ``lower`` to ``upper``; keys and result as in ``window_join``."""
        if lower > upper:
            raise ValueError("lower must not exceed upper")
        build = lambda a, b, lk, rk, made: joins.interval_join(a, b, lk, rk, lower, upper, made, ts)
        return self._joined(other, "IntervalJoin", "interval_join", build, (left_key, right_key), func, schema, columns, bounds=(lower, upper), ts=ts)

    def sink(self, func: Callable[[DataFrame], None] | None = None, name: str = "sink") -> Stream:
        """The end of a branch. ``func`` gets the whole result when the graph runs."""
        if func is not None:
            takes(func, 1, "a sink function", gives=False)
        return self._next(name, "Sink", lambda df: df, func=func)

    def _late(self) -> bool:
        """Whether a source upstream has a watermark and no window lies between (windows pass none on; joins pass the least)."""
        node = self.builder._nodes[self.id - 1]
        if node.kind == "Source":
            return "lateness" in node.params
        if node.kind == "Window":
            return False
        return any(Stream(self.builder, e.source)._late() for e in self.builder._edges if e.target == self.id)

    def build(self) -> DataflowGraph:
        return self.builder.build()


class WindowedStream:
    def __init__(self, stream: Stream, spec: WindowSpec):
        self.stream, self.spec = stream, spec

    def reduce(self, func: Callable | None = None, schema: str | None = None, **aggs: Agg | Column) -> Stream:
        """One row per window: aggregates by expression, or ``func`` over the window's rows as pandas with the ``schema`` of its row."""
        s, spec = self.stream, self.spec
        keys, late = list(s.keys), s._late()
        partition = "Keyed" if keys else "Forward"
        if func is not None:
            takes(func, 1, "a window function", gives=True)
            return s._next("window", "Window", lambda df: windows.apply_function(df, spec, func, schema, keys, late), partition, spec=spec, func=func, schema=schema, keys=keys)
        if spec.kind == "time":
            return s._next("window", "Window", lambda df: windows.time_aggregate(df, spec, aggs, keys, late), partition, spec=spec, aggs=aggs, keys=keys)
        return s._next("window", "Window", lambda df: windows.count_aggregate(df, spec, aggs, keys), partition, spec=spec, aggs=aggs, keys=keys)

    aggregate = reduce

    def updates(self, every: int = 1, purge: bool = False, retract: bool = False, allowed: int | None = None, **aggs: Agg) -> Stream:
        """A time window's results after every ``every`` rows and at its end (a count trigger): FIRE, or FIRE_AND_PURGE with ``purge``; ``every=1`` emits on update. With ``allowed``: at its end, and after every ``every`` rows that are late by no more."""
        s, spec = self.stream, self.spec
        if spec.kind != "time" or every < 1 or (allowed or 0) < 0 or purge and retract or not all(isinstance(a, Agg) for a in aggs.values()):
            raise ValueError("updates take a time window, every >= 1, allowed >= 0, mergeable aggregates and not both purge and retract")
        keys, late = list(s.keys), s._late()
        return s._next("updates", "Window", lambda df: windows.triggered(df, spec, aggs, keys, every, purge, retract, late, allowed), "Keyed" if keys else "Forward", updates=every)
