"""Bounded runs: every operator of the graph becomes a DataFrame, every leaf a result."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame

from millrace.operators.joins import shared_if_small
from millrace.plans.graph import DataflowGraph, Node
from millrace.plans.slots import SlotManager


def compile_graph(graph: DataflowGraph) -> dict[int, DataFrame]:
    """DataFrames by operator id, built once each, so branches and diamonds share their inputs."""
    made: dict[int, DataFrame] = {}
    for i in graph.topological_order():
        node = graph.op(i)
        inputs = [shared_if_small(made[e.source]) if e.partition == "Broadcast" else made[e.source] for e in graph.edges if e.target == i]
        made[i] = dealt(node.build(node.params, inputs), node)
    return made


def dealt(df: DataFrame, node: Node) -> DataFrame:
    """``df`` in as many partitions as the operator asks for, by its keys if it has some; as planned if it asks for one."""
    if node.parallelism == 1:
        return df
    return df.repartition(node.parallelism, *[k for k in node.params.get("keys", ()) if isinstance(k, str) and k in df.columns])


def results(graph: DataflowGraph) -> dict[int, DataFrame]:
    made = compile_graph(graph)
    return {i: made[i] for i in graph.leaves()}


def result(graph: DataflowGraph) -> DataFrame:
    """The only leaf's rows."""
    found = results(graph)
    if len(found) != 1:
        raise ValueError(f"the graph has {len(found)} leaves")
    return next(iter(found.values()))


class BatchEngine:
    """Runs several graphs, ``slots`` at a time; those that wait are queued, none is dropped."""

    def __init__(self, slots: int = 4):
        self.slots, self._graphs, self._stop = SlotManager(slots), [], threading.Event()

    def submit(self, graph: DataflowGraph) -> None:
        self._graphs.append(graph)

    def cancel(self) -> None:
        """Stops the graphs that run and lets none begin."""
        self._stop.set()
        self.slots.stop_all()

    def execute(self) -> int:
        """Calls every sink's function with its rows; the number of graphs that ran."""
        waiting, errors, ran, take = deque(self._graphs), [], [], threading.Lock()
        self._graphs = []

        def work(slot) -> None:
            while True:
                with take:
                    if self._stop.is_set() or errors or not waiting:
                        return
                    slot.assign(waiting.popleft())
                    slot.start()
                slot.wait()
                if slot.error:
                    errors.append(slot.error)
                elif slot.finished:
                    ran.append(slot)

        threads = [threading.Thread(target=work, args=(self.slots.get_slot(i),)) for i in range(min(len(waiting), self.slots.slot_count))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if errors:
            raise errors[0]
        return len(ran)
