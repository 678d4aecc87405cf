"""Slots: threads that run one bounded graph each and can be stopped one by one."""

from __future__ import annotations

import threading
import uuid

from pyspark import SparkContext

from millrace.plans.graph import DataflowGraph


class Slot:
    """Runs one graph at a time. Its jobs carry the slot's tag, so ``stop`` ends those of this slot alone."""

    def __init__(self):
        self._tag, self._context = f"millrace-{uuid.uuid4().hex}", None
        self._graph: DataflowGraph | None = None
        self._thread: threading.Thread | None = None
        self._stopped = threading.Event()
        self.error: Exception | None = None
        self.finished = False

    @property
    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    @property
    def is_assigned(self) -> bool:
        return self._graph is not None

    def assign(self, graph: DataflowGraph) -> None:
        if self.is_running:
            raise RuntimeError("the slot is running")
        self._graph = graph

    def start(self) -> None:
        """Runs the assigned graph in a thread."""
        if self.is_running or self._graph is None:
            raise RuntimeError("the slot is running" if self.is_running else "the slot has no graph")
        self._stopped.clear()
        self.error, self.finished, self._context = None, False, SparkContext.getOrCreate()
        self._thread = threading.Thread(target=self._run)
        self._thread.start()

    def stop(self) -> None:
        """Ends the graph that runs, if any, and waits until it has ended."""
        self._stopped.set()
        while self.is_running and self._thread is not threading.current_thread():
            self._context.cancelJobsWithTag(self._tag)  # again, since a job may begin just now
            self._thread.join(0.2)

    def wait(self) -> None:
        if self._thread is not None:
            self._thread.join()

    def _run(self) -> None:
        from millrace.plans.batch import results

        graph, self._graph = self._graph, None
        try:
            self._context.addJobTag(self._tag)
            for i, df in results(graph).items():
                if self._stopped.is_set():
                    return
                func = graph.op(i).params.get("func") if graph.op(i).kind == "Sink" else None
                if func:
                    func(df)
                else:
                    df.write.format("noop").mode("overwrite").save()
            self.finished = not self._stopped.is_set()
        except Exception as e:
            if not self._stopped.is_set():  # what a stopped graph throws is no failure
                self.error = e


class SlotManager:
    """A fixed number of slots."""

    def __init__(self, slot_count: int):
        if slot_count < 1:
            raise ValueError("slots must be positive")
        self._slots = [Slot() for _ in range(slot_count)]

    @property
    def slot_count(self) -> int:
        return len(self._slots)

    def get_slot(self, index: int) -> Slot:
        if not 0 <= index < len(self._slots):
            raise IndexError(index)
        return self._slots[index]

    def start_all(self) -> None:
        """Starts every slot that has a graph and doesn't run."""
        for s in self._slots:
            if s.is_assigned and not s.is_running:
                s.start()

    def stop_all(self) -> None:
        for s in self._slots:
            s.stop()
