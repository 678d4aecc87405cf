"""Sinks: functions for the end of a branch, bounded or per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row


def parquet_sink(path: str, partition_by: tuple[str, ...] = ()) -> Callable[[DataFrame], None]:
    """Appends the rows."""
    return lambda df: df.write.mode("append").partitionBy(*partition_by).parquet(path)


def each(func: Callable[[Row], None], opened: Callable[[], None] = lambda: None, closed: Callable[[], None] = lambda: None) -> Callable[[DataFrame], None]:
    """``func`` on every row, where the row is, between ``opened`` and ``closed`` once per partition."""

    def run(rows) -> None:
        opened()
        try:
            for r in rows:
                func(r)
        finally:
            closed()

    return lambda df: df.foreachPartition(run)


def collecting(into: list) -> Callable[[DataFrame], None]:
    """All rows to the driver; for tests and small results."""
    return lambda df: into.extend(df.collect())


def per_batch(sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A bounded sink for a stream's micro-batches."""
    return lambda df, _batch: sink(df)
