"""Sources: Parquet tables, in-memory rows and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.schema import StreamSchema
from millrace.operators.rows import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``tick`` (microseconds) and ``cents`` (the value as a whole number)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", micros("ts").alias("tick"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def from_records(spark: SparkSession, schema: StreamSchema | str, records: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(records), schema.struct() if isinstance(schema, StreamSchema) else schema)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def generator_source(name: str, schema: str, rows: Callable[[int, int], Iterator[tuple]], total: int, parts: int = 4) -> type[DataSource]:
    """A data source (register it with ``spark.dataSource.register``) whose rows ``lo..hi`` come from ``rows(lo, hi)``, made where they are read."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Range(total * i // parts, total * (i + 1) // parts) for i in range(parts)]

        def read(self, partition):
            yield from rows(partition.lo, partition.hi)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source
