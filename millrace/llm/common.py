"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordering import ranked as globally_ranked
from millrace.operators.ordering import settled, shared_folder

__all__ = ["SPACE_CHARS", "globally_ranked", "let", "partitions", "settled", "shared_folder", "table", "text_of"]

#: SPACE_CHARS: the word separators of the query contracts: space and the six ASCII controls from tab to carriage return.
SMALL_BYTES = 64 << 20
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read.

    A table of under ``SMALL_BYTES`` in fewer files than there are cores is dealt over the cores, as a
    small file is often one row group and would keep one core busy; larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def partitions(df: DataFrame) -> int:
    """The session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
