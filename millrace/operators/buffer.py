"""Ranges of event time: what a sorted buffer of rows is asked for, as filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import SEQ, TS


def between(df: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of [start, end)."""
    return df.filter((F.col(TS) >= start) & (F.col(TS) < end))


def extract(df: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """The rows of [start, end), and the others."""
    return between(df, start, end), df.filter((F.col(TS) < start) | (F.col(TS) >= end))


def from_time(df: DataFrame, start: int) -> DataFrame:
    """What is left once rows before ``start`` are dropped."""
    return df.filter(F.col(TS) >= start)


def in_time_order(df: DataFrame) -> DataFrame:
    """By event time; of equal times the latest arrival first."""
    return df.orderBy(F.col(TS), F.col(SEQ).desc())
