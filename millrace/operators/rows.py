"""The row model: payload columns beside reserved ones.

``__ts`` event time (long tick), ``__seq`` arrival order (long), ``__wm`` the watermark that stood when
the row arrived (long, null for none). Expressions may read the reserved columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS, SEQ, WM = "__ts", "__seq", "__wm"
RESERVED = (TS, SEQ, WM)


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def as_stream(df: DataFrame, ts: str | Column, seq: str | Column) -> DataFrame:
    """``df`` with event time and arrival order; the watermark is set by ``watermark.stamp``."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.withColumns({TS: column(ts).cast("long"), SEQ: column(seq).cast("long"), WM: F.lit(None).cast("long")})


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")
