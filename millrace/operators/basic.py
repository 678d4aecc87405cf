"""Map and filter: column expressions, or opaque Python functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import RESERVED, SEQ, TS, WM, payload


def map_columns(df: DataFrame, columns: dict[str, Column], ts: Column | None = None, keep: bool = False) -> DataFrame:
    """The payload becomes ``columns`` (with ``keep``: they are added). ``ts`` rewrites event time; the watermark stays that of the source."""
    own = payload(df) if keep else []
    kept = [F.col(c) for c in own if c not in columns]
    new = [c.alias(n) for n, c in columns.items()]
    return df.select(*kept, *new, (ts.cast("long") if ts is not None else F.col(TS)).alias(TS), SEQ, WM)


def map_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``func`` maps a batch of rows to as many rows in the same order; it may return ``__ts``. Arrow batches, never single rows."""
    fields = ", ".join([schema, *(f"{c} long" for c in RESERVED)])

    def run(batches):
        for batch in batches:
            out = func(batch)
            if len(out) != len(batch):
                raise ValueError("a map must return one row per row")
            for c in RESERVED:
                if c not in out:
                    out[c] = batch[c].to_numpy()
            out[WM] = out[WM].astype("Int64")
            yield out

    return df.mapInPandas(run, fields)


def filter_rows(df: DataFrame, predicate: Column | Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    if isinstance(predicate, Column):
        return df.filter(predicate)

    def run(batches):
        for batch in batches:
            yield batch[predicate(batch).to_numpy(dtype=bool)]

    return df.mapInPandas(run, df.schema)
