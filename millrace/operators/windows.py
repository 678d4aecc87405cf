"""Time and count windows, sessions and rolling aggregates as DataFrame rewrites.

Time windows end at multiples of ``advance`` and hold the rows of [end - size, end), clamped at 0; an
empty window gives nothing; with ``advance > size`` the rows in the gaps belong to no window. Count
windows hold ``size`` rows in arrival order and start every min(advance, size) rows; the rows left at
the end form one partial window. Keys make both independent per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import Agg, as_column, merged, partial
from millrace.operators.ordering import blocked, ranked
from millrace.operators.rows import SEQ, TS, WM
from millrace.operators.watermark import in_force
from millrace.plans.window_spec import WindowSpec

END, INDEX = "window_end", "window_index"

#: Windows that overlap so many times take rows in and out (where the aggregates can) instead of copying slices.
OVERLAP = 16


def _ends(ts: Column, spec: WindowSpec) -> Column:
    """All window ends that hold the tick: multiples of the advance in (ts, ts + size]."""
    step = F.lit(spec.advance).cast("long")
    first = F.floor(ts / step) * step + step
    last = F.floor((ts + spec.size) / step) * step
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def assign_time(df: DataFrame, spec: WindowSpec, late: bool = True) -> DataFrame:
    """``df`` once per window that holds the row, with ``window_end``; windows that had fired when the row came are left out."""
    ts = F.col(TS)
    if spec.tumbling:
        out = df.withColumn(END, F.floor(ts / spec.size) * spec.size + spec.size)
    else:
        out = df.withColumn(END, F.explode(_ends(ts, spec)))
    if late:
        wm = in_force(df)
        out = out.filter(wm.isNull() | (F.col(END) > wm))
    return out


def _finish(df: DataFrame, keys: list[str], names: list[str], spec: WindowSpec) -> DataFrame:
    start = F.greatest(F.col(END) - spec.size, F.lit(0).cast("long")).alias("window_start")
    return df.select(*keys, start, END, *names, F.col(END).alias(TS), F.col(END).alias(SEQ), F.lit(None).cast("long").alias(WM))


def time_aggregate(df: DataFrame, spec: WindowSpec, aggs: dict[str, Agg | Column], keys: list[str] = (), late: bool = False) -> DataFrame:
    """One row per window (and key) with ``aggs``; the result's event time is the window's end.

    Overlapping windows over mergeable aggregates share slices: rows are first aggregated by slices of
    gcd(size, advance) ticks, and only the slices are copied into their windows. Where rows can be late, a
    slice is one per watermark in force, and windows that had fired by then are left out. Counts, and sums and
    averages of whole numbers, over windows that overlap ``OVERLAP`` times or more are carried from window to
    window: a slice is added at its first and subtracted after its last.
    """
    keys, names = list(keys), list(aggs)
    if spec.advance >= spec.size or not all(isinstance(a, Agg) for a in aggs.values()):
        out = assign_time(df, spec, late).groupBy(*keys, END).agg(*[as_column(a).alias(n) for n, a in aggs.items()])
        return _finish(out, keys, names, spec)
    width = math.gcd(spec.size, spec.advance)
    rows = df.withColumn("__met", in_force(df)) if late else df
    if spec.size >= OVERLAP * spec.advance and _subtractable(rows, aggs):
        return _finish(_evicting(rows, spec, width, aggs, keys, late), keys, names, spec)
    slices = partial(rows.groupBy(*keys, (F.floor(F.col(TS) / width) * width).alias("__slice"), *(["__met"] if late else [])), aggs)
    windows = slices.withColumn(END, F.explode(_ends(F.col("__slice"), spec)))
    if late:
        windows = windows.filter(F.col("__met").isNull() | (F.col(END) > F.col("__met")))
    return _finish(merged(windows.groupBy(*keys, END), aggs, [*keys, END]), keys, names, spec)


def _subtractable(df: DataFrame, aggs: dict[str, Agg]) -> bool:
    if any(a.kind not in ("sum", "count", "avg") for a in aggs.values()):
        return False
    sums = df.select(*[a.partials()[0].alias(n) for n, a in aggs.items()])
    return all(f.dataType.simpleString() == "bigint" for f in sums.schema.fields)


def _evicting(rows: DataFrame, spec: WindowSpec, width: int, aggs: dict[str, Agg], keys: list[str], late: bool) -> DataFrame:
    """Aggregates per window: two changes per slice, added up along the windows' ends, and repeated for the ends without a change."""
    known = {f"{n}__known": Agg("count", a.column) for n, a in aggs.items() if a.kind == "sum"}  # a sum of nulls only is null
    full = {**aggs, **known, "__held": Agg("count", F.lit(1))}
    parts = [p for n, a in full.items() for p in a.names(n)]
    slices = partial(rows.groupBy(*keys, (F.floor(F.col(TS) / width) * width).alias("__slice"), *(["__met"] if late else [])), full)
    step = F.lit(spec.advance).cast("long")
    after = lambda t: F.floor(t / step) * step + step
    first = F.greatest(after(F.col("__slice")), after(F.col("__met"))) if late else after(F.col("__slice"))
    slices = slices.withColumn("__from", first).withColumn("__to", after(F.col("__slice") + spec.size)).filter("__from < __to")
    exact = {p: F.coalesce(F.col(p), F.lit(0)).cast("decimal(28,0)") for p in parts}  # no overflow but of a window's own sum
    change = lambda at, sign: F.struct(F.col(at).alias(END), *[(c * F.lit(sign).cast("decimal(1,0)")).cast("decimal(28,0)").alias(p) for p, c in exact.items()])
    changes = slices.select(*keys, F.explode(F.array(change("__from", 1), change("__to", -1))).alias("x")).select(*keys, "x.*")
    changes = changes.groupBy(*keys, END).agg(*[F.sum(p).alias(p) for p in parts])
    held = _so_far(changes, {p: Agg("sum", p) for p in parts}, keys, END, then="__then").filter("____held_0 > 0")
    out = held.withColumn(END, F.explode(F.sequence(F.col(END), F.col("__then") - step, step))).withColumns({p: F.col(p).cast("long") for p in parts})
    some = lambda n, a: F.when(F.col(f"__{n}__known_0") > 0, a.final(a.names(n))) if a.kind == "sum" else a.final(a.names(n))
    return out.select(*keys, END, *[some(n, a).alias(n) for n, a in aggs.items()])


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``__rn``, the place in arrival order from 1 on (per key), and ``__all``, the number of rows."""
    if keys:
        rows = blocked(df, keys, SEQ)
        whole = Window.partitionBy("__key")
        blocks = rows.groupBy("__key", "__block").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
        blocks = blocks.select("__key", "__block", F.min("__first").over(whole).alias("__first"), F.sum("__n").over(whole).alias("__all"))
        rows = rows.join(blocks, ["__key", "__block"]).withColumn("__rn", F.col("__place") - F.col("__first") + 1)
        return rows.drop("__key", "__block", "__place", "__first")
    return ranked(df, SEQ, name="__rn", total="__all").withColumn("__rn", F.col("__rn") + 1)


def _indexes(place: Column, spec: WindowSpec) -> Column:
    """The count windows that hold the row at that place."""
    size, step = spec.size, min(spec.advance, spec.size)
    div = lambda a, b: F.floor(a / b)
    full = F.when(F.col("__all") >= size, div(F.col("__all") - size, step) + 1).otherwise(0)
    lo = F.greatest(F.lit(0).cast("long"), div(place - size + step - 1, step))
    hi = F.least(full, div(place - 1, step))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def assign_count(df: DataFrame, spec: WindowSpec, keys: list[str] = ()) -> DataFrame:
    """``df`` once per count window that holds the row, with ``window_index`` from 0 on (per key)."""
    return _numbered(df, list(keys)).withColumn(INDEX, F.explode(_indexes(F.col("__rn"), spec))).drop("__rn", "__all")


def _count_slices(df: DataFrame, spec: WindowSpec, aggs: dict[str, Agg], keys: list[str]) -> DataFrame:
    width = math.gcd(spec.size, spec.advance)
    rows = _numbered(df, keys).withColumn("__slice", F.expr(f"(__rn - 1) div {width}"))
    last = F.max(F.struct(SEQ, TS)).alias("__last")
    slices = partial(rows.groupBy(*keys, "__slice", "__all"), aggs, last)
    spread = slices.withColumn(INDEX, F.explode(_indexes(F.col("__slice") * width + 1, spec)))
    out = merged(spread.groupBy(*keys, INDEX), aggs, [*keys, INDEX], F.max("__last").alias("__last"))
    return out.select(*keys, INDEX, *aggs, F.col(f"__last.{TS}").alias(TS), F.col(f"__last.{SEQ}").alias(SEQ), F.lit(None).cast("long").alias(WM))


def count_aggregate(df: DataFrame, spec: WindowSpec, aggs: dict[str, Agg | Column], keys: list[str] = ()) -> DataFrame:
    """One row per count window; its event time is that of its last row. Overlapping windows over mergeable aggregates share slices of gcd(size, advance) rows."""
    keys = list(keys)
    if spec.advance < spec.size and all(isinstance(a, Agg) for a in aggs.values()):
        return _count_slices(df, spec, aggs, keys)
    out = assign_count(df, spec, keys).groupBy(*keys, INDEX).agg(*[as_column(a).alias(n) for n, a in aggs.items()], F.max_by(TS, SEQ).alias(TS), F.max(SEQ).alias(SEQ))
    return out.select(*keys, INDEX, *aggs, TS, SEQ, F.lit(None).cast("long").alias(WM))


def apply_function(df: DataFrame, spec: WindowSpec, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = (), late: bool = False) -> DataFrame:
    """An opaque function of each window's rows, in time order (ties: latest arrival first) or arrival order. It returns one row; ``__ts`` is optional."""
    keys = list(keys)
    timed = spec.kind == "time"
    rows = assign_time(df, spec, late) if timed else assign_count(df, spec, keys)
    at = END if timed else INDEX
    by, up = ([TS, SEQ], [True, False]) if timed else ([SEQ], [True])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(by, ascending=up, kind="stable")
        out = func(part).copy()
        for k in [*keys, at]:
            out[k] = part[k].iloc[0]
        if TS not in out:
            out[TS] = part[at].iloc[0] if timed else part[TS].iloc[-1]
        out[SEQ] = part[at].iloc[0] if timed else part[SEQ].max()
        return out

    key_fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    fields = ", ".join([*key_fields, f"{at} long", schema, f"{TS} long", f"{SEQ} long"])
    return rows.groupBy(*keys, at).applyInPandas(run, fields).withColumn(WM, F.lit(None).cast("long"))


def session_aggregate(df: DataFrame, gap: int, aggs: dict[str, Agg | Column], keys: list[str]) -> DataFrame:
    """Sessions per key: rows less than ``gap`` ticks apart; the window ends ``gap`` after the last row. (An extension.)"""
    rows = blocked(df, keys, TS, SEQ)
    inside = Window.partitionBy("__key", "__block").orderBy("__place")
    rows = rows.withColumn("__fresh", F.when(F.col(TS) - F.lag(TS).over(inside) >= gap, 1).otherwise(0))
    rows = rows.withColumn("__inside", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("__key", "__block").agg(F.min(TS).alias("__low"), F.max(TS).alias("__top"), F.max("__inside").alias("__more"))
    along = Window.partitionBy("__key").orderBy("__block")
    blocks = blocks.withColumn("__new", F.when(F.col("__low") - F.lag("__top").over(along) < gap, 0).otherwise(1))
    upto = F.sum(F.col("__new") + F.col("__more")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(blocks.select("__key", "__block", (upto - F.col("__more")).alias("__before")), ["__key", "__block"])
    rows = rows.withColumn("__session", F.col("__before") + F.col("__inside"))
    out = rows.groupBy(*keys, "__session").agg(*[as_column(a).alias(n) for n, a in aggs.items()], F.min(TS).alias("window_start"), (F.max(TS) + gap).alias(END))
    return out.select(*keys, "window_start", END, *aggs, F.col(END).alias(TS), F.col(END).alias(SEQ), F.lit(None).cast("long").alias(WM))


def _so_far(df: DataFrame, aggs: dict[str, Agg], keys: list[str], order: str, then: str | None = None) -> DataFrame:
    """``df`` with the aggregates over each row and those of its key before it: run inside blocks, on top of what the blocks before hold. ``then`` names a column for the next row's ``order``."""
    rows = blocked(df, keys, order)
    names = {n: a.names(n) for n, a in aggs.items()}
    along = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__key", "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = partial(rows.groupBy("__key", "__block"), aggs, F.min(order).alias("__low"))
    coming = F.lead("__low").over(Window.partitionBy("__key").orderBy("__block")).alias("__coming")
    blocks = blocks.select("__key", "__block", *([coming] if then else []), *[c.over(along).alias(f"{p}_before") for n, a in aggs.items() for p, c in zip(names[n], a.merged(names[n]), strict=True)])
    rows = rows.select("*", *[c.over(inside).alias(p) for n, a in aggs.items() for p, c in zip(names[n], a.partials(), strict=True)])
    types = {f.name: f.dataType for f in rows.schema.fields}
    if then:
        rows = rows.withColumn(then, F.lead(order).over(Window.partitionBy("__key", "__block").orderBy("__place")))
    rows = rows.join(blocks, ["__key", "__block"])
    if then:
        rows = rows.withColumn(then, F.coalesce(then, "__coming"))
    for n, a in aggs.items():
        both = a.joined([F.col(f"{p}_before") for p in names[n]], [F.col(p) for p in names[n]])
        rows = rows.withColumns({p: c.cast(types[p]) for p, c in zip(names[n], both, strict=True)})
    rows = rows.withColumns({n: a.final(names[n]) for n, a in aggs.items()})
    made = [p for ps in names.values() for p in ps]
    return rows.drop("__key", "__block", "__place", "__coming", *made, *[f"{p}_before" for p in made])


def rolling(df: DataFrame, aggs: dict[str, Agg | Column], keys: list[str]) -> DataFrame:
    """The running aggregate per key after each row, in arrival order. (An extension.)

    Mergeable aggregates run in blocks of rows, so a hot key is split; others need all rows of a key in one task.
    """
    if all(isinstance(a, Agg) for a in aggs.values()):
        return _so_far(df, aggs, keys, SEQ)
    place = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: as_column(a).over(place) for n, a in aggs.items()})


def triggered(df: DataFrame, spec: WindowSpec, aggs: dict[str, Agg], keys: list[str], every: int, purge: bool, retract: bool, late: bool = False, allowed: int | None = None) -> DataFrame:
    """A time window's results as they are updated: after every ``every`` of its rows in arrival order, and at its end for the rest.

    A firing keeps the window's state (each result covers all rows so far) or, with ``purge``, clears it (each covers the rows
    since the last). ``firing`` counts from 0; ``every=1`` emits on each update. With ``retract`` each result that replaces
    another comes with that one again, ``change`` -1 instead of 1. With ``allowed`` a window fires at its end (``firing`` 0) and
    then after every ``every`` rows that come late, up to ``allowed`` ticks behind the watermark, and for the rest of them. Rows are numbered and firings run through in blocks, so a large window is split.
    """
    nth = F.floor((F.col("__rn") - 1) / every).cast("long")
    if allowed is None:
        rows = _numbered(assign_time(df, spec, late), [*keys, END]).withColumn("firing", nth)
    else:
        rows = assign_time(df.withColumn("__met", in_force(df)), spec, False).filter(F.col("__met").isNull() | (F.col(END) + allowed > F.col("__met")))
        rows = _numbered(rows.withColumn("__late", F.coalesce(F.col(END) <= F.col("__met"), F.lit(False))), [*keys, END, "__late"])
        rows = rows.withColumn("firing", F.when(F.col("__late"), nth + 1).otherwise(0))
    parts = partial(rows.groupBy(*keys, END, "firing"), aggs, F.max(SEQ).alias(SEQ))
    if not purge:
        parts = _so_far(parts, {p: step for n, a in aggs.items() for p, step in a.again(a.names(n)).items()}, [*keys, END], "firing")
    names = list(aggs)
    out = parts.select(*keys, END, "firing", SEQ, *[a.final(a.names(n)).alias(n) for n, a in aggs.items()])
    if retract:
        out = out.withColumn("__window", F.struct(*keys, END))
        replaced = out.select("__window", (F.col("firing") + 1).alias("firing"), *names)
        before = out.drop(*names).join(replaced, ["__window", "firing"])
        out = out.withColumn("change", F.lit(1)).unionByName(before.withColumn("change", F.lit(-1)))
        names = [*names, "change"]
    start = F.greatest(F.col(END) - spec.size, F.lit(0).cast("long")).alias("window_start")
    return out.select(*keys, start, END, "firing", *names, F.col(END).alias(TS), SEQ, F.lit(None).cast("long").alias(WM))
