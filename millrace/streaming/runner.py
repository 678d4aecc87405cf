"""Unbounded runs: a graph as Structured Streaming queries.

Sources are streaming DataFrames with ``__ts`` in microseconds. Time windows and both joins run on Spark's
state store under a watermark; count windows keep their open rows as the state of one group per
key. Differences from bounded runs: a window is emitted when the watermark passes its end, so the
last ones stay open until later rows (or ``far_future``, a row to send last) arrive; Spark drops rows behind
the watermark one batch later than the bounded form, so a stream's windows hold at least its rows.
Spark's first watermark is 1970, so joins take no rows at tick 0.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import basic
from millrace.operators.aggregates import Agg, as_column
from millrace.operators.joins import key_column, made_columns
from millrace.operators.rows import SEQ, TS, WM
from millrace.plans.batch import dealt
from millrace.plans.graph import DataflowGraph, Node
from millrace.plans.window_spec import WindowSpec

EVENT_TIME = "__event_time"
#: Ticks of a row that closes every window before it: the year 2200.
FAR_FUTURE = 7_258_118_400_000_000


def stream_source(df: DataFrame, ts: str | Column, seq: str | Column, lateness: int = 0) -> DataFrame:
    """A streaming DataFrame with event time, arrival order and a watermark that trails by ``lateness`` microseconds."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.withColumns({TS: column(ts).cast("long"), SEQ: column(seq).cast("long"), WM: F.lit(None).cast("long")})
    return rows.withColumn(EVENT_TIME, F.timestamp_micros(TS)).withWatermark(EVENT_TIME, f"{lateness} microseconds")


def _window(spec: WindowSpec) -> Column:
    """Spark's window whose ends are multiples of the advance; with gaps, the tumbling window of the advance."""
    if spec.advance > spec.size:
        return F.window(EVENT_TIME, f"{spec.advance} microseconds")
    offset = (-spec.size) % spec.advance
    return F.window(EVENT_TIME, f"{spec.size} microseconds", f"{spec.advance} microseconds", f"{offset} microseconds")


def time_aggregate(df: DataFrame, spec: WindowSpec, aggs: dict, keys: list[str] = ()) -> DataFrame:
    if spec.advance > spec.size:
        # on the event time, so that the filter stays above the watermark and rows in gaps still advance it
        df = df.filter(F.unix_micros(EVENT_TIME) % spec.advance >= spec.advance - spec.size)
    out = df.groupBy(*keys, _window(spec).alias("w")).agg(*[as_column(a).alias(n) for n, a in aggs.items()])
    end = F.unix_micros(F.col("w.end"))
    start = F.greatest(end - spec.size, F.lit(0).cast("long")).alias("window_start")
    return out.select(*keys, start, end.alias("window_end"), *aggs, end.alias(TS), end.alias(SEQ), F.lit(None).cast("long").alias(WM), F.window_time("w").alias(EVENT_TIME))


def session_aggregate(df: DataFrame, gap: int, aggs: dict, keys: list[str] = ()) -> DataFrame:
    """Sessions on the state store, merged as rows fill their gaps; emitted when the watermark passes their end."""
    out = df.groupBy(*keys, F.session_window(EVENT_TIME, f"{gap} microseconds").alias("w")).agg(*[as_column(a).alias(n) for n, a in aggs.items()])
    end = F.unix_micros(F.col("w.end"))
    return out.select(*keys, F.unix_micros(F.col("w.start")).alias("window_start"), end.alias("window_end"), *aggs, end.alias(TS), end.alias(SEQ), F.lit(None).cast("long").alias(WM), F.expr("w.end - INTERVAL '0.000001' SECOND").alias(EVENT_TIME))


def count_windows(df: DataFrame, spec: WindowSpec, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = ()) -> DataFrame:
    """``func`` of each full window's rows in arrival order. The state is the open rows (fewer than ``size``) and the windows so far."""
    step, names = min(spec.advance, spec.size), [c for c in df.columns if c != EVENT_TIME]
    key_fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def work(key, parts, state):
        held, index = (pd.DataFrame({n: list(v) for n, v in zip(names, state.get[:-1], strict=True)}), state.get[-1]) if state.exists else (None, 0)
        rows = pd.concat([x for x in [held, *(p[names] for p in parts)] if x is not None and len(x)], ignore_index=True)
        fresh = rows if held is None or not len(held) else rows.iloc[len(held) :]
        rows = pd.concat([rows.iloc[: len(rows) - len(fresh)], fresh.sort_values(SEQ)], ignore_index=True)
        made = []
        while len(rows) >= spec.size:
            out = func(rows.iloc[: spec.size]).copy()
            for k, v in zip(keys, key, strict=False):
                out[k] = v
            out["window_index"] = index
            made.append(out)
            index, rows = index + 1, rows.iloc[step:]
        state.update((*[rows[n].tolist() for n in names], index))
        if made:
            yield pd.concat(made, ignore_index=True)

    state = ", ".join(f"s_{i} array<{df.schema[n].dataType.simpleString()}>" for i, n in enumerate(names)) + ", made long"
    rows = df.select(*names) if keys else df.select(*names, F.lit(0).alias("__all"))
    group = rows.groupBy(*(keys or ["__all"]))
    return group.applyInPandasWithState(work, f"{key_fields}window_index long, {schema}", state, "append", "NoTimeout")


def time_apply(df: DataFrame, spec: WindowSpec, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = ()) -> DataFrame:
    """``func`` of all rows of each closed window, in time order (ties: latest arrival first). The state holds the rows."""
    if spec.advance > spec.size:
        df = df.filter(F.unix_micros(EVENT_TIME) % spec.advance >= spec.advance - spec.size)
    names = [c for c in df.columns if c != EVENT_TIME]
    held = df.groupBy(*keys, _window(spec).alias("w")).agg(F.collect_list(F.struct(*names)).alias("rows"))
    held = held.select(*keys, F.unix_micros(F.col("w.end")).alias("window_end"), "rows", F.window_time("w").alias(EVENT_TIME))
    key_fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = pd.DataFrame([dict(zip(names, x, strict=True)) if isinstance(x, tuple) else dict(x) for x in r.rows])
                out = func(rows.sort_values([TS, SEQ], ascending=[True, False], kind="stable")).copy()
                for k in keys:
                    out[k] = getattr(r, k)
                out["window_end"] = r.window_end
                yield out

    out = held.drop(EVENT_TIME).mapInPandas(run, f"{key_fields}window_end long, {schema}")
    return out.withColumns({TS: F.col("window_end"), SEQ: F.col("window_end"), WM: F.lit(None).cast("long")})


def _over_rows(aggs: dict) -> tuple[Callable[[pd.DataFrame], pd.DataFrame], str]:
    """Named aggregates of whole-number columns as a function of a window's rows, for count windows."""
    for n, a in aggs.items():
        if not isinstance(a, Agg) or not isinstance(a.column, str):
            raise ValueError(f"{n}: a streaming count window takes named aggregates of columns, or a function")
    how = {"sum": "sum", "count": "count", "min": "min", "max": "max", "avg": "mean"}
    func = lambda p: pd.DataFrame({n: [p[a.column].agg(how[a.kind])] for n, a in aggs.items()} | {TS: [p[TS].iloc[-1]], SEQ: [p[SEQ].max()]})
    fields = ", ".join(f"{n} {'double' if a.kind == 'avg' else 'long'}" for n, a in aggs.items())
    return func, f"{fields}, {TS} long, {SEQ} long"


def _window_node(df: DataFrame, p: dict) -> DataFrame:
    spec = p.get("spec")
    if "updates" in p:
        raise ValueError("updates run bounded only; a streaming sink in update mode emits each changed window")
    if spec is None:
        return session_aggregate(df, p["gap"], p["aggs"], p["keys"])
    if spec.kind == "time":
        return time_aggregate(df, spec, p["aggs"], p["keys"]) if "aggs" in p else time_apply(df, spec, p["func"], p["schema"], p["keys"])
    func, schema = _over_rows(p["aggs"]) if "aggs" in p else (p["func"], p["schema"])
    return count_windows(df, spec, func, schema, p["keys"])


def _pairs(left: DataFrame, right: DataFrame, node: Node) -> DataFrame:
    names = [[c for c in df.columns if c != EVENT_TIME] for df in (left, right)]
    a, b = (df.withColumn("__key", key_column(k, n)) for df, k, n in zip((left, right), node.params["keys"], names, strict=True))
    a, b = a.withColumnRenamed(EVENT_TIME, "__lt"), b.withColumnRenamed(EVENT_TIME, "__rt")
    if node.kind == "IntervalJoin":
        lower, upper = node.params["bounds"]
        low, high = (F.col("l.__lt") + F.expr(f"make_dt_interval(0, 0, 0, {x / 1e6:.6f})") for x in (lower, upper))
        on = (F.col("l.__key") == F.col("r.__key")) & F.col("r.__rt").between(low, high)
        pairs = a.alias("l").join(b.alias("r"), on)
    else:
        spec = node.params["spec"]
        at = lambda df, c: df.withColumnRenamed(c, EVENT_TIME).withColumn("w", _window(spec)).withColumnRenamed(EVENT_TIME, c)
        a, b = at(a, "__lt").alias("l"), at(b, "__rt").alias("r")
        pairs = a.join(b, (F.col("l.__key") == F.col("r.__key")) & (F.col("l.w") == F.col("r.w")))
    ts = node.params["ts"]
    ts = ts.cast("long") if ts is not None else F.greatest(F.col(f"l.{TS}"), F.col(f"r.{TS}"))
    seq = F.greatest(F.col(f"l.{SEQ}"), F.col(f"r.{SEQ}"))
    pairs, columns = made_columns(pairs, node.params["made"], *names)
    return pairs.select(*[c.alias(n) for n, c in columns.items()], ts.alias(TS), seq.alias(SEQ), F.lit(None).cast("long").alias(WM))


def compile_stream(graph: DataflowGraph, sources: dict[str, DataFrame]) -> dict[int, DataFrame]:
    """Streaming DataFrames by operator; ``sources`` holds those of the sources by name, made by ``stream_source``."""
    made: dict[int, DataFrame] = {}
    for i in graph.topological_order():
        node, inputs = graph.op(i), [made[s] for s in graph.sources_of(i)]
        if node.kind == "Source":
            made[i] = sources[node.name]
        elif node.kind in ("IntervalJoin", "WindowJoin"):
            made[i] = _pairs(*inputs, node)
        elif node.kind == "Window":
            made[i] = _window_node(inputs[0], node.params)
        else:
            out = node.build(node.params, [inputs[0]])
            if EVENT_TIME not in out.columns and EVENT_TIME in inputs[0].columns:
                out = out.withColumn(EVENT_TIME, F.timestamp_micros(TS))
            made[i] = out
        made[i] = dealt(made[i], node)
    return made


class StreamEngine:
    """Runs the leaves of several graphs as queries until they are done or cancelled."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.checkpoint = spark, checkpoint
        self._plans: list[tuple[str, DataFrame, Callable[[DataFrame, int], None], str]] = []
        self._running: list[StreamingQuery] = []
        self._lock = threading.Lock()

    def submit(self, name: str, df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
        """``sink(batch, batch_id)`` gets each micro-batch; batches repeat after a failure, so it must be idempotent by id.

        Mode ``update`` hands on each window whenever it changed (emit on update) instead of once, when it closed.
        """
        self._plans.append((name, df, sink, mode))

    def execute(self, available_now: bool = True) -> None:
        """Starts all queries, then waits for them."""
        with self._lock:
            for name, df, sink, mode in self._plans:
                writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{self.checkpoint}/{name}").foreachBatch(sink)
                self._running.append((writer.trigger(availableNow=True) if available_now else writer).start())
            self._plans = []
        for q in self._running:
            q.awaitTermination()

    def cancel(self) -> None:
        with self._lock:
            for q in self._running:
                q.stop()


__all__ = ["FAR_FUTURE", "StreamEngine", "basic", "compile_stream", "count_windows", "stream_source", "time_aggregate"]
