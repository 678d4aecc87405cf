"""The engine's own queries over the test tables, each with its DuckDB oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import metadata, strict
from millrace.operators import watermark
from millrace.operators.aggregates import avg_of, count_of, max_of, min_of, sum_of
from millrace.operators.ordering import shared_folder
from millrace.operators.rows import as_stream, micros, payload
from millrace.plans.batch import result, results
from millrace.plans.stream import GraphBuilder, Stream
from millrace.plans.window_spec import WindowSpec, count_tumbling_window, count_window, time_tumbling_window, time_window
from millrace.sources.tables import events, from_records, generator_source, table
from millrace.streaming.runner import EVENT_TIME, FAR_FUTURE, StreamEngine, compile_stream, stream_source

HOUR = 3_600_000_000
DAY = 24 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The events as the oracle reads them.
EV = "ev AS (SELECT event_id, epoch_us(ts)::BIGINT AS tick, user_id, event_type, cast(round(value * 100) AS BIGINT) AS cents FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str, **options) -> Stream:
    return GraphBuilder().source(lambda: events(spark, sf_dir), "tick", "event_id", **options)


def _rows(stream: Stream) -> DataFrame:
    out = result(stream.build())
    return out.select(*payload(out))


def _both(builder: GraphBuilder, spark: SparkSession, sf_dir: str) -> tuple[Stream, Stream]:
    """Clicks and purchases as two streams."""
    clicks = builder.source(lambda: events(spark, sf_dir), "tick", "event_id", name="clicks").filter(F.col("event_type") == "click")
    return clicks, builder.source(lambda: events(spark, sf_dir), "tick", "event_id", name="purchases").filter(F.col("event_type") == "purchase")


@query("SELECT * FROM (VALUES (30::BIGINT, 5::BIGINT), (80, 10), (130, 15)) AS v(total, last_ts)")
def q_demo(spark, sf_dir):
    """Fifteen records, doubled, in count windows of five."""
    rows = from_records(spark, "value int", [(i,) for i in range(1, 16)])
    s = GraphBuilder().source(rows, "value", "value").map(value=strict.multiply(F.col("value"), F.lit(2), "i32"))
    out = result(s.window(count_tumbling_window(5)).reduce(total=sum_of("value")).sink().build())
    return out.select("total", F.col("__ts").alias("last_ts"))


@query(f"WITH {EV} SELECT event_id, cents * 2 AS doubled, event_type FROM ev WHERE event_type <> 'view' AND cents > 1000")
def q_map_filter(spark, sf_dir):
    s = _events(spark, sf_dir).filter((F.col("event_type") != "view") & (F.col("cents") > 1000))
    return _rows(s.map(event_id=F.col("event_id"), doubled=F.col("cents") * 2, event_type=F.col("event_type")).sink())


@query(f"WITH {EV} SELECT event_id, cents % 7 AS rest FROM ev WHERE cents % 2 = 0")
def q_map_udf(spark, sf_dir):
    """Opaque functions over Arrow batches."""
    s = _events(spark, sf_dir).filter(lambda p: p["cents"] % 2 == 0)
    return _rows(s.map(lambda p: pd.DataFrame({"event_id": p["event_id"], "rest": p["cents"] % 7}), "event_id long, rest long").sink())


def _time_sql(size: int, advance: int, aggs: str = "count(*) AS n, sum(cents)::BIGINT AS total", keys: str = "", where: str = "TRUE") -> str:
    k = f"{keys}, " if keys else ""
    return f"""WITH {EV}, w AS (SELECT *, unnest(generate_series((tick // {advance} + 1) * {advance}, (tick + {size}) // {advance} * {advance}, {advance})) AS window_end FROM ev)
    SELECT {k}greatest(window_end - {size}, 0)::BIGINT AS window_start, window_end::BIGINT AS window_end, {aggs} FROM w WHERE {where} GROUP BY {k}window_end"""


@query(_time_sql(DAY, DAY))
def q_time_tumbling_day(spark, sf_dir):
    return _rows(_events(spark, sf_dir).window(time_tumbling_window(DAY)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(_time_sql(7 * DAY, DAY, "count(*) AS n, sum(cents)::BIGINT AS total, min(cents) AS least, max(cents) AS most"))
def q_time_sliding_7d_1d(spark, sf_dir):
    """Sliding windows over shared slices."""
    return _rows(_events(spark, sf_dir).window(time_window(7 * DAY, DAY)).aggregate(n=count_of(), total=sum_of("cents"), least=min_of("cents"), most=max_of("cents")).sink())


@query(_time_sql(5 * HOUR, 2 * HOUR))
def q_time_sliding_5h_2h(spark, sf_dir):
    """The advance doesn't divide the size."""
    return _rows(_events(spark, sf_dir).window(time_window(5 * HOUR, 2 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(_time_sql(30 * DAY, 6 * HOUR, "count(*) AS n, sum(cents)::BIGINT AS total", keys="event_type"))
def q_time_sliding_30d_6h(spark, sf_dir):
    """Windows that overlap 120 times: rows are added and, when they leave, subtracted."""
    return _rows(_events(spark, sf_dir).key_by("event_type").window(time_window(30 * DAY, 6 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(_time_sql(HOUR, 3 * HOUR))
def q_time_gap_1h_3h(spark, sf_dir):
    """Windows with gaps between them."""
    return _rows(_events(spark, sf_dir).window(time_window(HOUR, 3 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(_time_sql(DAY, DAY, "cast(round(avg(cents) * 1000) AS BIGINT) AS mean_milli, median(cents)::DOUBLE AS middle"))
def q_window_holistic(spark, sf_dir):
    """Aggregates that need all rows of a window."""
    s = _events(spark, sf_dir).window(time_tumbling_window(DAY)).reduce(mean_milli=F.round(F.avg("cents") * 1000).cast("long"), middle=F.median("cents"))
    return _rows(s.sink())


def _count_sql(size: int, advance: int, aggs: str = "count(*) AS n, sum(cents)::BIGINT AS total, max(event_id) AS last_id") -> str:
    step = min(size, advance)
    return f"""WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS c FROM ev),
    m AS (SELECT *, CASE WHEN c >= {size} THEN (c - {size}) // {step} + 1 ELSE 0 END AS m FROM r),
    w AS (SELECT *, unnest(generate_series(greatest(0, (rn - {size} + {step} - 1) // {step}), least(m, (rn - 1) // {step}))) AS window_index FROM m)
    SELECT window_index::BIGINT AS window_index, {aggs} FROM w GROUP BY window_index"""


@query(_count_sql(100, 100))
def q_count_tumbling(spark, sf_dir):
    return _rows(_events(spark, sf_dir).window(count_tumbling_window(100)).reduce(n=count_of(), total=sum_of("cents"), last_id=max_of("event_id")).sink())


@query(_count_sql(100, 40))
def q_count_sliding_100_40(spark, sf_dir):
    return _rows(_events(spark, sf_dir).window(count_window(100, 40)).reduce(n=count_of(), total=sum_of("cents"), last_id=max_of("event_id")).sink())


@query(_count_sql(70, 300))
def q_count_wide_advance(spark, sf_dir):
    """An advance beyond the size: as tumbling, nothing is skipped."""
    return _rows(_events(spark, sf_dir).window(count_window(70, 300)).reduce(n=count_of(), total=sum_of("cents"), last_id=max_of("event_id")).sink())


#: Arrival in another order than event time: ids are dealt anew by a multiplication.
_SHUFFLED = "(event_id * 7919) % 10007 + event_id // 10007 * 10007"
_WM = f"""WITH {EV}, s AS (SELECT *, row_number() OVER (ORDER BY event_id // 500, {_SHUFFLED}, event_id) - 1 AS i FROM ev),
    b AS (SELECT i // 100 AS b, max(tick) AS top, count(*) AS c FROM s GROUP BY 1),
    k AS (SELECT b, c, top, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR} AS wm FROM b)"""


def _disordered(spark, sf_dir):
    """The events in another arrival order: within each 500 by a hash of the id."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    mixed = (i * 7919) % 10007 + F.floor(i / 10007) * 10007
    return e.withColumn("arrival", F.floor(i / 500) * 100_000_000_000_000 + mixed * 1000 + i % 1000)


@query(f"""{_WM}, w AS (SELECT cents, tick // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} AS e, wm FROM s JOIN k ON s.i // 100 = k.b)
    SELECT greatest(e - {6 * HOUR}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, count(*) AS n, sum(cents)::BIGINT AS total FROM w WHERE wm IS NULL OR e > wm GROUP BY e""")
def q_late_interval100(spark, sf_dir):
    """Late rows: a window that has fired takes no more."""
    s = GraphBuilder().source(lambda: _disordered(spark, sf_dir), "tick", "arrival").with_watermark(HOUR)
    return _rows(s.window(time_tumbling_window(6 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(f"""{_WM}, a AS (SELECT b * 100 + c AS n_rows, max(top) OVER (ORDER BY b) - {HOUR} AS watermark FROM k),
    n AS (SELECT *, lag(watermark) OVER (ORDER BY n_rows) AS before FROM a WHERE watermark >= 0)
    SELECT n_rows::BIGINT AS n_rows, watermark FROM n WHERE before IS NULL OR watermark > before""")
def q_watermarks(spark, sf_dir):
    """The watermarks that a source emits."""
    return watermark.emitted(as_stream(_disordered(spark, sf_dir), "tick", "arrival"), HOUR, 100).select(F.col("at").alias("n_rows"), "watermark")


@query(f"""{_WM}, x AS (SELECT s.*, i, wm FROM s JOIN k ON s.i // 100 = k.b),
    p AS (SELECT greatest(l.tick, r.tick) AS t, greatest(l.i, r.i) AS place, CASE WHEN l.wm IS NOT NULL AND r.wm IS NOT NULL THEN least(l.wm, r.wm) END AS wm
          FROM x l JOIN x r ON l.user_id = r.user_id AND r.tick BETWEEN l.tick - {HOUR} AND l.tick + {6 * HOUR} WHERE l.event_type = 'click' AND r.event_type = 'purchase'),
    h AS (SELECT wm AS head FROM p ORDER BY place, wm NULLS FIRST LIMIT 1),
    w AS (SELECT t // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} AS e, CASE WHEN head IS NULL OR wm > head THEN wm END AS wm FROM p, h)
    SELECT greatest(e - {6 * HOUR}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, count(*) AS n FROM w WHERE wm IS NULL OR e > wm GROUP BY e""")
def q_join_watermark(spark, sf_dir):
    """A window over a join: the least watermark of both inputs decides which pairs are late."""
    b = GraphBuilder()
    side = lambda kind: b.source(lambda: _disordered(spark, sf_dir), "tick", "arrival", name=kind).with_watermark(HOUR).filter(F.col("event_type") == kind)
    user = F.col("user_id")
    s = side("click").interval_join(side("purchase"), user, user, -HOUR, 6 * HOUR, user_id=F.col("l.user_id"))
    return _rows(s.window(time_tumbling_window(6 * HOUR)).reduce(n=count_of()).sink())


@query(f"""{_WM}, x AS (SELECT cents, wm, unnest(generate_series((tick // {2 * HOUR} + 1) * {2 * HOUR}, (tick + {6 * HOUR}) // {2 * HOUR} * {2 * HOUR}, {2 * HOUR})) AS e FROM s JOIN k ON s.i // 100 = k.b)
    SELECT greatest(e - {6 * HOUR}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, count(*) AS n, sum(cents)::BIGINT AS total FROM x WHERE wm IS NULL OR e > wm GROUP BY e""")
def q_late_sliding(spark, sf_dir):
    """Late rows in sliding windows, by slices per watermark."""
    s = GraphBuilder().source(lambda: _disordered(spark, sf_dir), "tick", "arrival").with_watermark(HOUR)
    return _rows(s.window(time_window(6 * HOUR, 2 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink())


def _updates_sql(every: int, last: str) -> str:
    return f"""WITH {EV}, r AS (SELECT *, tick // {DAY} * {DAY} + {DAY} AS e FROM ev), f AS (SELECT *, (row_number() OVER (PARTITION BY e ORDER BY event_id) - 1) // {every} AS firing FROM r),
    g AS (SELECT e, firing, count(*) AS n, sum(cents)::BIGINT AS total, max(cents) AS most FROM f GROUP BY e, firing),
    c AS (SELECT greatest(e - {DAY}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, firing::BIGINT AS firing, (sum(n) OVER w)::BIGINT AS n, (sum(total) OVER w)::BIGINT AS total, max(most) OVER w AS most FROM g WINDOW w AS (PARTITION BY e ORDER BY firing))
    {last}"""


@query(_updates_sql(50, "SELECT * FROM c"))
def q_trigger_fire(spark, sf_dir):
    """A count trigger that keeps the window's state: results so far after every 50 rows and at the end."""
    return _rows(_events(spark, sf_dir).window(time_tumbling_window(DAY)).updates(50, n=count_of(), total=sum_of("cents"), most=max_of("cents")).sink())


@query(_updates_sql(50, f"SELECT greatest(e - {DAY}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, firing::BIGINT AS firing, n, total, most FROM g"))
def q_trigger_purge(spark, sf_dir):
    """A count trigger that clears the window's state when it fires."""
    return _rows(_events(spark, sf_dir).window(time_tumbling_window(DAY)).updates(50, purge=True, n=count_of(), total=sum_of("cents"), most=max_of("cents")).sink())


@query(_updates_sql(1, """SELECT *, 1 AS change FROM c UNION ALL SELECT * FROM (SELECT window_start, window_end, firing, lag(n) OVER w AS n, lag(total) OVER w AS total, lag(most) OVER w AS most, -1 AS change
    FROM c WINDOW w AS (PARTITION BY window_end ORDER BY firing)) WHERE firing > 0"""))
def q_emit_on_update(spark, sf_dir):
    """Each row's window result at once, with the result that it replaces taken back."""
    return _rows(_events(spark, sf_dir).window(time_tumbling_window(DAY)).updates(retract=True, n=count_of(), total=sum_of("cents"), most=max_of("cents")).sink())


@query(f"""{_WM}, w AS (SELECT i, cents, tick // {6 * HOUR} * {6 * HOUR} + {6 * HOUR} AS e, wm FROM s JOIN k ON s.i // 100 = k.b),
    v AS (SELECT *, coalesce(e <= wm, false) AS late FROM w WHERE wm IS NULL OR e + {DAY} > wm),
    f AS (SELECT *, CASE WHEN late THEN (row_number() OVER (PARTITION BY e, late ORDER BY i) - 1) // 3 + 1 ELSE 0 END AS firing FROM v),
    g AS (SELECT e, firing, count(*) AS n, sum(cents) AS total FROM f GROUP BY e, firing)
    SELECT greatest(e - {6 * HOUR}, 0)::BIGINT AS window_start, e::BIGINT AS window_end, firing::BIGINT AS firing, (sum(n) OVER o)::BIGINT AS n, (sum(total) OVER o)::BIGINT AS total FROM g WINDOW o AS (PARTITION BY e ORDER BY firing)""")
def q_late_updates(spark, sf_dir):
    """A window's result at its end, and again after every third row that comes up to a day late."""
    s = GraphBuilder().source(lambda: _disordered(spark, sf_dir), "tick", "arrival").with_watermark(HOUR)
    return _rows(s.window(time_tumbling_window(6 * HOUR)).updates(3, allowed=DAY, n=count_of(), total=sum_of("cents")).sink())


@query(f"""WITH {EV}, l AS (SELECT *, tick // {DAY} AS d FROM ev WHERE event_type = 'click'), r AS (SELECT *, tick // {DAY} AS d FROM ev WHERE event_type = 'purchase')
    SELECT l.user_id, l.event_id AS click_id, r.event_id AS purchase_id, ((l.d + 1) * {DAY})::BIGINT AS window_end FROM l JOIN r ON l.user_id = r.user_id AND l.d = r.d""")
def q_window_join(spark, sf_dir):
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    user = F.col("user_id")
    s = clicks.window_join(buys, user, user, time_tumbling_window(DAY), user_id=F.col("l.user_id"), click_id=F.col("l.event_id"), purchase_id=F.col("r.event_id"), window_end=F.col("l.window_end"))
    return _rows(s.sink())


@query(f"""WITH {EV}, x AS (SELECT *, unnest(generate_series((tick // {6 * HOUR} + 1) * {6 * HOUR}, (tick + {12 * HOUR}) // {6 * HOUR} * {6 * HOUR}, {6 * HOUR})) AS e FROM ev)
    SELECT l.event_id AS click_id, r.event_id AS purchase_id, l.e::BIGINT AS window_end FROM x l JOIN x r ON l.user_id = r.user_id AND l.e = r.e WHERE l.event_type = 'click' AND r.event_type = 'purchase'""")
def q_window_join_sliding(spark, sf_dir):
    """A pair once per window that both share."""
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    user = F.col("user_id")
    s = clicks.window_join(buys, user, user, time_window(12 * HOUR, 6 * HOUR), click_id=F.col("l.event_id"), purchase_id=F.col("r.event_id"), window_end=F.col("l.window_end"))
    return _rows(s.sink())


@query(f"""WITH {EV} SELECT l.event_id AS click_id, r.event_id AS purchase_id, r.tick - l.tick AS gap FROM ev l JOIN ev r
    ON l.user_id = r.user_id AND r.tick BETWEEN l.tick - {HOUR} AND l.tick + {6 * HOUR} WHERE l.event_type = 'click' AND r.event_type = 'purchase'""")
def q_interval_join(spark, sf_dir):
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    user = F.col("user_id")
    s = clicks.interval_join(buys, user, user, -HOUR, 6 * HOUR, click_id=F.col("l.event_id"), purchase_id=F.col("r.event_id"), gap=F.col("r.__ts") - F.col("l.__ts"))
    return _rows(s.sink())


@query(SQL["q_interval_join"])
def q_join_udf(spark, sf_dir):
    """Opaque key selectors and an opaque join function; the purchases are sent to every task if they are few."""
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    key = lambda rows: rows["user_id"]
    pair = lambda a, b: pd.DataFrame({"click_id": a["event_id"], "purchase_id": b["event_id"], "gap": b["__ts"] - a["__ts"]})
    return _rows(clicks.interval_join(buys.broadcast(), key, key, -HOUR, 6 * HOUR, pair, "click_id long, purchase_id long, gap long").sink())


@query(f"WITH {EV} SELECT event_id, user_id, cents * 3 AS tripled FROM ev WHERE cents % 3 <> 0")
def q_parallelism(spark, sf_dir):
    """Operators that ask for partitions of their own, one of them by key."""
    s = _events(spark, sf_dir).filter(F.col("cents") % 3 != 0).with_parallelism(6)
    s = s.key_by("user_id").map(event_id=F.col("event_id"), user_id=F.col("user_id"), tripled=F.col("cents") * 3).with_parallelism(3)
    return _rows(s.sink())


@query(f"""WITH {EV}, h AS (SELECT tick // {HOUR} * {HOUR} + {HOUR} AS e, sum(cents)::BIGINT AS total FROM ev GROUP BY 1)
    SELECT greatest(e // {DAY} * {DAY}, 0)::BIGINT AS window_start, (e // {DAY} * {DAY} + {DAY})::BIGINT AS window_end, count(*) AS hours, max(total) AS best FROM h GROUP BY e // {DAY}""")
def q_window_chain(spark, sf_dir):
    """Windows over the results of windows."""
    s = _events(spark, sf_dir).window(time_tumbling_window(HOUR)).reduce(total=sum_of("cents"))
    return _rows(s.window(time_tumbling_window(DAY)).reduce(hours=count_of(), best=max_of("total")).sink())


@query(f"""WITH {EV} SELECT a.event_id AS event_id, a.cents + 1 AS up, b.cents - 1 AS down FROM ev a JOIN ev b ON a.event_id = b.event_id WHERE a.cents > 500""")
def q_diamond(spark, sf_dir):
    """Two branches of one source joined again."""
    s = _events(spark, sf_dir)
    up = s.map(event_id=F.col("event_id"), up=F.col("cents") + 1).filter(F.col("up") > 501)
    down = s.map(event_id=F.col("event_id"), down=F.col("cents") - 1)
    return _rows(up.interval_join(down, F.col("event_id"), F.col("event_id"), 0, 0, event_id=F.col("l.event_id"), up=F.col("l.up"), down=F.col("r.down")).sink())


@query(f"""WITH {EV} SELECT 'high' AS branch, count(*) AS n, sum(cents)::BIGINT AS total FROM ev WHERE cents > 5000
    UNION ALL SELECT 'low', count(*), sum(cents)::BIGINT FROM ev WHERE cents <= 5000""")
def q_fanout(spark, sf_dir):
    """One source, two sinks; both run."""
    s = _events(spark, sf_dir)
    s.filter(F.col("cents") > 5000).sink(name="high")
    s.filter(F.col("cents") <= 5000).sink(name="low")
    graph = s.build()
    parts = [df.agg(F.count("*").alias("n"), F.sum("cents").alias("total")).select(F.lit(graph.op(i).name).alias("branch"), "n", "total") for i, df in results(graph).items()]
    return parts[0].union(parts[1])


@query(f"WITH {EV} SELECT event_id, cents FROM ev ORDER BY event_id LIMIT 1234")
def q_run_n(spark, sf_dir):
    """A bounded run pulls the first rows of the source; the limit is the feature."""
    return _rows(_events(spark, sf_dir, limit=1234).map(event_id=F.col("event_id"), cents=F.col("cents")).sink())


@query(f"""WITH {EV} SELECT event_id, ((cents - 5000) % 4294967296 + 4294967296) % 4294967296 AS wrapped, (cents * cents * 1000) % 4294967296 AS product,
    (4294967295 - cents) AS inverted FROM ev""")
def q_u32_wrap(spark, sf_dir):
    a = F.col("cents")
    return events(spark, sf_dir).select("event_id", strict.subtract(a, F.lit(5000), "u32").alias("wrapped"), strict.multiply(strict.multiply(a, a, "u32"), F.lit(1000), "u32").alias("product"), strict.bit_not(a, "u32").alias("inverted"))


@query(f"""WITH {EV} SELECT event_id, ((cents * 18446744073709551557 :: HUGEINT) % 18446744073709551616)::VARCHAR AS product,
    ((cents - 100000 + 18446744073709551616 :: HUGEINT) % 18446744073709551616)::VARCHAR AS wrapped FROM ev""")
def q_u64_wrap(spark, sf_dir):
    a, big = F.col("cents"), F.lit(str((1 << 64) - 59)).cast("decimal(20,0)")
    return events(spark, sf_dir).select("event_id", strict.multiply(a, big, "u64").cast("string").alias("product"), strict.subtract(a, F.lit(100000), "u64").cast("string").alias("wrapped"))


@query(f"""WITH {EV} SELECT event_id, ((cents - 3000) // 7)::INT AS quotient,
    ((cents - 3000) % 7)::INT AS rest, (cents & 255)::INT AS masked, (cents ^ 85)::INT AS mixed, (((cents + 128) % 256) - 128)::TINYINT AS low FROM
    (SELECT event_id, cents, xor(cents, 85) AS x FROM ev)""".replace("(cents ^ 85)", "x"))
def q_i32_ops(spark, sf_dir):
    a = F.col("cents")
    b, seven = strict.subtract(a, F.lit(3000), "i32"), F.lit(7)
    return events(spark, sf_dir).select("event_id", strict.divide(b, seven, "i32").alias("quotient"), strict.remainder(b, seven, "i32").alias("rest"), strict.bit_and(a.cast("int"), F.lit(255)).alias("masked"), strict.bit_xor(a.cast("int"), F.lit(85)).alias("mixed"), strict.truncate_to(a, "i8").alias("low"))


#: Quotients of whole numbers with zeros, as text where they aren't finite, else in millionths.
_QUOTIENT = "(CASE WHEN b <> 0 THEN cast(floor(cast(a AS DOUBLE) / b * 1000000) AS BIGINT)::VARCHAR WHEN a = 0 THEN 'nan' WHEN a > 0 THEN 'inf' ELSE '-inf' END)"


@query(f"WITH {EV}, x AS (SELECT event_id, cents % 5 - 2 AS a, cents % 3 AS b FROM ev) SELECT event_id, {_QUOTIENT} AS quotient, (a <> 0 OR b <> 0) AS same, b <> 0 AND a < b AS less FROM x")
def q_float_ops(spark, sf_dir):
    """Division by zero gives an infinity with its sign, or NaN, which equals nothing and is less than nothing."""
    a, b = F.col("cents") % 5 - 2, F.col("cents") % 3
    d = strict.divide_float(a, b)
    shown = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(F.floor(d * 1_000_000).cast("string"))
    finite = F.when(b != 0, F.col("cents").cast("double")).otherwise(float("nan"))
    less = strict.less_float(a.cast("double"), F.when(F.isnan(finite), finite).otherwise(b.cast("double")))
    return events(spark, sf_dir).select("event_id", shown.alias("quotient"), strict.equal_float(d, d).alias("same"), less.alias("less"))


@query(f"""WITH {EV} SELECT event_id, ((cents << 20) % 4294967296)::BIGINT AS moved_up, (cents >> 3)::BIGINT AS moved_down, ((2000 - cents) >> 2)::INT AS signed_down,
    (cents | 1025)::INT AS joined, (cents - 4000)::INT AS negated, ((4294967296 - cents) % 4294967296)::BIGINT AS negated_u32 FROM ev""")
def q_shift_ops(spark, sf_dir):
    """Shifts of signed and unsigned integers, bitwise or and unary minus."""
    a = F.col("cents")
    negated = strict.negate(strict.subtract(F.lit(4000), a, "i32"), "i32")
    signed = strict.shift_right(strict.subtract(F.lit(2000), a, "i32"), 2, "i32")
    return events(spark, sf_dir).select(
        "event_id", strict.shift_left(a, 20, "u32").cast("long").alias("moved_up"), strict.shift_right(a, 3, "u32").cast("long").alias("moved_down"), signed.alias("signed_down"),
        strict.bit_or(a.cast("int"), F.lit(1025)).alias("joined"), negated.alias("negated"), strict.negate(a, "u32").cast("long").alias("negated_u32"),
    )


@query(f"WITH {EV} SELECT event_id, regexp_replace((cents / 4.0)::DOUBLE::VARCHAR, '[.]0$', '') AS quarter, (cents - 3000)::VARCHAR AS whole FROM ev")
def q_number_text(spark, sf_dir):
    """Numbers as text."""
    a = F.col("cents")
    return events(spark, sf_dir).select("event_id", strict.text(a / 4, "f64").alias("quarter"), strict.text(strict.subtract(a, F.lit(3000), "i32"), "i32").alias("whole"))


@query("SELECT window_index::BIGINT AS window_index, count(*) AS n, sum(i * i)::BIGINT AS total FROM (SELECT i, i // 7 AS window_index FROM range(100) t(i)) GROUP BY window_index")
def q_generator(spark, sf_dir):
    """A source that makes its rows where they are read."""
    spark.dataSource.register(generator_source("millrace_squares", "i long, square long", _squares, 100))
    s = GraphBuilder().source(lambda: spark.read.format("millrace_squares").load(), "i", "i").window(count_tumbling_window(7))
    return _rows(s.reduce(n=count_of(), total=sum_of("square")).sink())


def _squares(lo: int, hi: int):
    for i in range(lo, hi):
        yield i, i * i


@query(_time_sql(DAY, DAY, "sum(cents)::BIGINT AS total, arg_max(event_id, tick) AS last_id"))
def q_reduce_udf(spark, sf_dir):
    """An opaque function of all rows of a window, in time order."""
    func = lambda p: pd.DataFrame({"window_start": [p["tick"].iloc[0] // DAY * DAY], "total": [p["cents"].sum()], "last_id": [p["event_id"].iloc[-1]]})
    return _rows(_events(spark, sf_dir).window(time_tumbling_window(DAY)).reduce(func, "window_start long, total long, last_id long").sink())


@query(_time_sql(DAY, DAY, "count(*) AS n, sum(cents)::BIGINT AS total", keys="event_type"))
def q_keyed_window(spark, sf_dir):
    """Extension: windows per key."""
    return _rows(_events(spark, sf_dir).key_by("event_type").window(time_tumbling_window(DAY)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(f"""WITH {EV}, f AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) < {6 * HOUR} THEN 0 ELSE 1 END AS f FROM ev),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS s FROM f)
    SELECT user_id, min(tick) AS window_start, max(tick) + {6 * HOUR} AS window_end, count(*) AS n, sum(cents)::BIGINT AS total FROM s GROUP BY user_id, s""")
def q_session_window(spark, sf_dir):
    """Extension: sessions per user."""
    return _rows(_events(spark, sf_dir).key_by("user_id").session(6 * HOUR, n=count_of(), total=sum_of("cents")).sink())


@query(f"WITH {EV} SELECT event_id, user_id, (sum(cents) OVER w)::BIGINT AS so_far, max(cents) OVER w AS best FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_rolling_reduce(spark, sf_dir):
    """Extension: the running aggregate per key."""
    s = _events(spark, sf_dir).key_by("user_id").rolling(so_far=sum_of("cents"), best=max_of("cents"))
    return _rows(s.map(event_id=F.col("event_id"), user_id=F.col("user_id"), so_far=F.col("so_far"), best=F.col("best")).sink())


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev)
    SELECT user_id, ((rn - 1) // 10)::BIGINT AS window_index, count(*) AS n, sum(cents)::BIGINT AS total FROM r GROUP BY 1, 2""")
def q_keyed_count_window(spark, sf_dir):
    """Extension: count windows per key."""
    return _rows(_events(spark, sf_dir).key_by("user_id").window(count_tumbling_window(10)).reduce(n=count_of(), total=sum_of("cents")).sink())


@query(f"WITH {EV} SELECT event_id, event_type AS kind, 'b' AS tag, NULL::VARCHAR AS missing FROM ev")
def q_metadata(spark, sf_dir):
    m = metadata.set_metadata(metadata.set_metadata(metadata.set_metadata(F.lit(None), "kind", F.col("event_type")), "tag", "a"), "tag", "b")
    e = events(spark, sf_dir).withColumn("metadata", m)
    return e.select("event_id", *[metadata.get_metadata(F.col("metadata"), k).alias(k) for k in ("kind", "tag")], metadata.get_metadata(F.col("metadata"), "absent").alias("missing"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate)::BIGINT AS t, cast(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
    l AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate)::BIGINT AS t FROM lineitem)
    SELECT o_orderkey, l_linenumber, l.t - o.t AS gap FROM o JOIN l ON o_orderkey = l_orderkey AND l.t BETWEEN o.t AND o.t + """ + f"{10 * DAY}")
def q_orders_shipped(spark, sf_dir):
    """An interval join of two tables as streams: lines shipped within ten days of their order."""
    b = GraphBuilder()
    orders = b.source(lambda: table(spark, sf_dir, "orders").select("o_orderkey", micros("o_orderdate").alias("t")), "t", "o_orderkey", name="orders")
    lines = b.source(lambda: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("t")), "t", "l_orderkey", name="lines")
    s = orders.interval_join(lines, F.col("o_orderkey"), F.col("l_orderkey"), 0, 10 * DAY, o_orderkey=F.col("l.o_orderkey"), l_linenumber=F.col("r.l_linenumber"), gap=F.col("r.t") - F.col("l.t"))
    return _rows(s.sink())


def _stream_events(spark, sf_dir, closing: bool):
    """The event file as a stream; ``closing`` adds a row far in the future, which closes every window before it."""
    e = table(spark, sf_dir, "events")
    raw = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    columns = ["event_id", "tick", "user_id", "event_type", "cents"]
    rows = raw.select("event_id", micros("ts").alias("tick"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    if closing:
        path = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
        last = spark.createDataFrame([(-1, FAR_FUTURE, -1, "close", 0)], "event_id long, tick long, user_id long, event_type string, cents long")
        last.coalesce(1).write.parquet(path)
        rows = rows.union(spark.readStream.schema(last.schema).parquet(path).select(*columns))
    return stream_source(rows, "tick", "event_id", HOUR)


def _streamed(spark, graph, sources) -> DataFrame:
    """Runs the graph's only leaf over what its sources hold now; the rows as a table."""
    out = compile_stream(graph, sources)[graph.leaves()[0]]
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = out.drop(EVENT_TIME)
    engine = StreamEngine(spark, f"{folder}/state")
    engine.submit(f"query-{uuid.uuid4().hex}", out, lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}"))
    engine.execute()
    done = spark.read.schema(out.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*")
    return done.select(*payload(out))


@query(_time_sql(5 * HOUR, 2 * HOUR))
def q_stream_sliding(spark, sf_dir):
    """Sliding windows on Structured Streaming; the same rows as the bounded run."""
    g = GraphBuilder().source(lambda: None, "tick", "event_id", name="events").filter(F.col("event_id") >= -1)
    graph = g.window(time_window(5 * HOUR, 2 * HOUR)).reduce(n=count_of(), total=sum_of("cents")).sink().build()
    return _streamed(spark, graph, {"events": _stream_events(spark, sf_dir, closing=True)})


@query(SQL["q_session_window"])
def q_stream_session(spark, sf_dir):
    """Sessions on Structured Streaming."""
    graph = GraphBuilder().source(lambda: None, "tick", "event_id", name="events").key_by("user_id").session(6 * HOUR, n=count_of(), total=sum_of("cents")).sink().build()
    return _streamed(spark, graph, {"events": _stream_events(spark, sf_dir, closing=True)})


@query(SQL["q_reduce_udf"])
def q_stream_reduce_udf(spark, sf_dir):
    """An opaque function of the rows of each closed window of a stream."""
    func = lambda p: pd.DataFrame({"window_start": [p["tick"].iloc[0] // DAY * DAY], "total": [p["cents"].sum()], "last_id": [p["event_id"].iloc[-1]]})
    graph = GraphBuilder().source(lambda: None, "tick", "event_id", name="events").window(time_tumbling_window(DAY)).reduce(func, "window_start long, total long, last_id long").sink().build()
    return _streamed(spark, graph, {"events": _stream_events(spark, sf_dir, closing=True)})


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev)
    SELECT user_id, ((rn - 1) // 10)::BIGINT AS window_index, count(*) AS n, sum(cents)::BIGINT AS total FROM r GROUP BY 1, 2 HAVING count(*) = 10""")
def q_stream_count_window(spark, sf_dir):
    """Count windows per key of a stream; a window that isn't full stays open."""
    graph = GraphBuilder().source(lambda: None, "tick", "event_id", name="events").key_by("user_id").window(count_tumbling_window(10)).reduce(n=count_of(), total=sum_of("cents")).sink().build()
    return _streamed(spark, graph, {"events": _stream_events(spark, sf_dir, closing=False)})


@query(SQL["q_interval_join"])
def q_stream_interval_join(spark, sf_dir):
    """Two streams joined in event time."""
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    user = F.col("user_id")
    s = clicks.interval_join(buys, user, user, -HOUR, 6 * HOUR, click_id=F.col("l.event_id"), purchase_id=F.col("r.event_id"), gap=F.col("r.__ts") - F.col("l.__ts"))
    sources = {n: _stream_events(spark, sf_dir, closing=False) for n in ("clicks", "purchases")}
    return _streamed(spark, s.sink().build(), sources)


@query(SQL["q_window_join"])
def q_stream_window_join(spark, sf_dir):
    """Two streams joined by common window, with opaque key selectors."""
    clicks, buys = _both(GraphBuilder(), spark, sf_dir)
    key = lambda rows: rows["user_id"]
    s = clicks.window_join(buys, key, key, time_tumbling_window(DAY), user_id=F.col("l.user_id"), click_id=F.col("l.event_id"), purchase_id=F.col("r.event_id"), window_end=F.unix_micros("l.w.end"))
    sources = {n: _stream_events(spark, sf_dir, closing=False) for n in ("clicks", "purchases")}
    return _streamed(spark, s.sink().build(), sources)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubled event values in count windows."""
    s = _events(spark, sf_dir).map(event_id=F.col("event_id"), cents=F.col("cents") * 2)
    return _rows(s.window(count_tumbling_window(5)).reduce(total=sum_of("cents"), mean=avg_of("cents")).sink())


__all__ = ["QUERIES", "SQL", "WindowSpec", "flagship"]
