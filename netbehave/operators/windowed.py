"""The connection features per time window, for batch and streaming frames alike.

Each function keeps only bounded values in one group, so it holds as streaming state:
distinct values are counted in two steps, and a pair's timestamps are gathered per short
slice before the slices of a window are put together. On a stream the two steps are
chained and emit in append mode once the watermark passes the window.
"""

from __future__ import annotations

import re
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netbehave.constants import MIN_BEACON_CONNECTIONS
from netbehave.functions.columns import epoch_time, find, has, number, ref, round_places, value
from netbehave.operators import schemas
from netbehave.operators.beaconing import PAIR, regularity, timed_pairs
from netbehave.operators.connections import address, empty, failed_to_port, first_target

WINDOW = "60 seconds"
WATERMARK = "10 minutes"
SLICES = 1000  # of a pane, at most


def with_event_time(conn: DataFrame, watermark: str) -> DataFrame:
    """The log with its event time and, on a stream, the allowed lateness."""
    if "event_time" not in conn.columns:
        conn = conn.withColumn("event_time", epoch_time(number(conn, "time")))
    if conn.isStreaming:
        conn = conn.withWatermark("event_time", watermark)
    return conn


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
BOUNDS_SCHEMA = "window_start timestamp, window_end timestamp"


def seconds(duration: str) -> int:
    """Length of a duration such as "90 seconds"; several parts add up."""
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", duration.lower())
    if not parts or any(unit not in UNITS for _, unit in parts):
        raise ValueError(f"not a duration: {duration}")
    return sum(int(number) * UNITS[unit] for number, unit in parts)


def slice_seconds(pane: int) -> int:
    """Shortest whole-second slice that divides a pane into at most ``SLICES``."""
    return next(n for n in range(max(1, -(-pane // SLICES)), pane + 1) if pane % n == 0)


def can_window(conn: DataFrame, *logical: str) -> bool:
    timed = "event_time" in conn.columns or has(conn, "time")
    return timed and has(conn, *logical)


def bounds() -> list[Column]:
    return [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
    ]


def port_scan_windowed(
    conn: DataFrame,
    duration: str = WINDOW,
    slide: str | None = None,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Port scan features per window; tumbling unless ``slide`` is given.

    Sliding windows are put together from panes, the longest pieces that every window
    consists of: distinct items are found per pane, and only they are spread over windows.
    """
    if not can_window(conn, "src", "dst", "port"):
        return empty(conn, f"{BOUNDS_SCHEMA}, {schemas.PORT_SCAN}")
    conn = with_event_time(conn, watermark)
    touched = F.explode(
        F.array(
            F.struct(F.lit("port").alias("kind"), value(conn, "port").cast("string").alias("item")),
            F.struct(F.lit("host").alias("kind"), address(conn, "dst").alias("item")),
        )
    )
    # On a stream, rows without a source join one group so that they too move the clock.
    known_source = value(conn, "src").isNotNull()
    pane = f"{gcd(seconds(duration), seconds(slide))} seconds" if slide else duration
    items = (
        (conn if conn.isStreaming else conn.where(known_source))
        .select("event_time", address(conn, "src").alias("src_ip"), touched.alias("touched"))
        .groupBy(
            F.window("event_time", pane),
            "src_ip",
            F.when(F.col("src_ip").isNotNull(), F.col("touched.kind")).alias("kind"),
            F.when(F.col("src_ip").isNotNull(), F.col("touched.item")).alias("item"),
        )
        .agg(F.count("*").alias("n"), F.count("src_ip").alias("known"))
        # A condition on the source itself would move below the clock.
        .where("known > 0")
    )
    if slide:
        items = (
            items.groupBy(
                F.window(F.window_time("window"), duration, slide), "src_ip", "kind", "item"
            )
            .agg(F.sum("n").alias("n"))
        )
    is_port = F.col("kind") == "port"
    known = F.col("item").isNotNull()
    return (
        items.groupBy("window", "src_ip")
        .agg(
            F.count_if(is_port & known).alias("distinct_ports"),
            F.count_if(~is_port & known).alias("distinct_hosts"),
            F.sum(F.when(is_port, F.col("n"))).alias("total_conns"),
        )
        .select(*bounds(), "src_ip", "distinct_ports", "distinct_hosts", "total_conns")
    )


def brute_force_windowed(
    conn: DataFrame,
    port: int = 22,
    duration: str = WINDOW,
    slide: str | None = None,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Brute force features per window.

    A filter before the aggregation would run before the watermark too, and rows it drops
    would not move the stream's clock: the last window of an attack would stay open until
    the next failed login. On a stream other rows therefore join one group without source,
    which is combined before the shuffle and keeps a count and no target.
    """
    if not can_window(conn, "src", "port"):
        return empty(conn, f"{BOUNDS_SCHEMA}, {schemas.BRUTE_FORCE}")
    conn = with_event_time(conn, watermark)
    failed = failed_to_port(conn, port) & value(conn, "src").isNotNull()
    target = first_target(conn)
    if conn.isStreaming:
        # The rows that only move the clock look for no target.
        marked = {"__failed": failed, "__src": address(conn, "src")}
        if name := find(conn, "dst"):
            marked[name] = F.when(failed, ref(name))
        conn = conn.withColumns(marked)
        failed, source = F.col("__failed"), F.when(F.col("__failed"), F.col("__src"))
    else:
        conn, source = conn.where(failed), address(conn, "src")
    return (
        conn.groupBy(
            F.window("event_time", duration, slide or duration), source.alias("src_ip")
        )
        .agg(F.count_if(failed).alias("failed_attempts"), target.alias("dst_ip"))
        .where("failed_attempts > 0")
        .select(*bounds(), "src_ip", "failed_attempts", "dst_ip")
    )


def squared_steps(later: Column, earlier: Column) -> Column:
    """Sum of the squared differences of two arrays of equal length."""
    return F.aggregate(
        F.zip_with(later, earlier, lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda total, square: total + square,
    )


def beaconing_windowed(
    conn: DataFrame,
    duration: str = WINDOW,
    slide: str | None = None,
    watermark: str = WATERMARK,
    slice_duration: str | None = None,
) -> DataFrame:
    """Beaconing features per window; intervals across window edges do not count.

    A batch frame takes the route of the unwindowed feature, with the window as part of
    the key. A stream cannot order rows across batches and gathers timestamps by slice.

    State of a stream: a pair's slice holds its distinct timestamps, 8 bytes each, until the
    watermark passes the slice. A pair's window holds one summary of 40 bytes per slice; a
    pane (the greatest common divisor of duration and slide) has at most ``SLICES``, so a
    tumbling window holds at most 40 kB. ``slice_duration`` overrides that choice.
    """
    if not can_window(conn, "src", "dst", "time"):
        return empty(conn, f"{BOUNDS_SCHEMA}, {schemas.BEACONING}")
    conn = with_event_time(conn, watermark)
    rows = timed_pairs(conn, "event_time")
    if conn.isStreaming:
        pane = gcd(seconds(duration), seconds(slide or duration))
        slice_duration = slice_duration or f"{slice_seconds(pane)} seconds"
        return beaconing_by_slice(rows, duration, slide, slice_duration)
    window = F.window("event_time", duration, slide or duration)
    placed = rows.withColumn("window", window).select(*bounds(), *PAIR, "ts")
    return regularity(placed, ("window_start", "window_end", *PAIR))


def beaconing_by_slice(
    rows: DataFrame, duration: str, slide: str | None, slice_duration: str
) -> DataFrame:
    """Beaconing features of a stream.

    ``duration`` and ``slide`` must be multiples of ``slice_duration``. A slice keeps a
    pair's distinct timestamps, at most one per microsecond; a window keeps one entry per
    slice of the pair.
    """
    times = F.col("times")
    slices = (
        rows.groupBy(F.window("event_time", slice_duration).alias("slice"), *PAIR)
        .agg(
            F.array_sort(F.collect_set("ts")).alias("times"),
            F.count("*").alias("n"),
        )
        .select(
            F.window_time("slice").alias("event_time"),
            *PAIR,
            F.struct(
                F.element_at(times, 1).alias("first"),
                F.element_at(times, -1).alias("last"),
                "n",
                squared_steps(
                    F.slice(times, F.lit(2), F.size(times) - 1),
                    F.slice(times, F.lit(1), F.size(times) - 1),
                ).alias("squares"),
            ).alias("part"),
        )
    )

    parts = F.col("parts")
    windows = (
        slices.groupBy(F.window("event_time", duration, slide or duration), *PAIR)
        .agg(
            F.array_sort(F.collect_list("part")).alias("parts"),
            F.sum("part.n").alias("n_conns"),
            F.sum("part.squares").alias("inner_squares"),
        )
        .where(F.col("n_conns") >= MIN_BEACON_CONNECTIONS)
        .withColumn(
            "edge_squares",
            squared_steps(
                F.slice(parts["first"], F.lit(2), F.size(parts) - 1),
                F.slice(parts["last"], F.lit(1), F.size(parts) - 1),
            ),
        )
        .withColumn("gaps", F.col("n_conns") - 1)
        .withColumn(
            "mean",
            (F.element_at(parts, -1)["last"] - F.element_at(parts, 1)["first"])
            / F.col("gaps"),
        )
        .where("mean > 0")
    )
    mean = F.col("mean")
    spread = (F.col("inner_squares") + F.col("edge_squares")) / F.col("gaps") - mean * mean
    return windows.select(
        *bounds(),
        *PAIR,
        "n_conns",
        round_places(mean, 2).alias("mean_interval"),
        round_places(F.sqrt(F.greatest(spread, F.lit(0.0))) / mean, 4).alias("jitter"),
    )
