"""Regularity of a pair's connections in time.

The intervals of a pair need its timestamps in order, and a pair may own a third of all
rows. So every pair is cut into time slices of ``SLICE_SECONDS``, and rows are dealt out and
ordered by (pair, slice): one scan, one shuffle. A second shuffle, by pair, takes only one
row per slice and adds the interval from one slice to the next. A year of one pair is
three million such rows.

A slice that itself holds very many rows is sorted on disk as far as memory does not do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netbehave.constants import MIN_BEACON_CONNECTIONS
from netbehave.functions.columns import has, number, round_places
from netbehave.operators import schemas
from netbehave.operators.connections import address, empty

SLICE_SECONDS = 10

PAIR = ("src_ip", "dst_ip")


def timed_pairs(conn: DataFrame, *more: str) -> DataFrame:
    """(src_ip, dst_ip, ts) of the rows that have all three."""
    return conn.select(
        address(conn, "src").alias("src_ip"),
        address(conn, "dst").alias("dst_ip"),
        number(conn, "time").cast("double").alias("ts"),
        *more,
    ).where("src_ip is not null and dst_ip is not null and ts is not null")


def in_slices(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their slice and the time since the previous row of the slice."""
    in_order = Window.partitionBy(*keys, "slice").orderBy("ts")
    placed = rows.withColumn("slice", F.floor(F.col("ts") / SLICE_SECONDS))
    return placed.withColumn("gap", F.col("ts") - F.lag("ts").over(in_order))


def beacon_intervals(conn: DataFrame) -> DataFrame:
    """Per connection: time since the pair's previous one, null for the pair's first.

    The first row of a slice looks up the end of the pair's previous slice; the other rows
    have their interval already and stay spread by slice.
    """
    if not has(conn, "src", "dst", "time"):
        return empty(conn, schemas.BEACON_INTERVALS)
    whole_slice = Window.partitionBy(*PAIR, "slice")
    rows = in_slices(timed_pairs(conn), PAIR).withColumn("last", F.max("ts").over(whole_slice))
    opens = F.col("gap").isNull()
    spread = F.when(~opens, F.col("slice"))
    slices = Window.partitionBy(*PAIR, spread).orderBy("slice")
    return rows.select(
        *PAIR,
        "ts",
        F.when(opens, F.col("ts") - F.lag("last").over(slices))
        .otherwise(F.col("gap"))
        .alias("interval"),
    )


def regularity(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: connections, mean interval, and jitter = population deviation / mean.

    A slice sends the number, mean and variance of its inner intervals. Deviations are
    taken from the mean of the key, part by part, so nothing is lost by cancellation.
    """
    slices = (
        in_slices(rows, keys)
        .groupBy(*keys, "slice")
        .agg(
            F.count("*").alias("n"),
            F.min("ts").alias("first"),
            F.max("ts").alias("last"),
            F.coalesce(F.avg("gap"), F.lit(0.0)).alias("inner_mean"),
            F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("inner_var"),
        )
    )
    of_key = Window.partitionBy(*keys)
    n_inner, inner, cross, mean = F.col("n") - 1, F.col("inner_mean"), F.col("cross"), F.col("mean")
    n_gaps = F.sum("n").over(of_key) - 1
    total = F.sum(n_inner * inner + F.coalesce(cross, F.lit(0.0))).over(of_key)
    parts = slices.withColumn(
        "cross", F.col("first") - F.lag("last").over(of_key.orderBy("slice"))
    ).withColumn("mean", total / F.nullif(n_gaps, F.lit(0)))
    squares = n_inner * (F.col("inner_var") + (inner - mean) * (inner - mean))
    squares += F.coalesce((cross - mean) * (cross - mean), F.lit(0.0))
    moments = (
        parts.groupBy(*keys)
        .agg(
            F.sum("n").alias("n_conns"),
            F.first("mean").alias("mean"),
            F.sum(squares).alias("squares"),
        )
        .where((F.col("n_conns") >= MIN_BEACON_CONNECTIONS) & (mean > 0))
    )
    deviation = F.sqrt(F.col("squares") / (F.col("n_conns") - 1))
    return moments.select(
        *keys,
        "n_conns",
        round_places(mean, 2).alias("mean_interval"),
        round_places(deviation / mean, 4).alias("jitter"),
    )


def beaconing_features(conn: DataFrame) -> DataFrame:
    """Per pair with at least three connections and a positive mean interval."""
    if not has(conn, "src", "dst", "time"):
        return empty(conn, schemas.BEACONING)
    return regularity(timed_pairs(conn), PAIR)
