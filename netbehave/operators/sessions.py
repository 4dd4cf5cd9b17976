"""Bytes that a pair of hosts exchanges in one session, sessions ending at a gap in time.

A session of a pair goes on while its next connection starts no more than ``gap`` after the one
before. On a stream this is Spark's session window. A batch frame may hold a third of all rows
in one pair, which a session window would bring into one task; so rows are dealt out by pair
and slice of time, sessions are found inside slices, and only these are put together by pair:
a pair has at most one row there for each gap or slice that its time range holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netbehave.functions.columns import value, whole_number
from netbehave.operators.connections import address, empty
from netbehave.operators.windowed import WATERMARK, can_window, seconds, with_event_time

GAP = "30 minutes"
GAPS_A_SLICE = 24  # length of a slice in gaps
PAIR = ("src_ip", "dst_ip")
SESSIONS = (
    "src_ip string, dst_ip string, session_start timestamp, session_end timestamp, "
    "total_orig_bytes decimal(38,0), n_conns bigint"
)


def sent_rows(conn: DataFrame) -> DataFrame:
    """Rows (src_ip, dst_ip, event_time, sent); unreadable byte counts are 0."""
    return conn.select(
        address(conn, "src").alias("src_ip"),
        address(conn, "dst").alias("dst_ip"),
        "event_time",
        F.coalesce(whole_number(conn, "bytes"), F.lit(0)).cast("decimal(28,0)").alias("sent"),
    )


def exfil_sessions(conn: DataFrame, gap: str = GAP, watermark: str = WATERMARK) -> DataFrame:
    """Per session: source, destination, first and last time, bytes sent and connections.

    Rows without a source, destination or time are left out. On a stream a session appears
    once the watermark is ``gap`` past its last row; rows later than the watermark are dropped.
    """
    if not can_window(conn, "src", "dst", "bytes"):
        return empty(conn, SESSIONS)
    conn = with_event_time(conn, watermark)
    known = value(conn, "src").isNotNull() & value(conn, "dst").isNotNull()
    rows = sent_rows(conn if conn.isStreaming else conn.where(known)).where("event_time IS NOT NULL")
    if conn.isStreaming:
        return streamed_sessions(rows, gap)
    return merged_sessions(sessions_in_slices(rows, gap), gap)


def streamed_sessions(rows: DataFrame, gap: str) -> DataFrame:
    # Rows without both addresses join one group, so that they too move the clock.
    known = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    return (
        rows.groupBy(
            F.session_window("event_time", gap).alias("window"),
            *[F.when(known, F.col(name)).alias(name) for name in PAIR],
        )
        .agg(F.sum("sent").alias("total_orig_bytes"), F.count("*").alias("n_conns"), F.count_if(known).alias("known"))
        .where("known > 0")
        .select(
            *PAIR,
            F.col("window.start").alias("session_start"),
            (F.col("window.end") - F.expr(f"INTERVAL {seconds(gap)} SECONDS")).alias("session_end"),
            F.col("total_orig_bytes").cast("decimal(38,0)").alias("total_orig_bytes"),
            "n_conns",
        )
    )


def sessions_in_slices(rows: DataFrame, gap: str) -> DataFrame:
    """Sessions cut at the edges of slices, several rows to a pair and slice."""
    slice_ = F.floor(F.unix_seconds("event_time") / F.lit(seconds(gap) * GAPS_A_SLICE))
    found = (
        rows.withColumn("slice", slice_)
        .groupBy(*PAIR, "slice", F.session_window("event_time", gap).alias("window"))
        .agg(
            F.min("event_time").alias("first"),
            F.max("event_time").alias("last"),
            F.sum("sent").alias("sent"),
            F.count("*").alias("n"),
        )
    )
    return found.select(*PAIR, "first", "last", "sent", "n")


def merged_sessions(parts: DataFrame, gap: str) -> DataFrame:
    """Whole sessions from parts; parts of one pair do not overlap."""
    ordered = Window.partitionBy(*PAIR).orderBy("first", "last")
    apart = F.unix_micros("first") - F.unix_micros(F.lag("last").over(ordered))
    starts = F.coalesce(apart > F.lit(seconds(gap) * 1_000_000), F.lit(True))
    numbered = parts.withColumn("starts", starts.cast("int"))
    numbered = numbered.withColumn("session", F.sum("starts").over(ordered))
    return (
        numbered.groupBy(*PAIR, "session")
        .agg(
            F.min("first").alias("session_start"),
            F.max("last").alias("session_end"),
            F.sum("sent").cast("decimal(38,0)").alias("total_orig_bytes"),
            F.sum("n").alias("n_conns"),
        )
        .drop("session")
    )
