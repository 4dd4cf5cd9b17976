"""Exact distinct ports from bitmaps that merge, in batch and on streams.

The ports of a source are kept as words of 64 bits, one row for each word that is not empty.
Words merge by ``bit_or``, so distinct ports can be put together over panes, days or any other
parts. All 65,536 ports take at most 1,024 words (8 kB of bits) for a source and pane, where
one row for each port would take 65,536 rows; a source of three ports has at most three words.
(Spark's own ``bitmap_construct_agg`` takes 4 kB for every source however few its ports, and
has to sort.) Everything is in 64-bit numbers, which hash aggregation combines map-side.

Whole numbers outside the range of ports have words of their own, and what is no whole number
is counted by its text, so counts equal those of distinct values as they are stored.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.functions.columns import find, value
from netbehave.operators import schemas
from netbehave.operators.connections import address, empty
from netbehave.operators.windowed import (
    BOUNDS_SCHEMA,
    WATERMARK,
    WINDOW,
    bounds,
    can_window,
    seconds,
    with_event_time,
)

PORT, HOST = "port", "host"
WHOLE = r"^(?:0|-?[1-9][0-9]{0,17})$"  # texts of whole numbers that have one spelling


def word_and_bit(conn: DataFrame) -> tuple[Column, Column]:
    """Key and bit of a row's port.

    The key is the number of the word, or ``=`` and the text of what is no whole number.
    """
    port = value(conn, "port")
    text = port.cast("string")
    if isinstance(conn.schema[find(conn, "port")].dataType, T.IntegralType):
        whole = port.cast("bigint")
    else:
        whole = F.when(text.rlike(WHOLE), text.try_cast("bigint"))
    one = F.lit(1).cast("bigint")
    bit = F.call_function("shiftleft", one, F.pmod(whole, F.lit(64)).cast("int"))
    # The shift keeps the sign, so it is a division that rounds down.
    key = F.coalesce(F.shiftright(whole, 6).cast("string"), F.concat(F.lit("="), text))
    return key, F.coalesce(bit, one)


def touched(conn: DataFrame) -> Column:
    """The two things that a row touches: (kind, item, bits), items null where unknown."""
    word, bit = word_and_bit(conn)
    one = F.lit(1).cast("bigint")
    return F.explode(
        F.array(
            F.struct(F.lit(PORT).alias("kind"), word.alias("item"), bit.alias("bits")),
            F.struct(F.lit(HOST).alias("kind"), address(conn, "dst").alias("item"), one.alias("bits")),
        )
    )


def counts() -> list[Column]:
    is_port, known = F.col("kind") == PORT, F.col("item").isNotNull()
    return [
        F.coalesce(F.sum(F.when(is_port & known, F.bit_count("bits").cast("bigint"))), F.lit(0)).alias(
            "distinct_ports"
        ),
        F.count_if(~is_port & known).alias("distinct_hosts"),
        F.sum(F.when(is_port, F.col("n"))).alias("total_conns"),
    ]


def port_bitmap_windowed(
    conn: DataFrame,
    duration: str = WINDOW,
    slide: str | None = None,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Port scan features per window, as ``port_scan_windowed`` gives them, from bitmaps.

    State of a stream for each source: at most 1,024 rows of 8 bytes and their key for the
    ports of a pane and as many for each open window, and one row for each distinct host.
    """
    if not can_window(conn, "src", "dst", "port"):
        return empty(conn, f"{BOUNDS_SCHEMA}, {schemas.PORT_SCAN}")
    conn = with_event_time(conn, watermark)
    known_source = value(conn, "src").isNotNull()
    pane = f"{gcd(seconds(duration), seconds(slide))} seconds" if slide else duration
    source = F.col("src_ip").isNotNull()
    # On a stream, rows without a source join one group so that they too move the clock.
    words = (
        (conn if conn.isStreaming else conn.where(known_source))
        .select("event_time", address(conn, "src").alias("src_ip"), touched(conn).alias("touched"))
        .groupBy(
            F.window("event_time", pane),
            "src_ip",
            F.when(source, F.col("touched.kind")).alias("kind"),
            F.when(source, F.col("touched.item")).alias("item"),
        )
        .agg(
            F.bit_or("touched.bits").alias("bits"),
            F.count("*").alias("n"),
            F.count("src_ip").alias("known"),
        )
        .where("known > 0")
    )
    if slide:
        words = words.groupBy(
            F.window(F.window_time("window"), duration, slide), "src_ip", "kind", "item"
        ).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return (
        words.groupBy("window", "src_ip")
        .agg(*counts())
        .select(*bounds(), "src_ip", "distinct_ports", "distinct_hosts", "total_conns")
    )


def port_words(conn: DataFrame) -> DataFrame:
    """Rows (src_ip, kind, item, bits, n) that can be stored and merged: see ``merged_ports``."""
    rows = conn.where(value(conn, "src").isNotNull())
    return (
        rows.select(address(conn, "src").alias("src_ip"), touched(conn).alias("touched"))
        .groupBy("src_ip", F.col("touched.kind").alias("kind"), F.col("touched.item").alias("item"))
        .agg(F.bit_or("touched.bits").alias("bits"), F.count("*").alias("n"))
    )


def merged_ports(words: DataFrame) -> DataFrame:
    """Port scan features from the words of any number of parts of a log."""
    merged = words.groupBy("src_ip", "kind", "item").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return merged.groupBy("src_ip").agg(*counts())
