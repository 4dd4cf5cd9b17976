"""Per-source and per-pair counts over connection logs.

Every aggregate here combines map-side, so a source or pair that owns a large share of
all rows sends one partial row per map task. Rows with a null key are dropped.
Results are not sorted; sort where they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.constants import FAILED_STATES
from netbehave.functions.columns import find, has, number, ref, value, whole_number
from netbehave.operators import schemas


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def address(df: DataFrame, logical: str) -> Column:
    return value(df, logical).cast("string")


def failed_to_port(conn: DataFrame, port: int) -> Column:
    """Whether a row went to ``port`` and failed; any row to it if no state is recorded."""
    to_port = number(conn, "port") == F.lit(port)
    if has(conn, "state"):
        return to_port & value(conn, "state").isin(*FAILED_STATES)
    return to_port


def first_target(conn: DataFrame) -> Column:
    """Aggregate: destination of the earliest row that has one, by time and uid.

    A row without a time or uid comes after those that have one.
    """
    name = find(conn, "dst")
    if name is None or not isinstance(conn.schema[name].dataType, T.StringType):
        return F.max(F.lit(None).cast("string"))
    order = [number(conn, "time")] if has(conn, "time") else []
    order += [ref("uid")] if "uid" in conn.columns else []
    known_first = [part for column in order for part in (column.isNull(), column)]
    target = ref(name)
    return F.min_by(target, F.when(target.isNotNull(), F.struct(*known_first, target)))


def port_scan_features(conn: DataFrame, approx: bool = False) -> DataFrame:
    """Per source: distinct destination ports, distinct hosts, connections.

    Exact counts shuffle the distinct (source, port) and (source, host) pairs, spread by
    both values; ``approx`` trades exactness for one sketch per source.
    """
    if not has(conn, "src", "dst", "port"):
        return empty(conn, schemas.PORT_SCAN)
    rows = conn.select(
        address(conn, "src").alias("src_ip"),
        value(conn, "dst").alias("dst"),
        value(conn, "port").alias("port"),
    ).where("src_ip is not null")
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return rows.groupBy("src_ip").agg(
        distinct("port").alias("distinct_ports"),
        distinct("dst").alias("distinct_hosts"),
        F.count("*").alias("total_conns"),
    )


def brute_force_features(conn: DataFrame, port: int = 22) -> DataFrame:
    """Per source: failed connections to ``port`` and the first destination."""
    if not has(conn, "src", "port"):
        return empty(conn, schemas.BRUTE_FORCE)
    rows = conn.where(failed_to_port(conn, port) & value(conn, "src").isNotNull())
    return rows.groupBy(address(conn, "src").alias("src_ip")).agg(
        F.count("*").alias("failed_attempts"),
        first_target(conn).alias("dst_ip"),
    )


def exfil_features(conn: DataFrame) -> DataFrame:
    """Per (source, destination): bytes sent and connections.

    Unreadable byte counts are 0. The sum is a decimal of 38 digits, which no number of
    64-bit counts that a cluster holds can exceed.
    """
    if not has(conn, "src", "dst", "bytes"):
        return empty(conn, schemas.EXFILTRATION)
    rows = conn.select(
        address(conn, "src").alias("src_ip"),
        address(conn, "dst").alias("dst_ip"),
        F.coalesce(whole_number(conn, "bytes"), F.lit(0)).alias("sent"),
    ).where("src_ip is not null and dst_ip is not null")
    return rows.groupBy("src_ip", "dst_ip").agg(
        F.sum(F.col("sent").cast("decimal(28,0)")).alias("total_orig_bytes"),
        F.count("*").alias("n_conns"),
    )
