"""Sketches of what each source touched a day, kept in a table and joined over any span.

A day and source has one HyperLogLog sketch of its ports and one of its hosts. Sketches merge
without loss, so the distinct counts of a week or a year come from a few kilobytes a day and
source, and the logs are not read again. With ``lg_k`` bits the relative standard error is
1.04 / sqrt(2 ** lg_k); ``bound`` gives three of these. Counts up to an eighth of 2 ** lg_k
are exact but for hash collisions.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netbehave.functions.columns import value
from netbehave.operators.connections import address
from netbehave.operators.windowed import can_window, with_event_time

LG_K = 12
SCHEMA = "src_ip string, ports binary, hosts binary, total_conns long, date date"


def bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate stays within with a probability of about 0.997."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def daily_sketches(conn: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Rows (src_ip, ports, hosts, total_conns, date).

    Sketches combine map-side: a source sends one row a task and day. Rows without a source
    or time are left out; unknown ports and hosts are not counted.
    """
    if not can_window(conn, "src", "dst", "port"):
        return conn.sparkSession.createDataFrame([], SCHEMA)
    rows = with_event_time(conn, "0 seconds").select(
        F.to_date("event_time").alias("date"),
        address(conn, "src").alias("src_ip"),
        value(conn, "port").cast("string").alias("port"),
        address(conn, "dst").alias("host"),
    )
    return (
        rows.where("date IS NOT NULL AND src_ip IS NOT NULL")
        .groupBy("date", "src_ip")
        .agg(
            F.hll_sketch_agg("port", lg_k).alias("ports"),
            F.hll_sketch_agg("host", lg_k).alias("hosts"),
            F.count("*").alias("total_conns"),
        )
        .select("src_ip", "ports", "hosts", "total_conns", "date")
    )


class SketchStore:
    """Table of daily sketches at ``path``, one folder for each date."""

    def __init__(self, spark: SparkSession, path: str, lg_k: int = LG_K):
        self.spark, self.path, self.lg_k = spark, path, lg_k

    def write(self, conn: DataFrame) -> None:
        """Store the days of a log. A day that is there is replaced, so a rerun changes nothing.

        So ``conn`` must hold all rows of the days that it has rows of.
        """
        found = daily_sketches(conn, self.lg_k)
        (
            found.repartition("date", F.pmod(F.xxhash64("src_ip"), F.lit(16)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(self.path)
        )

    def days(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def features(self, first: date, last: date) -> DataFrame:
        """Port scan features of a span of days, both included; only their folders are read."""
        span = self.days().where(F.col("date").between(F.lit(first), F.lit(last)))
        return span.groupBy("src_ip").agg(
            F.hll_sketch_estimate(F.hll_union_agg("ports")).alias("distinct_ports"),
            F.hll_sketch_estimate(F.hll_union_agg("hosts")).alias("distinct_hosts"),
            F.sum("total_conns").alias("total_conns"),
        )
