"""Features and alerts for reading: rankings, counts per severity, a summary, lines, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave import constants as C

WORST_FIRST = C.SEVERITIES[::-1]

# The column that ranks a feature table; jitter ranks the most regular pair first.
RANKS = ("distinct_ports", "failed_attempts", "jitter", "entropy", "total_orig_bytes")


def ranked(features: DataFrame) -> DataFrame:
    """A feature table in order of its metric, ties by address and name."""
    metric = next(name for name in RANKS if name in features.columns)
    order = F.asc(metric) if metric == "jitter" else F.desc(metric)
    ties = [name for name in ("src_ip", "dst_ip", "query") if name in features.columns]
    return features.orderBy(order, *ties)


def severity_histogram(alerts: DataFrame) -> DataFrame:
    """Alerts per known severity, worst first."""
    order = F.array(*[F.lit(severity) for severity in WORST_FIRST])
    return (
        alerts.where(F.col("severity").isin(*WORST_FIRST))
        .groupBy("severity")
        .agg(F.count("*").alias("alerts"))
        .orderBy(F.array_position(order, F.col("severity")))
    )


def summary(alerts: DataFrame) -> DataFrame:
    """One row: number of alerts and the breakdown by known severity as text."""
    counts = alerts.agg(
        F.count("*").alias("alerts"),
        *[F.count_if(F.col("severity") == severity).alias(severity) for severity in WORST_FIRST],
    )
    items = [
        F.when(F.col(severity) > 0, F.format_string(C.BREAKDOWN_ITEM, F.lit(severity), severity))
        for severity in WORST_FIRST
    ]
    return counts.select(
        "alerts", F.concat_ws(C.BREAKDOWN_SEPARATOR, *items).alias("breakdown")
    )


def render(alerts: DataFrame) -> DataFrame:
    """One text line per alert."""
    has_context = F.coalesce("cti_context", F.lit("{}")) != "{}"
    return alerts.select(
        F.format_string(
            C.ALERT_LINE,
            "severity",
            "detector",
            "src_ip",
            F.coalesce(F.nullif("dst_ip", F.lit("")), F.lit(C.NO_TARGET)),
            "description",
            F.when(has_context, C.CTI_MARK).otherwise(""),
        ).alias("line")
    )


def alert_json(alerts: DataFrame) -> DataFrame:
    """One JSON object per alert."""
    return alerts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
