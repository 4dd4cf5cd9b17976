"""Detectors: features, thresholds and the projection to alerts, as one lazy plan each."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netbehave import constants as C
from netbehave.functions.columns import round_places
from netbehave.operators.beaconing import beaconing_features
from netbehave.operators.connections import (
    brute_force_features,
    exfil_features,
    port_scan_features,
)
from netbehave.operators.dns import dns_features
from netbehave.operators.windowed import (
    beaconing_windowed,
    brute_force_windowed,
    port_scan_windowed,
)
from netbehave.sources.alert_store import alert_id
from netbehave.sources.schemas import ALERT_COLUMNS, ALERT_SCHEMA


@dataclass(frozen=True)
class Detector(ABC):
    """A detector names itself, its log and its thresholds (the dataclass fields).

    Subclasses give the suspects and, per suspect, a text and the evidence.
    """

    NAME: ClassVar[str]
    SEVERITY: ClassVar[str] = "LOW"
    MITRE: ClassVar[str] = ""
    THRESHOLD_KEY: ClassVar[str] = ""
    LOG: ClassVar[str] = "conn"

    @classmethod
    def from_thresholds(
        cls, thresholds: Mapping[str, Mapping] = C.THRESHOLDS, windowed: bool = False
    ):
        """Detector with the thresholds listed under its key; others keep their default.

        ``windowed`` makes it count per window of the listed ``window_sec``.
        """
        listed = dict(thresholds.get(cls.THRESHOLD_KEY, {}))
        if windowed and "window_sec" in listed:
            listed["window"] = f"{listed['window_sec']} seconds"
        return cls(**{f.name: listed[f.name] for f in fields(cls) if f.name in listed})

    @abstractmethod
    def suspects(self, log: DataFrame) -> DataFrame:
        """Feature rows beyond the thresholds; a column ``dst_ip`` becomes the target."""

    @abstractmethod
    def description(self) -> Column: ...

    @abstractmethod
    def evidence(self) -> dict[str, Column]: ...

    def analyze(self, logs: Mapping[str, DataFrame]) -> DataFrame:
        log = logs.get(self.LOG)
        if log is None:
            return SparkSession.active().createDataFrame([], ALERT_SCHEMA)
        return to_alerts(self.suspects(log), self, self.description(), self.evidence())

    def __str__(self) -> str:
        return f"{self.NAME} ({self.SEVERITY}, {self.MITRE})"


def to_alerts(
    suspects: DataFrame,
    detector: Detector,
    description: Column,
    evidence: Mapping[str, Column],
) -> DataFrame:
    """Suspects as alert rows. An empty target is null; the window, or the time and uid of
    a single row, enter the evidence and so the identity."""
    target = F.nullif("dst_ip", F.lit("")) if "dst_ip" in suspects.columns else F.lit(None)
    facts = dict(evidence)
    # What tells alerts of one kind apart: their window, or the row they stand for.
    for name in ("window_start", "window_end", "ts", "uid"):
        if name in suspects.columns:
            facts[name] = F.col(name)
    return (
        suspects.select(
            F.current_timestamp().alias("timestamp"),
            F.lit(detector.NAME).alias("detector"),
            F.lit(detector.SEVERITY).alias("severity"),
            F.coalesce(F.col("src_ip").cast("string"), F.lit(C.NO_SOURCE)).alias("src_ip"),
            target.cast("string").alias("dst_ip"),
            description.alias("description"),
            F.lit(detector.MITRE).alias("mitre"),
            F.to_json(F.struct(*[fact.alias(name) for name, fact in facts.items()])).alias(
                "evidence"
            ),
            F.lit("{}").alias("cti_context"),
        )
        .withColumn("id", alert_id())
        .select(*ALERT_COLUMNS)
    )


def text(threshold) -> Column:
    return F.lit(str(threshold))


@dataclass(frozen=True)
class PortScanDetector(Detector):
    """One source, very many destination ports."""

    NAME: ClassVar[str] = "PortScanDetector"
    SEVERITY: ClassVar[str] = "MEDIUM"
    MITRE: ClassVar[str] = "T1046"
    THRESHOLD_KEY: ClassVar[str] = "port_scan"

    min_ports: int = 50
    window: str | None = None
    slide: str | None = None

    def suspects(self, log: DataFrame) -> DataFrame:
        features = (
            port_scan_windowed(log, self.window, self.slide)
            if self.window
            else port_scan_features(log)
        )
        return features.where(F.col("distinct_ports") >= self.min_ports).drop("dst_ip")

    def description(self) -> Column:
        return F.format_string(
            C.PORT_SCAN_TEXT, "distinct_ports", "distinct_hosts", text(self.min_ports)
        )

    def evidence(self) -> dict[str, Column]:
        return {
            "distinct_ports": F.col("distinct_ports"),
            "distinct_hosts": F.col("distinct_hosts"),
            "total_conns": F.col("total_conns"),
            "threshold": F.lit(self.min_ports),
        }


@dataclass(frozen=True)
class BruteForceDetector(Detector):
    """One source, many failed connections to a login port."""

    NAME: ClassVar[str] = "BruteForceDetector"
    SEVERITY: ClassVar[str] = "HIGH"
    MITRE: ClassVar[str] = "T1110"
    THRESHOLD_KEY: ClassVar[str] = "brute_force"

    min_attempts: int = 10
    port: int = 22
    window: str | None = None
    slide: str | None = None

    def suspects(self, log: DataFrame) -> DataFrame:
        features = (
            brute_force_windowed(log, self.port, self.window, self.slide)
            if self.window
            else brute_force_features(log, self.port)
        )
        return features.where(F.col("failed_attempts") >= self.min_attempts)

    def description(self) -> Column:
        return F.format_string(
            C.BRUTE_FORCE_TEXT, "failed_attempts", text(self.port), text(self.min_attempts)
        )

    def evidence(self) -> dict[str, Column]:
        return {
            "failed_attempts": F.col("failed_attempts"),
            "port": F.lit(self.port),
            "threshold": F.lit(self.min_attempts),
        }


@dataclass(frozen=True)
class BeaconingDetector(Detector):
    """A pair that connects often and at very regular intervals."""

    NAME: ClassVar[str] = "BeaconingDetector"
    SEVERITY: ClassVar[str] = "CRITICAL"
    MITRE: ClassVar[str] = "T1071"
    THRESHOLD_KEY: ClassVar[str] = "beaconing"

    max_jitter: float = 0.10
    min_connections: int = 10
    window: str | None = None
    slide: str | None = None

    def suspects(self, log: DataFrame) -> DataFrame:
        features = (
            beaconing_windowed(log, self.window, self.slide)
            if self.window
            else beaconing_features(log)
        )
        return features.where(
            (F.col("jitter") <= self.max_jitter) & (F.col("n_conns") >= self.min_connections)
        )

    def description(self) -> Column:
        return F.format_string(
            C.BEACONING_TEXT,
            "n_conns",
            round_places(F.col("jitter") * 100, 1),
            round_places(F.col("mean_interval"), 0),
            F.lit(f"{self.max_jitter:.0%}"),
        )

    def evidence(self) -> dict[str, Column]:
        return {
            "n_conns": F.col("n_conns"),
            "jitter": F.col("jitter"),
            "mean_interval": F.col("mean_interval"),
            "max_jitter": F.lit(self.max_jitter),
        }


@dataclass(frozen=True)
class DnsTunnelDetector(Detector):
    """Query names that look like encoded data, one alert per DNS row."""

    NAME: ClassVar[str] = "DNSTunnelDetector"
    SEVERITY: ClassVar[str] = "HIGH"
    MITRE: ClassVar[str] = "T1071.004"
    THRESHOLD_KEY: ClassVar[str] = "dns_tunnel"
    LOG: ClassVar[str] = "dns"

    min_entropy: float = 3.5

    def suspects(self, log: DataFrame) -> DataFrame:
        return dns_features(log, identity=True).where(F.col("entropy") >= self.min_entropy)

    def description(self) -> Column:
        return F.format_string(
            C.DNS_TUNNEL_TEXT, "query", "entropy", "qlen", text(self.min_entropy)
        )

    def evidence(self) -> dict[str, Column]:
        return {
            "query": F.col("query"),
            "qlen": F.col("qlen"),
            "entropy": F.col("entropy"),
            "threshold": F.lit(self.min_entropy),
        }


@dataclass(frozen=True)
class ExfiltrationDetector(Detector):
    """A pair that sends more bytes than the limit."""

    NAME: ClassVar[str] = "ExfiltrationDetector"
    SEVERITY: ClassVar[str] = "HIGH"
    MITRE: ClassVar[str] = "T1048"
    THRESHOLD_KEY: ClassVar[str] = "exfiltration"

    max_bytes: int = 1_000_000

    def suspects(self, log: DataFrame) -> DataFrame:
        return exfil_features(log).where(F.col("total_orig_bytes") > self.max_bytes)

    def description(self) -> Column:
        return F.format_string(
            C.EXFILTRATION_TEXT,
            F.col("total_orig_bytes").cast("string"),
            "n_conns",
            text(self.max_bytes),
        )

    def evidence(self) -> dict[str, Column]:
        return {
            "total_orig_bytes": F.col("total_orig_bytes"),
            "n_conns": F.col("n_conns"),
            "threshold": F.lit(self.max_bytes),
        }


def default_detectors(thresholds: Mapping[str, Mapping] = C.THRESHOLDS) -> list[Detector]:
    """The detectors of a standard run; the other two are there to be added."""
    return [
        kind.from_thresholds(thresholds)
        for kind in (PortScanDetector, BruteForceDetector, BeaconingDetector)
    ]
