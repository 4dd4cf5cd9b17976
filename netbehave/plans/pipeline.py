"""Detection over a set of logs."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netbehave.constants import SEVERITIES
from netbehave.plans.detectors import Detector, default_detectors
from netbehave.sources.alert_store import AlertStore
from netbehave.sources.logs import load_logs
from netbehave.sources.schemas import ALERT_SCHEMA

log = logging.getLogger(__name__)


@dataclass
class Run:
    """Alerts of a run, detectors that failed and the number of stored alerts.

    ``counts`` has the stored alerts by detector and severity, as far as there are any.
    """

    alerts: DataFrame
    failures: dict[str, str] = field(default_factory=dict)
    stored: int = 0
    persisted: list[DataFrame] = field(default_factory=list)
    counts: dict[tuple[str, str], int] = field(default_factory=dict)

    def release(self) -> None:
        for frame in self.persisted:
            frame.unpersist()


def analyses(
    logs: Mapping[str, DataFrame], detectors: Sequence[Detector]
) -> tuple[dict[int, DataFrame], dict[str, str]]:
    """Alert plans by detector position, and the detectors whose plan could not be made."""
    plans, failures = {}, {}
    for position, detector in enumerate(detectors):
        try:
            plans[position] = detector.analyze(logs)
        except Exception as error:
            log.warning("%s failed: %s", detector.NAME, error)
            failures[place_of(detectors, position)] = str(error)
    return plans, failures


def place_of(detectors: Sequence[Detector], position: int) -> str:
    """Name of a detector, with its position where several have the name."""
    name = detectors[position].NAME
    alone = sum(detector.NAME == name for detector in detectors) == 1
    return name if alone else f"{name} {position}"


def union(plans: Sequence[DataFrame]) -> DataFrame:
    if not plans:
        return SparkSession.active().createDataFrame([], ALERT_SCHEMA)
    return reduce(DataFrame.unionByName, plans)


def detect(logs: Mapping[str, DataFrame], detectors: Sequence[Detector] | None = None) -> Run:
    """Alerts of all detectors as one lazy plan."""
    plans, failures = analyses(logs, default_detectors() if detectors is None else detectors)
    return Run(union(list(plans.values())), failures)


def stage_logs(logs: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write parsed logs as Parquet by date under ``path`` and read them back.

    Text logs are parsed once instead of once per detector, and later scans read only the
    columns and dates they need. Nothing is shuffled: rotated logs cover a day or two per
    file, so a task writes few files. ``path`` must be shared storage on a cluster.
    """
    staged = {}
    for name, rows in logs.items():
        target = f"{path}/{name}"
        folders = ["event_date"] if "event_time" in rows.columns else []
        dated = rows.withColumns({day: F.to_date("event_time") for day in folders})
        dated.write.mode("overwrite").partitionBy(*folders).parquet(target)
        staged[name] = rows.sparkSession.read.schema(dated.schema).parquet(target)
    return staged


def store_alerts(
    store: AlertStore, alerts: DataFrame, detectors: Sequence[Detector], once: bool
) -> tuple[int, dict[tuple[str, str], int]]:
    """Append alerts; their number, and that by detector and severity, from the same job."""
    names = dict.fromkeys(detector.NAME for detector in detectors)
    pairs = [(name, severity) for name in names for severity in SEVERITIES]
    counts = {
        f"{name} {severity}": F.count_if((F.col("detector") == name) & (F.col("severity") == severity))
        for name, severity in pairs
    }
    found = store.append_new(alerts, counts=counts) if once else store.append_counted(alerts, counts)
    return found["alerts"], {pair: n for pair in pairs if (n := found[" ".join(pair)])}


def run(
    spark: SparkSession,
    logs_dir: str,
    detectors: Sequence[Detector] | None = None,
    store: AlertStore | None = None,
    staging: str | None = None,
    isolate: bool = False,
    fields: Mapping[str, tuple[str, ...]] | None = None,
    once: bool = False,
) -> Run:
    """Load logs, detect and, with a store, append the alerts.

    ``once`` stores only alerts that the store does not have, so that a run may be repeated.

    Only the logs of the chosen detectors are looked at. ``fields`` gives the layouts that
    are known, by log; others are looked up in the headers. Files without a header are
    named in ``Run.failures``. Staging parses the text once for all detectors.
    By default all detectors are one plan and one write, which fails as a whole if data
    breaks one of them. ``isolate`` computes and writes per detector and keeps the others.
    Computed alerts are persisted for the write and later reports; ``Run.release`` frees
    them.
    """
    chosen = default_detectors() if detectors is None else detectors
    needed = dict.fromkeys(detector.LOG for detector in chosen)
    headerless: list[str] = []
    logs = load_logs(spark, logs_dir, needed, fields, headerless)
    if staging:
        logs = stage_logs(logs, staging)
    plans, failures = analyses(logs, chosen)
    failures |= {file: "no header" for file in headerless}
    if not isolate:
        alerts = union(list(plans.values())).persist(StorageLevel.MEMORY_AND_DISK)
        stored, counts = store_alerts(store, alerts, chosen, once) if store else (0, {})
        return Run(alerts, failures, stored, [alerts], counts)

    kept, stored, counts = [], 0, {}
    for position, plan in plans.items():
        plan.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if store:
                found, by_kind = store_alerts(store, plan, [chosen[position]], once)
            else:
                found, by_kind = plan.count(), {}
        except Exception as error:
            log.warning("%s failed: %s", chosen[position].NAME, error)
            failures[place_of(chosen, position)] = str(error)
            plan.unpersist()
            continue
        log.info("%s: %d alerts", chosen[position].NAME, found)
        kept.append(plan)
        stored += found if store else 0
        for kind, n in by_kind.items():
            counts[kind] = counts.get(kind, 0) + n
    return Run(union(kept), failures, stored, kept, counts)
