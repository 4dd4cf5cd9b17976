"""The alert table: Parquet files by batch, date and severity.

Every append is a folder of its own, written as a whole. A stream names its batches, so a
repeated batch replaces itself and nothing is stored twice or left out. Small folders are
compacted into one: a version, written last, says which folders a new one stands for, so a
reader sees either the old folders or the new one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.sources.schemas import ALERT_COLUMNS, ALERT_SCHEMA

PARTITIONS = ("alert_date", "severity")
DATED_SCHEMA = T.StructType([*ALERT_SCHEMA.fields, T.StructField("alert_date", T.DateType())])
STORE_SCHEMA = T.StructType([*DATED_SCHEMA.fields, T.StructField("batch", T.StringType())])
LATEST = 50
DATE_FOLDER = re.compile(r"/alert_date=(\d{4}-\d{2}-\d{2})/")

# Folders made by compaction; they count only once a version names them.
COMPACTED = "compacted-"
OWN_NAME = re.compile(rf"({COMPACTED})?[0-9a-f]{{32}}")
VERSION_SCHEMA = "batch string, replaced double"
SMALL_BYTES = 128 * 2**20
RETAIN_HOURS = 24.0


def alert_id():
    """Identity of an alert's content: the same finding has the same id in every run."""
    return F.sha2(
        F.concat_ws(
            "\u0001",
            "detector",
            "src_ip",
            F.coalesce("dst_ip", F.lit("")),
            "description",
            "evidence",
        ),
        256,
    )


def new_alert(
    spark: SparkSession,
    detector: str,
    severity: str,
    src_ip: str,
    description: str,
    dst_ip: str | None = None,
    mitre: str | None = None,
    evidence: Mapping | None = None,
    cti_context: Mapping | None = None,
    timestamp: datetime | None = None,
) -> DataFrame:
    """One alert as a frame of one row."""
    row = (
        timestamp or datetime.now(timezone.utc),
        detector,
        severity,
        src_ip,
        dst_ip,
        description,
        mitre,
        json.dumps(dict(evidence or {})),
        json.dumps(dict(cti_context or {})),
    )
    schema = T.StructType(ALERT_SCHEMA.fields[1:])
    return spark.createDataFrame([row], schema).withColumn("id", alert_id()).select(*ALERT_COLUMNS)


def stored(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT_COLUMNS).withColumn("alert_date", F.to_date("timestamp"))


def latest(alerts: DataFrame, limit: int = LATEST, severity: str | None = None) -> DataFrame:
    """The most recent alerts, with evidence and context decoded from JSON."""
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    top = alerts.orderBy(F.desc("timestamp"), "id").limit(limit)
    return top.withColumns(
        {
            name: F.parse_json(F.coalesce(name, F.lit("{}")))
            for name in ("evidence", "cti_context")
        }
    )


class AlertStore:
    """Alerts kept under one path of the cluster's shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.create()

    def create(self) -> None:
        """Make an empty table unless something is stored already."""
        if not self._files().exists(self._hadoop_path(self.path)):
            self.clear()

    def append(self, alerts: DataFrame, batch: str | None = None) -> int:
        """Add alerts, none included, and return how many were written.

        Rows are balanced by target folder before the write: small folders get one file and
        a large one is split over several tasks. A batch that has been appended under the
        same name is replaced; once it has been compacted it is final, and appending it
        again writes nothing and returns 0.
        """
        return self.append_counted(alerts, {}, batch)["alerts"]

    def append_counted(
        self, alerts: DataFrame, counts: Mapping[str, Column], batch: str | None = None
    ) -> dict[str, int]:
        """Append and return the values of aggregates over what was written.

        ``alerts``, the number of rows, is always among them. The job that writes computes
        them; nothing is read again.
        """
        if batch and batch.startswith(COMPACTED):
            raise ValueError(f"names of batches cannot begin with {COMPACTED}")
        if batch and self._version().get(batch):
            return dict.fromkeys(("alerts", *counts), 0)
        folder = self._folder(batch or uuid.uuid4().hex)
        return self._write(stored(alerts), "overwrite", folder, counts)

    def append_new(
        self,
        alerts: DataFrame,
        days: int | None = None,
        counts: Mapping[str, Column] | None = None,
    ) -> dict[str, int]:
        """Append the alerts whose id is not stored yet; a rerun over the same logs adds none.

        Of alerts with equal ids the least row by time is taken. An alert without an id gets
        that of its content. ``days`` limits the search to the dates of the new alerts, so
        many more on either side, and alerts without a time; by default all dates are
        searched, since a later run dates its alerts later. Two calls at the same time do
        not see each other's alerts.
        """
        identified = alerts.withColumn("id", F.coalesce("id", alert_id()))
        identified = identified.select(*ALERT_COLUMNS).persist()
        try:
            return self.append_counted(self.unseen(identified, days), counts or {})
        finally:
            identified.unpersist()

    def unseen(self, alerts: DataFrame, days: int | None = None) -> DataFrame:
        """One row for each id that is not stored, see ``append_new``.

        Stored ids are first cut down to those of the new alerts, so what is joined and
        shuffled follows the new alerts; Spark may put a Bloom filter of their ids in front.
        """
        others = [name for name in ALERT_COLUMNS if name != "id"]
        once = alerts.groupBy("id").agg(F.min(F.struct(*others)).alias("row"))
        known = self.alerts()
        if days is not None:
            day = F.to_date("timestamp")
            first, last = alerts.agg(F.min(day), F.max(day)).first()
            dated = F.col("alert_date")
            near = dated.isNull()
            if first:
                margin = timedelta(days=days)
                near |= dated.between(F.lit(first - margin), F.lit(last + margin))
            known = known.where(near)
        repeated = known.join(once, "id", "left_semi").select("id")
        return once.join(repeated, "id", "left_anti").select("id", "row.*").select(*ALERT_COLUMNS)

    def append_one(self, alert: DataFrame) -> str:
        """Add a frame of one alert and return its id."""
        row = alert.select(*ALERT_COLUMNS).first()
        self.append(self.spark.createDataFrame([row], ALERT_SCHEMA))
        return row["id"]

    def alerts(self) -> DataFrame:
        return self._read(self.batches())

    def batches(self) -> list[str]:
        """Names of the batches that readers see."""
        version = self._version()
        return [
            name
            for name in self._names("batch=*")
            if not version.get(name) and (name in version or not name.startswith(COMPACTED))
        ]

    def compact(self, small_bytes: int = SMALL_BYTES) -> int:
        """Put the folders below ``small_bytes`` into a new one; returns how many there were.

        The new folder has a file for each date and severity, more where one is large. It
        counts from the moment that the version is written, so a reader has each alert once
        at any time, and a compaction that fails changes nothing. Replaced folders stay until
        ``vacuum``, for those who read them still. Appends may go on meanwhile; compactions
        must not overlap, and no batch that is compacted may be appended again meanwhile.
        """
        version = self._version()
        done = set(self._names("batch=*/_SUCCESS"))
        small = [
            name for name in self.batches() if name in done and self._size(name) < small_bytes
        ]
        if len(small) < 2:
            return 0
        target = COMPACTED + uuid.uuid4().hex
        rows = self._read(small).select(*ALERT_COLUMNS, "alert_date")
        self._write(rows, "overwrite", self._folder(target))
        there = set(self._names("batch=*"))
        # A name that only the store gave is not needed once its folder is gone.
        kept = {n: at for n, at in version.items() if n in there or not OWN_NAME.fullmatch(n)}
        self._publish({**kept, target: None, **dict.fromkeys(small, time.time())})
        return len(small)

    def vacuum(self, hours: float = RETAIN_HOURS) -> int:
        """Delete folders replaced over ``hours`` ago, and those of compactions that failed
        as long ago; returns how many. Readers must have ended by then."""
        before = time.time() - hours * 3600
        version = self._version()
        old = [
            name
            for name in self._names("batch=*")
            if (version.get(name) or before) < before
            or (
                name.startswith(COMPACTED)
                and name not in version
                and self._changed(self._folder(name)) < before
            )
        ]
        for name in old:
            self._files().delete(self._hadoop_path(self._folder(name)), True)
        for number in self._versions()[:-1]:
            folder = self._version_folder(number)
            if self._changed(folder) < before:
                self._files().delete(self._hadoop_path(folder), True)
        return len(old)

    def recent(self, limit: int = LATEST, severity: str | None = None) -> DataFrame:
        """The most recent alerts. Only the newest dates that are sure to hold them are read.

        Dates are counted from the newest on, twice as many at a time, until there are alerts
        enough; the counts come from the footers of the files. Alerts without a time come last
        and are read only if all others are too few. Alerts must be stored under one time
        zone, for their dates to be in the order of their times.
        """
        first = self._first_date(limit, severity)
        found = self.alerts() if first is None else self.alerts().where(F.col("alert_date") >= F.lit(first))
        return latest(found.select(*ALERT_COLUMNS), limit, severity)

    def _first_date(self, limit: int, severity: str | None) -> date | None:
        """Oldest date that the latest alerts can have, or None if all are needed."""
        alerts = self.alerts().where(F.col("alert_date").isNotNull())
        if severity:
            alerts = alerts.where(F.col("severity") == severity)
        # As many as there are folders of dates; the list of files has them all.
        named = {found for file in self.alerts().inputFiles() if (found := DATE_FOLDER.search(file))}
        days = sorted({date.fromisoformat(found[1]) for found in named}, reverse=True)
        total, done, step = 0, 0, 1
        while done < len(days):
            span = days[done : done + step]
            in_span = F.col("alert_date").between(F.lit(span[-1]), F.lit(span[0]))
            total += alerts.where(in_span).count()
            if total >= limit:
                return span[-1]
            done, step = done + step, 2 * step
        return None

    def count(self) -> int:
        return self.alerts().count()

    def clear(self) -> None:
        self._write(stored(self.spark.createDataFrame([], ALERT_SCHEMA)), "overwrite", self.path)

    def _read(self, batches: Sequence[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        reader = self.spark.read.schema(STORE_SCHEMA).option("basePath", self.path)
        return reader.parquet(*map(self._folder, batches))

    def _write(
        self, rows: DataFrame, mode: str, path: str, counts: Mapping[str, Column] | None = None
    ) -> dict[str, int]:
        written = Observation()
        (
            rows.hint("rebalance", *PARTITIONS)
            # Behind the shuffle, where a repeated task does not count twice.
            .observe(written, F.count("*").alias("alerts"), *[c.alias(n) for n, c in (counts or {}).items()])
            .write.mode(mode)
            .option("partitionOverwriteMode", "static")
            .partitionBy(*PARTITIONS)
            .parquet(path)
        )
        return written.get

    # A version has a row for each compacted folder and each folder that one stands for,
    # these with the time of the compaction. The newest version holds the whole state.

    def _version(self) -> dict[str, float | None]:
        numbers = self._versions()
        if not numbers:
            return {}
        rows = self.spark.read.schema(VERSION_SCHEMA).json(self._version_folder(numbers[-1]))
        return {row["batch"]: row["replaced"] for row in rows.collect()}

    def _publish(self, version: Mapping[str, float | None]) -> None:
        number = max(self._versions(), default=0) + 1
        rows = self.spark.createDataFrame(list(version.items()), VERSION_SCHEMA)
        # One file, so that a version is there as a whole or not at all.
        rows.coalesce(1).write.mode("error").json(self._version_folder(number))

    def _versions(self) -> list[int]:
        return sorted({int(name) for name in self._names("_versions/*/part-*")})

    def _version_folder(self, number: int) -> str:
        return f"{self.path}/_versions/{number:08d}"

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={batch}"

    # Spark lists no folders by themselves, so these ask the store's file system.

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return self._hadoop_path(self.path).getFileSystem(conf)

    def _names(self, pattern: str) -> list[str]:
        """Names of batches or versions with a file or folder of this pattern."""
        found = self._files().globStatus(self._hadoop_path(f"{self.path}/{pattern}")) or []
        paths = [status.getPath() for status in found]
        named = [path.getParent() if "/" in pattern else path for path in paths]
        return sorted(path.getName().removeprefix("batch=") for path in named)

    def _size(self, batch: str) -> int:
        return self._files().getContentSummary(self._hadoop_path(self._folder(batch))).getLength()

    def _changed(self, path: str) -> float:
        return self._files().getFileStatus(self._hadoop_path(path)).getModificationTime() / 1000
