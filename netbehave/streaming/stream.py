"""Logs and alerts as streams.

The windowed detectors take a streaming log as they take a batch one:

    conn = read_log_stream(spark, "/logs/drop", "conn")
    alerts = PortScanDetector(window="60 seconds").analyze({"conn": conn})
    write_alert_stream(alerts, AlertStore(spark, "/alerts"), "/checkpoints/port_scan")
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netbehave.sources.alert_store import AlertStore
from netbehave.sources.logs import CSV_OPTIONS, empty_log, layouts, read_log_files, text_schema, typed
from netbehave.sources.schemas import column_name, fields_of


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_log_stream(
    spark: SparkSession,
    folder: str,
    log_name: str,
    fields: tuple[str, ...] | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Log files dropped into a folder, all of one layout (the usual one by default).

    The headers of the files that are there at the start are checked, and another layout
    is refused, because its values would stand in the wrong columns.
    """
    names = tuple(fields or fields_of(log_name))
    others = [found for found in layouts(spark, folder).by_fields if found != names]
    if others:
        raise ValueError(f"{folder}: files have the fields {others[0]}, not {names}")
    reader = spark.readStream.schema(text_schema(names)).options(**CSV_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return typed(reader.csv(folder), log_name, names)


def stage_log_stream(
    spark: SparkSession,
    folder: str,
    log_name: str,
    staged: str,
    checkpoint: str | None = None,
    max_files: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Turn log files of any layouts, as they arrive in a folder, into one Parquet table.

    Each micro-batch looks up the headers of its own files and reads every file by its own
    header, so layouts may change from file to file. Fields that the log is not known to have
    become text columns; files without a header are left out with a warning. A batch is a
    folder of its own, so one that is repeated replaces itself. Read the table as a stream
    with ``read_staged_stream``.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        # The names of a batch's new files, which Spark's source has listed in the driver too.
        files = [row["path"] for row in batch.collect()]
        if files:
            read_log_files(spark, files, log_name).write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")

    # Nothing but the names is read here: the content is a column that is not asked for.
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (
        reader.load(folder).select("path").writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint or checkpoint_location(spark, f"staged-{log_name}"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_staged(
    spark: SparkSession, staged: str, log_name: str, more: tuple[str, ...] = (), stream: bool = False
) -> DataFrame:
    """A table of ``stage_log_stream``, with the fields of the log and ``more`` text fields."""
    schema = empty_log(spark, log_name).schema
    for name in more:
        schema = schema.add(column_name(name), "string")
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(staged)
    return rows.drop("batch")


def read_staged_stream(
    spark: SparkSession, staged: str, log_name: str, more: tuple[str, ...] = ()
) -> DataFrame:
    return read_staged(spark, staged, log_name, more, stream=True)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Folder for a stream's progress under the checkpoint folder the session names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint folder")
    return f"{root.rstrip('/')}/{name}"


def write_alert_stream(
    alerts: DataFrame,
    store: AlertStore,
    checkpoint: str | None = None,
    name: str = "alerts",
    once: bool = False,
) -> StreamingQuery:
    """Append a stream of alerts to a store; ``once`` works off what has arrived.

    A restarted stream may repeat its last batch. Batches are stored under the identity of
    the stream's checkpoint and their number, so a repeated one replaces itself.
    """
    spark = alerts.sparkSession
    place = checkpoint or checkpoint_location(spark, name)
    identity: list[str] = []

    def add(batch: DataFrame, batch_id: int) -> None:
        if not identity:
            metadata = spark.read.text(f"{place}/metadata").first()["value"]
            identity.append(json.loads(metadata)["id"])
        store.append(batch, f"{identity[0]}-{batch_id}")

    writer = (
        alerts.writeStream.outputMode("append")
        .option("checkpointLocation", place)
        .foreachBatch(add)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
