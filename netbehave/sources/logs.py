"""Tab-separated Zeek logs as DataFrames.

Files are read as text columns by the CSV source and typed by lazy expressions, so an
unused column is never converted. A path may be a file, a folder or a glob. Files whose
headers name different fields are read per layout and united by name.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.constants import BUNDLE, FIELDS_TAG, SET_SEPARATOR, UNSET_FIELD
from netbehave.functions.columns import (
    epoch_time,
    ref,
    to_double,
    to_long,
    unset_to_null,
)
from netbehave.sources.schemas import SPARK_TYPES, column_name, fields_of, zeek_type

CSV_OPTIONS = {
    "sep": "\t",
    "comment": "#",
    "quote": "",
    "nullValue": UNSET_FIELD,
    "mode": "PERMISSIVE",
}

log = logging.getLogger(__name__)


@dataclass
class Layouts:
    """Files by the fields their headers name, and files without a header."""

    by_fields: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    headerless: list[str] = field(default_factory=list)


def text_schema(fields: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(field, T.StringType()) for field in fields])


def typed_column(log_name: str, field: str) -> Column:
    text = unset_to_null(ref(field))
    kind = zeek_type(log_name, field)
    target = SPARK_TYPES.get(kind, "string")
    if target == "double":
        column = to_double(text)
    elif target == "bigint":
        column = to_long(text)
    elif target == "int":
        column = to_long(text).try_cast("int")
    elif target == "boolean":
        column = F.when(text == "T", True).when(text == "F", False)
    elif target == "array<string>":
        column = F.split(text, SET_SEPARATOR)
    elif target == "array<double>":
        column = F.transform(F.split(text, SET_SEPARATOR), to_double)
    else:
        column = text
    return column.alias(column_name(field))


def typed(text: DataFrame, log_name: str, fields: tuple[str, ...]) -> DataFrame:
    """Typed columns of a log read as text, with ``event_time`` beside ``ts``."""
    rows = text.select(*[typed_column(log_name, name) for name in fields])
    return rows.withColumn("event_time", epoch_time(F.col("ts"))) if "ts" in fields else rows


def empty_log(
    spark: SparkSession, log_name: str, fields: tuple[str, ...] | None = None
) -> DataFrame:
    fields = fields or fields_of(log_name)
    return typed(spark.createDataFrame([], text_schema(fields)), log_name, fields)


def plain_name(uri: str) -> str:
    """File name as Spark reads it, the same from a listing and from file metadata."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def layouts(spark: SparkSession, path: str | list[str]) -> Layouts:
    """Layouts of the files of one or more paths, by one job over all of them.

    The first header line of a file counts. What reaches the driver is the list of files,
    which it needs to read them, and one header for each.
    """
    try:
        text = spark.read.text(path)
        files = [plain_name(file) for file in text.inputFiles()]
    except AnalysisException:
        return Layouts()
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    headers = (
        text.select("value", "_metadata.file_path", place.alias("place"))
        .where(F.col("value").startswith(FIELDS_TAG))
        .groupBy("file_path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    named = {plain_name(row["file_path"]): row["header"] for row in headers.collect()}
    found = Layouts()
    for file in files:
        fields = tuple(named.get(file, "").strip().split("\t")[1:])
        if fields:
            found.by_fields.setdefault(fields, []).append(file)
        else:
            found.headerless.append(file)
    return found


def read_files(
    spark: SparkSession, files: str | list[str], log_name: str, fields: tuple[str, ...]
) -> DataFrame:
    text = spark.read.schema(text_schema(fields)).options(**CSV_OPTIONS).csv(files)
    return typed(text, log_name, fields)


def read_log(
    spark: SparkSession,
    logs_dir: str,
    log_name: str,
    fields: tuple[str, ...] | None = None,
    headerless: list[str] | None = None,
) -> DataFrame:
    """Log ``<logs_dir>/<log_name>.log``; empty when it or its header is missing.

    Layouts come from the headers, which costs one job that reads the text; with ``fields``
    all files are taken to have that layout and the job is saved. Files without a header
    are left out with a warning and added to ``headerless``, if given.
    """
    path = f"{logs_dir}/{log_name}.log"
    if fields:
        try:
            return read_files(spark, path, log_name, tuple(fields))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_log(spark, log_name, tuple(fields))
    return read_log_files(spark, path, log_name, headerless)


def read_log_files(
    spark: SparkSession,
    path: str | list[str],
    log_name: str,
    headerless: list[str] | None = None,
) -> DataFrame:
    """The files of one or more paths as a log, each read by its own header."""
    found = layouts(spark, path)
    for file in found.headerless:
        log.warning("%s has no header and is left out", file)
    if headerless is not None:
        headerless += found.headerless
    if not found.by_fields:
        return empty_log(spark, log_name)
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [read_files(spark, files, log_name, names) for names, files in found.by_fields.items()],
    )


def load_logs(
    spark: SparkSession,
    logs_dir: str,
    names: Iterable[str] = BUNDLE,
    fields: Mapping[str, tuple[str, ...]] | None = None,
    headerless: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The logs detectors may use, by name. All are lazy: an unused log is not scanned.

    ``fields`` gives the layouts that are known, by log.
    """
    known = fields or {}
    return {
        name: read_log(spark, logs_dir, name, known.get(name), headerless) for name in names
    }
