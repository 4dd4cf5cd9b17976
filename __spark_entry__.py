"""

``events`` stands in for connection logs, ``pages.url`` for DNS queries and
``documents.text`` for long texts; the adapters below only rename and derive columns.
"""

from __future__ import annotations

import importlib
import importlib.util
import uuid
from collections.abc import Callable
from datetime import date
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.constants import FAILED_STATES
from netbehave.functions.columns import (
    epoch_time,
    number,
    to_double,
    to_long,
    unset_to_null,
)
from netbehave.operators.connections import failed_to_port
from netbehave.sources.alert_store import alert_id, latest
from netbehave.sources.logs import read_log
from netbehave.sources.schemas import ALERT_COLUMNS
from netbehave.sources.sketch_store import bound
from netbehave.streaming.stream import read_staged, stage_log_stream

SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters that select some but not all rows of the driver's tables.
PORT_SCAN = nb.PortScanDetector(min_ports=50)
BRUTE_FORCE = nb.BruteForceDetector(min_attempts=10)
BEACONING = nb.BeaconingDetector(max_jitter=0.6, min_connections=10)
DNS_TUNNEL = nb.DnsTunnelDetector(min_entropy=4.2)
EXFILTRATION = nb.ExfiltrationDetector(max_bytes=1000)

FOUND = ["detector", "severity", "src_ip", "dst_ip", "description", "mitre", "evidence"]


# ---------------------------------------------------------------- adapters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_key(events: DataFrame) -> DataFrame:
    """``events`` with the number inside ``props`` as column ``k``."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def host(number_column: str) -> Column:
    return F.concat(F.lit("10.0."), F.col(number_column) % 4, F.lit("."), F.col(number_column))


def as_conn(events: DataFrame, auth: bool = False) -> DataFrame:
    """``events`` as a connection log; ``auth`` moves half of the ports to 22."""
    port = F.col("k")
    time = F.col("ts").cast("timestamp")
    return with_key(events).select(
        host("user_id").alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        (F.when(port < 50, 22).otherwise(port) if auth else port).alias("dst_port"),
        F.when(F.col("event_type") == "error", "REJ")
        .when(F.col("event_type") == "signup", "S0")
        .otherwise("SF")
        .alias("conn_state"),
        (F.unix_micros(time) / F.lit(1e6)).alias("ts"),
        time.alias("event_time"),
        F.floor("value").alias("orig_bytes"),
        F.col("event_id").alias("uid"),
    )


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_conn(table(spark, sf_dir, "events"))


def auth_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_conn(table(spark, sf_dir, "events"), auth=True)


def hot_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a third of its rows moved to one pair, and times in whole minutes."""
    rows = conn(spark, sf_dir)
    hot = F.col("uid") % 3 == 0
    return rows.withColumns(
        {
            "src_ip": F.when(hot, "hot").otherwise(F.col("src_ip")),
            "dst_ip": F.when(hot, "hot").otherwise(F.col("dst_ip")),
            "ts": F.floor(F.col("ts") / 60) * F.lit(60.0),
        }
    )


def odd_conn(spark: SparkSession, sf_dir: str, auth: bool = False) -> DataFrame:
    """The log with nulls, unreadable values and repeated rows, as texts."""
    rows = as_conn(table(spark, sf_dir, "events"), auth)
    uid = F.col("uid")

    def gap(name: str, every: int, at: int, bad: str | None = None) -> Column:
        return F.when(uid % every == at, F.lit(bad)).otherwise(F.col(name).cast("string"))

    return rows.unionByName(rows.where(uid % 13 == 0)).select(
        gap("src_ip", 11, 1).alias("src_ip"),
        gap("dst_ip", 7, 2).alias("dst_ip"),
        gap("dst_port", 17, 3, "abc").alias("dst_port"),
        gap("conn_state", 19, 4).alias("conn_state"),
        F.when(uid % 5 == 0, F.lit(None)).otherwise(F.floor("ts")).cast("double").alias("ts"),
        gap("orig_bytes", 6, 5, "-").alias("orig_bytes"),
        F.when(uid % 4 != 1, uid.cast("string")).alias("uid"),
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        host("page_id").alias("src_ip"),
        F.col("url").alias("query"),
        F.col("page_id").cast("string").alias("uid"),
    )


def odd_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS rows without a source column, some without a query and some with an empty one."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.when(page % 9 == 0, F.lit(None))
        .when(page % 9 == 1, F.lit(""))
        .otherwise(F.col("url"))
        .alias("query")
    )


def hot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the pages, a third of the rows moved to names of their own below one domain."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.when(page % 3 == 0, F.concat(F.lit("X"), page, F.lit(".cdn.Hot.example.")))
        .otherwise(F.regexp_extract("url", "://([^/?#]*)", 1))
        .alias("query")
    )


def found(detector: nb.Detector, **logs: DataFrame) -> DataFrame:
    return detector.analyze(logs)


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the three standard detectors, brute force over the login variant."""
    return (
        found(PORT_SCAN, conn=conn(spark, sf_dir))
        .unionByName(found(BRUTE_FORCE, conn=auth_conn(spark, sf_dir)))
        .unionByName(found(BEACONING, conn=conn(spark, sf_dir)))
    )


def dated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as alerts that carry the time of the event."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.lit("EventDetector").alias("detector"),
            F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("severity"),
            host("user_id").alias("src_ip"),
            F.lit(None).cast("string").alias("dst_ip"),
            F.concat(F.lit("event "), F.col("event_id")).alias("description"),
            F.lit("").alias("mitre"),
            F.col("props").alias("evidence"),
            F.lit("{}").alias("cti_context"),
        )
        .withColumn("id", alert_id())
        .select(*ALERT_COLUMNS)
    )


def scratch(spark: SparkSession) -> str:
    """New folder on the cluster's shared storage, in one place for each application.

    That is the checkpoint folder the session names, or else its warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def volumes_ranked(log: DataFrame) -> DataFrame:
    return nb.ranked(volumes(log))


def ntz(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("timestamp_ntz") for name in names}


# ---------------------------------------------------------------- queries


def conn_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conn(spark, sf_dir).select(
        "uid", "src_ip", "dst_ip", "dst_port", "conn_state", "orig_bytes"
    )


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("k") < 50, F.concat("k", F.lit(".0"))).otherwise(F.col("event_type"))
    return (
        with_key(table(spark, sf_dir, "events"))
        .withColumn("text", text)
        .select(
            "event_id",
            to_double(F.col("text")).alias("number"),
            to_long(F.col("text")).alias("whole"),
        )
    )


def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "view", "-")
        .when(F.col("event_type") == "click", "(empty)")
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", unset_to_null(text).alias("state"))


def epoch_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conn(spark, sf_dir)
    return rows.select("uid", epoch_time(F.col("ts")).cast("timestamp_ntz").alias("event_time"))


def port_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = auth_conn(spark, sf_dir)
    return rows.where(number(rows, "port") == 22).select("uid", "src_ip", "dst_port")


def failed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conn(spark, sf_dir)
    return rows.where(F.col("conn_state").isin(*FAILED_STATES)).select("uid", "conn_state")


def failed_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = auth_conn(spark, sf_dir)
    return rows.where(failed_to_port(rows, 22)).select("uid", "src_ip", "conn_state")


def intervals_of(log: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rounded = {name: F.round(name, 3) for name in ("ts", "interval")}
        return nb.beacon_intervals(log(spark, sf_dir)).withColumns(rounded)

    return query


def volumes(log: DataFrame) -> DataFrame:
    """Byte sums as whole numbers; those of the tables fit."""
    return nb.exfil_features(log).withColumn(
        "total_orig_bytes", F.col("total_orig_bytes").cast("bigint")
    )


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.text_entropy(table(spark, sf_dir, "documents"), "doc_id", "text")


def alerts_of(detector: nb.Detector, log: Callable, name: str = "conn") -> Callable:
    return lambda spark, sf_dir: found(detector, **{name: log(spark, sf_dir)}).select(*FOUND)


def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(dated_alerts(spark, sf_dir), 50, "HIGH").select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "severity",
        "src_ip",
        "description",
        F.variant_get("evidence", "$.k", "int").alias("k"),
    )


def alert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_alerts(spark, sf_dir).agg(F.count("*").alias("alerts"))


def alert_evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = F.parse_json("evidence")
    names = ("distinct_ports", "failed_attempts", "n_conns", "jitter")
    return all_alerts(spark, sf_dir).select(
        "detector",
        "src_ip",
        "dst_ip",
        *[F.variant_get(decoded, f"$.{name}", "double").alias(name) for name in names],
    )


def alert_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(PORT_SCAN, conn=conn(spark, sf_dir)).select("id", "src_ip")


def cti_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicators = table(spark, sf_dir, "labels").select(
        host("doc_id").alias("src_ip"), F.col("quality").alias("confidence")
    )
    return nb.enrich(all_alerts(spark, sf_dir), indicators).select(
        "detector", "src_ip", "dst_ip", "cti_context"
    )


def port_scan_windowed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return nb.port_scan_windowed(conn(spark, sf_dir), "1 day", **options).withColumns(
        ntz("window_start", "window_end")
    )


def brute_force_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.brute_force_windowed(auth_conn(spark, sf_dir), 22, "5 days").withColumns(
        ntz("window_start", "window_end")
    )


def beaconing_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.beaconing_windowed(conn(spark, sf_dir), "10 days").withColumns(
        ntz("window_start", "window_end")
    )


def streamed(
    feature: Callable[[DataFrame], DataFrame],
    auth: bool = False,
    times: tuple[str, ...] = ("window_start", "window_end"),
) -> Callable:
    """Run a windowed feature as a stream over the files of ``events``.

    The stream works off what is there and stops; its result is read back from the files
    it wrote. A last row far ahead of all others ends the input and closes every window but
    its own.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = table(spark, sf_dir, "events").schema
        folder = scratch(spark)
        # A pattern, because a stream takes a folder or a pattern but no single file.
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
        last = table(spark, sf_dir, "events").agg(
            *[F.max(name).cast(schema[name].dataType).alias(name) for name in schema.names]
        )
        last = last.withColumn("ts", F.expr("ts + INTERVAL 1000 DAYS"))
        last.select(*schema.names).write.parquet(f"{folder}/last")
        source = source.union(spark.readStream.schema(schema).parquet(f"{folder}/last"))
        result = feature(as_conn(source, auth))
        result = result.withColumns(ntz(*times)) if times else result
        stream = (
            result.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{folder}/result")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{folder}/result")

    return query


def log_columns() -> dict[str, Column]:
    port = F.col("dst_port").cast("string")
    return {
        "ts": F.format_string("%.6f", "ts"),
        "uid": F.col("uid").cast("string"),
        "id.orig_h": F.col("src_ip"),
        "id.resp_h": F.col("dst_ip"),
        "id.resp_p": F.when(F.col("dst_port") < 90, port).otherwise("-"),
        "conn_state": F.when(F.col("dst_ip") == "view", "(empty)").otherwise(F.col("conn_state")),
        "orig_bytes": F.when(F.col("dst_ip") == "click", "bad").otherwise(
            F.col("orig_bytes").cast("string")
        ),
    }


def write_log(rows: DataFrame, path: str, columns: dict[str, Column]) -> None:
    """Rows as a Zeek log of one file for each partition, and one without rows.

    Every file has a header, and the one without rows comment lines and a closing line too.
    """
    line = F.concat_ws("\t", *columns.values())
    fields = "\t".join(["#fields", *columns])
    marks = rows.sparkSession.createDataFrame(
        [("#path\tconn",), (fields,), ("#note",), ("#close\tnow",)], "line string"
    )
    # The lower 33 bits number the rows of a partition.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    body = rows.select(number.alias("number"), line.alias("line"))
    headed = F.when(F.col("number") == 0, F.array(F.lit(fields), "line", F.lit("#note"))).otherwise(F.array("line"))
    files = marks.coalesce(1).union(body.select(F.explode(headed).alias("line")))
    files.write.mode("append").text(path)


def written_log(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> str:
    """Folder with the connections as a log in two layouts, the second in another order."""
    folder = scratch(spark)
    rows = conn(spark, sf_dir)
    write_log(rows.where("uid % 2 = 0"), f"{folder}/conn.log", columns)
    turned = dict(reversed(list(columns.items())))
    write_log(rows.where("uid % 2 = 1"), f"{folder}/conn.log", turned)
    return folder


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written log, read by its headers."""
    log = read_log(spark, written_log(spark, sf_dir, log_columns()), "conn")
    names = [name.replace(".", "_") for name in log_columns() if name != "ts"]
    return log.withColumns(ntz("event_time")).select(*names, "event_time")


def run_over_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: read the written logs, detect, store, and read the stored alerts."""
    columns = log_columns() | {"id.resp_p": F.col("dst_port").cast("string")}
    folder = written_log(spark, sf_dir, columns)
    store = nb.AlertStore(spark, f"{folder}/alerts")
    done = nb.run(spark, folder, [PORT_SCAN, BEACONING], store, staging=f"{folder}/staged")
    done.release()
    return store.alerts().select(*FOUND)


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append alerts of two kinds and an empty result to a new table and read all of it."""
    store = nb.AlertStore(spark, f"{scratch(spark)}/alerts")
    store.append(found(PORT_SCAN, conn=conn(spark, sf_dir)))
    store.append(found(nb.PortScanDetector(min_ports=10**6), conn=conn(spark, sf_dir)))
    store.append(found(BRUTE_FORCE, conn=auth_conn(spark, sf_dir)))
    return store.alerts().select(*FOUND)


def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in a table before and after it is cleared and filled again."""
    store = nb.AlertStore(spark, f"{scratch(spark)}/alerts")
    alerts = found(PORT_SCAN, conn=conn(spark, sf_dir))
    store.append(alerts)
    before = store.count()
    store.clear()
    cleared = store.count()
    store.append(alerts.union(alerts))
    return store.alerts().agg(
        F.lit(before).cast("long").alias("before"),
        F.lit(cleared).cast("long").alias("cleared"),
        F.count("*").alias("after"),
    )


def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by listed thresholds, windowed where a window is listed."""
    listed = {"port_scan": {"min_ports": 3, "window_sec": 86_400}}
    detector = nb.PortScanDetector.from_thresholds(listed, windowed=True)
    alerts = found(detector, conn=conn(spark, sf_dir))
    return alerts.groupBy("src_ip", "description").agg(F.count("*").alias("alerts"))


def alert_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON, with some of the fields read back out of it."""
    rendered = nb.alert_json(all_alerts(spark, sf_dir))
    names = ("detector", "severity", "src_ip", "dst_ip", "mitre")
    return rendered.select(
        *[F.get_json_object("json", f"$.{name}").alias(name) for name in names],
        F.json_object_keys("json").alias("keys"),
    ).withColumn("keys", F.array_join("keys", ","))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert lines after enrichment, with the mark of a known source."""
    indicators = table(spark, sf_dir, "labels").select(
        host("doc_id").alias("src_ip"), F.col("quality").alias("confidence")
    )
    return nb.render(nb.enrich(all_alerts(spark, sf_dir), indicators))


def cti_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections from addresses of both families, marked by the longest known prefix."""
    user, label = F.col("user_id"), F.col("doc_id")
    rows = with_key(table(spark, sf_dir, "events")).select(
        "event_id",
        F.when(
            F.col("event_id") % 2 == 0,
            F.concat(F.lit("10."), user % 256, F.lit("."), "k", F.lit("."), F.col("event_id") % 256),
        )
        .otherwise(
            F.concat(
                F.lit("2001:DB8:"), F.hex(user % 65_536), F.lit("::"), F.hex(F.col("event_id") % 65_536)
            )
        )
        .alias("dst_ip"),
        F.lit("{}").alias("cti_context"),
    )
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(label % 65_536)), F.lit("::/48"))
    four = F.concat(F.lit("10."), label % 256, F.lit("."))
    indicators = table(spark, sf_dir, "labels").select(
        F.when(label % 3 == 0, F.concat(four, F.lit("0.0/16")))
        .when(label % 3 == 1, F.concat(four, label % 100, F.lit("."), label % 5, F.lit("/24")))
        .otherwise(six)
        .alias("prefix"),
        F.col("quality").alias("confidence"),
    )
    return nb.enrich_prefixes(rows, indicators, "dst_ip").select("event_id", "cti_context")


def port_bitmap_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.port_bitmap_windowed(conn(spark, sf_dir), "1 day", "12 hours").withColumns(
        ntz("window_start", "window_end")
    )


def port_bitmap_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports of which some are no numbers, from the words of two parts of the log."""
    log = odd_conn(spark, sf_dir)
    late = F.coalesce(F.col("ts") > 1.7e9, F.lit(False))
    parts = [nb.port_words(log.where(late)), nb.port_words(log.where(~late))]
    return nb.merged_ports(parts[0].unionByName(parts[1]))


SPAN = (date(2024, 1, 3), date(2024, 1, 20))


def sketch_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of a span of days from stored sketches, held against exact ones."""
    log = conn(spark, sf_dir)
    store = nb.SketchStore(spark, f"{scratch(spark)}/sketches")
    store.write(log)
    store.write(log)  # a rerun replaces its days
    exact = nb.port_scan_features(log.where(F.to_date("event_time").between(*map(F.lit, SPAN))))
    estimated = store.features(*SPAN)
    both = exact.alias("exact").join(estimated.alias("estimated"), "src_ip", "full")

    def within(name: str) -> Column:
        real, found = F.col(f"exact.{name}"), F.col(f"estimated.{name}")
        return (F.abs(found - real) <= F.lit(bound()) * real).alias(f"{name}_within")

    return both.select(
        "src_ip",
        F.col("estimated.total_conns").alias("total_conns"),
        within("distinct_ports"),
        within("distinct_hosts"),
    )


def recent_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest alerts of one severity out of a stored table of many dates."""
    store = nb.AlertStore(spark, f"{scratch(spark)}/alerts")
    store.append(dated_alerts(spark, sf_dir))
    return store.recent(50, "HIGH").select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "severity",
        "src_ip",
        "description",
        F.variant_get("evidence", "$.k", "int").alias("k"),
    )


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest alerts of a table of five appends, of which compaction made one folder."""
    store = nb.AlertStore(spark, f"{scratch(spark)}/alerts")
    alerts = dated_alerts(spark, sf_dir)
    for part in range(5):
        store.append(alerts.where(F.pmod(F.xxhash64("id"), F.lit(5)) == part), f"part-{part}")
    store.compact()
    store.append(alerts, "part-0")
    store.vacuum(0)
    return store.alerts().groupBy(F.col("alert_date"), F.col("severity")).agg(
        F.count("*").alias("alerts"), F.count_distinct("id").alias("ids"), F.count_distinct("batch").alias("folders")
    )


def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by detector and severity after a run that is repeated, and as the runs count them."""
    folder = written_log(spark, sf_dir, log_columns() | {"id.resp_p": F.col("dst_port").cast("string")})
    store = nb.AlertStore(spark, f"{folder}/alerts")
    runs = []
    for _ in range(2):
        runs.append(nb.run(spark, folder, [PORT_SCAN, BEACONING], store, once=True))
        runs[-1].release()
    counted = F.coalesce(
        *[
            F.when((F.col("detector") == name) & (F.col("severity") == severity), F.lit(n))
            for (name, severity), n in runs[0].counts.items()
        ],
        F.lit(0),
    )
    return (
        store.alerts()
        .groupBy("detector", "severity")
        .agg(F.count("*").alias("alerts"))
        .withColumns({"counted": counted.cast("bigint"), "repeated": F.lit(runs[1].stored).cast("bigint")})
    )


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written log of two layouts, read as a stream of files and staged."""
    folder = written_log(spark, sf_dir, log_columns())
    stream = stage_log_stream(
        spark, f"{folder}/conn.log", "conn", f"{folder}/staged", f"{folder}/state", max_files=1, once=True
    )
    stream.awaitTermination()
    log = read_staged(spark, f"{folder}/staged", "conn")
    names = [name.replace(".", "_") for name in log_columns() if name != "ts"]
    return log.withColumns(ntz("event_time")).select(*names, "event_time")


def sessions_of(log: DataFrame) -> DataFrame:
    """Sessions with byte sums as whole numbers; those of the tables fit."""
    found = nb.exfil_sessions(log, "12 hours")
    return found.withColumn("total_orig_bytes", F.col("total_orig_bytes").cast("bigint"))


def exfil_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_of(conn(spark, sf_dir)).withColumns(ntz("session_start", "session_end"))


def entry(spark: SparkSession) -> DataFrame:
    """Port scan, brute force and beaconing alerts of the smallest tables."""
    return all_alerts(spark, SMOKE_DIR).select(*FOUND)


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "conn_project": conn_project,
        "numeric_coerce": numeric_coerce,
        "null_tokens": null_tokens,
        "epoch_datetime": epoch_datetime,
        "port_filter": port_filter,
        "failed_states": failed_states,
        "failed_logins": failed_logins,
        "port_scan_features": lambda s, d: nb.port_scan_features(conn(s, d)),
        "port_scan_ranked": lambda s, d: nb.ranked(nb.port_scan_features(conn(s, d))),
        "brute_force_features": lambda s, d: nb.brute_force_features(auth_conn(s, d)),
        "beacon_intervals": intervals_of(conn),
        "beacon_intervals_hot": intervals_of(hot_conn),
        "beaconing_features": lambda s, d: nb.beaconing_features(conn(s, d)),
        "beaconing_features_hot": lambda s, d: nb.beaconing_features(hot_conn(s, d)),
        "beaconing_ranked": lambda s, d: nb.ranked(nb.beaconing_features(conn(s, d))),
        "dns_features": lambda s, d: nb.dns_features(dns(s, d)),
        "text_entropy": text_entropy,
        "exfil_features": lambda s, d: volumes(conn(s, d)),
        "port_scan_alerts": alerts_of(PORT_SCAN, conn),
        "brute_force_alerts": alerts_of(BRUTE_FORCE, auth_conn),
        "beaconing_alerts": alerts_of(BEACONING, conn),
        "dns_tunnel_alerts": alerts_of(DNS_TUNNEL, dns, "dns"),
        "exfil_alerts": alerts_of(EXFILTRATION, conn),
        "alert_union": lambda s, d: all_alerts(s, d).select(*FOUND),
        "severity_histogram": lambda s, d: nb.severity_histogram(all_alerts(s, d)),
        "alert_summary": lambda s, d: nb.summary(all_alerts(s, d)),
        "recent_alerts": recent_alerts,
        "alert_count": alert_count,
        "alert_render": lambda s, d: nb.render(all_alerts(s, d)),
        "alert_evidence_json": alert_evidence_json,
        "alert_identity": alert_identity,
        "cti_enrich": cti_enrich,
        "port_scan_windowed": port_scan_windowed,
        "port_scan_sliding": lambda s, d: port_scan_windowed(s, d, slide="12 hours"),
        "brute_force_windowed": brute_force_windowed,
        "beaconing_windowed": beaconing_windowed,
        "port_scan_stream": streamed(lambda log: nb.port_scan_windowed(log, "1 day")),
        "brute_force_stream": streamed(
            lambda log: nb.brute_force_windowed(log, 22, "5 days"), auth=True
        ),
        "beaconing_stream": streamed(lambda log: nb.beaconing_windowed(log, "10 days")),
        "log_scan": log_scan,
        "alert_table": alert_table,
        "run_over_logs": run_over_logs,
        "store_count": store_count,
        "threshold_alerts": threshold_alerts,
        "alert_objects": alert_objects,
        "marked_lines": marked_lines,
        "brute_force_ranked": lambda s, d: nb.ranked(nb.brute_force_features(auth_conn(s, d))),
        "dns_ranked": lambda s, d: nb.ranked(nb.dns_features(dns(s, d))),
        "exfil_ranked": lambda s, d: volumes_ranked(conn(s, d)),
        "port_scan_odd": lambda s, d: nb.port_scan_features(odd_conn(s, d)),
        "brute_force_odd": lambda s, d: nb.brute_force_features(odd_conn(s, d, auth=True)),
        "beacon_intervals_odd": intervals_of(odd_conn),
        "beaconing_odd": lambda s, d: nb.beaconing_features(odd_conn(s, d)),
        "exfil_odd": lambda s, d: volumes(odd_conn(s, d)),
        "dns_odd": lambda s, d: nb.dns_features(odd_dns(s, d)),
        "cti_prefix": cti_prefix,
        "port_bitmap_sliding": port_bitmap_sliding,
        "port_bitmap_odd": port_bitmap_odd,
        "port_bitmap_stream": streamed(lambda log: nb.port_bitmap_windowed(log, "1 day")),
        "sketch_span": sketch_span,
        "exfil_sessions": exfil_sessions,
        "recent_from_store": recent_from_store,
        "compacted_store": compacted_store,
        "repeated_runs": repeated_runs,
        "parent_domains": lambda s, d: nb.parent_domain_features(hot_names(s, d), 0.005),
        "log_stream": log_stream,
        "beaconing_stateful": streamed(
            lambda log: nb.beaconing_stateful(log, "400 days"), times=()
        ),
        "exfil_sessions_stream": streamed(sessions_of, times=("session_start", "session_end")),
    }


# ---------------------------------------------------------------- oracle

EVENTS_AS_CONN = """
SELECT concat('10.0.', user_id % 4, '.', user_id) AS src_ip,
       event_type AS dst_ip,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst_port,
       CASE event_type WHEN 'error' THEN 'REJ' WHEN 'signup' THEN 'S0' ELSE 'SF' END
         AS conn_state,
       epoch_us(ts) / 1e6 AS ts,
       ts AS event_time,
       CAST(floor(value) AS BIGINT) AS orig_bytes,
       event_id AS uid
FROM events
"""
WITH_CONN = f"""
WITH conn AS ({EVENTS_AS_CONN}),
auth AS (SELECT * REPLACE (CASE WHEN dst_port < 50 THEN 22 ELSE dst_port END AS dst_port)
         FROM conn),
failed AS (SELECT * FROM auth WHERE dst_port = 22
           AND conn_state IN ('REJ', 'S0', 'RSTO', 'RSTR', 'RSTOS0', 'SH')),
scans AS (SELECT src_ip, count(DISTINCT dst_port) AS distinct_ports,
                 count(DISTINCT dst_ip) AS distinct_hosts, count(*) AS total_conns
          FROM conn GROUP BY src_ip),
attempts AS (SELECT src_ip, count(*) AS failed_attempts,
                    arg_min(dst_ip, (ts, uid)) AS dst_ip
             FROM failed GROUP BY src_ip),
gaps AS (SELECT src_ip, dst_ip, ts,
                ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts) AS gap
         FROM conn),
beacons AS (SELECT src_ip, dst_ip, count(*) AS n_conns,
                   CAST(format('{{:.2f}}', avg(gap)) AS DOUBLE) AS mean_interval,
                   CAST(format('{{:.4f}}', stddev_pop(gap) / avg(gap)) AS DOUBLE) AS jitter
            FROM gaps GROUP BY src_ip, dst_ip HAVING count(*) >= 3 AND avg(gap) > 0),
volumes AS (SELECT src_ip, dst_ip, CAST(sum(coalesce(orig_bytes, 0)) AS BIGINT)
                     AS total_orig_bytes, count(*) AS n_conns
            FROM conn GROUP BY src_ip, dst_ip),
scan_alerts AS (
  SELECT 'PortScanDetector' AS detector, 'MEDIUM' AS severity, src_ip,
         CAST(NULL AS VARCHAR) AS dst_ip,
         format('Port scan detecte : {{}} ports distincts contactes sur {{}} hote(s) '
                '(seuil : 50)', distinct_ports, distinct_hosts) AS description,
         'T1046' AS mitre,
         CAST(json_object('distinct_ports', distinct_ports, 'distinct_hosts', distinct_hosts,
                          'total_conns', total_conns, 'threshold', 50) AS VARCHAR) AS evidence
  FROM scans WHERE distinct_ports >= 50),
brute_alerts AS (
  SELECT 'BruteForceDetector' AS detector, 'HIGH' AS severity, src_ip, dst_ip,
         format('Brute force SSH detecte : {{}} tentatives echouees sur le port 22 '
                '(seuil : 10)', failed_attempts) AS description,
         'T1110' AS mitre,
         CAST(json_object('failed_attempts', failed_attempts, 'port', 22, 'threshold', 10)
              AS VARCHAR) AS evidence
  FROM attempts WHERE failed_attempts >= 10),
beacon_alerts AS (
  SELECT 'BeaconingDetector' AS detector, 'CRITICAL' AS severity, src_ip, dst_ip,
         format('Beaconing C2 detecte : {{}} connexions tres regulieres (jitter {{:.1f}}%, '
                'intervalle moyen {{:.0f}}s, seuil jitter 60%)',
                n_conns, jitter * 100, mean_interval) AS description,
         'T1071' AS mitre,
         CAST(json_object('n_conns', n_conns, 'jitter', jitter,
                          'mean_interval', mean_interval, 'max_jitter', CAST(0.6 AS DOUBLE))
              AS VARCHAR) AS evidence
  FROM beacons WHERE jitter <= 0.6 AND n_conns >= 10),
alerts AS (SELECT * FROM scan_alerts UNION ALL SELECT * FROM brute_alerts
           UNION ALL SELECT * FROM beacon_alerts)
"""
WITH_DNS = """
WITH names AS (
  SELECT concat('10.0.', page_id % 4, '.', page_id) AS src_ip, url AS query,
         CAST(page_id AS VARCHAR) AS uid, CAST(length(url) AS INTEGER) AS qlen,
         round_even(list_aggregate(string_split(url, ''), 'entropy'), 3) AS entropy
  FROM pages WHERE url IS NOT NULL)
"""
INTERVALS_SQL = """
SELECT src_ip, dst_ip, round(ts, 3) AS ts,
       round(ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts), 3) AS interval
FROM {log} WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND ts IS NOT NULL"""
BEACONS_SQL = """
SELECT src_ip, dst_ip, count(*) AS n_conns,
       CAST(format('{{:.2f}}', avg(gap)) AS DOUBLE) AS mean_interval,
       CAST(format('{{:.4f}}', stddev_pop(gap) / avg(gap)) AS DOUBLE) AS jitter
FROM (SELECT src_ip, dst_ip,
             ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts) AS gap
      FROM {log} WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND ts IS NOT NULL)
GROUP BY src_ip, dst_ip HAVING count(*) >= 3 AND avg(gap) > 0"""
WITH_HOT = (
    WITH_CONN
    + """, hot AS (
SELECT CASE WHEN uid % 3 = 0 THEN 'hot' ELSE src_ip END AS src_ip,
       CASE WHEN uid % 3 = 0 THEN 'hot' ELSE dst_ip END AS dst_ip,
       floor(ts / 60) * 60 AS ts FROM conn)
"""
)
WITH_ODD = (
    WITH_CONN
    + """, odd AS (
SELECT CASE WHEN uid % 11 <> 1 THEN src_ip END AS src_ip,
       CASE WHEN uid % 7 <> 2 THEN dst_ip END AS dst_ip,
       CASE WHEN uid % 17 <> 3 THEN dst_port END AS port,
       CASE WHEN uid % 17 = 3 THEN 'abc' ELSE CAST(dst_port AS VARCHAR) END AS dst_port,
       CASE WHEN uid % 19 <> 4 THEN conn_state END AS conn_state,
       CASE WHEN uid % 5 <> 0 THEN floor(ts) END AS ts,
       CASE WHEN uid % 6 <> 5 THEN orig_bytes ELSE 0 END AS orig_bytes,
       CASE WHEN uid % 4 <> 1 THEN CAST(uid AS VARCHAR) END AS uid
FROM (SELECT * FROM auth_or_conn UNION ALL SELECT * FROM auth_or_conn WHERE uid % 13 = 0))
"""
)


def windowed_scan_sql(starts: str, days: str) -> str:
    return f"""
SELECT window_start, window_start + INTERVAL {days} AS window_end, src_ip,
       count(DISTINCT dst_port) AS distinct_ports, count(DISTINCT dst_ip) AS distinct_hosts,
       count(*) AS total_conns
FROM (SELECT *, {starts} AS window_start FROM conn) GROUP BY ALL"""


EPOCH = "TIMESTAMP '1970-01-01'"

DAILY_SCANS_SQL = windowed_scan_sql(
    f"time_bucket(INTERVAL 1 DAY, event_time, {EPOCH})", "1 DAY"
)
WINDOWED_ATTEMPTS_SQL = f"""
SELECT window_start, window_start + INTERVAL 5 DAY AS window_end, src_ip,
       count(*) AS failed_attempts, arg_min(dst_ip, (ts, uid)) AS dst_ip
FROM (SELECT *, time_bucket(INTERVAL 5 DAY, event_time, {EPOCH}) AS window_start FROM failed)
GROUP BY window_start, src_ip"""
WINDOWED_BEACONS_SQL = f"""
SELECT window_start, window_start + INTERVAL 10 DAY AS window_end, src_ip, dst_ip,
       count(*) AS n_conns,
       CAST(format('{{:.2f}}', avg(gap)) AS DOUBLE) AS mean_interval,
       CAST(format('{{:.4f}}', stddev_pop(gap) / avg(gap)) AS DOUBLE) AS jitter
FROM (SELECT window_start, src_ip, dst_ip,
             ts - lag(ts) OVER (PARTITION BY window_start, src_ip, dst_ip ORDER BY ts) AS gap
      FROM (SELECT *, time_bucket(INTERVAL 10 DAY, event_time, {EPOCH}) AS window_start
            FROM conn))
GROUP BY window_start, src_ip, dst_ip HAVING count(*) >= 3 AND avg(gap) > 0"""

SLIDING_SCANS_SQL = windowed_scan_sql(
    f"""unnest([time_bucket(INTERVAL 12 HOUR, event_time, {EPOCH}),
              time_bucket(INTERVAL 12 HOUR, event_time, {EPOCH}) - INTERVAL 12 HOUR])""",
    "1 DAY",
)
ODD_SCANS_SQL = """SELECT src_ip, count(DISTINCT dst_port) AS distinct_ports,
       count(DISTINCT dst_ip) AS distinct_hosts, count(*) AS total_conns
FROM odd WHERE src_ip IS NOT NULL GROUP BY src_ip"""
SESSIONS_SQL = """
SELECT src_ip, dst_ip, min(event_time) AS session_start, max(event_time) AS session_end,
       CAST(sum(coalesce(orig_bytes, 0)) AS BIGINT) AS total_orig_bytes, count(*) AS n_conns
FROM (SELECT *, sum(starts) OVER (PARTITION BY src_ip, dst_ip ORDER BY event_time
                                  RANGE UNBOUNDED PRECEDING) AS session
      FROM (SELECT *, CASE WHEN event_time - lag(event_time) OVER (
                             PARTITION BY src_ip, dst_ip ORDER BY event_time) <= INTERVAL 12 HOUR
                           THEN 0 ELSE 1 END AS starts FROM conn))
GROUP BY src_ip, dst_ip, session"""
RECENT_SQL = """
SELECT ts AS timestamp, 'HIGH' AS severity,
       concat('10.0.', user_id % 4, '.', user_id) AS src_ip,
       concat('event ', event_id) AS description,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 50"""
LOG_SQL = """SELECT CAST(uid AS VARCHAR) AS uid, src_ip AS id_orig_h, dst_ip AS id_resp_h,
       CASE WHEN dst_port < 90 THEN dst_port END AS id_resp_p,
       CASE WHEN dst_ip <> 'view' THEN conn_state END AS conn_state,
       CASE WHEN dst_ip <> 'click' THEN orig_bytes END AS orig_bytes,
       event_time
FROM conn"""
PREFIX_SQL = """
WITH log AS (
  SELECT event_id, user_id % 256 AS a, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         user_id % 65536 AS u FROM events
), wide AS (
  SELECT doc_id % 256 AS a, count(*) AS n, max(quality) AS c, concat('10.', a, '.0.0/16') AS p
  FROM labels WHERE doc_id % 3 = 0 GROUP BY a
), narrow AS (
  SELECT doc_id % 256 AS a, doc_id % 100 AS k, count(*) AS n, max(quality) AS c,
         min(concat('10.', doc_id % 256, '.', doc_id % 100, '.', doc_id % 5, '/24')) AS p
  FROM labels WHERE doc_id % 3 = 1 GROUP BY ALL
), six AS (
  SELECT doc_id % 65536 AS u, count(*) AS n, max(quality) AS c,
         concat('2001:db8:', lower(to_hex(u)), '::/48') AS p
  FROM labels WHERE doc_id % 3 = 2 GROUP BY u
), found AS (
  SELECT event_id, coalesce(narrow.p, wide.p) AS p, coalesce(narrow.n, wide.n) AS n,
         coalesce(narrow.c, wide.c) AS c
  FROM log LEFT JOIN wide ON wide.a = log.a LEFT JOIN narrow ON narrow.a = log.a AND narrow.k = log.k
  WHERE event_id % 2 = 0
  UNION ALL
  SELECT event_id, p, n, c FROM log LEFT JOIN six ON six.u = log.u WHERE event_id % 2 <> 0
)
SELECT event_id, CASE WHEN p IS NULL THEN '{}' ELSE
  format('{{"prefix":"{}","matches":{},"confidence":{}}}', p, n, c) END AS cti_context
FROM found"""


def odd(log: str) -> str:
    return WITH_ODD.replace("auth_or_conn", log)


def own_sql() -> dict[str, str]:
    return {
        "conn_project": WITH_CONN
        + "SELECT uid, src_ip, dst_ip, dst_port, conn_state, orig_bytes FROM conn",
        "numeric_coerce": """
SELECT event_id, TRY_CAST(word AS DOUBLE) AS number,
       CAST(TRY_CAST(word AS DOUBLE) AS BIGINT) AS whole
FROM (SELECT event_id, CASE WHEN k < 50 THEN concat(k, '.0') ELSE event_type END AS word
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
        "null_tokens": """
SELECT event_id, NULLIF(NULLIF(word, '-'), '(empty)') AS state
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '-' WHEN 'click' THEN '(empty)'
                       ELSE event_type END AS word FROM events)""",
        "epoch_datetime": "SELECT event_id AS uid, make_timestamp(epoch_us(ts)) AS event_time "
        "FROM events",
        "port_filter": WITH_CONN + "SELECT uid, src_ip, dst_port FROM auth WHERE dst_port = 22",
        "failed_states": WITH_CONN
        + """SELECT uid, conn_state FROM conn
WHERE conn_state IN ('REJ', 'S0', 'RSTO', 'RSTR', 'RSTOS0', 'SH')""",
        "failed_logins": WITH_CONN + "SELECT uid, src_ip, conn_state FROM failed",
        "port_scan_features": WITH_CONN + "SELECT * FROM scans",
        "port_scan_ranked": WITH_CONN
        + "SELECT * FROM scans ORDER BY distinct_ports DESC, src_ip",
        "brute_force_features": WITH_CONN + "SELECT * FROM attempts",
        "beacon_intervals": WITH_CONN + INTERVALS_SQL.format(log="conn"),
        "beacon_intervals_hot": WITH_HOT + INTERVALS_SQL.format(log="hot"),
        "beaconing_features": WITH_CONN + "SELECT * FROM beacons",
        "beaconing_features_hot": WITH_HOT + BEACONS_SQL.format(log="hot"),
        "beaconing_ranked": WITH_CONN
        + "SELECT * FROM beacons ORDER BY jitter, src_ip, dst_ip",
        "dns_features": WITH_DNS + "SELECT * EXCLUDE (uid) FROM names",
        "text_entropy": """
SELECT doc_id, round_even(coalesce(list_aggregate(string_split(text, ''), 'entropy'), 0), 3)
         AS entropy FROM documents""",
        "exfil_features": WITH_CONN + "SELECT * FROM volumes",
        "port_scan_alerts": WITH_CONN + "SELECT * FROM scan_alerts",
        "brute_force_alerts": WITH_CONN + "SELECT * FROM brute_alerts",
        "beaconing_alerts": WITH_CONN + "SELECT * FROM beacon_alerts",
        "dns_tunnel_alerts": WITH_DNS
        + """SELECT 'DNSTunnelDetector' AS detector, 'HIGH' AS severity, src_ip,
       CAST(NULL AS VARCHAR) AS dst_ip,
       format('Tunnel DNS suspect : {} (entropie {:.3f}, longueur {}, seuil : 4.2)',
              query, entropy, qlen) AS description,
       'T1071.004' AS mitre,
       CAST(json_object('query', query, 'qlen', qlen, 'entropy', entropy,
                        'threshold', CAST(4.2 AS DOUBLE), 'uid', uid) AS VARCHAR)
         AS evidence
FROM names WHERE entropy >= 4.2""",
        "exfil_alerts": WITH_CONN
        + """SELECT 'ExfiltrationDetector' AS detector, 'HIGH' AS severity, src_ip, dst_ip,
       format('Exfiltration suspecte : {} octets sortants sur {} connexions (seuil : 1000)',
              total_orig_bytes, n_conns) AS description,
       'T1048' AS mitre,
       CAST(json_object('total_orig_bytes', total_orig_bytes, 'n_conns', n_conns,
                        'threshold', 1000) AS VARCHAR) AS evidence
FROM volumes WHERE total_orig_bytes > 1000""",
        "alert_union": WITH_CONN + "SELECT * FROM alerts",
        "severity_histogram": WITH_CONN
        + "SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity",
        "alert_summary": WITH_CONN
        + """SELECT sum(n)::BIGINT AS alerts,
       string_agg(format('{}: {}', severity, n), ' · ' ORDER BY place) AS breakdown
FROM (SELECT severity, count(*) AS n,
             list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity) AS place
      FROM alerts GROUP BY severity)""",
        "recent_alerts": RECENT_SQL,
        "alert_count": WITH_CONN + "SELECT count(*) AS alerts FROM alerts",
        "alert_render": WITH_CONN
        + """SELECT format('[{}] {} — {} → {} : {}', severity, detector, src_ip,
              coalesce(dst_ip, 'N/A'), description) AS line FROM alerts""",
        "alert_evidence_json": WITH_CONN
        + """SELECT detector, src_ip, dst_ip,
       CAST(json_extract_string(evidence, '$.distinct_ports') AS DOUBLE) AS distinct_ports,
       CAST(json_extract_string(evidence, '$.failed_attempts') AS DOUBLE) AS failed_attempts,
       CAST(json_extract_string(evidence, '$.n_conns') AS DOUBLE) AS n_conns,
       CAST(json_extract_string(evidence, '$.jitter') AS DOUBLE) AS jitter
FROM alerts""",
        "alert_identity": WITH_CONN
        + """SELECT sha256(concat_ws(chr(1), detector, src_ip, coalesce(dst_ip, ''),
                        description, evidence)) AS id, src_ip FROM scan_alerts""",
        "cti_enrich": WITH_CONN
        + """SELECT detector, a.src_ip, dst_ip,
       coalesce(CASE WHEN matches IS NOT NULL THEN
         format('{{"matches":{},"confidence":{}}}', matches, confidence) END, '{}')
         AS cti_context
FROM alerts a LEFT JOIN (
  SELECT concat('10.0.', doc_id % 4, '.', doc_id) AS src_ip, count(*) AS matches,
         max(quality) AS confidence FROM labels GROUP BY 1) i ON a.src_ip = i.src_ip""",
        "port_scan_windowed": WITH_CONN + DAILY_SCANS_SQL,
        "port_scan_sliding": WITH_CONN + SLIDING_SCANS_SQL,
        "brute_force_windowed": WITH_CONN + WINDOWED_ATTEMPTS_SQL,
        "beaconing_windowed": WITH_CONN + WINDOWED_BEACONS_SQL,
        "port_scan_stream": WITH_CONN + DAILY_SCANS_SQL,
        "brute_force_stream": WITH_CONN + WINDOWED_ATTEMPTS_SQL,
        "beaconing_stream": WITH_CONN + WINDOWED_BEACONS_SQL,
        "log_scan": WITH_CONN + LOG_SQL,
        "alert_table": WITH_CONN
        + "SELECT * FROM scan_alerts UNION ALL SELECT * FROM brute_alerts",
        "run_over_logs": WITH_CONN
        + "SELECT * FROM scan_alerts UNION ALL SELECT * FROM beacon_alerts",
        "store_count": WITH_CONN
        + """SELECT count(*) AS "before", CAST(0 AS BIGINT) AS cleared, 2 * count(*) AS "after"
FROM scan_alerts""",
        "threshold_alerts": WITH_CONN
        + f"""SELECT src_ip,
       format('Port scan detecte : {{}} ports distincts contactes sur {{}} hote(s) '
              '(seuil : 3)', distinct_ports, distinct_hosts) AS description,
       count(*) AS alerts
FROM ({DAILY_SCANS_SQL}) WHERE distinct_ports >= 3 GROUP BY ALL""",
        "alert_objects": WITH_CONN
        + """SELECT detector, severity, src_ip, dst_ip, mitre,
       'id,timestamp,detector,severity,src_ip,dst_ip,description,mitre,evidence,cti_context'
         AS keys FROM alerts""",
        "marked_lines": WITH_CONN
        + """SELECT format('[{}] {} — {} → {} : {}{}', severity, detector, src_ip,
              coalesce(dst_ip, 'N/A'), description,
              CASE WHEN src_ip IN (SELECT concat('10.0.', doc_id % 4, '.', doc_id) FROM labels)
                   THEN ' [CTI ✓]' ELSE '' END) AS line FROM alerts""",
        "brute_force_ranked": WITH_CONN
        + "SELECT * FROM attempts ORDER BY failed_attempts DESC, src_ip, dst_ip",
        "dns_ranked": WITH_DNS
        + "SELECT * EXCLUDE (uid) FROM names ORDER BY entropy DESC, src_ip, query",
        "exfil_ranked": WITH_CONN
        + "SELECT * FROM volumes ORDER BY total_orig_bytes DESC, src_ip, dst_ip",
        "port_scan_odd": odd("conn") + ODD_SCANS_SQL,
        "brute_force_odd": odd("auth")
        + """SELECT src_ip, count(*) AS failed_attempts,
       first(dst_ip ORDER BY ts NULLS LAST, uid NULLS LAST, dst_ip)
         FILTER (dst_ip IS NOT NULL) AS dst_ip
FROM odd WHERE src_ip IS NOT NULL AND port = 22
  AND conn_state IN ('REJ', 'S0', 'RSTO', 'RSTR', 'RSTOS0', 'SH') GROUP BY src_ip""",
        "beacon_intervals_odd": odd("conn") + INTERVALS_SQL.format(log="odd"),
        "beaconing_odd": odd("conn") + BEACONS_SQL.format(log="odd"),
        "exfil_odd": odd("conn")
        + """SELECT src_ip, dst_ip, CAST(sum(orig_bytes) AS BIGINT) AS total_orig_bytes,
       count(*) AS n_conns
FROM odd WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip""",
        "dns_odd": """
SELECT 'N/A' AS src_ip, query, CAST(length(query) AS INTEGER) AS qlen,
       coalesce(round_even(list_aggregate(string_split(query, ''), 'entropy'), 3), 0) AS entropy
FROM (SELECT CASE WHEN page_id % 9 = 1 THEN '' WHEN page_id % 9 <> 0 THEN url END AS query
      FROM pages) WHERE query IS NOT NULL""",
        "cti_prefix": PREFIX_SQL,
        "port_bitmap_sliding": WITH_CONN + SLIDING_SCANS_SQL,
        "port_bitmap_odd": odd("conn") + ODD_SCANS_SQL,
        "port_bitmap_stream": WITH_CONN + DAILY_SCANS_SQL,
        "sketch_span": WITH_CONN
        + f"""SELECT src_ip, count(*) AS total_conns, true AS distinct_ports_within,
       true AS distinct_hosts_within
FROM conn WHERE CAST(event_time AS DATE) BETWEEN '{SPAN[0]}' AND '{SPAN[1]}' GROUP BY src_ip""",
        "exfil_sessions": WITH_CONN + SESSIONS_SQL,
        "recent_from_store": RECENT_SQL,
        "compacted_store": """
SELECT CAST(ts AS DATE) AS alert_date, if(event_type = 'error', 'HIGH', 'LOW') AS severity,
       count(*) AS alerts, count(*) AS ids, CAST(1 AS BIGINT) AS folders
FROM events GROUP BY ALL""",
        "repeated_runs": WITH_CONN
        + """SELECT detector, severity, count(*) AS alerts, count(*) AS counted,
       CAST(0 AS BIGINT) AS repeated
FROM (SELECT * FROM scan_alerts UNION ALL SELECT * FROM beacon_alerts) GROUP BY ALL""",
        "parent_domains": """
WITH asked AS (
  SELECT CASE WHEN page_id % 3 = 0 THEN concat('x', page_id, '.cdn.hot.example')
              ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS name FROM pages),
names AS (SELECT string_split(name, '.') AS labels, count(*) AS n FROM asked GROUP BY name),
below AS (SELECT labels, n, unnest(range(1, len(labels) + 1)) AS level FROM names)
SELECT array_to_string(labels[-level:], '.') AS domain, CAST(level AS INTEGER) AS level,
       CAST(sum(n) AS BIGINT) AS queries, count(*) AS names,
       round_even(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 3) AS entropy
FROM below GROUP BY 1, 2
HAVING sum(n) >= 0.005 * (SELECT count(*) FROM asked)""",
        "log_stream": WITH_CONN + LOG_SQL,
        "beaconing_stateful": WITH_CONN + "SELECT * FROM beacons",
        "exfil_sessions_stream": WITH_CONN + SESSIONS_SQL,
    }


# ---------------------------------------------------------------- optional parts


def optional(name: str) -> ModuleType | None:
    """Module of this name, or None where it is not part of this copy of the repository."""
    try:
        there = importlib.util.find_spec(name)
    except ModuleNotFoundError:
        there = None
    return importlib.import_module(name) if there else None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = own_queries()
    if llm := optional("netbehave.llm.queries"):
        found |= llm.QUERIES
        if pipeline := optional("corpus_pipeline"):
            found["pipeline"] = pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = own_sql()
    if llm := optional("netbehave.llm.queries"):
        found |= llm.ORACLE_SQL
        if (pipeline := optional("corpus_pipeline")) and pipeline.ORACLE_SQL:
            found["pipeline"] = pipeline.ORACLE_SQL
    return found
