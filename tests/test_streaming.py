"""Streamed windows equal batch windows."""

import json
import os

import pytest
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.sources.logs import read_log
from netbehave.streaming.stream import checkpoint_location, read_log_stream, write_alert_stream
from tests.conftest import rows_of

FIELDS = ("ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "conn_state")


@pytest.fixture
def drop(tmp_path):
    """Three files in time order, some rows late but within the watermark, then a last row
    far ahead that closes every window."""
    rows = []
    for i in range(300):
        ts = i * 1.37 if i % 10 else max(i * 1.37 - 20, 0)
        port = "-" if i % 17 == 0 else 22 if i % 3 else i % 50
        rows.append(f"{ts:.6f}\tu{i:04d}\th{i % 3}\td{i % 2}\t{port}\tREJ")
        if i % 7 == 0:
            rows.append(f"{ts:.6f}\tv{i:04d}\th{i % 3}\td{i % 2}\t22\tS0")
    rows.append("1000000\tlast\tend\tend\t1\tSF")
    folder = tmp_path / "conn.log"
    folder.mkdir()
    header = "#fields\t" + "\t".join(FIELDS)
    for part, first in enumerate((0, 120, 240)):
        last = first + 120 if part < 2 else None
        file = folder / f"{part}.log"
        file.write_text("\n".join([header, *rows[first:last]]) + "\n")
        os.utime(file, (part + 1, part + 1))
    return folder


def streamed(spark, tmp_path, result, name):
    out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(out)


CASES = {
    "port_scan": lambda conn: nb.port_scan_windowed(conn),
    "port_scan_sliding": lambda conn: nb.port_scan_windowed(conn, "60 seconds", "30 seconds"),
    "brute_force": lambda conn: nb.brute_force_windowed(conn),
    "beaconing": lambda conn: nb.beaconing_windowed(conn, "120 seconds"),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, drop, name):
    stream = read_log_stream(spark, str(drop), "conn", FIELDS)
    batch = read_log(spark, str(tmp_path), "conn")
    expected = CASES[name](batch).where("src_ip <> 'end'")
    result = streamed(spark, tmp_path, CASES[name](stream), name)
    assert rows_of(result.where("src_ip <> 'end'")) == rows_of(expected)
    assert expected.count() > 3


def test_windowed_beacons_equal_plain_ones_inside_a_window(spark, tmp_path, drop):
    batch = read_log(spark, str(tmp_path), "conn").where("ts < 3600")
    windowed = nb.beaconing_windowed(batch, "1 hour").drop("window_start", "window_end")
    assert rows_of(windowed) == rows_of(nb.beaconing_features(batch))
    sliding = nb.beaconing_windowed(batch, "2 hours", "1 hour")
    assert sliding.count() == 2 * windowed.count()


def test_alert_stream(spark, tmp_path, drop):
    store = nb.AlertStore(spark, str(tmp_path / "alerts"))
    conn = read_log_stream(spark, str(drop), "conn", FIELDS, max_files=1)
    detector = nb.BruteForceDetector(min_attempts=10, window="60 seconds")

    def work(state):
        query = write_alert_stream(detector.analyze({"conn": conn}), store, state, once=True)
        query.awaitTermination(240)
        assert query.exception() is None

    batch = detector.analyze({"conn": read_log(spark, str(tmp_path), "conn")})
    expected = rows_of(batch.select("id", "src_ip", "dst_ip", "evidence"))
    work(str(tmp_path / "state"))
    assert rows_of(store.alerts().select("id", "src_ip", "dst_ip", "evidence")) == expected
    assert expected and "window_start" in json.loads(expected[0][3])


def test_restarts_lose_nothing(spark, tmp_path):
    """A stream started three times over files that repeat a finding, one at a time."""
    store = nb.AlertStore(spark, str(tmp_path / "alerts"))
    folder = tmp_path / "drop"
    folder.mkdir()
    line = "{ts}\t{uid}\th\td\t53\t{query}"
    names = ("ts", "uid", "id.orig_h", "id.resp_h", "id.resp_p", "query")
    finding = {"A": "abcdefghijklmnopqrstuvwxyz", "B": "zyxwvutsrqponmlkjihgfedcba"}
    header = "#fields\t" + "\t".join(names)
    for number, found in enumerate(("A", "AB", "A")):
        rows = [
            line.format(ts=number, uid=f"u{number}{name}", query=finding[name]) for name in found
        ]
        (folder / f"{number}.log").write_text("\n".join([header, *rows]) + "\n")
        alerts = nb.DnsTunnelDetector().analyze({"dns": read_log_stream(spark, str(folder), "dns", names)})
        query = write_alert_stream(alerts, store, str(tmp_path / "state"), once=True)
        query.awaitTermination(240)
        assert query.exception() is None
    assert store.count() == 4
    assert store.alerts().select("id").distinct().count() == 4


def test_another_layout_is_refused(spark, tmp_path, drop):
    with pytest.raises(ValueError, match="fields"):
        read_log_stream(spark, str(drop), "conn", FIELDS[::-1])


def test_repeated_batch_adds_nothing_twice(spark, tmp_path, drop):
    """A stream that dies between writing a batch and recording it repeats the batch."""
    store = nb.AlertStore(spark, str(tmp_path / "alerts"))
    state = tmp_path / "state"
    alerts = nb.BruteForceDetector(min_attempts=10, window="60 seconds").analyze(
        {"conn": read_log_stream(spark, str(drop), "conn", FIELDS)}
    )

    def work():
        query = write_alert_stream(alerts, store, str(state), once=True)
        query.awaitTermination(240)
        assert query.exception() is None
        return query.recentProgress

    work()
    stored = store.count()
    assert stored > 0
    batches = sorted((state / "commits").glob("[0-9]*"), key=lambda file: int(file.name))
    batches[-1].unlink()
    (state / "commits" / f".{batches[-1].name}.crc").unlink()
    assert any(step["batchId"] == int(batches[-1].name) for step in work())
    assert store.count() == stored


def test_checkpoint_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_location(spark, "alerts") == f"{shared}/alerts"


def test_stream_source_types(spark, drop):
    conn = read_log_stream(spark, str(drop), "conn", FIELDS)
    assert conn.isStreaming
    assert dict(conn.dtypes)["event_time"] == "timestamp"
    assert dict(conn.select(F.col("id_resp_p")).dtypes) == {"id_resp_p": "int"}
