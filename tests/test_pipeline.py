"""Runs over log folders and the alert table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.sources.schemas import ALERT_COLUMNS
from tests.test_detectors import FailingDetector, OwnDetector


@pytest.fixture
def store(spark, tmp_path):
    return nb.AlertStore(spark, str(tmp_path / "alerts"))


@pytest.fixture
def logs(tmp_path):
    """A scan of 60 ports, 12 failed logins and 12 beats."""
    lines = ["#fields\tts\tuid\tid.orig_h\tid.resp_h\tid.resp_p\tconn_state\torig_bytes"]
    for i in range(60):
        lines.append(f"{i * i}\ts{i}\tscanner\tvictim\t{1000 + i}\tREJ\t-")
    for i in range(12):
        lines.append(f"{i * i}\tb{i}\tguesser\tserver\t22\tS0\t10")
        lines.append(f"{i * 30}\tc{i}\tinfected\tc2\t443\tSF\t500")
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "conn.log").write_text("\n".join(lines) + "\n")
    return str(folder)


EXPECTED = {
    ("PortScanDetector", "scanner", None),
    ("BruteForceDetector", "guesser", "server"),
    ("BeaconingDetector", "infected", "c2"),
}


def keys(alerts):
    return {(a.detector, a.src_ip, a.dst_ip) for a in alerts.collect()}


def test_run_without_store(spark, logs):
    result = nb.run(spark, logs)
    assert keys(result.alerts) == EXPECTED
    assert (result.failures, result.stored) == ({}, 0)
    result.release()


@pytest.mark.parametrize("isolate", [False, True])
def test_run_with_store(spark, logs, store, isolate):
    detectors = [FailingDetector(), *nb.default_detectors()]
    result = nb.run(spark, logs, detectors, store, isolate=isolate)
    assert keys(result.alerts) == keys(store.alerts()) == EXPECTED
    assert result.stored == store.count() == 3
    assert set(result.failures) == {"FailingDetector"}
    result.release()


class FailingOnData(OwnDetector):
    NAME = "FailingOnData"

    def suspects(self, log):
        return log.select(F.raise_error(F.lit("bad row")).cast("string").alias("src_ip"), F.lit(1).alias("rows"))


def test_isolated_failure_on_data(spark, logs, store):
    detectors = [FailingOnData(), *nb.default_detectors()]
    result = nb.run(spark, logs, detectors, store, isolate=True)
    assert keys(store.alerts()) == EXPECTED
    assert set(result.failures) == {"FailingOnData"}
    result.release()


def test_run_over_staged_logs(spark, logs, tmp_path):
    result = nb.run(spark, logs, staging=str(tmp_path / "staged"))
    assert keys(result.alerts) == EXPECTED
    staged = spark.read.parquet(str(tmp_path / "staged" / "conn"))
    assert staged.count() == 84
    assert staged.inputFiles()[0].split("/")[-2] == "event_date=1970-01-01"
    result.release()


def test_staged_log_without_time(spark, tmp_path):
    frame = spark.createDataFrame([("h",)], "host string")
    staged = nb.stage_logs({"http": frame}, str(tmp_path / "staged"))
    assert [tuple(row) for row in staged["http"].collect()] == [("h",)]


def test_store(spark, store):
    assert store.count() == 0
    start = datetime(2026, 1, 1)
    for i in range(6):
        alert = nb.new_alert(
            spark,
            "D",
            "HIGH" if i % 2 else "LOW",
            f"s{i}",
            "text",
            evidence={"n": i, "jitter": 0.5},
            timestamp=start + timedelta(hours=10 * i),
        )
        assert store.append_one(alert) == alert.first().id
    assert store.count() == 6
    assert store.append(store.alerts().where("src_ip = 's0'")) == 1
    assert store.count() == 7

    latest = store.recent(limit=2)
    assert latest.columns == ALERT_COLUMNS
    assert [row.src_ip for row in latest.collect()] == ["s5", "s4"]
    assert latest.first().evidence.toPython() == {"n": 5, "jitter": 0.5}
    assert latest.first().cti_context.toPython() == {}
    assert [row.src_ip for row in store.recent(severity="LOW").collect()] == ["s4", "s2", "s0", "s0"]

    again = nb.AlertStore(spark, store.path)
    assert again.count() == 7
    again.clear()
    assert again.count() == store.count() == 0
    assert store.append_one(nb.new_alert(spark, "D", "LOW", "s", "text"))
    assert store.count() == 1


def test_appending_nothing(spark, store, conn):
    """Plans that turn out empty only when they run."""
    log = {"conn": conn([{}] * 5)}
    assert store.append(nb.PortScanDetector(min_ports=10**6).analyze(log)) == 0
    assert store.append(nb.ExfiltrationDetector(max_bytes=10**12).analyze(log)) == 0
    assert store.count() == 0


def test_a_named_batch_replaces_itself(spark, store):
    for text in ("one", "two"):
        assert store.append(nb.new_alert(spark, "D", "LOW", "s", text), "stream-7") == 1
    assert [row.description for row in store.alerts().collect()] == ["two"]


def test_repeats_of_a_query_are_told_apart(spark):
    rows = [(1.0, "u1", "s", "x" * 9 + "abcdefghijklmnop")] * 1 + [(2.0, "u2", "s", "x" * 9 + "abcdefghijklmnop")]
    dns = spark.createDataFrame(rows, "ts double, uid string, src_ip string, query string")
    alerts = nb.DnsTunnelDetector(min_entropy=1.0).analyze({"dns": dns})
    assert alerts.select("id").distinct().count() == 2


def test_severity_prunes_folders(spark, store):
    store.append(nb.new_alert(spark, "D", "LOW", "s", "text"))
    plan = store.recent(severity="LOW")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "(severity" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
