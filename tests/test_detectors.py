"""Thresholds, alert rows, texts, reports and enrichment."""

import json
from dataclasses import dataclass
from typing import ClassVar

import pytest
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.constants import THRESHOLDS
from netbehave.sources.schemas import ALERT_COLUMNS
from tests.conftest import rows_of


def alerts(detector, conn):
    return detector.analyze({"conn": conn}).collect()


@pytest.mark.parametrize("ports, found", [(49, 0), (50, 1)])
def test_port_scan(conn, ports, found):
    frame = conn([{"id_resp_p": p} for p in range(ports)])
    result = alerts(nb.PortScanDetector(), frame)
    assert len(result) == found
    if found:
        alert = result[0]
        assert (alert.detector, alert.severity, alert.mitre) == ("PortScanDetector", "MEDIUM", "T1046")
        assert (alert.src_ip, alert.dst_ip) == ("10.0.0.1", None)
        assert alert.description == (
            "Port scan detecte : 50 ports distincts contactes sur 1 hote(s) (seuil : 50)"
        )
        assert json.loads(alert.evidence) == {
            "distinct_ports": 50,
            "distinct_hosts": 1,
            "total_conns": 50,
            "threshold": 50,
        }
        assert alert.cti_context == "{}"
        assert alert.timestamp is not None


@pytest.mark.parametrize("attempts, found", [(9, 0), (10, 1)])
def test_brute_force(conn, attempts, found):
    frame = conn([{"ts": float(i)} for i in range(attempts)] + [{"conn_state": "SF"}])
    result = alerts(nb.BruteForceDetector(), frame)
    assert len(result) == found
    if found:
        alert = result[0]
        assert (alert.severity, alert.mitre, alert.dst_ip) == ("HIGH", "T1110", "10.0.0.2")
        assert alert.description == (
            "Brute force SSH detecte : 10 tentatives echouees sur le port 22 (seuil : 10)"
        )
        assert json.loads(alert.evidence) == {"failed_attempts": 10, "port": 22, "threshold": 10}


def test_brute_force_without_state_or_on_another_port(conn):
    frame = conn([{"conn_state": "SF"}] * 10).drop("conn_state")
    assert len(alerts(nb.BruteForceDetector(), frame)) == 1
    assert alerts(nb.BruteForceDetector(port=23), frame) == []
    assert alerts(nb.BruteForceDetector(), conn([{"id_resp_h": ""}] * 10))[0].dst_ip is None


@pytest.mark.parametrize("beats, found", [(9, 0), (10, 1)])
def test_beaconing_count(conn, beats, found):
    frame = conn([{"ts": 60.0 * i} for i in range(beats)])
    result = alerts(nb.BeaconingDetector(), frame)
    assert len(result) == found
    if found:
        alert = result[0]
        assert (alert.severity, alert.mitre) == ("CRITICAL", "T1071")
        assert (alert.src_ip, alert.dst_ip) == ("10.0.0.1", "10.0.0.2")
        assert alert.description == (
            "Beaconing C2 detecte : 10 connexions tres regulieres "
            "(jitter 0.0%, intervalle moyen 60s, seuil jitter 10%)"
        )
        assert json.loads(alert.evidence) == {
            "n_conns": 10,
            "jitter": 0.0,
            "mean_interval": 60.0,
            "max_jitter": 0.1,
        }


@pytest.mark.parametrize("jitter, found", [(0.10004, 1), (0.10006, 0)])
def test_beaconing_tests_the_rounded_jitter(conn, jitter, found):
    """Nine steps, mean 1000, deviation 1000 * jitter: one at 1000, four on either side."""
    step = 1000 * jitter * (9 / 8) ** 0.5
    times = [0.0]
    for sign in (0, 1, -1, 1, -1, 1, -1, 1, -1):
        times.append(times[-1] + 1000 + sign * step)
    assert len(alerts(nb.BeaconingDetector(), conn([{"ts": t} for t in times]))) == found


@pytest.mark.parametrize("sent, found", [(1_000_000, 0), (1_000_001, 1)])
def test_exfiltration(conn, sent, found):
    assert len(alerts(nb.ExfiltrationDetector(), conn([{"orig_bytes": sent}]))) == found


def test_dns_tunnel(spark):
    dns = spark.createDataFrame([("h", "abcd"), ("h", "aaaa")], "src_ip string, query string")
    found = nb.DnsTunnelDetector(min_entropy=2.0).analyze({"dns": dns}).collect()
    assert [json.loads(a.evidence)["query"] for a in found] == ["abcd"]


def test_windowed_detector(conn):
    frame = conn([{"id_resp_p": p, "ts": p * 2.0} for p in range(60)])
    assert len(alerts(nb.PortScanDetector(min_ports=30), frame)) == 1
    found = alerts(nb.PortScanDetector(min_ports=30, window="60 seconds"), frame)
    starts = sorted(json.loads(a.evidence)["window_start"] for a in found)
    assert starts == ["1970-01-01T00:00:00.000Z", "1970-01-01T00:01:00.000Z"]
    assert len({a.id for a in found}) == 2


def test_thresholds():
    assert nb.default_detectors() == [
        nb.PortScanDetector(50),
        nb.BruteForceDetector(10, 22),
        nb.BeaconingDetector(0.10, 10),
    ]
    assert THRESHOLDS["port_scan"]["window_sec"] == 60
    assert nb.DnsTunnelDetector.from_thresholds().min_entropy == 3.5
    assert nb.ExfiltrationDetector.from_thresholds().max_bytes == 1_000_000
    changed = {"port_scan": {"min_ports": 5, "unknown": 1}}
    assert nb.PortScanDetector.from_thresholds(changed).min_ports == 5
    assert nb.BruteForceDetector.from_thresholds(changed) == nb.BruteForceDetector()
    assert str(nb.PortScanDetector()) == "PortScanDetector (MEDIUM, T1046)"


def test_no_log_gives_no_alerts(spark):
    for detector in nb.default_detectors():
        result = detector.analyze({})
        assert result.columns == ALERT_COLUMNS and result.count() == 0


@dataclass(frozen=True)
class OwnDetector(nb.Detector):
    """What a user writes to add a detector."""

    NAME: ClassVar[str] = "OwnDetector"
    min_rows: int = 1

    def suspects(self, log):
        return log.groupBy(F.col("id_orig_h").alias("src_ip")).agg(F.count("*").alias("rows"))

    def description(self):
        return F.format_string("%d rows", "rows")

    def evidence(self):
        return {}


class FailingDetector(OwnDetector):
    NAME = "FailingDetector"

    def suspects(self, log):
        return log.select("no_such_column")


def test_own_and_failing_detectors(conn):
    frame = conn([{}, {}])
    result = nb.detect({"conn": frame}, [FailingDetector(), OwnDetector()])
    assert set(result.failures) == {"FailingDetector"}
    alert = result.alerts.first()
    assert (alert.detector, alert.severity, alert.mitre) == ("OwnDetector", "LOW", "")
    assert (alert.description, alert.evidence, alert.dst_ip) == ("2 rows", "{}", None)
    assert nb.detect({"conn": frame}, []).alerts.count() == 0


def test_ids_depend_on_content_only(conn):
    frame = conn([{"id_resp_p": p} for p in range(50)])
    one, two = (alerts(nb.PortScanDetector(), frame)[0] for _ in range(2))
    other = alerts(nb.PortScanDetector(min_ports=49), frame)[0]
    assert one.id == two.id != other.id


def sample(spark):
    rows = [
        ("LOW", "a", None),
        ("HIGH", "b", "c"),
        ("HIGH", "b", ""),
        ("CRITICAL", "d", "e"),
        ("ODD", "f", None),
    ]
    frames = [nb.new_alert(spark, "D", sev, src, "text", dst) for sev, src, dst in rows]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def test_histogram_and_summary(spark):
    histogram = [tuple(row) for row in nb.severity_histogram(sample(spark)).collect()]
    assert histogram == [("CRITICAL", 1), ("HIGH", 2), ("LOW", 1)]
    assert rows_of(nb.summary(sample(spark))) == [(5, "CRITICAL: 1 · HIGH: 2 · LOW: 1")]
    assert rows_of(nb.summary(sample(spark).limit(0))) == [(0, "")]


def test_lines(spark):
    marked = nb.new_alert(spark, "D", "LOW", "a", "text", cti_context={"score": 1})
    lines = [row.line for row in nb.render(sample(spark).unionByName(marked)).collect()]
    assert lines == [
        "[LOW] D — a → N/A : text",
        "[HIGH] D — b → c : text",
        "[HIGH] D — b → N/A : text",
        "[CRITICAL] D — d → e : text",
        "[ODD] D — f → N/A : text",
        "[LOW] D — a → N/A : text [CTI ✓]",
    ]


def test_json(spark):
    alert = nb.new_alert(spark, "D", "LOW", "a", "text", evidence={"n": 1})
    decoded = json.loads(nb.alert_json(alert).first().json)
    assert list(decoded) == ALERT_COLUMNS
    assert decoded["dst_ip"] is None and json.loads(decoded["evidence"]) == {"n": 1}


def test_enrichment(spark):
    indicators = spark.createDataFrame(
        [("a", 10), ("a", 30), ("z", 5), (None, 1)], "src_ip string, confidence int"
    )
    enriched = nb.enrich(sample(spark), indicators)
    assert enriched.columns == ALERT_COLUMNS
    context = {row.src_ip: row.cti_context for row in enriched.collect()}
    assert enriched.count() == 5
    assert json.loads(context["a"]) == {"matches": 2, "confidence": 30}
    assert context["b"] == "{}"
