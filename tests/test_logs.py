"""Reader: headers, null tokens, typing and missing files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.sources.logs import layouts
from tests.conftest import rows_of

CONN_HEADER = """#separator \\x09
#set_separator\t,
#empty_field\t(empty)
#unset_field\t-
#path\tconn
#open\t2026-08-06-21-16-07
#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tduration\torig_bytes\tresp_bytes\tconn_state\tlocal_orig\tlocal_resp\tmissed_bytes\thistory\torig_pkts\torig_ip_bytes\tresp_pkts\tresp_ip_bytes\ttunnel_parents\tip_proto
"""
# (ts, source, source port, target, target port, protocol, sent, state)
CONN_ROWS = [
    ("1786050683.186254", "fe80::20c:29ff:fe16:c369", 5353, "ff02::fb", 5353, "udp", "-", "S0"),
    ("1786050683.186275", "192.168.100.30", 5353, "224.0.0.251", 5353, "udp", "-", "S0"),
    ("1786050669.271997", "192.168.100.1", 5353, "224.0.0.251", 5353, "udp", "763", "S0"),
    ("1786050669.272172", "fe80::bcd0:74ff:fe42:fa66", 5353, "ff02::fb", 5353, "udp", "763", "S0"),
    ("1786050680.412424", "fe80::a179:94aa:6f36:945", 133, "ff02::2", 134, "icmp", "-", "OTH"),
    ("1786050671.197091", "192.168.100.1", 55928, "239.255.255.250", 1900, "udp", "1250", "S0"),
    ("1786050669.347096", "192.168.100.1", 60953, "192.168.100.10", 22, "tcp", "0", "OTH"),
]
DNS_HEADER = "#fields\tts\tuid\tid.orig_h\tquery\tAA\tanswers\tTTLs\n"


def conn_text():
    lines = [
        "\t".join(
            map(
                str,
                [ts, f"C{i}", src, sport, dst, dport, proto, "-", "-", sent, "-", state]
                + ["T", "F", "0", "D", "1", "93", "0", "0", "-", "17"],
            )
        )
        for i, (ts, src, sport, dst, dport, proto, sent, state) in enumerate(CONN_ROWS)
    ]
    return CONN_HEADER + "\n".join(lines) + "\n#close\t2026-08-06-21-16-07\n"


@pytest.fixture
def logs(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.log").write_text(text)
        return str(tmp_path)

    return write


def test_sample_connections(spark, logs):
    conn = nb.read_log(spark, logs(conn=conn_text()), "conn")
    types = dict(conn.dtypes)
    assert types["ts"] == "double" and types["event_time"] == "timestamp"
    assert types["id_resp_p"] == "int" and types["orig_bytes"] == "bigint"
    assert types["local_orig"] == "boolean" and types["tunnel_parents"] == "array<string>"
    assert conn.count() == 7
    first = conn.where("uid = 'C0'").first()
    assert first["event_time"] == datetime(2026, 8, 6, 21, 11, 23, 186254)
    assert first["orig_bytes"] is None and first["service"] is None
    assert (first["local_orig"], first["local_resp"]) == (True, False)


def test_sample_features(spark, logs):
    conn = nb.read_log(spark, logs(conn=conn_text()), "conn")
    assert rows_of(nb.port_scan_features(conn)) == [
        ("192.168.100.1", 3, 3, 3),
        ("192.168.100.30", 1, 1, 1),
        ("fe80::20c:29ff:fe16:c369", 1, 1, 1),
        ("fe80::a179:94aa:6f36:945", 1, 1, 1),
        ("fe80::bcd0:74ff:fe42:fa66", 1, 1, 1),
    ]
    assert rows_of(nb.exfil_features(conn)) == [
        ("192.168.100.1", "192.168.100.10", 0, 1),
        ("192.168.100.1", "224.0.0.251", 763, 1),
        ("192.168.100.1", "239.255.255.250", 1250, 1),
        ("192.168.100.30", "224.0.0.251", 0, 1),
        ("fe80::20c:29ff:fe16:c369", "ff02::fb", 0, 1),
        ("fe80::a179:94aa:6f36:945", "ff02::2", 0, 1),
        ("fe80::bcd0:74ff:fe42:fa66", "ff02::fb", 763, 1),
    ]
    assert nb.brute_force_features(conn).count() == 0
    assert nb.beaconing_features(conn).count() == 0
    assert nb.detect({"conn": conn}).alerts.count() == 0


def test_values_are_kept_whole(spark, logs):
    text = DNS_HEADER + "\n".join(
        [
            '1.5\ta\t10.0.0.1\tx#y.example\tT\tone,two\t60.0,bad',
            '2.5\tb\t10.0.0.1\t"quoted\tF\t-\t-',
            "3.5\tc\tnull\tNA\tx\t(empty)\t(empty)",
            "",
            "4.5\td\t\t(empty)\t-\t-\t-",
            "#close\tnever",
        ]
    )
    dns = nb.read_log(spark, logs(dns=text + "\n"), "dns").orderBy("uid")
    assert [tuple(row) for row in dns.drop("event_time").collect()] == [
        (1.5, "a", "10.0.0.1", "x#y.example", True, ["one", "two"], [60.0, None]),
        (2.5, "b", "10.0.0.1", '"quoted', False, None, None),
        (3.5, "c", "null", "NA", None, None, None),
        (4.5, "d", None, None, None, None, None),
    ]


def test_extra_and_missing_fields(spark, logs):
    text = "#fields\tts\tuid\tid.orig_h\n1\ta\th\textra\tmore\n2\tb\nbad\tc\th\n"
    log = nb.read_log(spark, logs(conn=text), "conn")
    assert rows_of(log.select("ts", "uid", "id_orig_h")) == [
        (1.0, "a", "h"),
        (2.0, "b", None),
        (None, "c", "h"),
    ]


def test_numbers(spark, logs):
    text = "#fields\tts\tid.resp_p\torig_bytes\n" + "\n".join(
        ["1\t22.0\t12", "2\tabc\t9007199254740993", "nan\t99999999999\t1.0", "3\t-\tx"]
    )
    log = nb.read_log(spark, logs(conn=text + "\n"), "conn")
    assert rows_of(log.drop("event_time")) == [
        (1.0, 22, 12),
        (2.0, None, 9007199254740993),
        (3.0, None, None),
        (None, None, 1),
    ]


def test_missing_file_and_missing_header(spark, logs):
    folder = logs(dns="1\ta\n", http="", ssl="#path\tssl\n")
    for name in ("conn", "dns", "http", "ssl", "files"):
        assert nb.read_log(spark, folder, name).count() == 0
    bundle = nb.load_logs(spark, folder)
    assert set(bundle) == {"conn", "dns", "http", "ssl"}
    assert nb.port_scan_features(bundle["conn"]).count() == 0
    assert nb.detect(bundle).alerts.count() == 0


def test_layout_of_an_unlisted_log(spark, logs):
    text = "#fields\tts\tuid\tid.resp_p\thost\tduration\n1\ta\t80\th\t0.5\n"
    http = nb.read_log(spark, logs(http=text), "http")
    assert dict(http.dtypes) == {
        "ts": "double",
        "uid": "string",
        "id_resp_p": "int",
        "host": "string",
        "duration": "double",
        "event_time": "timestamp",
    }


def test_mixed_layouts_are_united(spark, tmp_path):
    folder = tmp_path / "conn.log"
    folder.mkdir()
    (folder / "a b.log").write_text("#fields\tts\tuid\n1\ta\n")
    (folder / "b.log").write_text("#fields\tuid\tts\tservice\nb\t2\tssh\n")
    (folder / "c.log").write_text("#fields\tts\tuid\n3\tc\n")
    (folder / "d.log").write_text("4\td\n")
    log = nb.read_log(spark, str(tmp_path), "conn")
    assert rows_of(log.select("ts", "uid", "service")) == [
        (1.0, "a", None),
        (2.0, "b", "ssh"),
        (3.0, "c", None),
    ]
    found = layouts(spark, str(folder))
    assert len(found.by_fields) == 2
    assert [file.rsplit("/", 1)[1] for file in found.headerless] == ["d.log"]
    left_out = []
    nb.read_log(spark, str(tmp_path), "conn", headerless=left_out)
    assert left_out == found.headerless


def test_first_header_counts(spark, logs):
    folder = logs(conn="#fields\tts\tuid\n1\ta\n#fields\tuid\tts\n")
    assert list(layouts(spark, f"{folder}/conn.log").by_fields) == [("ts", "uid")]


def test_missing_file_with_known_fields(spark, tmp_path):
    log = nb.read_log(spark, str(tmp_path), "conn", fields=("ts", "uid"))
    assert log.columns == ["ts", "uid", "event_time"] and log.isEmpty()


def test_fields_and_names_reach_the_reader(spark, logs):
    folder = logs(conn="1\ta\n", dns="2\tb\n")
    found = nb.load_logs(spark, folder, ("conn",), {"conn": ("ts", "uid")})
    assert list(found) == ["conn"] and rows_of(found["conn"].select("uid")) == [("a",)]


def test_known_fields_skip_the_headers(spark, logs):
    folder = logs(conn="1\ta\n2\tb\n")
    log = nb.read_log(spark, folder, "conn", fields=("ts", "uid"))
    assert rows_of(log.select("ts", "uid")) == [(1.0, "a"), (2.0, "b")]


def test_late_header(spark, logs):
    folder = logs(conn="#note\n" * 300 + "#fields\tts\n1\n")
    assert list(layouts(spark, f"{folder}/conn.log").by_fields) == [("ts",)]


def test_only_used_columns_are_parsed(spark, logs):
    conn = nb.read_log(spark, logs(conn=conn_text()), "conn")
    plan = nb.exfil_features(conn)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "orig_bytes" in scan and "history" not in scan and "ts:" not in scan


def test_driver_logs_are_written_by_all_tasks(spark, tmp_path):
    """A file for each partition with rows, each with a header, and one where there are none."""
    import __spark_entry__ as entry

    columns = {"ts": F.col("id").cast("string"), "uid": F.concat(F.lit("u"), F.col("id").cast("string"))}
    rows = spark.range(0, 1000, 1, 5).where("id >= 200")
    entry.write_log(rows, f"{tmp_path}/conn.log", columns)
    files = list((tmp_path / "conn.log").glob("part-*"))
    assert len(files) == 5 and all(file.read_text().startswith(("#fields\tts\tuid\n", "#path")) for file in files)
    found = nb.read_log(spark, str(tmp_path), "conn").select("ts", "uid")
    assert sorted(map(tuple, found.collect())) == [(float(n), f"u{n}") for n in range(200, 1000)]
    (tmp_path / "none").mkdir()
    entry.write_log(rows.where("id < 0"), f"{tmp_path}/none/conn.log", columns)
    log = nb.read_log(spark, f"{tmp_path}/none", "conn")
    assert log.columns == ["ts", "uid", "event_time"] and log.isEmpty()
