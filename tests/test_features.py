"""Boundary cases of the feature tables."""

import math
import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.functions.columns import round_places, to_long
from tests.conftest import rows_of

STATES = ["REJ", "S0", "RSTO", "RSTR", "RSTOS0", "SH"]


def test_port_scan_nulls(conn):
    frame = conn(
        [
            {"id_resp_p": 1},
            {"id_resp_p": 1, "id_resp_h": None},
            {"id_resp_p": None, "id_resp_h": "10.0.0.3"},
            {"id_orig_h": None},
        ]
    )
    assert rows_of(nb.port_scan_features(frame)) == [("10.0.0.1", 1, 2, 3)]
    assert rows_of(nb.port_scan_features(frame, approx=True)) == [("10.0.0.1", 1, 2, 3)]


def test_nan_is_null(spark):
    frame = spark.createDataFrame(
        [("a", "b", 1.0), ("a", "b", float("nan"))], "src_ip string, dst_ip string, dst_port double"
    )
    assert rows_of(nb.port_scan_features(frame)) == [("a", 1, 1, 2)]


def test_dotted_and_plain_names(spark):
    dotted = spark.createDataFrame(
        [("a", "b", 1)], "`id.orig_h` string, `id.resp_h` string, `id.resp_p` int"
    )
    both = dotted.withColumn("src_ip", F.lit("other"))
    assert rows_of(nb.port_scan_features(dotted)) == [("a", 1, 1, 1)]
    assert rows_of(nb.port_scan_features(both)) == [("a", 1, 1, 1)]


def test_missing_columns_give_an_empty_table(spark):
    frame = spark.createDataFrame([(1,)], "other int")
    for table, columns in [
        (nb.port_scan_features(frame), ["src_ip", "distinct_ports", "distinct_hosts", "total_conns"]),
        (nb.brute_force_features(frame), ["src_ip", "failed_attempts", "dst_ip"]),
        (nb.beaconing_features(frame), ["src_ip", "dst_ip", "n_conns", "mean_interval", "jitter"]),
        (nb.dns_features(frame), ["src_ip", "query", "qlen", "entropy"]),
        (nb.exfil_features(frame), ["src_ip", "dst_ip", "total_orig_bytes", "n_conns"]),
    ]:
        assert table.columns == columns
        assert table.count() == 0


def test_failed_states(conn):
    frame = conn([{"conn_state": s} for s in [*STATES, "SF", "RSTRH", "OTH", None]])
    assert rows_of(nb.brute_force_features(frame)) == [("10.0.0.1", 6, "10.0.0.2")]


def test_port_text(spark):
    frame = spark.createDataFrame(
        [("a", "22.0"), ("a", "22"), ("a", "abc"), ("a", None), ("a", "23")],
        "src_ip string, dst_port string",
    )
    assert rows_of(nb.brute_force_features(frame)) == [("a", 2, None)]


def test_first_target_is_the_earliest_known(conn):
    frame = conn(
        [
            {"ts": 3.0, "uid": "c", "id_resp_h": "late"},
            {"ts": 1.0, "uid": "a", "id_resp_h": None},
            {"ts": 2.0, "uid": "z", "id_resp_h": "second"},
            {"ts": 2.0, "uid": "b", "id_resp_h": "first"},
        ]
    )
    assert rows_of(nb.brute_force_features(frame)) == [("10.0.0.1", 4, "first")]


def test_target_that_is_not_text_is_dropped(spark):
    frame = spark.createDataFrame([("a", 7, 22)], "src_ip string, dst_ip int, dst_port int")
    assert rows_of(nb.brute_force_features(frame)) == [("a", 1, None)]


def beat(times, **more):
    return [{"ts": t, **more} for t in times]


class TestBeaconing:
    def features(self, frame):
        return rows_of(nb.beaconing_features(frame))

    def test_group_size(self, conn):
        assert self.features(conn(beat([1.0]))) == []
        assert self.features(conn(beat([1.0, 2.0]))) == []
        assert self.features(conn(beat([1.0, 2.0, 3.0]))) == [
            ("10.0.0.1", "10.0.0.2", 3, 1.0, 0.0)
        ]

    def test_equal_times(self, conn):
        assert self.features(conn(beat([5.0] * 4))) == []

    def test_copies_count_as_zero_intervals(self, conn):
        times = [0.0, 0.0, 10.0, 10.0, 10.0, 40.0]
        gaps = [0.0, 10.0, 0.0, 0.0, 30.0]
        jitter = round(statistics.pstdev(gaps) / statistics.mean(gaps), 4)
        assert self.features(conn(beat(times))) == [
            ("10.0.0.1", "10.0.0.2", 6, 8.0, jitter)
        ]

    def test_order_and_bad_times(self, spark):
        frame = spark.createDataFrame(
            [("a", "b", t) for t in ["30", "10", "x", None, "nan", "20", "1e1"]]
            + [(None, "b", "1"), ("a", None, "1")],
            "src_ip string, dst_ip string, timestamp string",
        )
        mean = 20 / 3
        jitter = statistics.pstdev([0, 10, 10]) / mean
        assert self.features(frame) == [("a", "b", 4, round(mean, 2), round(jitter, 4))]

    def test_slice_edges(self, conn):
        """Times on, just before and far beyond a slice's edge."""
        times = [9.999999, 10.0, 10.000001, 20.0, 95.5, 4000.25, 4000.25]
        gaps = [b - a for a, b in zip(times, times[1:])]
        mean = statistics.mean(gaps)
        assert self.features(conn(beat(times[::-1]))) == [
            ("10.0.0.1", "10.0.0.2", 7, round(mean, 2), round(statistics.pstdev(gaps) / mean, 4))
        ]


def brute_intervals(rows):
    pairs = {}
    for src, dst, ts in rows:
        pairs.setdefault((src, dst), []).append(ts)
    result = []
    for (src, dst), times in pairs.items():
        times.sort()
        result += [(src, dst, b, b - a) for a, b in zip(times, times[1:])]
        result.append((src, dst, times[0], None))
    return sorted(result, key=repr)


SLOW = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@SLOW
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b"]),
            st.sampled_from(["x", "y"]),
            st.one_of(st.integers(0, 60), st.integers(0, 10**6)).map(lambda n: n / 4),
        ),
        min_size=1,
        max_size=60,
    ),
)
def test_intervals_are_those_of_every_connection(spark, rows):
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, ts double").repartition(3)
    assert rows_of(nb.beacon_intervals(frame)) == brute_intervals(rows)


def test_one_pair_with_a_third_of_all_rows(spark):
    """A hot pair, half of it one timestamp, beside many ordinary pairs."""
    hot = spark.range(20_000).select(
        F.lit("hot").alias("src_ip"),
        F.lit("c2").alias("dst_ip"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id") / 8).alias("ts"),
    )
    rest = spark.range(40_000).select(
        F.concat(F.lit("s"), F.col("id") % 500).alias("src_ip"),
        F.lit("d").alias("dst_ip"),
        (F.col("id") * F.col("id") % 7919 / 4).alias("ts"),
    )
    frame = hot.unionByName(rest)
    found = {(row[0], row[1]): row[2:] for row in rows_of(nb.beaconing_features(frame))}
    for pair in [("hot", "c2"), ("s7", "d")]:
        times = sorted(row.ts for row in frame.where(f"src_ip = '{pair[0]}'").collect())
        gaps = [b - a for a, b in zip(times, times[1:])]
        mean = statistics.fmean(gaps)
        jitter = statistics.pstdev(gaps) / mean
        assert found[pair] == (len(times), round(mean, 2), pytest.approx(jitter, abs=6e-5))
    assert len(found) == 501


def test_query_names(spark):
    tie = "a" * 16 + "b" * 8 + "ccddeefg"
    frame = spark.createDataFrame(
        [("h", q) for q in ["", "aaaa", "ab", "abcd", tie, "é💡é💡", None]] + [(None, "ab")],
        "src_ip string, query string",
    )
    assert rows_of(nb.dns_features(frame)) == sorted(
        [
            ("h", "", 0, 0.0),
            ("h", "aaaa", 4, 0.0),
            ("h", "ab", 2, 1.0),
            ("h", "abcd", 4, 2.0),
            ("h", tie, 32, 2.062),
            ("h", "é💡é💡", 4, 1.0),
            (None, "ab", 2, 1.0),
        ],
        key=repr,
    )
    assert rows_of(nb.dns_features(frame.select("query").limit(1))) == [("N/A", "", 0, 0.0)]


def test_sample_query_names(spark):
    names = ["_spotify-connect._tcp.local", "_ipps._tcp.local"]
    frame = spark.createDataFrame([(n,) for n in names], "qname string")
    assert rows_of(nb.dns_features(frame)) == [
        ("N/A", "_ipps._tcp.local", 16, 3.203),
        ("N/A", "_spotify-connect._tcp.local", 27, 3.736),
    ]


def formula(text):
    return sum(-c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


@SLOW
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_entropy(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, query string")
    short = {r["query"]: r["entropy"] for r in nb.dns_features(frame).collect()}
    long = dict(rows_of(nb.text_entropy(frame, "id", "query")))
    for key, text in enumerate(texts):
        assert short[text] == pytest.approx(formula(text), abs=6e-4)
        assert long[key] == pytest.approx(formula(text), abs=6e-4)
        assert 0 <= short[text] <= math.log2(max(len(text), 1)) + 1e-3


def test_entropy_of_nothing(spark):
    frame = spark.createDataFrame([(1, ""), (2, None), (3, "aab")], "id int, t string")
    assert rows_of(nb.text_entropy(frame, "id", "t")) == [(1, 0.0), (2, 0.0), (3, 0.918)]


def test_entropy_of_a_very_long_text(spark):
    """Longer than a piece, with characters beyond 16 bits in turn with others."""
    text = "a💡\n" * 200_000
    frame = spark.createDataFrame([(1, text), (2, text[: 2**18])], "id int, t string")
    assert rows_of(nb.text_entropy(frame, "id", "t")) == [(1, 1.585), (2, 1.585)]


def test_ranking(spark):
    scans = spark.createDataFrame(
        [("b", 5), ("a", 5), ("c", 9)], "src_ip string, distinct_ports bigint"
    )
    assert [row.src_ip for row in nb.ranked(scans).collect()] == ["c", "a", "b"]
    beacons = spark.createDataFrame(
        [("a", "y", 0.2), ("b", "x", 0.1), ("a", "x", 0.2)],
        "src_ip string, dst_ip string, jitter double",
    )
    order = [(row.src_ip, row.dst_ip) for row in nb.ranked(beacons).collect()]
    assert order == [("b", "x"), ("a", "x"), ("a", "y")]


def test_bytes(spark):
    frame = spark.createDataFrame(
        [("a", "b", v) for v in ["10", "2.0", "x", None, "-"]] + [("a", None, "5"), (None, "b", "5")],
        "src_ip string, dst_ip string, orig_bytes string",
    )
    assert rows_of(nb.exfil_features(frame)) == [("a", "b", 12, 5)]


def test_bytes_prefer_the_first_name_even_if_null(spark):
    frame = spark.createDataFrame(
        [("a", "b", None, 9)], "src_ip string, dst_ip string, orig_bytes bigint, orig_ip_bytes bigint"
    )
    assert rows_of(nb.exfil_features(frame)) == [("a", "b", 0, 1)]


def test_sum_beyond_64_bits(conn):
    frame = conn([{"orig_bytes": 2**63 - 1}, {"orig_bytes": 5}])
    assert rows_of(nb.exfil_features(frame)) == [("10.0.0.1", "10.0.0.2", 2**63 + 4, 2)]
    below = conn([{"orig_bytes": -(2**63)}, {"orig_bytes": -5}])
    assert rows_of(nb.exfil_features(below)) == [("10.0.0.1", "10.0.0.2", -(2**63) - 5, 2)]
    assert nb.ExfiltrationDetector().analyze({"conn": below}).isEmpty()
    (alert,) = nb.ExfiltrationDetector().analyze({"conn": frame}).collect()
    assert str(2**63 + 4) in alert.description and str(2**63 + 4) in alert.evidence


@pytest.mark.parametrize(
    ("text", "number"),
    [
        (str(2**63 - 1), 2**63 - 1),
        (str(2**63), None),
        (str(-(2**63)), -(2**63)),
        ("-9007199254740993", -9007199254740993),
        (" 1000000000000000001 ", 1000000000000000001),
        ("999999999999999999", 999999999999999999),
        ("0.9999999", 0),
        ("2.2e1", 22),
        ("nan", None),
        ("inf", None),
        ("abc", None),
    ],
)
def test_whole_numbers_are_exact(spark, text, number):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(to_long(F.col("t"))).first()[0] == number


def test_target_of_the_earliest_known_time(spark):
    rows = [
        ("a", None, "u1", "without a time"),
        ("a", 5.0, None, "without a uid"),
        ("a", 5.0, "u2", "first"),
        ("a", 6.0, "u0", "later"),
        ("a", 1.0, "u0", None),
        ("b", None, None, "z"),
        ("b", None, None, "y"),
    ]
    frame = spark.createDataFrame(rows, "src_ip string, ts double, uid string, dst_ip string").withColumn(
        "dst_port", F.lit(22)
    )
    assert rows_of(nb.brute_force_features(frame)) == [("a", 5, "first"), ("b", 2, "y")]


def test_windowed_forms_without_their_columns(spark):
    bare = spark.createDataFrame([("a",)], "src_ip string")
    for feature in (nb.port_scan_windowed, nb.brute_force_windowed, nb.beaconing_windowed):
        found = feature(bare)
        assert found.isEmpty() and found.columns[:3] == ["window_start", "window_end", "src_ip"]


def test_sliding_windows_of_uneven_panes(spark):
    rows = [("s", f"h{n % 3}", n % 7, float(n * 11)) for n in range(60)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, ts double")
    found = {
        row.window_start.timestamp(): row for row in nb.port_scan_windowed(frame, "100 seconds", "40 seconds").collect()
    }
    for start, row in found.items():
        inside = [r for r in rows if start <= r[3] < start + 100]
        assert row.total_conns == len(inside)
        assert (row.distinct_ports, row.distinct_hosts) == (len({r[2] for r in inside}), len({r[1] for r in inside}))
    covering = sum(start <= r[3] < start + 100 for r in rows for start in range(-80, 700, 40))
    assert sum(row.total_conns for row in found.values()) == covering


@SLOW
@given(
    st.lists(
        st.one_of(
            st.floats(0, 1e6),
            st.integers(0, 10**6).map(lambda n: n / 10**5),
            st.integers(0, 10**6).map(lambda n: n / 2**4),
            st.floats(2**31, 2**60),
        ),
        min_size=1,
        max_size=200,
    )
)
def test_rounding_is_that_of_the_binary_value(spark, numbers):
    frame = spark.createDataFrame([(n,) for n in [*numbers, 0.10005, 0.00005, 2.5, 4.55]], "n double")
    shown = frame.select(
        "n", *[round_places(F.col("n"), p).alias(f"p{p}") for p in (0, 1, 2, 4)]
    )
    for row in shown.collect():
        for places in (0, 1, 2, 4):
            assert row[f"p{places}"] == round(row["n"], places), (row["n"], places)


def test_rows_may_come_in_any_order_and_layout(conn):
    rows = [
        {"ts": float(i * i % 101), "uid": str(i), "id_resp_p": i % 30, "id_orig_h": f"h{i % 4}"}
        for i in range(300)
    ]
    frame, mixed = conn(rows), conn(rows[::-1]).repartition(7, "uid")
    for features in (
        nb.port_scan_features,
        nb.brute_force_features,
        nb.beaconing_features,
        nb.exfil_features,
    ):
        assert rows_of(features(frame)) == rows_of(features(mixed))
