"""Counts that merge: bitmaps of ports, stored sketches, sessions."""

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import netbehave as nb
from netbehave.sources.sketch_store import bound, daily_sketches
from tests.conftest import rows_of
from tests.test_plans import static_plan

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def at(seconds):
    return START.timestamp() + seconds


# ---------------------------------------------------------------- ports


def test_every_port_once(spark):
    """All 65,536 ports, and numbers beside them, are counted and kept in 1,024 words."""
    log = spark.range(70_000).selectExpr(
        "'a' AS src_ip", "'h' AS dst_ip", "CAST(id % 65536 AS int) AS dst_port"
    )
    words = nb.port_words(log)
    assert words.where("kind = 'port'").count() == 1024
    assert rows_of(nb.merged_ports(words)) == [("a", 65_536, 1, 70_000)]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_odd_ports_are_counted_as_stored(spark, kind):
    ports = {
        "bigint": [None, 0, 1, 63, 64, 65_535, 65_536, -1, -64, -65, 2**62, -(2**63), 2**63 - 1],
        "string": [None, "0", "22", "22.0", "022", "-0", "-5", "x", "", "9" * 18, "9" * 30, "9007199254740993", "9007199254740992"],
        "double": [None, 0.0, 22.0, 22.5, 1e300, -3.0, float("nan")],
    }[kind]
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.choice(["h", "i", None]), draw.choice(ports)) for _ in range(400)]
    log = spark.createDataFrame(rows, f"src_ip string, dst_ip string, dst_port {kind}").repartition(5)
    halves = [nb.port_words(log.where("dst_ip = 'h'")), nb.port_words(log.where("dst_ip IS DISTINCT FROM 'h'"))]
    assert rows_of(nb.merged_ports(halves[0].union(halves[1]))) == rows_of(nb.port_scan_features(log))


@pytest.mark.parametrize(("duration", "slide"), [("60 seconds", None), ("60 seconds", "20 seconds"), ("50 seconds", "20 seconds")])
def test_windows_equal_distinct_values(spark, duration, slide):
    draw = random.Random(5)
    rows = [
        (draw.choice(["a", "b", None]), draw.choice(["h", "i", None]), draw.choice([None, *range(-3, 300)]), at(draw.random() * 400))
        for _ in range(2000)
    ]
    log = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, ts double")
    assert rows_of(nb.port_bitmap_windowed(log, duration, slide)) == rows_of(nb.port_scan_windowed(log, duration, slide))


def test_words_are_combined_before_the_shuffle(spark):
    log = spark.range(10).selectExpr("'a' AS src_ip", "'h' AS dst_ip", "CAST(id AS int) AS dst_port")
    plan = static_plan(nb.port_words(log))
    assert "partial_bit_or" in plan and "SortAggregate" not in plan


def test_logs_without_ports_have_no_windows(spark):
    log = spark.createDataFrame([("a", 1.0)], "src_ip string, ts double")
    assert nb.port_bitmap_windowed(log).count() == 0


# ---------------------------------------------------------------- sketches


@pytest.fixture
def days(spark):
    """Four days of a source that touches 3,000 ports a day, half of them the day before's."""
    return spark.range(24_000).selectExpr(
        "'a' AS src_ip",
        "concat('h', id % 9) AS dst_ip",
        "CAST(id % 3000 + 1500 * (id div 6000) AS int) AS dst_port",
        f"{at(0)} + 86400.0 * (id div 6000) + id % 6000 AS ts",
    )


def test_spans_are_joined_from_sketches(spark, days, tmp_path):
    store = nb.SketchStore(spark, str(tmp_path / "sketches"))
    assert store.features(date(2024, 3, 1), date(2024, 3, 2)).collect() == []
    store.write(days)
    for n_days in (1, 2, 4):
        row = store.features(date(2024, 3, 1), date(2024, 3, n_days)).first()
        exact = 3000 + 1500 * (n_days - 1)
        assert abs(row["distinct_ports"] - exact) <= bound() * exact
        assert row["distinct_hosts"] == 9 and row["total_conns"] == 6000 * n_days
    assert store.features(date(2024, 3, 9), date(2024, 3, 9)).collect() == []


def test_a_day_is_replaced_and_only_its_folder_is_read(spark, days, tmp_path):
    store = nb.SketchStore(spark, str(tmp_path / "sketches"))
    store.write(days)
    store.write(days.where(f"ts < {at(86400)}"))
    assert store.features(date(2024, 3, 1), date(2024, 3, 4)).first()["total_conns"] == 24_000
    plan = static_plan(store.features(date(2024, 3, 2), date(2024, 3, 3)))
    assert "PartitionFilters: [isnotnull(date" in plan


def test_sketches_leave_out_what_has_no_day_or_source(spark):
    rows = [(None, "h", 1, at(0)), ("a", "h", 1, None), ("a", None, None, at(0))]
    log = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, ts double")
    found = daily_sketches(log).select("src_ip", F.hll_sketch_estimate("ports"), "total_conns").collect()
    assert [tuple(row) for row in found] == [("a", 0, 1)]


# ---------------------------------------------------------------- sessions


def plain_sessions(rows, gap):
    pairs = {}
    for src, dst, ts, sent in rows:
        if src is not None and dst is not None and ts is not None:
            pairs.setdefault((src, dst), []).append((ts, sent or 0))
    found = []
    for (src, dst), times in pairs.items():
        times.sort()
        sessions = [[times[0]]]
        for before, one in zip(times, times[1:]):
            if one[0] - before[0] > gap:
                sessions.append([])
            sessions[-1].append(one)
        for one in sessions:
            ends = [datetime.fromtimestamp(one[n][0], timezone.utc).replace(tzinfo=None) for n in (0, -1)]
            found.append((src, dst, *ends, sum(sent for _, sent in one), len(one)))
    return sorted(found, key=repr)


def session_rows(df):
    return sorted(
        (
            (r["src_ip"], r["dst_ip"], r["session_start"], r["session_end"], int(r["total_orig_bytes"]), r["n_conns"])
            for r in df.collect()
        ),
        key=repr,
    )


@pytest.fixture
def visits():
    """A third of all rows in one pair; gaps exactly at, under and over the limit; ties."""
    draw = random.Random(6)
    rows = []
    for n in range(900):
        hot = n % 3 == 0
        src, dst = ("hot", "h") if hot else (draw.choice(["a", "b", None]), draw.choice(["h", "i", None]))
        rows.append((src, dst, at(draw.randrange(0, 40_000, 10)), draw.choice([None, 5, 10**12])))
    rows += [("edge", "h", at(s), 1) for s in (0, 299, 598, 898, 1197, 1496, 1797, 1797, 1797)]
    # A chain that goes on for days, over many slices.
    rows += [("long", "h", at(290 * n), 1) for n in range(900)] + [("a", "h", None, 7)]
    return rows


def test_sessions_end_at_gaps(spark, visits):
    log = spark.createDataFrame(visits, "src_ip string, dst_ip string, ts double, orig_bytes bigint").repartition(6)
    found = session_rows(nb.exfil_sessions(log, "300 seconds"))
    assert found == plain_sessions(visits, 300)
    assert [row[-1] for row in found if row[0] == "edge"] == [6, 3]
    assert [row[-1] for row in found if row[0] == "long"] == [900]


def test_streamed_sessions_equal_batch(spark, visits, tmp_path):
    schema = "src_ip string, dst_ip string, ts double, orig_bytes bigint"
    ordered = sorted((row for row in visits if row[2] is not None), key=lambda row: row[2])
    for part in range(3):
        rows = ordered[part * len(ordered) // 3 : (part + 1) * len(ordered) // 3]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    end = at(timedelta(days=90).total_seconds())
    spark.createDataFrame([("end", "end", end, 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = (
        nb.exfil_sessions(stream, "300 seconds").writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "out"))
    assert session_rows(found) == plain_sessions(visits, 300)


def test_sessions_need_times_and_bytes(spark):
    log = spark.createDataFrame([("a", "h", 1.0)], "src_ip string, dst_ip string, ts double")
    assert nb.exfil_sessions(log).count() == 0
