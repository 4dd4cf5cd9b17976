"""Compaction, appends without repeats and counts of the alert table."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import netbehave as nb
from netbehave.sources.alert_store import ALERT_SCHEMA, COMPACTED, alert_id
from netbehave.sources.schemas import ALERT_COLUMNS
from tests.conftest import rows_of

START = datetime(2026, 3, 1)


@pytest.fixture
def store(spark, tmp_path):
    return nb.AlertStore(spark, str(tmp_path / "alerts"))


def alerts(spark, numbers, days=1):
    """One alert for each number, over so many dates; their content follows the number."""
    rows = [
        (START + timedelta(days=n % days), "D", "HIGH" if n % 2 else "LOW", f"s{n}", None, f"alert {n}", "", "{}", "{}")
        for n in numbers
    ]
    schema = T.StructType([T.StructField(name, ALERT_SCHEMA[name].dataType) for name in ALERT_COLUMNS[1:]])
    return spark.createDataFrame(rows, schema).withColumn("id", alert_id()).select(*ALERT_COLUMNS)


def found(store):
    return rows_of(store.alerts().select(*ALERT_COLUMNS))


def files(store):
    return [name for _, _, names in os.walk(store.path) for name in names if name.endswith(".parquet")]


def test_many_appends_become_few_files(spark, store):
    for n in range(0, 120, 4):
        store.append(alerts(spark, range(n, n + 4), days=3))
    want, reader = found(store), store.alerts()
    assert len(files(store)) >= 90
    assert store.compact() == 30
    assert len(store.batches()) == 1
    assert len(store.alerts().inputFiles()) == 6
    assert found(store) == want
    # A reader from before goes on with the folders it knows.
    assert rows_of(reader.select(*ALERT_COLUMNS)) == want
    assert store.vacuum() == 0
    assert store.vacuum(hours=0) == 30
    assert len(files(store)) == 6
    assert found(store) == want
    assert store.compact() == 0
    assert store.count() == 120


def test_compaction_goes_on_from_compacted_folders(spark, store):
    for n in range(6):
        store.append(alerts(spark, [n]))
        store.compact()
    assert len(store.batches()) == 1
    assert [row.src_ip for row in store.alerts().orderBy("src_ip").collect()] == [f"s{n}" for n in range(6)]
    store.vacuum(hours=0)
    store.append(alerts(spark, [6]))
    store.compact()
    assert (store.count(), len(store._version())) == (7, 3)
    assert len(store._versions()) <= 2


def test_large_folders_stay(spark, store):
    store.append(alerts(spark, range(5)), "large")
    small = store._size("large")
    store.append(alerts(spark, range(5, 3000), days=40), "larger")
    store.append(alerts(spark, range(3000, 3005)), "other")
    assert store.compact(small_bytes=2 * small) == 2
    assert "larger" in store.batches() and len(store.batches()) == 2
    assert store.count() == 3005


def test_a_failed_compaction_changes_nothing(spark, store, monkeypatch):
    for n in range(3):
        store.append(alerts(spark, [n]))
    want = found(store)

    def fail(version):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_publish", fail)
        with pytest.raises(OSError):
            store.compact()
    assert found(store) == want
    assert any(name.startswith(f"batch={COMPACTED}") for name in os.listdir(store.path))
    assert store.vacuum(hours=0) == 1
    assert found(store) == want
    assert store.compact() == 3
    assert found(store) == want


def test_unfinished_appends_are_not_compacted(spark, store):
    store.append(alerts(spark, [1]))
    store.append(alerts(spark, [2]))
    os.makedirs(f"{store.path}/batch=running/_temporary")
    assert store.compact() == 2
    assert "running" in store.batches()
    store.append(alerts(spark, [3]), "running")
    assert store.count() == 3


def test_a_compacted_batch_is_final(spark, store):
    store.append(alerts(spark, [1]), "stream-0")
    assert store.append(alerts(spark, [1, 2]), "stream-0") == 2
    store.append(alerts(spark, [3]), "stream-1")
    store.compact()
    for hours in (24, 0):
        store.vacuum(hours)
        assert store.append(alerts(spark, [1, 2]), "stream-0") == 0
        store.append(alerts(spark, [4]))
        store.append(alerts(spark, [5]))
        store.compact()
    assert store.append(alerts(spark, [1, 2]), "stream-0") == 0
    assert store.append(alerts(spark, [6]), "stream-2") == 1
    assert store.count() == 3 + 4 + 1
    with pytest.raises(ValueError):
        store.append(alerts(spark, [1]), f"{COMPACTED}1")


def test_clearing_forgets_versions(spark, store):
    store.append(alerts(spark, [1]), "a")
    store.append(alerts(spark, [2]), "b")
    store.compact()
    store.clear()
    assert (store.count(), store.batches()) == (0, [])
    assert store.append(alerts(spark, [1]), "a") == 1


def test_recent_after_compaction(spark, store):
    for n in range(4):
        store.append(alerts(spark, range(n * 10, n * 10 + 10), days=5))
    want = rows_of(store.recent(7).drop("evidence", "cti_context"))
    store.compact()
    assert rows_of(store.recent(7).drop("evidence", "cti_context")) == want


def test_repeats_are_not_appended(spark, store):
    first = alerts(spark, range(10), days=4)
    assert store.append_new(first)["alerts"] == 10
    assert store.append_new(first)["alerts"] == 0
    # Later alerts of the same content, twice over, and two that are new.
    later = alerts(spark, range(12), days=4).withColumn("timestamp", F.col("timestamp") + F.expr("interval 30 days"))
    assert store.append_new(later.union(later))["alerts"] == 2
    store.compact()
    assert store.append_new(later)["alerts"] == 0
    # None of the same content lies within two days.
    assert store.append_new(later.where("src_ip = 's3'"), days=2)["alerts"] == 1
    assert store.append_new(first.where("src_ip = 's3'"), days=0)["alerts"] == 0
    assert store.append_new(first.limit(0), days=0)["alerts"] == 0


def test_repeats_with_nulls(spark, store):
    rows = alerts(spark, range(3))
    nothing = rows.withColumns({"id": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("timestamp")})
    assert store.append_new(nothing)["alerts"] == 3
    assert store.append_new(nothing, days=1)["alerts"] == 0
    assert store.append_new(rows, days=1)["alerts"] == 0
    assert {row.id for row in store.alerts().collect()} == {row.id for row in rows.collect()}
    empty = rows.withColumns({name: F.lit(None).cast("string") for name in ("id", "detector", "src_ip", "evidence")})
    assert store.append_new(empty.withColumn("description", F.lit(None).cast("string")))["alerts"] == 1


def test_the_earliest_of_equal_ids_is_kept(spark, store):
    rows = alerts(spark, [1])
    store.append_new(rows.withColumn("timestamp", F.expr("timestamp + interval 1 hour")).union(rows))
    assert [row.timestamp for row in store.alerts().collect()] == [START]


def test_a_search_by_dates_reads_those_dates(spark, store):
    store.append(alerts(spark, range(60), days=30))
    plan = store.unseen(alerts(spark, [100], days=30), days=1)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    filters = shown[shown.index("PartitionFilters") : shown.index("PushedFilters")]
    # From the day before the alert's date to the day after it.
    first = (START + timedelta(days=9)).date()
    # The filters of a scan are shortened where they are shown; those of the plan are not.
    chosen = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "alert_date" in filters
    assert str(first) in chosen and str(first + timedelta(days=2)) in chosen
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_counts_come_from_the_write(spark, store):
    counts = {"high": F.count_if(F.col("severity") == "HIGH")}
    assert store.append_counted(alerts(spark, range(7)), counts) == {"alerts": 7, "high": 3}
    assert store.append_counted(alerts(spark, range(7)).limit(0), counts) == {"alerts": 0, "high": 0}
    assert store.append_counted(alerts(spark, [8]).where("rand() > 2"), counts) == {"alerts": 0, "high": 0}


@pytest.mark.parametrize("isolate", [False, True])
def test_a_repeated_run_stores_nothing_new(spark, store, tmp_path, isolate):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = ["#fields\tts\tuid\tid.orig_h\tid.resp_h\tid.resp_p\tconn_state\torig_bytes"]
    lines += [f"{i * i}\ts{i}\tscanner\tvictim\t{1000 + i}\tREJ\t-" for i in range(60)]
    lines += [f"{i * i}\tb{i}\tguesser\tserver\t22\tS0\t10" for i in range(12)]
    (folder / "conn.log").write_text("\n".join(lines) + "\n")
    results = [nb.run(spark, str(folder), store=store, isolate=isolate, once=True) for _ in range(2)]
    assert [result.stored for result in results] == [2, 0]
    by_kind = {(row.detector, row.severity): 1 for row in store.alerts().collect()}
    assert results[0].counts == by_kind and len(by_kind) == 2
    assert results[1].counts == {}
    for result in results:
        result.release()
