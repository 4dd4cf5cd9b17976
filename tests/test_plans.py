"""Physical plans: what is read, what is shuffled, what never appears."""

import pytest

import __spark_entry__ as driver
import netbehave as nb

SF_DIR = "/root/testdata/sf0.001"
WRITES = {
    "log_scan",
    "alert_table",
    "port_scan_stream",
    "brute_force_stream",
    "beaconing_stream",
}
NEVER = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroups",
    "SinglePartition, REPARTITION",
)


def final_plan(df):
    """Plan after adaptive execution has run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    text = execution.executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def static_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - WRITES))
def test_no_row_by_row_python_and_no_cross_join(spark, name):
    plan = static_plan(driver.queries()[name](spark, SF_DIR))
    assert not [bad for bad in NEVER if bad in plan]


@pytest.mark.parametrize(
    "name, count",
    [
        ("conn_project", 0),
        ("dns_features", 0),
        ("dns_tunnel_alerts", 0),
        ("exfil_features", 1),
        ("brute_force_features", 1),
        ("port_scan_features", 2),
        ("beaconing_features", 2),
        ("beaconing_alerts", 2),
        ("text_entropy", 0),
        ("beacon_intervals", 2),
    ],
)
def test_shuffles(spark, name, count):
    assert shuffles(final_plan(driver.queries()[name](spark, SF_DIR))) == count


@pytest.mark.parametrize("name", ["beacon_intervals", "beaconing_features", "beaconing_features_hot"])
def test_beaconing_reads_once_and_joins_nothing(spark, name):
    plan = static_plan(driver.queries()[name](spark, SF_DIR))
    assert plan.count("FileScan") == 1
    assert "Union" not in plan and "Join" not in plan
    assert any("Window [lag" in line and "slice" in line for line in plan.splitlines())


@pytest.fixture
def stored_conn(spark, conn, tmp_path):
    path = str(tmp_path / "conn")
    conn([{}]).write.parquet(path)
    return spark.read.parquet(path)


def scan(df):
    return next(line for line in static_plan(df).splitlines() if "FileScan" in line)


def test_login_filters_reach_the_scan(stored_conn):
    line = scan(nb.brute_force_features(stored_conn))
    pushed = line[line.index("PushedFilters") :]
    assert "EqualTo(id_resp_p,22)" in pushed
    assert "In(conn_state" in pushed


@pytest.mark.parametrize(
    "features, unread",
    [
        (nb.port_scan_features, ["ts", "uid", "conn_state", "orig_bytes"]),
        (nb.exfil_features, ["ts", "uid", "id_resp_p", "conn_state"]),
        (nb.beaconing_features, ["uid", "id_resp_p", "conn_state", "orig_bytes"]),
        (nb.brute_force_features, ["orig_bytes"]),
    ],
)
def test_only_needed_columns_are_read(stored_conn, features, unread):
    line = scan(features(stored_conn))
    read = line[line.index("ReadSchema") :]
    assert not [name for name in unread if f"{name}:" in read]


def test_counting_happens_before_the_shuffle(spark):
    plan = static_plan(driver.queries()["exfil_features"](spark, SF_DIR))
    below = plan[plan.index("Exchange") :]
    assert "partial_sum" in below and "partial_count" in below
