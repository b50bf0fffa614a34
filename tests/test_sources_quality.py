"""Files, contracts, fingerprints, rules, comparison and history correction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stayline.operators import diff, history, quality
from stayline.sources import tables
from stayline.sources.contracts import CONTRACTS, Contract

SMALL = Contract("people", ("id",), "id int, name string, since date", private=("name",))


def write(path, text):
    path.write_text(text)
    return str(path)


def test_every_contract_has_a_schema_and_its_key(spark):
    assert len(CONTRACTS) == 12
    for contract in CONTRACTS.values():
        assert set(contract.key) <= set(contract.columns)


def test_csv_header_must_match(spark, tmp_path):
    good = write(tmp_path / "good.csv", "id,name,since\n1,a,2024-01-01\n")
    bad = write(tmp_path / "bad.csv", "name,id,since\na,1,2024-01-01\n")
    assert tables.read_csv(spark, good, SMALL).first().since == dt.date(2024, 1, 1)
    with pytest.raises(Exception, match="CSV header"):
        tables.read_csv(spark, bad, SMALL).collect()


def test_bulk_load_reconciles(spark, tmp_path):
    write(tmp_path / "people.csv", "id,name,since\n1,a,2024-01-01\n2,b,2024-01-02\n")
    loaded = tables.bulk_load(spark, str(tmp_path), str(tmp_path / "store"), [SMALL]).first()
    assert (loaded.table_name, loaded.row_count) == ("people", 2)
    write(tmp_path / "people.csv", "id,since,name\n1,2024-01-01,a\n")
    with pytest.raises(ValueError, match="header"):
        tables.bulk_load(spark, str(tmp_path), str(tmp_path / "store"), [SMALL])
    assert spark.read.parquet(str(tmp_path / "store" / "people")).count() == 2


def test_conform_projects_and_coerces(spark):
    raw = spark.createDataFrame([("1", "a", "2024-01-01", "x"), ("2", "b", "never", "y")], "id string, name string, since string, extra string")
    out = tables.conform(raw, SMALL, public_only=True)
    assert out.columns == ["id", "since"] and out.where("since is null").count() == 1
    with pytest.raises(ValueError, match="missing"):
        tables.conform(raw.drop("since"), SMALL)


def test_partitioned_sink_prunes(spark, tmp_path):
    path = str(tmp_path / "panel")
    tables.write_partitioned(spark.range(10).withColumn("snapshot_date", (F.col("id") % 2).cast("int")), path, "snapshot_date")
    one = spark.read.parquet(path).where("snapshot_date = 1")
    assert one.count() == 5 and "PartitionFilters: [isnotnull(snapshot_date" in one._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(1, 2.5, None), (2, 1.0, "x"), (2, 1.0, "x")], "a int, b double, c string")
    same = df.orderBy(F.desc("a")).withColumn("b", F.col("b") + 1e-14)
    other = df.withColumn("c", F.coalesce("c", F.lit("NULL")))
    first = tables.fingerprint(df).first()
    assert first == tables.fingerprint(same).first()
    assert first != tables.fingerprint(other).first()
    assert first != tables.fingerprint(df.distinct()).first()


def test_failed_checks_raise(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    checks = {r.check: r.status for r in quality.key_rules(df, "k", 1).collect()}
    assert checks == {"k null": "FAIL", "k repeated": "FAIL", "k sequence": "FAIL"}
    with pytest.raises(ValueError, match="k repeated"):
        quality.report([quality.key_rules(df, "k")], raise_on_failure=True)


def test_leaky_columns_and_policy_coverage(spark):
    df = spark.createDataFrame([("a", 1)], "termination_date string, x int")
    assert quality.forbidden_columns(df, ["termination_date"]).first().status == "FAIL"
    rows = {r.check: r.status for r in quality.policy_coverage(df, {"n": ["x"]}, {"x": "1"}).collect()}
    assert rows["columns without role"] == "FAIL" and rows["reference x"] == "PASS"


def test_overlapping_windows_are_found(spark):
    rows = [(1, "2023-06-30", "2024-06-30"), (1, "2023-06-30", "2024-06-30"), (2, "2024-06-30", "2025-06-30"), (3, "2025-01-31", None)]
    panel = spark.createDataFrame(rows, "s int, d string, h string").select("s", F.to_date("d").alias("d"), F.to_date("h").alias("h"))
    assert quality.windows_disjoint(panel, "s", "d", "h").first().observed == 1
    assert quality.windows_disjoint(panel.where("s < 3"), "s", "d", "h").first().status == "PASS"


def test_table_comparison_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0, 5, True), (2, 2.0, 6, None)], "k int, x double, n int, f boolean")
    b = spark.createDataFrame([(1, 1.0 + 1e-10, 5, True), (2, 2.0 + 1e-6, 7, False)], "k int, x double, n int, f boolean")
    classes = {"x": "tolerant_numeric", "n": "exact_numeric", "f": "boolean"}
    rows = {r.feature: r for r in diff.compare_tables(a, b, ["k"], classes).collect()}
    assert rows["x"].value_mismatches == 1 and rows["n"].value_mismatches == 1
    assert rows["f"].null_pattern_mismatches == 1 and rows["n"].maximum_absolute_difference == 1.0


def test_unreadable_values_raise(spark):
    df = spark.createDataFrame([("true",), ("perhaps",)], "f string")
    with pytest.raises(ValueError, match="f"):
        diff.require_valid(df, {"f": "boolean"})
    assert diff.normalise(df, {"f": "boolean"}).where("f is null").count() == 1


def test_reassignment_keeps_department_level_and_capacity(spark):
    day = dt.date(2024, 6, 1)
    rows = [(100, None, "Active", None, "Senior Manager", 1), (101, 100, "Terminated", day, "Manager", 1)]
    rows += [(102, 100, "Active", None, "Manager", 1), (103, 100, "Active", None, "Manager", 1)]
    rows += [(i, 101, "Active", None, "Individual Contributor", 1) for i in range(1, 9)]
    rows += [(20, 102, "Active", None, "Individual Contributor", 1), (30, 101, "Terminated", dt.date(2024, 1, 1), "Individual Contributor", 1)]
    people = spark.createDataFrame(
        rows, "employee_id int, manager_id int, employment_status string, termination_date date, organizational_level string, department_id int"
    )
    levels = {"Individual Contributor": ["Manager", "Senior Manager"], "Manager": ["Senior Manager"], "Senior Manager": ["Senior Manager"]}
    out = history.reassign_reports(people, "2025-01-01", levels, {"Manager": 4, "Senior Manager": 5}).collect()
    assert {r.employee_id for r in out} == set(range(1, 9))
    load = {}
    for r in out:
        load[r.new_manager_id] = load.get(r.new_manager_id, 0) + 1
    # seven manager slots (one is taken by employee 20), then the senior manager
    assert load == {102: 3, 103: 4, 100: 1}


def test_leave_pairs_survive_only_whole(spark):
    day = dt.date
    people = spark.createDataFrame(
        [(1, "Terminated", day(2024, 6, 1), "Voluntary"), (2, "Active", None, None)],
        "employee_id int, employment_status string, termination_date date, termination_type string",
    )
    events = spark.createDataFrame(
        [(1, day(2024, 5, 1), "Leave"), (1, day(2024, 7, 1), "Leave"), (2, day(2024, 5, 1), "Leave"), (2, day(2024, 7, 1), "Leave"), (2, day(2024, 1, 1), "Termination")],
        "employee_id int, event_date date, event_type string",
    ).selectExpr("*", "'' as old_value", "'' as new_value", "'' as notes")
    out = history.rebuild_events(events, people, "2025-01-01").collect()
    assert sorted((r.employee_id, r.event_type) for r in out) == [(1, "Termination"), (2, "Leave"), (2, "Leave")]


def test_comparison_and_digest_tell_close_values_apart(spark):
    a = spark.sql("SELECT 1 AS k, 9007199254740993L AS n, TIMESTAMP '2024-01-01 01:00:00' AS t, 'a' AS x, 'b' AS y")
    b = spark.sql("SELECT 1 AS k, 9007199254740992L AS n, TIMESTAMP '2024-01-01 23:00:00' AS t, 'a' AS x, 'b' AS y")
    classes = diff.infer_classes(a.drop("k"))
    assert classes["t"] == "timestamp"
    found = {r.feature: (r.value_mismatches, r.maximum_absolute_difference) for r in diff.compare_tables(a, b, ["k"], classes).collect()}
    assert found["n"] == (1, 1.0) and found["t"][0] == 1 and found["x"][0] == 0

    def digest(df, *columns):
        return tables.fingerprint(df, list(columns)).first()

    assert digest(a, "t") != digest(b, "t")
    pairs = spark.sql("SELECT 'a\x1fb' AS x, 'c' AS y"), spark.sql("SELECT 'a' AS x, 'b\x1fc' AS y")
    assert digest(pairs[0], "x", "y") != digest(pairs[1], "x", "y")
    assert digest(spark.sql("SELECT '<NULL>' AS x"), "x") != digest(spark.sql("SELECT CAST(NULL AS STRING) AS x"), "x")
    long = "SELECT CAST('12345678901234567{}.50' AS DECIMAL(38,2)) AS x"
    assert digest(spark.sql(long.format(1)), "x") != digest(spark.sql(long.format(2)), "x")
    assert digest(spark.sql("SELECT DATE '2024-01-01' AS x"), "x") == digest(spark.sql("SELECT TIMESTAMP '2024-01-01' AS x"), "x")
