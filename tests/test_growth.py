"""Steps whose work must not outgrow their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import hazard, history, isotonic, model, panel, rank, resample


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_isotonic_application_reads_no_frame_to_the_end(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 97 / 100.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    pools = isotonic.isotonic_pools(rows, "s", "y")
    out = isotonic.apply_isotonic(rows.where("id % 2 = 0"), pools, "s", block=64)
    assert "unboundedfollowing" not in plan(out).lower()
    ends = sorted({(p[e], p["value"]) for p in pools.collect() for e in ("low", "high")})
    for r in out.collect():
        assert r["isotonic"] == pytest.approx(np.interp(r["s"], [e[0] for e in ends], [e[1] for e in ends]))


def fold_rows(spark, twice=False):
    rng = np.random.default_rng(5)
    people = [
        (i, None if rng.random() < 0.1 else float(rng.normal(5e4, 1e4)), None if rng.random() < 0.2 else "abcd"[rng.integers(4)], int(rng.random() < 0.3))
        for i in range(400)
    ]
    return spark.createDataFrame(people + people[:40] * twice, "id long, pay double, kind string, y int")


@pytest.mark.parametrize("twice", [False, True])
def test_fold_fits_equal_fits_to_copies(spark, twice):
    rows = fold_rows(spark, twice)
    held = rows.withColumn("_train", F.expr("array_repeat(1 + id % 3, 1 + CAST(id % 2 AS INT))").cast("array<int>"))
    fits, fitted = model.fit_fold_logistic(held, ["pay"], {"kind": ["a", "b", "c"]}, "y", 3)
    copies = held.withColumn("fit", F.explode("_train"))
    train, _, names = model.encode_per_fit(copies, copies, ["pay"], {"kind": ["a", "b", "c"]}, ["id", "y"])
    expected = model.fit_logistic(train, names, "y", "fit")
    assert fits.features == expected.features and sorted(fits.groups) == sorted(expected.groups) == [1, 2, 3]
    for g, beta in expected.groups.items():
        assert fits.groups[g] == pytest.approx(beta, abs=1e-7)


def test_repeated_folds_of_rows_that_come_twice(spark):
    out = model.repeated_out_of_fold_models(fold_rows(spark, True), ["pay"], {"kind": ["a", "b", "c"]}, "id", "y", 3, 4, 9).collect()
    assert len(out) == 400
    assert {r["id"] for r in out if not r["covered"]} == set(range(40))
    assert {r["scores"] for r in out if r["covered"]} == {4}


def test_a_column_without_values_leaves_no_fit(spark):
    rows = fold_rows(spark).withColumn("pay", F.lit(None).cast("double"))
    assert model.repeated_out_of_fold_models(rows, ["pay"], {"kind": ["a", "b", "c"]}, "id", "y", 3, 2, 9).count() == 0


@pytest.mark.parametrize("probabilities", [{"m": 0.5}, {"lo": 0.0, "q": 0.25, "hi": 1.0}])
def test_quantiles_by_cells(spark, probabilities):
    rng = np.random.default_rng(3)
    values = {None: np.concatenate([rng.normal(0, 1e3, 300), [0.0, -0.0, 1e-310]]), "b": np.repeat(rng.integers(1, 5, 40), 9) * 1.0, "c": np.array([7.5])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("c", None), ("d", None)], "g string, v double")
    found = {r["g"]: r for r in rank.exact_quantiles(rows, "v", probabilities, ["g"], rows_per_bucket=30).collect()}
    assert set(found) == set(values)
    for g, vs in values.items():
        assert found[g]["_n"] == len(vs)
        for name, p in probabilities.items():
            assert found[g][name] == pytest.approx(np.quantile(vs, p), abs=1e-12)


def test_few_values_are_exchanged_for_a_median(spark):
    rows = spark.range(20000).select((F.col("id") % 2).alias("g"), (F.col("id") * 3.5 + 1).alias("v"))
    near = rank._near_quantiles(rows, "v", F.count(F.lit(1)), [0.5], ["g"])
    assert near.count() < 200


def test_ranks_with_a_base_do_not_repeat_the_steps_before(spark):
    base = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 50).alias("a"), (F.col("id") * 11 % 60).alias("b"))
    out = expected = base
    for name in ("a", "b"):
        order = [rank.Key(name), rank.Key("id")]
        out = rank.ranked(out, order, ["g"], f"r_{name}", rows_per_bucket=40, base=base)
        expected = rank.ranked(expected, order, ["g"], f"r_{name}")
    assert sorted(map(tuple, out.select("id", "r_a", "r_b").collect())) == sorted(map(tuple, expected.select("id", "r_a", "r_b").collect()))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 500") == 1


def test_reassigned_reports_come_from_stored_rounds(spark):
    people = [(1, None, 1, "Manager", "Terminated", "2020-01-01")] + [(i, 1, 1, "Individual Contributor", "Active", None) for i in range(2, 9)]
    people += [(i, None, 1, "Manager" if i < 12 else "Senior Manager", "Active", None) for i in range(10, 14)]
    frame = spark.createDataFrame(people, "employee_id long, manager_id long, department_id long, organizational_level string, employment_status string, termination_date string")
    frame = frame.withColumn("termination_date", F.to_date("termination_date"))
    levels = {"Individual Contributor": ["Manager", "Senior Manager"]}
    out = history.reassign_reports(frame, "2021-01-01", levels, {"Manager": 2, "Senior Manager": 1})
    assert sorted(r["new_manager_id"] or 0 for r in out.collect()) == [0, 10, 10, 11, 11, 12, 13]
    assert "Window" not in plan(out)


def test_peers_meet_their_centres_without_an_exchange_of_rows(spark):
    rows = spark.range(300).select("id", (F.col("id") % 4).alias("g"), (F.col("id") * 1.5).alias("v"))
    for out in (hazard.robust_peer_z(rows, "v", ["g"], "z"), panel.peer_position(rows, "v", ["g"], "z")):
        assert "SortMergeJoin" not in plan(out)
        assert out.count() == 300


def test_rates_meet_the_folds_without_an_exchange_of_rows(spark):
    out = resample.repeated_out_of_fold(fold_rows(spark), "id", "y", 3, 4, 9, "kind")
    assert "SortMergeJoin" not in plan(out)
    assert {r["scores"] for r in out.collect()} == {4}
