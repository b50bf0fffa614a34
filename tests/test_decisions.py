"""Economics, selection, fairness and planning on hand-made populations."""

import pytest
from pyspark.sql import functions as F

from stayline.functions import expr
from stayline.operators import fairness, metrics, policy


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, 0.40, 20e3, 1), (2, 0.30, 30e3, 0), (3, 0.20, 200e3, 1), (4, 0.10, 300e3, 0)]
    return spark.createDataFrame(rows, "id int, p double, salary double, y int")


def test_expected_value_rule_and_probability_rule_disagree(people):
    net = people.withColumn("net", policy.expected_net(F.col("p"), F.col("salary")))
    assert [round(r.net) for r in net.orderBy("id").collect()] == [-500, -250, 7500, 5000]
    chosen = policy.select_within(net, "net", "id", "on").where("on").collect()
    assert {r.id for r in chosen} == {3, 4}
    half = metrics.ranking_grid(people, "p", "y", "id", [0.5]).first()
    assert (half.selected_count, half.captured_positive_cases, half.lift_at_k) == (2, 1, 1.0)


@pytest.mark.parametrize(("maximum", "budget", "expected"), [(1, 1e9, {3}), (700, 2500.0, {3}), (700, 2499.99, set()), (700, 5000.0, {3, 4})])
def test_limits(people, maximum, budget, expected):
    net = people.withColumn("net", policy.expected_net(F.col("p"), F.col("salary")))
    out = policy.select_within(net, "net", "id", "on", maximum=maximum, budget=budget)
    assert {r.id for r in out.where("on").collect()} == expected


def test_cost_threshold_without_gain(people):
    poor = people.withColumn("net", F.lit(-1.0))
    row = policy.cost_threshold(poor, "p", "id", "net").first()
    assert (row.probability_threshold, row.selected_count) == (1.0, 0)


def test_scenarios(spark):
    rows = [("validation", 80e3), ("validation", 100e3), ("current", 90e3), ("current", 110e3)]
    df = spark.createDataFrame(rows, "population string, base_salary double")
    out = policy.scenario_table(df, "population", "base_salary")
    assert out.count() == 54
    base = out.where("population = 'validation' and scenario_id = 'base-standard-base'").first()
    assert base.average_base_salary == 90e3
    assert base.average_maximum_avoidable_cost_usd == 22_500
    assert base.coverage_hours_per_replacement == 180


def test_planning_rollup(people):
    flagged = policy.with_economics(people.withColumn("on", F.col("id") >= 3).withColumn("d", F.lit("x")), "p", "salary")
    active = people.agg(F.lit("x").alias("d"), (F.count(F.lit(1)) + 1).alias("active_workforce_employees"))
    plan = policy.planning_rollup(policy.planning_columns(flagged, "p", "on"), ["d"], "on", active).first()
    assert abs(plan.expected_departures_12m - 1.0) < 1e-12
    assert abs(plan.expected_prevented_departures - 0.075) < 1e-12
    assert plan.protected_active_employees == 1 and plan.planned_intervention_spend_usd == 5000


def test_wilson_interval_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k int, n int")
    low, high = expr.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("lo"), high.alias("hi")).collect()
    assert rows[0].lo is None and rows[0].hi is None
    assert 0.0 <= rows[1].lo < 1e-12 and 1.0 - 1e-12 < rows[2].hi <= 1.0
    assert abs(rows[3].lo - 0.2366) < 1e-4 and abs(rows[3].hi - 0.7634) < 1e-4


def test_policy_digest_guards_the_reserved_target(people):
    frozen = policy.policy_digest(people.limit(1).select(F.lit(0.35).alias("threshold")))
    digest = frozen.first().policy_digest
    target = people.select("id", "y")
    assert policy.join_reserved_target(frozen, digest, people.drop("y"), target, "id").count() == 4
    with pytest.raises(ValueError, match="frozen"):
        policy.join_reserved_target(frozen, "0" * 64, people, target, "id")


def test_undefined_rates_are_null_in_subgroups(spark):
    df = spark.createDataFrame([(0.2, 0, False, "a"), (0.4, 0, False, "a"), (0.9, 1, True, "b")], "p double, y int, on boolean, g string")
    rows = {r.group: r for r in fairness.group_metrics(df, ["g"], "p", "y", "on").collect()}
    assert rows["a"].precision is None and rows["a"].true_positive_rate is None and rows["a"].roc_auc is None
    assert rows["b"].false_positive_rate is None and not rows["b"].eligible_for_disparity_comparison


def test_planted_threshold_tie(people):
    tied = people.withColumn("p", F.lit(0.3)).withColumn("net", F.when(F.col("id") == 1, 10.0).otherwise(-4.0))
    row = policy.cost_threshold(tied, "p", "id", "net").first()
    # the prefix holds one row, the threshold later takes all four
    assert row.selected_count == 1 and tied.where(F.col("p") >= row.probability_threshold).count() == 4
