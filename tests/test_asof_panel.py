"""As-of joins, event-time attributes and panel features on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stayline.functions import expr
from stayline.operators import asof, hazard, panel

D = dt.date


@pytest.fixture(scope="module")
def dated(spark):
    rows = [
        (1, D(2023, 1, 1), 1, 10), (1, D(2024, 1, 1), 2, 20), (1, D(2025, 1, 1), 3, 30),
        (2, D(2023, 6, 1), 4, 40), (2, D(2024, 6, 1), 5, 50),
    ]
    return spark.createDataFrame(rows, "employee_id int, effective_date date, id int, value int")


def test_latest_and_first(dated):
    latest = asof.latest_on_or_before(dated, "employee_id", "effective_date", "2024-01-01", ["id"], ["value"])
    assert {r.employee_id: r.value for r in latest.collect()} == {1: 20, 2: 40}
    before = asof.latest_on_or_before(dated, "employee_id", "effective_date", "2024-01-01", ["id"], ["value"], inclusive=False)
    assert {r.employee_id: r.value for r in before.collect()} == {1: 10, 2: 40}
    first = asof.first_on_or_before(dated, "employee_id", "effective_date", "2024-12-31", ["id"], ["value"])
    assert {r.employee_id: r.value for r in first.collect()} == {1: 10, 2: 40}


def test_calendar_months(spark):
    df = spark.createDataFrame([(D(2024, 1, 31),), (D(2023, 12, 1),)], "d date")
    out = df.select(expr.calendar_months(F.lit(D(2025, 1, 1)), F.col("d")).alias("m")).collect()
    assert [r.m for r in out] == [12, 13]


def test_months_before_clamps_to_the_month_end(spark):
    assert asof.months_before("2024-02-29", 12) == "2023-02-28"
    assert asof.months_before("2024-03-31", 1) == "2024-02-29"
    row = spark.range(1).select(F.add_months(F.lit("2024-02-29").cast("date"), -12).alias("d")).first()
    assert str(row.d) == "2023-02-28"


def test_attribute_reconstruction(spark):
    people = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "employee_id int, location_id int").withColumn(
        "cutoff", F.lit("2025-06-30").cast("date")
    )
    events = spark.createDataFrame(
        [
            (1, 1, D(2022, 1, 1), "Hire", None, None, "location_id=1"),
            (2, 1, D(2024, 1, 1), "Transfer", "1", "2", None),
            (3, 1, D(2026, 1, 1), "Transfer", "2", "3", None),
            (4, 2, D(2022, 1, 1), "Hire", None, None, "location_id=4"),
        ],
        "event_id int, employee_id int, event_date date, event_type string, old_value string, new_value string, notes string",
    )
    out = asof.attribute_at(
        people, events, "employee_id", "cutoff", "location_id", "Transfer", "then", initial_pattern="location_id=([0-9]+)"
    )
    assert {r.employee_id: r.then for r in out.collect()} == {1: 2, 2: 4, 3: 5}


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_join_matches_brute_force_with_a_hot_entity(spark, inclusive):
    rng = random.Random(3)
    day = D(2024, 1, 1)
    right = [(0 if i % 3 else i % 11, day + dt.timedelta(days=rng.randint(0, 300)), i) for i in range(1200)]
    left = [(j, 0 if j % 3 else j % 13, day + dt.timedelta(days=rng.randint(-5, 310))) for j in range(900)]
    r = spark.createDataFrame(right, "e int, t date, id int")
    l = spark.createDataFrame(left, "row int, e int, t date")
    out = asof.asof_join(l, r, "e", "t", "t", ["id"], ["id"], inclusive, rows_per_bucket=150)
    got = {x.row: x.id for x in out.collect()}
    assert len(got) == 900
    for row, e, t in left:
        seen = [(rt, i) for re, rt, i in right if re == e and (rt <= t if inclusive else rt < t)]
        assert got[row] == (max(seen)[1] if seen else None)


def test_checked_join_raises(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        asof.checked_join(a, b, ["k"])
    assert asof.checked_join(a, b, ["k"], validate=None).count() == 3


def test_peer_position(spark):
    rows = [("Engineering", 2, 80e3), ("Engineering", 2, 100e3), ("Engineering", 2, 120e3), ("Sales", 2, 50e3)]
    df = spark.createDataFrame(rows, "job_family string, job_level int, base_salary double")
    out = panel.peer_position(df, "base_salary", ["job_family", "job_level"], "p").collect()
    assert sorted((r.job_family, round(r.p, 9)) for r in out) == [
        ("Engineering", -20.0), ("Engineering", 0.0), ("Engineering", 20.0), ("Sales", 0.0),
    ]


def test_future_label(spark):
    df = spark.createDataFrame([(D(2024, 6, 30),), (D(2024, 7, 1),), (D(2025, 6, 30),), (D(2025, 7, 1),), (None,)], "end date")
    s, h = F.lit(D(2024, 6, 30)), F.lit(D(2025, 6, 30))
    got = [r.y for r in df.select(panel.future_label(F.col("end"), s, h).alias("y")).collect()]
    assert got == [0, 1, 1, 0, 0]
    assert df.select(panel.future_label(F.col("end"), s, F.lit(None).cast("date")).alias("y")).where("y is not null").count() == 0


@pytest.fixture(scope="module")
def hazard_row(spark):
    people = spark.createDataFrame(
        [(1, D(2023, 5, 10), None, "Manager")], "employee_id int, hire_date date, termination_date date, organizational_level string"
    )
    risk = hazard.person_months(people, "2025-01-31")
    pay = spark.createDataFrame(
        [(1, 1, D(2024, 1, 1), 100e3, "Hire"), (2, 1, D(2024, 12, 1), 120e3, "Promotion")],
        "compensation_id int, employee_id int, effective_date date, base_salary double, change_reason string",
    )
    reviews = spark.createDataFrame(
        [(1, 1, D(2024, 3, 1), 3.2), (2, 1, D(2024, 9, 1), 3.7), (3, 1, D(2025, 1, 1), 1.0)],
        "review_id int, employee_id int, review_date date, performance_rating double",
    )
    training = spark.createDataFrame(
        [(1, D(2024, 1, 1), "Completed", 8), (1, D(2023, 12, 31), "Completed", 99), (1, D(2024, 5, 5), "Failed", 3), (1, D(2025, 1, 1), "Failed", 1)],
        "employee_id int, completion_date date, completion_status string, training_hours int",
    )
    events = spark.createDataFrame(
        [(1, D(2024, 2, 2), "Manager Change"), (1, D(2024, 12, 31), "Manager Change"), (1, D(2025, 1, 1), "Manager Change")],
        "employee_id int, event_date date, event_type string",
    )
    return {str(r.cutoff): r for r in hazard.lagged_features(risk, pay, reviews, training, events).collect()}


def test_lagged_features_see_only_earlier_records(hazard_row):
    r = hazard_row["2025-01-01"]
    assert (r.performance_level, round(r.performance_trend, 9), r.no_prior_review) == (3.7, 0.5, 0.0)
    assert (r.current_salary, round(r.trailing_compensation_growth, 9)) == (120e3, 0.20)
    assert (r.months_since_promotion, r.no_prior_promotion) == (1.0, 0.0)
    assert (r.completed_training_hours, r.failed_training_count, r.manager_changes) == (8.0, 1, 2)


def test_lagged_defaults(hazard_row):
    r = hazard_row["2023-07-01"]
    assert (r.performance_level, r.performance_trend, r.no_prior_review) == (3.5, 0.0, 1.0)
    assert (r.current_salary, r.trailing_compensation_growth, r.no_prior_promotion) == (None, 0.03, 1.0)


def test_risk_set_starts_after_the_hire_month(hazard_row):
    assert min(hazard_row) == "2023-06-01" and max(hazard_row) == "2025-01-01"


def test_cause_probabilities_respect_limits(spark):
    limits = {
        "minimum_cause_probability": 0.001, "maximum_voluntary_probability": 0.05,
        "maximum_involuntary_probability": 0.03, "maximum_combined_probability": 0.06,
    }
    df = spark.createDataFrame([(-30.0, -30.0), (30.0, 30.0), (-4.0, -5.0)], "v double, i double")
    cols = hazard.cause_probabilities(F.col("v"), F.col("i"), limits)
    low, high, mid = df.select(*[c.alias(n) for c, n in zip(cols, "svi", strict=True)]).collect()
    assert (low.v, low.i) == (0.001, 0.001)
    assert abs(high.v + high.i - 0.06) < 1e-12 and abs(high.v / high.i - 5 / 3) < 1e-9
    assert abs(sum(mid) - 1.0) < 1e-12
