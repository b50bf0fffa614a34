"""Workforce reports: headcount, turnover, funnel, durations, profiles, composition, attribution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import active_on, count_if, exact_mean, latest, missing_label, safe_div
from stayline.operators.rank import Key, attach, exact_quantiles, top_per_group


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def headcount_by(employees: DataFrame, dimension: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """Active, terminated and total employees per dimension value."""
    counted = employees.groupBy(on).agg(
        count_if(F.col("employment_status") == "Active").alias("active"),
        count_if(F.col("employment_status") == "Terminated").alias("terminated"),
        F.count(F.lit(1)).alias("total"),
    )
    # The dimension is joined to the few aggregated keys, not to the employees.
    return counted.join(dimension, on).groupBy(*by).agg(
        F.sum("active").alias("active_headcount"),
        F.sum("terminated").alias("terminated_headcount"),
        F.sum("total").alias("total_headcount"),
    )


def active_headcount(employees: DataFrame, dimension: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    counted = (
        employees.where(F.col("employment_status") == "Active").groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.join(dimension, on).groupBy(*by).agg(F.sum("n").alias("active_headcount"))


def with_share(grouped: DataFrame, count: str, out: str, decimals: int = 2) -> DataFrame:
    """Percent of the grand total, over rows that are already grouped."""
    total = F.sum(count).over(Window.partitionBy())
    return grouped.withColumn(out, F.round(100.0 * F.col(count) / total, decimals))


def turnover(employees: DataFrame, dimension: DataFrame, on: str, label: str, start: str, end: str) -> DataFrame:
    """Start and end headcount, exits between both dates, exits per average headcount in percent."""
    counted = employees.groupBy(on).agg(
        count_if(active_on("hire_date", "termination_date", day(start))).alias("s"),
        count_if(active_on("hire_date", "termination_date", day(end))).alias("e"),
        count_if(F.col("termination_date").between(day(start), day(end))).alias("x"),
    )
    grouped = counted.join(dimension, on).groupBy(label).agg(
        F.sum("s").alias("starting_headcount"), F.sum("e").alias("ending_headcount"), F.sum("x").alias("terminations")
    )
    average = (F.col("starting_headcount") + F.col("ending_headcount")) / 2.0
    return grouped.withColumn("average_headcount", F.round(average, 2)).withColumn(
        "turnover_rate_percent", F.round(100.0 * safe_div(F.col("terminations"), average), 2)
    )


def funnel_by_source(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Distinct candidates, applications, interviews, offers, hires and the hire rate per source.

    Counting is per candidate first, so distinct candidates need no second expansion.
    """
    per_candidate = applications.groupBy("candidate_id").agg(
        F.count("application_id").alias("n"),
        F.count(F.when(F.col("interview_score").isNotNull(), F.col("application_id"))).alias("i"),
        F.count(F.when(F.col("offer_date").isNotNull(), F.col("application_id"))).alias("o"),
        F.count(F.when(F.col("application_status") == "Hired", F.col("application_id"))).alias("h"),
    )
    joined = per_candidate.join(candidates.select("candidate_id", "application_source"), "candidate_id")
    grouped = joined.groupBy("application_source").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum("n").alias("application_count"),
        F.sum("i").alias("interviewed_applications"),
        F.sum("o").alias("offers"),
        F.sum("h").alias("hires"),
    )
    return grouped.withColumn(
        "application_to_hire_rate_percent",
        F.round(100.0 * safe_div(F.col("hires"), F.col("application_count")), 2),
    )


def funnel_by_status(candidates: DataFrame, applications: DataFrame, statuses: dict[str, str]) -> DataFrame:
    """Applications per source and one count per status; ``statuses`` maps column to status text."""
    per_candidate = applications.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("total_applications"),
        *[count_if(F.col("application_status") == text).alias(name) for name, text in statuses.items()],
    )
    joined = per_candidate.join(candidates.select("candidate_id", "application_source"), "candidate_id")
    grouped = joined.groupBy("application_source").agg(
        *[F.sum(c).alias(c) for c in ["total_applications", *statuses]]
    )
    return grouped.withColumn(
        "hire_rate_percent", F.round(100.0 * safe_div(F.col("hired"), F.col("total_applications")), 2)
    )


def days_open(as_of: str) -> Column:
    return F.datediff(F.coalesce("close_date", day(as_of)), "open_date").cast("bigint")


def requisition_duration(requisitions: DataFrame, as_of: str) -> DataFrame:
    open_days = days_open(as_of)
    return requisitions.groupBy("requisition_status").agg(
        F.count(F.lit(1)).alias("requisition_count"),
        F.sum("target_headcount").alias("target_headcount"),
        F.round(F.avg(open_days), 2).alias("average_days_open"),
        F.min(open_days).alias("minimum_days_open"),
        F.max(open_days).alias("maximum_days_open"),
    )


def latest_by_employee(facts: DataFrame, order: Sequence[str], values: Sequence[str], as_of: str | None = None) -> DataFrame:
    visible = facts if as_of is None else facts.where(F.col(order[0]) <= day(as_of))
    return visible.groupBy("employee_id").agg(latest(values, [*order, *values]).alias("_r")).select("employee_id", "_r.*")


def _active(employees: DataFrame) -> DataFrame:
    return employees.where(F.col("employment_status") == "Active")


def current_compensation_by_department(
    employees: DataFrame, departments: DataFrame, compensation: DataFrame, as_of: str
) -> DataFrame:
    current = latest_by_employee(
        compensation, ["effective_date", "compensation_id"], ["base_salary", "bonus_target", "equity_value"], as_of
    )
    joined = _active(employees).select("employee_id", "department_id").join(current, "employee_id")
    return (
        joined.join(departments.select("department_id", "department_name"), "department_id")
        .groupBy("department_name")
        .agg(
            F.count(F.lit(1)).alias("active_employee_count"),
            exact_mean("base_salary").alias("average_base_salary"),
            F.round(F.min("base_salary"), 2).alias("minimum_base_salary"),
            F.round(F.max("base_salary"), 2).alias("maximum_base_salary"),
            exact_mean("bonus_target").alias("average_bonus_target"),
            exact_mean("equity_value").alias("average_equity_value"),
        )
    )


def latest_performance_by_department(
    employees: DataFrame, departments: DataFrame, reviews: DataFrame, order: Sequence[str]
) -> DataFrame:
    current = latest_by_employee(reviews, order, ["performance_rating", "goal_completion", "promotion_recommended"])
    joined = _active(employees).select("employee_id", "department_id").join(current, "employee_id")
    return (
        joined.join(departments.select("department_id", "department_name"), "department_id")
        .groupBy("department_name")
        .agg(
            F.count(F.lit(1)).alias("reviewed_employee_count"),
            exact_mean("performance_rating").alias("average_performance_rating"),
            exact_mean("goal_completion").alias("average_goal_completion"),
            F.round(
                100.0 * safe_div(count_if(F.col("promotion_recommended")), F.count("employee_id")), 2
            ).alias("promotion_recommendation_rate_percent"),
        )
    )


def training_per_employee(training: DataFrame) -> DataFrame:
    done = F.col("completion_status") == "Completed"
    return training.groupBy("employee_id").agg(
        count_if(done).alias("completed_training_programs"),
        F.coalesce(F.sum(F.when(done, F.col("training_hours"))), F.lit(0.0)).alias("completed_training_hours"),
    )


def training_by_department(employees: DataFrame, departments: DataFrame, training: DataFrame) -> DataFrame:
    joined = (
        _active(employees)
        .select("employee_id", "department_id")
        .join(training_per_employee(training), "employee_id", "left")
        .fillna(0, ["completed_training_programs", "completed_training_hours"])
    )
    return (
        joined.join(departments.select("department_id", "department_name"), "department_id")
        .groupBy("department_name")
        .agg(
            F.count(F.lit(1)).alias("active_employee_count"),
            exact_mean("completed_training_programs").alias("average_completed_programs"),
            exact_mean("completed_training_hours").alias("average_completed_training_hours"),
        )
    )


def active_profile(tables: dict[str, DataFrame], review_order: Sequence[str]) -> DataFrame:
    """One wide row per active employee."""
    people = _active(tables["employees"]).select(
        "employee_id", "hire_date", "employment_type", "education_level", "organizational_level",
        "department_id", "location_id", "job_role_id",
    )
    pay = latest_by_employee(
        tables["compensation_history"], ["effective_date", "compensation_id"], ["base_salary", "bonus_target", "equity_value"]
    )
    review = latest_by_employee(
        tables["performance_reviews"], review_order, ["performance_rating", "goal_completion", "promotion_recommended"]
    )
    wide = (
        people.join(pay, "employee_id", "left")
        .join(review, "employee_id", "left")
        .join(training_per_employee(tables["training_records"]), "employee_id", "left")
        .fillna(0, ["completed_training_programs", "completed_training_hours"])
        .join(tables["departments"].select("department_id", "department_name"), "department_id")
        .join(tables["locations"].select("location_id", "city", "region"), "location_id")
        .join(tables["job_roles"].select("job_role_id", "job_title", "job_family", "job_level"), "job_role_id")
    )
    return wide.drop("department_id", "location_id", "job_role_id")


def overview_kpis(
    employees: DataFrame, requisitions: DataFrame, applications: DataFrame, as_of: str, start: str, end: str
) -> DataFrame:
    """One row of headline figures; one pass over each table."""
    active = active_on("hire_date", "termination_date", day(as_of))
    people = employees.agg(
        count_if(active).alias("active_headcount"),
        F.count_distinct(F.when(active, F.col("department_id"))).alias("active_department_count"),
        F.count_distinct(F.when(active, F.col("location_id"))).alias("active_location_count"),
        count_if(F.col("termination_date").between(day(start), day(end))).alias("terminations"),
        count_if(active_on("hire_date", "termination_date", day(start))).alias("_s"),
        count_if(active_on("hire_date", "termination_date", day(end))).alias("_e"),
    )
    rate = F.round(100.0 * safe_div(F.col("terminations"), (F.col("_s") + F.col("_e")) / 2.0), 2)
    people = people.withColumn("turnover_rate_percent", rate).drop("_s", "_e")
    open_jobs = requisitions.agg(count_if(F.col("requisition_status") == "Open").alias("open_requisitions"))
    applied = applications.agg(
        F.count(F.lit(1)).alias("total_applications"),
        count_if(F.col("application_status") == "Hired").alias("hired_applications"),
    )
    return beside(people, open_jobs, applied).withColumn("as_of_date", day(as_of))


def beside(*one_row_frames: DataFrame) -> DataFrame:
    """Put one-row aggregates next to each other."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one_row_frames)


def long_counts(df: DataFrame, dimension: str, value: str, label: str) -> DataFrame:
    return df.groupBy(F.col(value).cast("string").alias("category")).agg(F.count(F.lit(1)).alias(dimension)).select(
        F.lit(label).alias("report"), "category", dimension
    )


def load_sanity(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts by status, by department and by application status, hired ids and summed headcount, long."""
    employees, applications = tables["employees"], tables["applications"]
    reports = [
        long_counts(employees, "value", "employment_status", "employees by status"),
        long_counts(employees, "value", "department_id", "employees by department"),
        long_counts(applications, "value", "application_status", "applications by status"),
    ]
    hired = applications.where(F.col("application_status") == "Hired").agg(
        F.count_distinct("employee_id").alias("value")
    )
    filled = tables["job_requisitions"].where(F.col("requisition_status") == "Filled").agg(
        F.coalesce(F.sum("target_headcount"), F.lit(0)).alias("value")
    )
    reports.append(hired.select(F.lit("distinct hired employees").alias("report"), F.lit("all").alias("category"), "value"))
    reports.append(filled.select(F.lit("filled headcount").alias("report"), F.lit("all").alias("category"), "value"))
    return reduce(lambda a, b: a.unionByName(b), reports)


def joined_sample(employees: DataFrame, departments: DataFrame, locations: DataFrame, limit: int = 20) -> DataFrame:
    """First rows by id of the employee, department and location join."""
    return (
        employees.select("employee_id", "department_id", "location_id", "employment_status")
        .join(departments.select("department_id", "department_name"), "department_id")
        .join(locations.select("location_id", "city"), "location_id")
        .orderBy("employee_id")
        .limit(limit)
        .select("employee_id", "department_name", "city", "employment_status")
    )


def _melt(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and feature with the category as text; a row-local expansion."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), missing_label(f).alias("category")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.category")


melt = _melt


def composition(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count and share per category of each feature."""
    counts = _melt(df, features, []).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("headcount"))
    total = F.sum("headcount").over(Window.partitionBy("feature"))
    return counts.withColumn("workforce_share", F.col("headcount") / total)


def rate_by_category(df: DataFrame, features: Sequence[str], outcome: str, minimum: int = 50) -> DataFrame:
    """Rows, positives, rate, base rate and lift per category; small groups are marked."""
    grouped = _melt(df, features, [outcome]).groupBy("feature", "category").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.sum(outcome).cast("bigint").alias("attrition_cases"),
        F.avg(outcome).alias("attrition_rate"),
    )
    base = df.agg(F.avg(outcome).alias("baseline_attrition_rate"))
    return attach(grouped, base, []).select(
        "*",
        safe_div(F.col("attrition_rate"), F.col("baseline_attrition_rate")).alias("lift_vs_baseline"),
        (F.col("sample_size") >= minimum).alias("large_enough"),
    )


def target_balance(df: DataFrame, outcome: str) -> DataFrame:
    counts = df.groupBy(outcome).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and rate per column from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot("_n", list(columns), "column_name", "missing_count").select(
        "column_name", "missing_count", safe_div(F.col("missing_count"), F.col("_n")).alias("missing_rate")
    )


def missingness_vs_outcome(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Outcome rate with the value missing and with it present, for columns that have both or one."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("missing")) for c in columns])
    long = df.select(F.col(outcome).alias("_y"), F.explode(pairs).alias("_p")).select("_y", "_p.*")
    return long.groupBy("column_name").agg(
        count_if(F.col("missing")).alias("missing_rows"),
        F.avg(F.when(F.col("missing"), F.col("_y"))).alias("rate_when_missing"),
        F.avg(F.when(~F.col("missing"), F.col("_y"))).alias("rate_when_present"),
    ).withColumn("difference", F.col("rate_when_missing") - F.col("rate_when_present"))


# The reported quantiles.
SUMMARY_QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max and five exact quantiles per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    return moments.join(exact_quantiles(long, "value", SUMMARY_QUANTILES, ["column_name"]).drop("_n"), "column_name")


def rule_probability(
    eligible: Column, base: float, adjustments: Sequence[tuple[Column, float]], low: float, high: float
) -> Column:
    """Expected probability from additive rules, clipped; 0 for rows outside the rule."""
    total = F.lit(base)
    for condition, delta in adjustments:
        total = total + F.when(condition, delta).otherwise(0.0)
    return F.when(eligible, F.greatest(F.lit(low), F.least(F.lit(high), total))).otherwise(0.0)


def observed_vs_expected(df: DataFrame, group: str, event: Column, expected: Column, individual: Column) -> DataFrame:
    grouped = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("headcount"),
        count_if(event).alias("terminations"),
        F.avg(event.cast("int")).alias("observed_attrition_rate"),
        F.avg(expected).alias("expected_attrition_rate"),
        F.avg(individual.cast("int")).alias("individual_contributor_share"),
    )
    return grouped.withColumn(
        "rate_difference", F.col("observed_attrition_rate") - F.col("expected_attrition_rate")
    )


def events_per_month(df: DataFrame, date: str, out: str = "events") -> DataFrame:
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_format(date, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias(out))
    )


def reattribution_summary(records: DataFrame, domain: str, entity: str = "employee_id") -> DataFrame:
    """How many records belong to another location at event time than today."""
    moved = F.col("current_location") != F.col("historical_location")
    per_entity = records.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), count_if(moved).alias("m"))
    return per_entity.agg(
        F.sum("n").alias("total_records"),
        F.sum("m").alias("reassigned_records"),
        count_if(F.col("m") > 0).alias("reassigned_employees"),
        safe_div(F.sum("m"), F.sum("n")).alias("reassignment_rate"),
    ).select(F.lit(domain).alias("domain"), "*")


def attribution_comparison(records: DataFrame, domain: str, metric: str, aggregate: Column) -> DataFrame:
    """A metric by current and by event-time location, their difference and its relative size."""
    current = records.groupBy(F.col("current_location").alias("location")).agg(
        aggregate.cast("double").alias("current_value")
    )
    historical = records.groupBy(F.col("historical_location").alias("location")).agg(
        aggregate.cast("double").alias("historical_value")
    )
    joined = current.join(historical, "location", "full").fillna(0.0, ["current_value", "historical_value"])
    difference = F.col("historical_value") - F.col("current_value")
    return joined.select(
        F.lit(domain).alias("domain"),
        F.lit(metric).alias("metric"),
        "location",
        "current_value",
        "historical_value",
        difference.alias("difference"),
        F.abs(difference).alias("absolute_difference"),
        safe_div(difference, F.col("current_value")).alias("relative_difference"),
    )


def changed_samples(records: DataFrame, domain: str, date: str, tie_break: Sequence[str], limit: int = 20) -> DataFrame:
    """First changed records of a domain by date."""
    moved = records.where(F.col("current_location") != F.col("historical_location")).withColumn("domain", F.lit(domain))
    order = [Key(date), *[Key(c) for c in tie_break]]
    return top_per_group(moved, ["domain"], order, limit).select(
        "domain", "employee_id", F.col(date).alias("record_date"), "current_location", "historical_location", "position"
    )


def transition_flows(events: DataFrame, change_type: str) -> DataFrame:
    return (
        events.where(F.col("event_type") == change_type)
        .groupBy(F.col("old_value").alias("from_value"), F.col("new_value").alias("to_value"))
        .agg(F.count(F.lit(1)).alias("transitions"))
    )


def hire_mismatch_by(employees: DataFrame, hired: DataFrame, parsed: str, current: str, by: str) -> DataFrame:
    """Share of entities whose value at hire differs from today's, per group."""
    joined = employees.join(hired, "employee_id", "left")
    differs = ~F.coalesce(F.col(parsed) == F.col(current), F.lit(False))
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("employees"),
        count_if(differs).alias("mismatches"),
        F.avg(differs.cast("int")).alias("mismatch_rate"),
    )


def segment_summary(df: DataFrame, segment: str, means: dict[str, str], order: dict[str, int]) -> DataFrame:
    """Count, means and share of the population per segment, with its display order."""
    grouped = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("employee_count"), *[F.avg(c).alias(n) for n, c in means.items()]
    )
    place = F.lit(None).cast("int")
    for label, number in order.items():
        place = F.when(F.col(segment) == label, F.lit(number)).otherwise(place)
    share = 100.0 * F.col("employee_count") / F.sum("employee_count").over(Window.partitionBy())
    return grouped.withColumn("population_percent", share).withColumn("sort_order", place)


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, out: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, out)


def dataset_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row metric tables with equal columns, as metric, both values and their change."""

    def long(df: DataFrame, out: str) -> DataFrame:
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        return typed.unpivot([], list(df.columns), "metric", out)

    joined = long(first, "version_1").join(long(second, "version_2"), "metric", "full")
    change = F.col("version_2") - F.col("version_1")
    return joined.withColumn("absolute_change", change).withColumn(
        "relative_change", safe_div(change, F.abs("version_1"))
    )
