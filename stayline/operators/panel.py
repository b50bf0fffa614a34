"""Point-in-time feature blocks and the employee-snapshot panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import active_on, calendar_months, count_if, safe_div
from stayline.operators.asof import Calendar, assemble, collapse_between, expand_snapshots, facts_at_snapshots
from stayline.operators.rank import exact_quantiles
from stayline.session import store

KEY = ["employee_id", "snapshot_date"]
CHANGE_TYPES = ("Promotion", "Transfer", "Manager Change", "Leave")

# The columns of the panel, in order.
PANEL_COLUMNS = """
employee_id dataset_type snapshot_sequence snapshot_date prediction_end_date approx_age tenure_years employment_type
education_level organizational_level department_name department_group city region location_type job_title job_family
job_level initial_base_salary base_salary bonus_target equity_value salary_growth_percent salary_growth_12m_percent
salary_position_percent days_since_compensation_change compensation_record_count promotion_compensation_count
performance_rating goal_completion promotion_recommended days_since_review review_count average_performance_rating
performance_trend no_prior_review completed_training_programs_12m failed_training_programs_12m
completed_training_hours_12m average_training_score_12m prior_promotion_events prior_transfer_events
prior_manager_change_events prior_leave_events prior_change_events promotions_12m manager_changes_12m leaves_12m
days_since_last_change_event months_since_promotion no_prior_promotion attrition_next_12m
""".split()

LEAKY_COLUMNS = ("termination_date", "termination_type", "employment_status", "final_location_id", "manager_id")


def days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def growth_percent(current: Column, reference: Column) -> Column:
    return 100.0 * (safe_div(current, reference) - 1.0)


def future_label(end: Column, snapshot: Column, horizon: Column) -> Column:
    """1 when the end falls in (snapshot, horizon], else 0; null while the horizon is open."""
    inside = F.coalesce((end > snapshot) & (end <= horizon), F.lit(False))
    return F.when(horizon.isNotNull(), inside.cast("int"))


def compensation_block(compensation: DataFrame, calendar: Calendar) -> DataFrame:
    record = F.struct("effective_date", "compensation_id", "base_salary", "bonus_target", "equity_value")
    collapsed = collapse_between(
        compensation,
        "employee_id",
        "effective_date",
        calendar,
        [
            F.max(record).alias("last"),
            F.min(record).alias("first"),
            F.count(F.lit(1)).alias("n"),
            count_if(F.col("change_reason") == "Promotion").alias("promotions"),
        ],
    )
    year_ago = F.col("_bound") <= F.add_months("snapshot_date", -12)
    grouped = facts_at_snapshots(collapsed, "_bound", calendar).groupBy(*KEY).agg(
        F.max("last").alias("now"),
        F.min("first").alias("first"),
        F.max(F.when(year_ago, F.col("last"))).alias("year_ago"),
        F.sum("n").alias("compensation_record_count"),
        F.sum("promotions").alias("promotion_compensation_count"),
    )
    initial, now = F.col("first.base_salary"), F.col("now.base_salary")
    return grouped.select(
        *KEY,
        initial.alias("initial_base_salary"),
        "now.base_salary",
        "now.bonus_target",
        "now.equity_value",
        growth_percent(now, initial).alias("salary_growth_percent"),
        growth_percent(now, F.coalesce("year_ago.base_salary", initial)).alias("salary_growth_12m_percent"),
        days(F.col("snapshot_date"), F.col("now.effective_date")).alias("days_since_compensation_change"),
        "compensation_record_count",
        "promotion_compensation_count",
        F.col("now.effective_date").alias("latest_compensation_date"),
    )


def performance_block(reviews: DataFrame, calendar: Calendar, tie_break: Sequence[str] = ("review_id",)) -> DataFrame:
    # The values close the ordering, so that full ties give one answer.
    record = F.struct("review_date", *tie_break, "performance_rating", "goal_completion", "promotion_recommended")
    collapsed = collapse_between(
        reviews,
        "employee_id",
        "review_date",
        calendar,
        [
            F.max(record).alias("last"),
            F.min(record).alias("first"),
            F.count(F.lit(1)).alias("n"),
            F.sum("performance_rating").alias("total"),
        ],
        lags=(),
    )
    grouped = facts_at_snapshots(collapsed, "_bound", calendar).groupBy(*KEY).agg(
        F.max("last").alias("now"),
        F.min("first").alias("first"),
        F.sum("n").alias("review_count"),
        (F.sum("total") / F.sum("n")).alias("average_performance_rating"),
    )
    first = F.col("first.performance_rating")
    return grouped.select(
        *KEY,
        "now.performance_rating",
        "now.goal_completion",
        "now.promotion_recommended",
        days(F.col("snapshot_date"), F.col("now.review_date")).alias("days_since_review"),
        "review_count",
        "average_performance_rating",
        first.alias("first_rating"),
        F.coalesce(F.col("now.performance_rating") - first, F.lit(0.0)).alias("performance_trend"),
        F.lit(0).alias("no_prior_review"),
        F.col("now.review_date").alias("latest_review_date"),
    )


def training_block(training: DataFrame, calendar: Calendar, trailing_months: int | None = 12) -> DataFrame:
    visible = facts_at_snapshots(
        training.select("employee_id", "completion_date", "completion_status", "training_hours", "score"),
        "completion_date",
        calendar,
        trailing_months,
    )
    done = F.col("completion_status") == "Completed"
    return visible.groupBy(*KEY).agg(
        count_if(done).alias("completed_training_programs_12m"),
        count_if(F.col("completion_status") == "Failed").alias("failed_training_programs_12m"),
        F.sum(F.when(done, F.col("training_hours")).otherwise(F.lit(0.0))).alias("completed_training_hours_12m"),
        F.avg(F.when(done, F.col("score"))).alias("average_training_score_12m"),
        F.max("completion_date").alias("latest_training_date"),
    )


def event_block(events: DataFrame, calendar: Calendar) -> DataFrame:
    kind = F.col("event_type")
    changes = kind.isin(*CHANGE_TYPES)
    moved = F.when(kind == "Transfer", F.struct("event_date", "event_id", "new_value"))
    names = {"promotion": "Promotion", "transfer": "Transfer", "manager_change": "Manager Change", "leave": "Leave"}
    collapsed = collapse_between(
        events,
        "employee_id",
        "event_date",
        calendar,
        [
            *[count_if(kind == text).alias(name) for name, text in names.items()],
            count_if(changes).alias("change"),
            F.max(F.when(changes, F.col("event_date"))).alias("latest_change_date"),
            F.max(F.when(kind == "Promotion", F.col("event_date"))).alias("latest_promotion_date"),
            F.max(moved).alias("moved"),
            F.max("event_date").alias("latest_event_date"),
        ],
    )
    recent = F.col("_bound") > F.add_months("snapshot_date", -12)

    def lately(name: str) -> Column:
        return F.sum(F.when(recent, F.col(name)).otherwise(F.lit(0)))

    grouped = facts_at_snapshots(collapsed, "_bound", calendar).groupBy(*KEY).agg(
        *[F.sum(name).alias(f"prior_{name}_events") for name in [*names, "change"]],
        lately("promotion").alias("promotions_12m"),
        lately("manager_change").alias("manager_changes_12m"),
        lately("leave").alias("leaves_12m"),
        F.max("latest_change_date").alias("latest_change_date"),
        F.max("latest_promotion_date").alias("latest_promotion_date"),
        F.max("moved").alias("moved"),
        F.max("latest_event_date").alias("latest_event_date"),
    )
    return grouped.withColumn("moved_to", F.col("moved.new_value")).drop("moved").withColumn(
        "days_since_last_change_event", days(F.col("snapshot_date"), F.col("latest_change_date"))
    )


def hire_notes(events: DataFrame, pattern: str, out: str) -> DataFrame:
    """Integer parsed from the note of each entity's first hire event."""
    return (
        events.where(F.col("event_type") == "Hire")
        .groupBy("employee_id")
        .agg(F.min_by("notes", F.struct("event_date", "event_id")).alias("_note"))
        .select("employee_id", F.nullif(F.regexp_extract("_note", pattern, 1), F.lit("")).try_cast("int").alias(out))
    )


COUNT_FILLS = {
    c: 0
    for c in (
        "compensation_record_count promotion_compensation_count review_count completed_training_programs_12m "
        "failed_training_programs_12m prior_promotion_events prior_transfer_events prior_manager_change_events "
        "prior_leave_events prior_change_events promotions_12m manager_changes_12m leaves_12m"
    ).split()
}


def panel_with_audit(
    tables: dict[str, DataFrame],
    calendar: Calendar,
    minimum_tenure_days: int = 0,
    review_tie_break: Sequence[str] = ("review_id",),
) -> DataFrame:
    """The panel plus the dates each row was built from (columns of ``ROW_AUDIT``)."""
    people = expand_snapshots(tables["employees"], "hire_date", "termination_date", calendar)
    people = people.where(F.datediff("snapshot_date", "hire_date") >= minimum_tenure_days)
    people = people.withColumn(
        "attrition_next_12m",
        future_label(F.col("termination_date"), F.col("snapshot_date"), F.col("prediction_end_date")),
    )
    events = tables["employee_events"]
    wide = assemble(
        people,
        KEY,
        [
            (compensation_block(tables["compensation_history"], calendar), {}),
            (
                performance_block(tables["performance_reviews"], calendar, review_tie_break),
                {"performance_trend": 0.0, "no_prior_review": 1},
            ),
            (training_block(tables["training_records"], calendar), {"completed_training_hours_12m": 0.0}),
            (event_block(events, calendar), {}),
        ],
    ).fillna(COUNT_FILLS)
    wide = wide.join(hire_notes(events, r"location_id=([0-9]+)", "hired_into"), "employee_id", "left")
    tenure_days = days(F.col("snapshot_date"), F.col("hire_date"))
    wide = (
        wide.withColumn(
            "snapshot_location_id",
            F.coalesce(F.col("moved_to").try_cast("int"), F.col("hired_into"), F.col("location_id").cast("int")),
        )
        .withColumn("tenure_years", tenure_days / F.lit(365.25))
        .withColumn("approx_age", F.year("snapshot_date") - F.col("birth_year"))
        .withColumn(
            "months_since_promotion",
            F.coalesce(
                calendar_months(F.col("snapshot_date"), F.col("latest_promotion_date")).cast("double"),
                tenure_days / F.lit(365.25) * 12.0,
            ),
        )
        .withColumn("no_prior_promotion", F.col("latest_promotion_date").isNull().cast("int"))
        .withColumnRenamed("location_id", "final_location_id")
    )
    places = tables["locations"].withColumnRenamed("location_id", "snapshot_location_id")
    wide = (
        wide.join(tables["departments"], "department_id")
        .join(places, "snapshot_location_id")
        .join(tables["job_roles"], "job_role_id")
    )
    return peer_position(wide, "base_salary", ["snapshot_date", "job_family", "job_level"], "salary_position_percent")


ROW_AUDIT = (
    "hire_date termination_date latest_compensation_date latest_review_date latest_training_date latest_event_date "
    "snapshot_location_id final_location_id"
).split()


def build_panel(tables: dict[str, DataFrame], calendar: Calendar, **options) -> DataFrame:
    """One row per active employee and snapshot with the 52 panel columns."""
    return panel_with_audit(tables, calendar, **options).select(*PANEL_COLUMNS)


def row_audit(audited: DataFrame) -> DataFrame:
    """Per panel row: employment interval, latest source dates used, location then and now."""
    return audited.select("employee_id", "dataset_type", "snapshot_sequence", "snapshot_date", *ROW_AUDIT)


def peer_position(df: DataFrame, value: str, peers: Sequence[str], out: str) -> DataFrame:
    """Percent distance of a value from the median of its peer group; a null peer key has no median."""
    # the rows are made once for the medians, narrow, and not exchanged for the join with a row per group
    narrow = store(df.where(F.col(value).isNotNull()).select(*peers, value))
    medians = store(exact_quantiles(narrow, value, {"_median": 0.5}, peers).drop("_n"))
    known = df.join(medians, list(peers), "left")
    return known.withColumn(out, growth_percent(F.col(value), F.col("_median"))).drop("_median")


def source_cutoffs(sources: dict[str, tuple[DataFrame, str]], calendar: Calendar, trailing: dict[str, int] | None = None) -> DataFrame:
    """Greatest date used per source and snapshot, next to the cutoff it must not pass."""
    frames = []
    for name, (df, date) in sources.items():
        visible = facts_at_snapshots(df.select(date), date, calendar, (trailing or {}).get(name))
        frames.append(
            visible.groupBy("snapshot_date")
            .agg(F.max(date).alias("latest_date_used"))
            .select("snapshot_date", F.lit(name).alias("source"), "latest_date_used")
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.withColumn("within_cutoff", F.col("latest_date_used") <= F.col("snapshot_date"))


def hire_context(
    applications: DataFrame,
    candidates: DataFrame,
    requisitions: DataFrame,
    departments: DataFrame,
    locations: DataFrame,
    job_roles: DataFrame,
    cutoff: str,
) -> DataFrame:
    """First hired application per employee decided by the cutoff, with candidate and requisition attributes."""
    hired = applications.where(
        (F.col("application_status") == "Hired")
        & F.col("employee_id").isNotNull()
        & (F.col("decision_date") <= F.lit(cutoff).cast("date"))
    ).select("employee_id", "decision_date", "application_id", "candidate_id", "requisition_id")
    # Inner joins can drop an application, so the first one is taken after them.
    chain = (
        hired.join(candidates.select("candidate_id", "application_source", "years_experience"), "candidate_id")
        .join(requisitions.select("requisition_id", "department_id", "location_id", "job_role_id"), "requisition_id")
        .join(departments.select("department_id", "department_name"), "department_id")
        .join(locations.select("location_id", "region"), "location_id")
        .join(job_roles.select("job_role_id", "job_family", "job_level"), "job_role_id")
    )
    values = ["application_source", "years_experience", "department_name", "region", "job_family", "job_level"]
    order = F.struct("decision_date", "application_id", *values)
    first = chain.groupBy("employee_id").agg(F.min_by(F.struct(*values), order).alias("h"))
    return first.select(
        "employee_id",
        "h.application_source",
        F.col("h.years_experience").alias("years_experience_at_hire"),
        F.col("h.department_name").alias("hire_department_name"),
        F.col("h.region").alias("hire_region"),
        F.col("h.job_family").alias("hire_job_family"),
        F.col("h.job_level").alias("hire_job_level"),
    )


def single_snapshot_set(
    tables: dict[str, DataFrame], snapshot: str, horizon: str, review_tie_break: Sequence[str] = ("review_id",)
) -> DataFrame:
    """Modelling set at one date: hire context, lifetime training counts, rounded figures."""
    calendar = [(1, "historical", snapshot, horizon)]
    day, end = F.lit(snapshot).cast("date"), F.lit(horizon).cast("date")
    people = tables["employees"].where(active_on("hire_date", "termination_date", day))
    training = facts_at_snapshots(tables["training_records"], "start_date", calendar)
    done = F.col("completion_status") == "Completed"
    lifetime = training.groupBy("employee_id").agg(
        count_if(done).alias("completed_training_programs"),
        count_if(F.col("completion_status") == "Failed").alias("failed_training_programs"),
        count_if(F.col("completion_status") == "In Progress").alias("in_progress_training_programs"),
        F.sum(F.when(done, F.col("training_hours")).otherwise(F.lit(0.0))).alias("completed_training_hours"),
        F.round(F.avg(F.when(done, F.col("score"))), 2).alias("average_training_score"),
    )
    changes = facts_at_snapshots(tables["employee_events"], "event_date", calendar)
    kind = F.col("event_type")
    event_counts = changes.groupBy("employee_id").agg(
        *[
            count_if(kind == name).alias(f"prior_{name.lower().replace(' ', '_')}_events")
            for name in CHANGE_TYPES
        ],
        count_if(kind != "Hire").alias("prior_change_events"),
        F.max(F.when(kind != "Hire", F.col("event_date"))).alias("last_change"),
    )
    pay = compensation_block(tables["compensation_history"], calendar).drop("snapshot_date")
    reviews = performance_block(tables["performance_reviews"], calendar, review_tie_break).drop("snapshot_date")
    hired = hire_context(
        tables["applications"],
        tables["candidates"],
        tables["job_requisitions"],
        tables["departments"],
        tables["locations"],
        tables["job_roles"],
        snapshot,
    )
    wide = assemble(people, ["employee_id"], [(f, {}) for f in (hired, pay, reviews, lifetime, event_counts)])
    counts = [c for c in wide.columns if c.startswith("prior_") or c.endswith(("_count", "_programs"))]
    wide = wide.fillna(0, subset=[*counts, "completed_training_hours"])
    return wide.select(
        "employee_id",
        day.alias("snapshot_date"),
        end.alias("prediction_end_date"),
        (F.year(day) - F.col("birth_year")).alias("approx_age"),
        F.round(days(day, F.col("hire_date")) / F.lit(365.25), 2).alias("tenure_years"),
        "employment_type",
        "education_level",
        *[c for c in hired.columns if c != "employee_id"],
        "initial_base_salary",
        "base_salary",
        "bonus_target",
        "equity_value",
        F.round("salary_growth_percent", 2).alias("salary_growth_percent"),
        "days_since_compensation_change",
        "compensation_record_count",
        "promotion_compensation_count",
        "performance_rating",
        "goal_completion",
        "promotion_recommended",
        "days_since_review",
        "review_count",
        F.round("average_performance_rating", 2).alias("average_performance_rating"),
        "completed_training_programs",
        "failed_training_programs",
        "in_progress_training_programs",
        "completed_training_hours",
        "average_training_score",
        *[f"prior_{n.lower().replace(' ', '_')}_events" for n in CHANGE_TYPES],
        "prior_change_events",
        days(day, F.col("last_change")).alias("days_since_last_change_event"),
        F.coalesce(future_label(F.col("termination_date"), day, end), F.lit(0)).alias("attrition_next_12m"),
    )


def diagnostic_snapshot(tables: dict[str, DataFrame], snapshot: str, horizon: str) -> DataFrame:
    """Reduced feature set at one date for signal checks."""
    calendar = [(1, "historical", snapshot, horizon)]
    columns = (
        "employee_id tenure_years approx_age department_name region job_family job_level employment_type base_salary "
        "salary_growth_12m_percent salary_position_percent performance_rating performance_trend review_count "
        "completed_training_hours_12m failed_training_programs_12m promotions_12m manager_changes_12m "
        "months_since_promotion attrition_next_12m"
    ).split()
    return build_panel(tables, calendar, review_tie_break=("review_id", "review_line")).select(*columns)


def history_summary(
    facts: DataFrame, entity: str, date: str, order: Sequence[str], value: str, outcome: DataFrame, outcome_flag: str
) -> DataFrame:
    """First, last, mean and count per entity over its whole history, averaged by outcome."""
    key = F.struct(date, *order)
    per_entity = facts.groupBy(entity).agg(
        F.min_by(value, key).alias("first_value"),
        F.max_by(value, key).alias("last_value"),
        F.avg(value).alias("mean_value"),
        F.count(F.lit(1)).alias("records"),
    )
    joined = outcome.select(entity, outcome_flag).join(per_entity, entity, "left")
    return joined.groupBy(outcome_flag).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("first_value").alias("mean_first_value"),
        F.avg("last_value").alias("mean_last_value"),
        F.avg("mean_value").alias("mean_of_means"),
        F.avg("records").alias("mean_records"),
        F.avg(F.col("last_value") - F.col("first_value")).alias("mean_change"),
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, employees and positives per snapshot."""
    return panel.groupBy("dataset_type", "snapshot_sequence", "snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.col("attrition_next_12m")).alias("labelled_rows"),
        F.coalesce(F.sum("attrition_next_12m"), F.lit(0)).alias("positives"),
        F.avg("attrition_next_12m").alias("positive_rate"),
    )


