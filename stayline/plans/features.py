"""Queries for point-in-time features, the panel and the hazard features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import asof, hazard, panel
from stayline.plans.binding import AS_OF, SNAPSHOTS, snapshot_values
from stayline.plans.foundations import HIRED_SQL
from stayline.plans.registry import Tables, query, round_all
from stayline.session import store

TIE = ("review_id", "review_line")
HR = "employees departments locations job_roles compensation_history performance_reviews training_records employee_events"

PEOPLE = f"""people AS (SELECT e.*, s.* FROM employees e, {snapshot_values()}
  WHERE hire_date <= snapshot_date AND (termination_date IS NULL OR termination_date > snapshot_date))"""
CAL = f"cal AS (SELECT * FROM {snapshot_values()})"
PAY = """pay AS (SELECT employee_id, snapshot_date,
  arg_max(effective_date, (effective_date, compensation_id)) AS latest_compensation_date,
  arg_min(base_salary, (effective_date, compensation_id)) AS initial_base_salary,
  arg_max(base_salary, (effective_date, compensation_id)) AS base_salary,
  arg_max(bonus_target, (effective_date, compensation_id)) AS bonus_target,
  arg_max(equity_value, (effective_date, compensation_id)) AS equity_value,
  arg_max(base_salary, (effective_date, compensation_id)) FILTER (WHERE effective_date <= snapshot_date - INTERVAL 1 YEAR) AS year_ago,
  COUNT(*) AS compensation_record_count, COUNT(*) FILTER (WHERE change_reason = 'Promotion') AS promotion_compensation_count
  FROM compensation_history JOIN cal ON effective_date <= snapshot_date GROUP BY ALL)"""
PAY_OUT = """ROUND(initial_base_salary, 6) AS initial_base_salary, ROUND(base_salary, 6) AS base_salary, ROUND(bonus_target, 4) AS bonus_target, ROUND(equity_value, 4) AS equity_value,
  ROUND(100.0::DOUBLE * (base_salary / NULLIF(initial_base_salary, 0) - 1), 6) AS salary_growth_percent,
  ROUND(100.0::DOUBLE * (base_salary / NULLIF(COALESCE(year_ago, initial_base_salary), 0) - 1), 6) AS salary_growth_12m_percent,
  snapshot_date - latest_compensation_date AS days_since_compensation_change, compensation_record_count, promotion_compensation_count"""
REVIEW_ORDER = "(review_date, review_id, review_line, performance_rating, goal_completion, promotion_recommended)"
REVIEWS = f"""rev AS (SELECT employee_id, snapshot_date, arg_max(performance_rating, {REVIEW_ORDER}) AS performance_rating,
  arg_max(goal_completion, {REVIEW_ORDER}) AS goal_completion,
  arg_max(promotion_recommended, {REVIEW_ORDER}) AS promotion_recommended,
  arg_min(performance_rating, {REVIEW_ORDER}) AS first_rating, MAX(review_date) AS latest_review_date,
  COUNT(*) AS review_count, AVG(performance_rating) AS average_performance_rating
  FROM performance_reviews JOIN cal ON review_date <= snapshot_date GROUP BY employee_id, snapshot_date)"""
TRAIN = """trn AS (SELECT employee_id, snapshot_date,
  COUNT(*) FILTER (WHERE completion_status = 'Completed') AS completed_training_programs_12m,
  COUNT(*) FILTER (WHERE completion_status = 'Failed') AS failed_training_programs_12m,
  SUM(CASE WHEN completion_status = 'Completed' THEN training_hours ELSE 0 END) AS completed_training_hours_12m,
  AVG(score) FILTER (WHERE completion_status = 'Completed') AS average_training_score_12m,
  MAX(completion_date) AS latest_training_date
  FROM training_records JOIN cal ON completion_date <= snapshot_date AND completion_date > snapshot_date - INTERVAL 1 YEAR
  GROUP BY employee_id, snapshot_date)"""
CHANGES = "event_type IN ('Promotion', 'Transfer', 'Manager Change', 'Leave')"
EVENTS = f"""evt AS (SELECT employee_id, snapshot_date,
  COUNT(*) FILTER (WHERE event_type = 'Promotion') AS prior_promotion_events,
  COUNT(*) FILTER (WHERE event_type = 'Transfer') AS prior_transfer_events,
  COUNT(*) FILTER (WHERE event_type = 'Manager Change') AS prior_manager_change_events,
  COUNT(*) FILTER (WHERE event_type = 'Leave') AS prior_leave_events,
  COUNT(*) FILTER (WHERE {CHANGES}) AS prior_change_events,
  COUNT(*) FILTER (WHERE event_type = 'Promotion' AND event_date > snapshot_date - INTERVAL 1 YEAR) AS promotions_12m,
  COUNT(*) FILTER (WHERE event_type = 'Manager Change' AND event_date > snapshot_date - INTERVAL 1 YEAR) AS manager_changes_12m,
  COUNT(*) FILTER (WHERE event_type = 'Leave' AND event_date > snapshot_date - INTERVAL 1 YEAR) AS leaves_12m,
  MAX(event_date) FILTER (WHERE {CHANGES}) AS latest_change_date,
  MAX(event_date) FILTER (WHERE event_type = 'Promotion') AS latest_promotion_date,
  arg_max(new_value, (event_date, event_id)) FILTER (WHERE event_type = 'Transfer') AS moved_to,
  MAX(event_date) AS latest_event_date
  FROM employee_events JOIN cal ON event_date <= snapshot_date GROUP BY employee_id, snapshot_date)"""
HIRED_INTO = """hin AS (SELECT employee_id, CAST(NULLIF(regexp_extract(arg_min(notes, (event_date, event_id)), 'location_id=([0-9]+)', 1), '') AS INT)
  AS hired_into FROM employee_events WHERE event_type = 'Hire' GROUP BY employee_id)"""
WIDE = f"""{PEOPLE}, {CAL}, {PAY}, {REVIEWS}, {TRAIN}, {EVENTS}, {HIRED_INTO}, wide AS (
  SELECT p.*, pay.* EXCLUDE (employee_id, snapshot_date), rev.* EXCLUDE (employee_id, snapshot_date),
    trn.* EXCLUDE (employee_id, snapshot_date), evt.* EXCLUDE (employee_id, snapshot_date),
    COALESCE(CAST(moved_to AS INT), hired_into, p.location_id) AS snapshot_location_id,
    (p.snapshot_date - p.hire_date) / 365.25::DOUBLE AS tenure_years
  FROM people p LEFT JOIN pay USING (employee_id, snapshot_date) LEFT JOIN rev USING (employee_id, snapshot_date)
  LEFT JOIN trn USING (employee_id, snapshot_date) LEFT JOIN evt USING (employee_id, snapshot_date)
  LEFT JOIN hin USING (employee_id)),
  based AS (SELECT w.*, d.department_name, d.department_group, l.city, l.region, l.location_type, r.job_title, r.job_family, r.job_level
    FROM wide w JOIN departments d ON w.department_id = d.department_id
    JOIN locations l ON w.snapshot_location_id = l.location_id JOIN job_roles r ON w.job_role_id = r.job_role_id),
  med AS (SELECT snapshot_date, job_family, job_level, quantile_cont(base_salary, 0.5) AS median_salary FROM based GROUP BY ALL)"""
PANEL_SQL = f"""WITH {WIDE} SELECT employee_id, dataset_type, snapshot_sequence, b.snapshot_date, prediction_end_date,
  CAST(year(b.snapshot_date) - birth_year AS INT) AS approx_age, ROUND(tenure_years, 6) AS tenure_years, employment_type,
  education_level, organizational_level, department_name, department_group, city, region, location_type, job_title,
  b.job_family, b.job_level, {PAY_OUT.replace("snapshot_date -", "b.snapshot_date -").replace("compensation_record_count, promotion_compensation_count", "COALESCE(compensation_record_count, 0) AS compensation_record_count, COALESCE(promotion_compensation_count, 0) AS promotion_compensation_count")},
  ROUND(100.0::DOUBLE * (base_salary / NULLIF(median_salary, 0) - 1), 6) AS salary_position_percent,
  performance_rating, goal_completion, promotion_recommended, b.snapshot_date - latest_review_date AS days_since_review,
  COALESCE(review_count, 0) AS review_count, ROUND(average_performance_rating, 6) AS average_performance_rating,
  COALESCE(performance_rating - first_rating, 0) AS performance_trend, CAST(latest_review_date IS NULL AS INT) AS no_prior_review,
  COALESCE(completed_training_programs_12m, 0) AS completed_training_programs_12m,
  COALESCE(failed_training_programs_12m, 0) AS failed_training_programs_12m,
  COALESCE(completed_training_hours_12m, 0) AS completed_training_hours_12m,
  ROUND(average_training_score_12m, 6) AS average_training_score_12m,
  COALESCE(prior_promotion_events, 0) AS prior_promotion_events, COALESCE(prior_transfer_events, 0) AS prior_transfer_events,
  COALESCE(prior_manager_change_events, 0) AS prior_manager_change_events, COALESCE(prior_leave_events, 0) AS prior_leave_events,
  COALESCE(prior_change_events, 0) AS prior_change_events, COALESCE(promotions_12m, 0) AS promotions_12m,
  COALESCE(manager_changes_12m, 0) AS manager_changes_12m, COALESCE(leaves_12m, 0) AS leaves_12m,
  b.snapshot_date - latest_change_date AS days_since_last_change_event,
  ROUND(COALESCE(CAST(year(b.snapshot_date) * 12 + month(b.snapshot_date) - year(latest_promotion_date) * 12
    - month(latest_promotion_date) AS DOUBLE), tenure_years * 12), 6) AS months_since_promotion,
  CAST(latest_promotion_date IS NULL AS INT) AS no_prior_promotion,
  CASE WHEN prediction_end_date IS NOT NULL THEN CAST(COALESCE(termination_date > b.snapshot_date AND termination_date <= prediction_end_date, false) AS INT)
    END AS attrition_next_12m
  FROM based b LEFT JOIN med USING (snapshot_date, job_family, job_level)"""


def hr(t: Tables):
    return t.pick(*HR.split())


def full_panel(t: Tables):
    return panel.build_panel(hr(t), SNAPSHOTS, review_tie_break=TIE)


@query("f1_panel", HR, PANEL_SQL)
def _(t: Tables):
    return round_all(full_panel(t).withColumn("bonus_target", F.round("bonus_target", 4)).withColumn("equity_value", F.round("equity_value", 4)))


@query(
    "f1_panel_summary",
    HR,
    PANEL_SQL.replace("WITH people", "WITH people", 1).replace(
        " SELECT employee_id, dataset_type,", ", pnl AS (SELECT employee_id, dataset_type,", 1
    )
    + """) SELECT dataset_type, snapshot_sequence, snapshot_date, COUNT(*) AS rows, COUNT(attrition_next_12m) AS labelled_rows,
    CAST(COALESCE(SUM(attrition_next_12m), 0) AS BIGINT) AS positives, ROUND(AVG(attrition_next_12m), 6) AS positive_rate
    FROM pnl GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(panel.panel_summary(full_panel(t)))


def block_sql(cte: str, name: str, out: str) -> str:
    return f"WITH {CAL}, {cte} SELECT employee_id, snapshot_date, {out} FROM {name}"


@query("f2_compensation_block", "compensation_history", block_sql(PAY, "pay", PAY_OUT))
def _(t: Tables):
    block = panel.compensation_block(t["compensation_history"], SNAPSHOTS).drop("latest_compensation_date")
    return round_all(block.withColumn("bonus_target", F.round("bonus_target", 4)).withColumn("equity_value", F.round("equity_value", 4)))


@query(
    "f3_performance_block",
    "performance_reviews",
    block_sql(
        REVIEWS,
        "rev",
        """performance_rating, goal_completion, promotion_recommended, snapshot_date - latest_review_date AS days_since_review,
        review_count, ROUND(average_performance_rating, 6) AS average_performance_rating, first_rating,
        performance_rating - first_rating AS performance_trend, 0 AS no_prior_review""",
    ),
)
def _(t: Tables):
    return round_all(panel.performance_block(t["performance_reviews"], SNAPSHOTS, TIE).drop("latest_review_date"))


@query(
    "f4_trailing_window_block",
    "training_records",
    block_sql(
        TRAIN,
        "trn",
        """completed_training_programs_12m, failed_training_programs_12m, completed_training_hours_12m,
        ROUND(average_training_score_12m, 6) AS average_training_score_12m, latest_training_date""",
    ),
)
def _(t: Tables):
    return round_all(panel.training_block(t["training_records"], SNAPSHOTS))


@query(
    "f5_event_block",
    "employee_events",
    block_sql(
        EVENTS,
        "evt",
        """prior_promotion_events, prior_transfer_events, prior_manager_change_events, prior_leave_events, prior_change_events,
        promotions_12m, manager_changes_12m, leaves_12m, latest_change_date, latest_promotion_date, moved_to, latest_event_date,
        snapshot_date - latest_change_date AS days_since_last_change_event""",
    ),
)
def _(t: Tables):
    return panel.event_block(t["employee_events"], SNAPSHOTS)


@query(
    "f6_calendar_months",
    "employees",
    f"""SELECT employee_id, CAST((2001 - year(hire_date)) * 12 + 8 - month(hire_date) AS INT) AS months,
    CAST(GREATEST(0, (1998 - year(hire_date)) * 12 + 6 - month(hire_date)) AS INT) AS months_floored FROM employees""",
)
def _(t: Tables):
    return t["employees"].select(
        "employee_id",
        x.calendar_months(F.lit(AS_OF).cast("date"), F.col("hire_date")).alias("months"),
        x.calendar_months(F.lit("1998-06-30").cast("date"), F.col("hire_date"), True).alias("months_floored"),
    )


@query(
    "f7_peer_median_position",
    "scored",
    """WITH m AS (SELECT department_name, job_level, quantile_cont(base_salary, 0.5) AS med FROM scored GROUP BY ALL)
    SELECT employee_id, ROUND(100.0::DOUBLE * (base_salary / NULLIF(med, 0) - 1), 6) AS position_percent
    FROM scored JOIN m USING (department_name, job_level)""",
)
def _(t: Tables):
    out = panel.peer_position(t["scored"], "base_salary", ["department_name", "job_level"], "position_percent")
    return round_all(out.select("employee_id", "position_percent"))


@query(
    "f8_tenure_and_age",
    "employees",
    f"""SELECT employee_id, ROUND((DATE '{AS_OF}' - hire_date) / 365.25::DOUBLE, 2) AS tenure_years, 2001 - birth_year AS approx_age
    FROM employees""",
)
def _(t: Tables):
    today = F.lit(AS_OF).cast("date")
    return t["employees"].select(
        "employee_id",
        F.round(panel.days(today, F.col("hire_date")) / F.lit(365.25), 2).alias("tenure_years"),
        (F.year(today) - F.col("birth_year")).alias("approx_age"),
    )


@query(
    "f9_future_label",
    "employees",
    f"""WITH {PEOPLE} SELECT employee_id, snapshot_sequence, CASE WHEN prediction_end_date IS NOT NULL THEN
    CAST(COALESCE(termination_date > snapshot_date AND termination_date <= prediction_end_date, false) AS INT) END AS label FROM people""",
)
def _(t: Tables):
    people = asof.expand_snapshots(
        t["employees"].select("employee_id", "hire_date", "termination_date"), "hire_date", "termination_date", SNAPSHOTS
    )
    label = panel.future_label(F.col("termination_date"), F.col("snapshot_date"), F.col("prediction_end_date"))
    return people.select("employee_id", "snapshot_sequence", label.alias("label"))


SINGLE = "2000-06-30"
SINGLE_SQL = f"""WITH cal AS (SELECT DATE '{SINGLE}' AS snapshot_date), {PAY}, {REVIEWS}, hc AS ({HIRED_SQL}),
  lt AS (SELECT employee_id, COUNT(*) FILTER (WHERE completion_status = 'Completed') AS completed_training_programs,
    COUNT(*) FILTER (WHERE completion_status = 'Failed') AS failed_training_programs,
    COUNT(*) FILTER (WHERE completion_status = 'In Progress') AS in_progress_training_programs,
    SUM(CASE WHEN completion_status = 'Completed' THEN training_hours ELSE 0 END) AS completed_training_hours,
    ROUND(AVG(score) FILTER (WHERE completion_status = 'Completed'), 2) AS average_training_score
    FROM training_records WHERE start_date <= DATE '{SINGLE}' GROUP BY employee_id),
  ev AS (SELECT employee_id, COUNT(*) FILTER (WHERE event_type = 'Promotion') AS prior_promotion_events,
    COUNT(*) FILTER (WHERE event_type = 'Transfer') AS prior_transfer_events,
    COUNT(*) FILTER (WHERE event_type = 'Manager Change') AS prior_manager_change_events,
    COUNT(*) FILTER (WHERE event_type = 'Leave') AS prior_leave_events, COUNT(*) FILTER (WHERE event_type <> 'Hire') AS prior_change_events,
    MAX(event_date) FILTER (WHERE event_type <> 'Hire') AS last_change
    FROM employee_events WHERE event_date <= DATE '{SINGLE}' GROUP BY employee_id)
  SELECT e.employee_id, DATE '{SINGLE}' AS snapshot_date, DATE '2001-06-30' AS prediction_end_date,
    CAST(2000 - birth_year AS INT) AS approx_age, ROUND((DATE '{SINGLE}' - hire_date) / 365.25::DOUBLE, 2) AS tenure_years,
    employment_type, education_level, application_source, years_experience_at_hire, hire_department_name, hire_region,
    hire_job_family, hire_job_level, initial_base_salary, base_salary, ROUND(bonus_target, 4) AS bonus_target,
    ROUND(equity_value, 4) AS equity_value,
    ROUND(100.0::DOUBLE * (base_salary / NULLIF(initial_base_salary, 0) - 1), 2) AS salary_growth_percent,
    DATE '{SINGLE}' - latest_compensation_date AS days_since_compensation_change,
    COALESCE(compensation_record_count, 0) AS compensation_record_count,
    COALESCE(promotion_compensation_count, 0) AS promotion_compensation_count, performance_rating, goal_completion,
    promotion_recommended, DATE '{SINGLE}' - latest_review_date AS days_since_review, COALESCE(review_count, 0) AS review_count,
    ROUND(average_performance_rating, 2) AS average_performance_rating,
    COALESCE(completed_training_programs, 0) AS completed_training_programs,
    COALESCE(failed_training_programs, 0) AS failed_training_programs,
    COALESCE(in_progress_training_programs, 0) AS in_progress_training_programs,
    COALESCE(completed_training_hours, 0) AS completed_training_hours, average_training_score,
    COALESCE(prior_promotion_events, 0) AS prior_promotion_events, COALESCE(prior_transfer_events, 0) AS prior_transfer_events,
    COALESCE(prior_manager_change_events, 0) AS prior_manager_change_events,
    COALESCE(prior_leave_events, 0) AS prior_leave_events, COALESCE(prior_change_events, 0) AS prior_change_events,
    DATE '{SINGLE}' - last_change AS days_since_last_change_event,
    CASE WHEN termination_date > DATE '{SINGLE}' AND termination_date <= DATE '2001-06-30' THEN 1 ELSE 0 END AS attrition_next_12m
  FROM employees e LEFT JOIN hc ON hc.employee_id = e.employee_id LEFT JOIN pay ON pay.employee_id = e.employee_id
  LEFT JOIN rev ON rev.employee_id = e.employee_id LEFT JOIN lt ON lt.employee_id = e.employee_id
  LEFT JOIN ev ON ev.employee_id = e.employee_id
  WHERE hire_date <= DATE '{SINGLE}' AND (termination_date IS NULL OR termination_date > DATE '{SINGLE}')"""


@query("f10_single_snapshot_set", f"{HR} applications candidates job_requisitions", SINGLE_SQL)
def _(t: Tables):
    tables = t.pick(*HR.split(), "applications", "candidates", "job_requisitions")
    out = panel.single_snapshot_set(tables, SINGLE, "2001-06-30", TIE)
    return out.withColumn("bonus_target", F.round("bonus_target", 4)).withColumn("equity_value", F.round("equity_value", 4))


SOURCES = [
    ("compensation_history", "effective_date", None),
    ("performance_reviews", "review_date", None),
    ("training_records", "completion_date", 12),
    ("employee_events", "event_date", None),
]


@query(
    "f11_source_cutoffs",
    " ".join(s[0] for s in SOURCES),
    f"WITH {CAL} "
    + " UNION ALL ".join(
        f"SELECT snapshot_date, '{n}' AS source, MAX({d}) AS latest_date_used, MAX({d}) <= snapshot_date AS within_cutoff "
        f"FROM {n} JOIN cal ON {d} <= snapshot_date {f'AND {d} > snapshot_date - INTERVAL {m} MONTH' if m else ''} GROUP BY snapshot_date"
        for n, d, m in SOURCES
    ),
)
def _(t: Tables):
    return panel.source_cutoffs(
        {n: (t[n], d) for n, d, _ in SOURCES}, SNAPSHOTS, {n: m for n, _, m in SOURCES if m}
    )


@query(
    "f12_row_date_audit",
    HR,
    f"""WITH {WIDE} SELECT employee_id, dataset_type, snapshot_sequence, snapshot_date, hire_date, termination_date,
    latest_compensation_date, latest_review_date, latest_training_date, latest_event_date, snapshot_location_id,
    location_id AS final_location_id FROM based""",
)
def _(t: Tables):
    return panel.row_audit(panel.panel_with_audit(hr(t), SNAPSHOTS, review_tie_break=TIE))


DIAGNOSTIC = """employee_id, tenure_years, approx_age, department_name, region, job_family, job_level, employment_type, base_salary,
  salary_growth_12m_percent, salary_position_percent, performance_rating, performance_trend, review_count,
  completed_training_hours_12m, failed_training_programs_12m, promotions_12m, manager_changes_12m, months_since_promotion,
  attrition_next_12m"""


@query("f13_diagnostic_snapshot", HR, f"SELECT {DIAGNOSTIC} FROM ({PANEL_SQL}) WHERE snapshot_sequence = 2")
def _(t: Tables):
    return round_all(panel.diagnostic_snapshot(hr(t), "1999-06-30", "2000-06-30"))


@query(
    "f14_history_summary",
    "employees compensation_history",
    """WITH h AS (SELECT employee_id, arg_min(base_salary, (effective_date, compensation_id)) AS f,
      arg_max(base_salary, (effective_date, compensation_id)) AS l, AVG(base_salary) AS m, COUNT(*) AS n FROM compensation_history GROUP BY employee_id)
    SELECT employment_status, COUNT(*) AS entities, ROUND(AVG(f), 4) AS mean_first_value, ROUND(AVG(l), 4) AS mean_last_value,
      ROUND(AVG(m), 4) AS mean_of_means, ROUND(AVG(n), 4) AS mean_records, ROUND(AVG(l - f), 4) AS mean_change
    FROM employees LEFT JOIN h USING (employee_id) GROUP BY employment_status""",
)
def _(t: Tables):
    out = panel.history_summary(
        t["compensation_history"], "employee_id", "effective_date", ["compensation_id"], "base_salary", t["employees"], "employment_status"
    )
    return round_all(out, 4)


# ---- hazard features --------------------------------------------------------------------------

LAG = 2
RISK_SQL = f"""risk AS (SELECT employee_id, hire_date, termination_date, employment_type, organizational_level, termination_type, job_role_id,
  CAST(m AS DATE) AS month_start, CAST(m - INTERVAL {LAG - 1} MONTH AS DATE) AS cutoff,
  CAST((year(m) - year(hire_date)) * 12 + month(m) - month(hire_date) AS DOUBLE) AS tenure_months
  FROM employees, LATERAL (SELECT unnest(generate_series(CAST(date_trunc('month', hire_date) + INTERVAL 1 MONTH AS TIMESTAMP),
    CAST(date_trunc('month', LEAST(COALESCE(termination_date, DATE '{AS_OF}'), DATE '{AS_OF}')) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m))"""


def risk_set(t: Tables):
    return hazard.person_months(
        t["employees"], AS_OF, LAG, keep=["employment_type", "organizational_level", "termination_type", "job_role_id"]
    )


@query(
    "f15_person_month_risk_set",
    "employees",
    f"WITH {RISK_SQL} SELECT employee_id, month_start, cutoff, tenure_months FROM risk",
)
def _(t: Tables):
    return risk_set(t).select("employee_id", "month_start", "cutoff", "tenure_months")


ASOF_ORDER = "review_date, review_id, review_line, performance_rating"
LAGGED_SQL = f"""{RISK_SQL},
  rv AS (SELECT *, LAG(performance_rating) OVER (PARTITION BY employee_id ORDER BY {ASOF_ORDER}) AS before_rating,
    ROW_NUMBER() OVER (PARTITION BY employee_id ORDER BY {ASOF_ORDER}) AS seq FROM performance_reviews),
  rv1 AS (SELECT * FROM rv QUALIFY ROW_NUMBER() OVER (PARTITION BY employee_id, review_date ORDER BY seq DESC) = 1),
  cp AS (SELECT employee_id, effective_date, arg_max(base_salary, compensation_id) AS base_salary FROM compensation_history GROUP BY ALL),
  pr AS (SELECT DISTINCT employee_id, effective_date FROM compensation_history WHERE change_reason = 'Promotion'),
  tr AS (SELECT r.employee_id, r.cutoff, SUM(CASE WHEN completion_status = 'Completed' THEN training_hours ELSE 0 END) AS hours,
    COUNT(*) FILTER (WHERE completion_status = 'Failed') AS failed FROM risk r JOIN training_records x ON x.employee_id = r.employee_id
    AND completion_date < r.cutoff AND completion_date >= r.cutoff - INTERVAL 1 YEAR GROUP BY ALL),
  mc AS (SELECT r.employee_id, r.cutoff, COUNT(*) AS n FROM risk r JOIN employee_events x ON x.employee_id = r.employee_id
    AND event_type = 'Manager Change' AND event_date < r.cutoff AND event_date >= r.cutoff - INTERVAL 1 YEAR GROUP BY ALL),
  lagged AS (SELECT r.*, COALESCE(v.performance_rating, 3.5) AS performance_level,
    COALESCE(v.performance_rating - v.before_rating, 0) AS performance_trend,
    CASE WHEN v.employee_id IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS no_prior_review, c.base_salary AS current_salary,
    COALESCE(c.base_salary / NULLIF(y.base_salary, 0) - 1, 0.03) AS trailing_compensation_growth,
    CAST(COALESCE((year(r.cutoff) - year(p.effective_date)) * 12 + month(r.cutoff) - month(p.effective_date), 0) AS DOUBLE) AS months_since_promotion,
    CASE WHEN p.employee_id IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS no_prior_promotion,
    COALESCE(tr.hours, 0) AS completed_training_hours, COALESCE(tr.failed, 0) AS failed_training_count, COALESCE(mc.n, 0) AS manager_changes
  FROM risk r ASOF LEFT JOIN rv1 v ON v.employee_id = r.employee_id AND v.review_date < r.cutoff
  ASOF LEFT JOIN cp c ON c.employee_id = r.employee_id AND c.effective_date < r.cutoff
  ASOF LEFT JOIN cp y ON y.employee_id = r.employee_id AND y.effective_date <= CAST(r.cutoff - INTERVAL 1 YEAR AS DATE)
  ASOF LEFT JOIN pr p ON p.employee_id = r.employee_id AND p.effective_date < r.cutoff
  LEFT JOIN tr ON tr.employee_id = r.employee_id AND tr.cutoff = r.cutoff
  LEFT JOIN mc ON mc.employee_id = r.employee_id AND mc.cutoff = r.cutoff)"""
HAZARD_TABLES = "employees compensation_history performance_reviews training_records employee_events job_roles"
LAGGED = (
    "performance_level performance_trend no_prior_review current_salary trailing_compensation_growth months_since_promotion "
    "no_prior_promotion completed_training_hours failed_training_count manager_changes"
).split()


def lagged(t: Tables):
    return hazard.lagged_features(
        risk_set(t), t["compensation_history"], t["performance_reviews"], t["training_records"], t["employee_events"],
        ("review_id", "review_line", "performance_rating"),
    )


@query(
    "f16_lagged_features",
    HAZARD_TABLES,
    f"""WITH {LAGGED_SQL} SELECT employee_id, month_start, performance_level, performance_trend, no_prior_review, current_salary,
    ROUND(trailing_compensation_growth, 6) AS trailing_compensation_growth, months_since_promotion, no_prior_promotion,
    completed_training_hours, failed_training_count, manager_changes FROM lagged""",
)
def _(t: Tables):
    out = lagged(t).select("employee_id", "month_start", *LAGGED)
    return out.withColumn("trailing_compensation_growth", F.round("trailing_compensation_growth", 6))


POSITION_SQL = """rolled AS (SELECT l.*, r.job_family, r.job_level FROM lagged l JOIN job_roles r ON r.job_role_id = l.job_role_id),
  md AS (SELECT month_start, job_family, job_level, quantile_cont(current_salary, 0.5) AS med, stddev_samp(current_salary) AS sd FROM rolled GROUP BY ALL),
  dv AS (SELECT rolled.*, med, sd, ABS(current_salary - med) AS dev FROM rolled JOIN md USING (month_start, job_family, job_level)),
  ma AS (SELECT month_start, job_family, job_level, quantile_cont(dev, 0.5) AS mad FROM dv GROUP BY ALL),
  positioned AS (SELECT dv.*, COALESCE((current_salary - med) / CASE WHEN 1.4826 * mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END, 0)
    AS salary_position FROM dv JOIN ma USING (month_start, job_family, job_level))"""


def positioned(t: Tables):
    roles = t["job_roles"].select("job_role_id", "job_family", "job_level")
    return hazard.robust_peer_z(
        store(lagged(t)).join(roles, "job_role_id"), "current_salary", ["month_start", "job_family", "job_level"], "salary_position"
    )


@query(
    "f17_robust_peer_z",
    HAZARD_TABLES,
    f"WITH {LAGGED_SQL}, {POSITION_SQL} SELECT employee_id, month_start, ROUND(salary_position, 6) AS salary_position FROM positioned",
)
def _(t: Tables):
    return round_all(positioned(t).select("employee_id", "month_start", "salary_position"))


# A hazard configuration for the test tables.
HAZARD = {
    "intercepts": {"voluntary": -4.6, "involuntary": -5.4},
    "tenure_effects": {
        "onboarding_protection": {"voluntary": -1.2, "involuntary": -0.8},
        "early_tenure_peak": {"voluntary": 0.5, "involuntary": 0.3},
        "long_tenure_stability": {"voluntary": -0.4, "involuntary": -0.2},
    },
    "features": {
        "performance_level": {"transform": {"type": "z_score", "center": 25, "scale": 15, "minimum": -2, "maximum": 2}, "coefficients": {"voluntary": -0.1, "involuntary": -0.5}},
        "salary_position": {"transform": {"type": "robust_z_score", "minimum": -3, "maximum": 3}, "coefficients": {"voluntary": -0.3, "involuntary": 0.0}},
        "failed_training_count": {"transform": {"type": "capped_count", "maximum": 3}, "coefficients": {"voluntary": 0.05, "involuntary": 0.2}},
        "no_prior_promotion": {"transform": {"type": "binary"}, "coefficients": {"voluntary": 0.3, "involuntary": 0.1}},
        "manager_changes": {"transform": {"type": "capped_count", "maximum": 2}, "coefficients": {"voluntary": 0.2, "involuntary": 0.1}},
    },
    "organizational_level_effects": {"Manager": {"voluntary": -0.2, "involuntary": -0.1}, "Senior Manager": {"voluntary": -0.5, "involuntary": -0.4}},
    "seasonality": {"voluntary": 0.1, "involuntary": 0.05},
    "probability_limits": {
        "minimum_cause_probability": 0.0005, "maximum_voluntary_probability": 0.02,
        "maximum_involuntary_probability": 0.008, "maximum_combined_probability": 0.022,
    },
}


def _clip_sql(text: str, low: float, high: float) -> str:
    return f"GREATEST({low}::DOUBLE, LEAST({high}::DOUBLE, {text}))"


def _transform_sql(name: str, spec: dict) -> str:
    if spec["type"] == "binary":
        return f"(CASE WHEN {name} <> 0 THEN 1 ELSE 0 END)"
    if spec["type"] == "capped_count":
        return f"LEAST({name}::DOUBLE, {spec['maximum']})"
    value = name if spec["type"] == "robust_z_score" else f"(({name} - {spec['center']}) / {spec['scale']}::DOUBLE)"
    return _clip_sql(value, spec["minimum"], spec["maximum"])


def _logit_sql(cause: str) -> str:
    c = HAZARD
    te = c["tenure_effects"]
    parts = [
        f"{c['intercepts'][cause]}::DOUBLE",
        f"exp(-tenure_months / 3) * {te['onboarding_protection'][cause]}",
        f"exp(-pow((tenure_months - 18) / 12, 2)) * {te['early_tenure_peak'][cause]}",
        f"ln(1 + tenure_months) / {math.log(73.0)!r} * {te['long_tenure_stability'][cause]}",
        *[f"{_transform_sql(n, s['transform'])} * {s['coefficients'][cause]}" for n, s in c["features"].items()],
        "CASE organizational_level " + " ".join(f"WHEN '{k}' THEN {v[cause]}" for k, v in c["organizational_level_effects"].items()) + " ELSE 0 END",
        f"sin(2 * pi() * month(month_start) / 12) * {c['seasonality'][cause]}",
    ]
    return " + ".join(parts)


LIM = HAZARD["probability_limits"]
SCORE_SQL = f"""lg AS (SELECT *, exp({_clip_sql(_logit_sql('voluntary'), -20, 20)}) AS ev, exp({_clip_sql(_logit_sql('involuntary'), -20, 20)}) AS ei FROM positioned),
  pb AS (SELECT *, {_clip_sql('ev / (1 + ev + ei)', LIM['minimum_cause_probability'], LIM['maximum_voluntary_probability'])} AS pv,
    {_clip_sql('ei / (1 + ev + ei)', LIM['minimum_cause_probability'], LIM['maximum_involuntary_probability'])} AS pi FROM lg),
  hz AS (SELECT * EXCLUDE (pv, pi), pv * LEAST(1, {LIM['maximum_combined_probability']} / (pv + pi)) AS voluntary_probability,
    pi * LEAST(1, {LIM['maximum_combined_probability']} / (pv + pi)) AS involuntary_probability FROM pb)"""


def scored_months(t: Tables):
    return hazard.hazard_score(positioned(t), HAZARD)


@query(
    "f18_feature_transforms",
    HAZARD_TABLES,
    f"WITH {LAGGED_SQL}, {POSITION_SQL} SELECT employee_id, month_start, "
    + ", ".join(f"ROUND({_transform_sql(n, s['transform'])}::DOUBLE, 6) AS {n}" for n, s in HAZARD["features"].items())
    + " FROM positioned",
)
def _(t: Tables):
    return positioned(t).select(
        "employee_id",
        "month_start",
        *[F.round(x.transform_feature(n, s["transform"]), 6).alias(n) for n, s in HAZARD["features"].items()],
    )


@query(
    "f19_two_cause_hazard",
    HAZARD_TABLES,
    f"""WITH {LAGGED_SQL}, {POSITION_SQL}, {SCORE_SQL} SELECT employee_id, month_start,
    ROUND(1 - voluntary_probability - involuntary_probability, 8) AS stay_probability,
    ROUND(voluntary_probability, 8) AS voluntary_probability, ROUND(involuntary_probability, 8) AS involuntary_probability FROM hz""",
)
def _(t: Tables):
    return round_all(
        scored_months(t).select("employee_id", "month_start", "stay_probability", "voluntary_probability", "involuntary_probability"), 8
    )


@query(
    "f20_monthly_hazard_diagnostics",
    HAZARD_TABLES,
    f"""WITH {LAGGED_SQL}, {POSITION_SQL}, {SCORE_SQL} SELECT month_start, COUNT(*) AS at_risk,
    ROUND(AVG(voluntary_probability), 8) AS mean_voluntary_probability, ROUND(AVG(involuntary_probability), 8) AS mean_involuntary_probability,
    COUNT(*) FILTER (WHERE date_trunc('month', termination_date) = month_start AND termination_type = 'Voluntary') AS voluntary_exits,
    COUNT(*) FILTER (WHERE date_trunc('month', termination_date) = month_start AND termination_type = 'Involuntary') AS involuntary_exits,
    COUNT(*) FILTER (WHERE organizational_level = 'Senior Manager') AS protected_employees FROM hz GROUP BY month_start""",
)
def _(t: Tables):
    return round_all(hazard.monthly_diagnostics(scored_months(t), ["Senior Manager"]), 8)
