"""Queries for the aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import panel, reports
from stayline.plans.binding import AS_OF
from stayline.plans.features import REVIEW_ORDER
from stayline.plans.foundations import bands, located, today
from stayline.plans.registry import Tables, query, round_all

YEAR = ("2000-01-01", "2000-12-31")
REVIEW = ["review_date", "review_id", "review_line"]


@query(
    "a1_headcount_by_department",
    "employees departments",
    """SELECT department_name, COUNT(*) FILTER (WHERE employment_status = 'Active') AS active_headcount,
    COUNT(*) FILTER (WHERE employment_status = 'Terminated') AS terminated_headcount, COUNT(*) AS total_headcount
    FROM employees e JOIN departments d ON e.department_id = d.department_id GROUP BY department_name""",
)
def _(t: Tables):
    return reports.headcount_by(t["employees"], t["departments"], "department_id", ["department_name"])


@query(
    "a2_headcount_by_location",
    "employees locations",
    """SELECT l.location_id, city, region, location_type, COUNT(*) AS active_headcount, concat(city, ', ', region) AS location_label,
    ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS headcount_percent FROM employees e
    JOIN locations l ON e.location_id = l.location_id WHERE employment_status = 'Active' GROUP BY ALL""",
)
def _(t: Tables):
    out = reports.active_headcount(
        t["employees"], t["locations"], "location_id", ["location_id", "city", "region", "location_type"]
    )
    labelled = out.withColumn("location_label", F.concat("city", F.lit(", "), "region"))
    return reports.with_share(labelled, "active_headcount", "headcount_percent")


@query(
    "a3_headcount_by_job_family",
    "employees job_roles",
    """SELECT job_family, COUNT(*) AS active_headcount FROM employees e JOIN job_roles r ON e.job_role_id = r.job_role_id
    WHERE employment_status = 'Active' GROUP BY job_family""",
)
def _(t: Tables):
    return reports.active_headcount(t["employees"], t["job_roles"], "job_role_id", ["job_family"])


def _headcount_sql(d: str) -> str:
    return f"COUNT(*) FILTER (WHERE hire_date <= DATE '{d}' AND (termination_date IS NULL OR termination_date > DATE '{d}'))"


@query(
    "a4_turnover_by_department",
    "employees departments",
    f"""SELECT department_name, s AS starting_headcount, e AS ending_headcount, x AS terminations,
    ROUND((s + e) / 2.0::DOUBLE, 2) AS average_headcount, ROUND(100.0::DOUBLE * x / NULLIF((s + e) / 2.0::DOUBLE, 0), 2) AS turnover_rate_percent
    FROM (SELECT department_name, {_headcount_sql(YEAR[0])} AS s, {_headcount_sql(YEAR[1])} AS e,
      COUNT(*) FILTER (WHERE termination_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}') AS x
      FROM employees JOIN departments USING (department_id) GROUP BY department_name)""",
)
def _(t: Tables):
    return reports.turnover(t["employees"], t["departments"], "department_id", "department_name", *YEAR)


@query(
    "a5_funnel_by_source",
    "candidates applications",
    """SELECT application_source, COUNT(DISTINCT c.candidate_id) AS candidate_count, COUNT(application_id) AS application_count,
    COUNT(application_id) FILTER (WHERE interview_score IS NOT NULL) AS interviewed_applications,
    COUNT(application_id) FILTER (WHERE offer_date IS NOT NULL) AS offers,
    COUNT(application_id) FILTER (WHERE application_status = 'Hired') AS hires,
    ROUND(100.0::DOUBLE * COUNT(application_id) FILTER (WHERE application_status = 'Hired') / NULLIF(COUNT(application_id), 0), 2)
      AS application_to_hire_rate_percent
    FROM candidates c JOIN applications a ON a.candidate_id = c.candidate_id GROUP BY application_source""",
)
def _(t: Tables):
    return reports.funnel_by_source(t["candidates"], t["applications"])


STATUSES = {
    "hired": "Hired", "rejected": "Rejected", "withdrawn": "Withdrawn", "offer_declined": "Offer Declined",
    "in_process": "Interviewed", "applied": "Applied",
}


@query(
    "a5_funnel_by_status",
    "candidates applications",
    "SELECT application_source, COUNT(*) AS total_applications, "
    + ", ".join(f"COUNT(*) FILTER (WHERE application_status = '{s}') AS {c}" for c, s in STATUSES.items())
    + """, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE application_status = 'Hired') / NULLIF(COUNT(*), 0), 2) AS hire_rate_percent
    FROM applications a JOIN candidates c ON a.candidate_id = c.candidate_id GROUP BY application_source""",
)
def _(t: Tables):
    return reports.funnel_by_status(t["candidates"], t["applications"], STATUSES)


@query(
    "a6_requisition_duration",
    "job_requisitions",
    f"""SELECT requisition_status, COUNT(*) AS requisition_count, SUM(target_headcount)::BIGINT AS target_headcount,
    ROUND(AVG(COALESCE(close_date, DATE '{AS_OF}') - open_date), 2) AS average_days_open,
    MIN(COALESCE(close_date, DATE '{AS_OF}') - open_date) AS minimum_days_open,
    MAX(COALESCE(close_date, DATE '{AS_OF}') - open_date) AS maximum_days_open FROM job_requisitions GROUP BY requisition_status""",
)
def _(t: Tables):
    return reports.requisition_duration(t["job_requisitions"], AS_OF)


LATEST_PAY = f"""lc AS (SELECT * FROM compensation_history WHERE effective_date <= DATE '{AS_OF}' QUALIFY ROW_NUMBER() OVER
    (PARTITION BY employee_id ORDER BY effective_date DESC, compensation_id DESC) = 1)"""
LATEST_REVIEW = f"""lr AS (SELECT employee_id, arg_max(performance_rating, {REVIEW_ORDER}) AS performance_rating,
    arg_max(goal_completion, {REVIEW_ORDER}) AS goal_completion, arg_max(promotion_recommended, {REVIEW_ORDER}) AS promotion_recommended
    FROM performance_reviews GROUP BY employee_id)"""
TRAINED = """ts AS (SELECT employee_id, COUNT(*) FILTER (WHERE completion_status = 'Completed') AS programs,
    COALESCE(SUM(training_hours) FILTER (WHERE completion_status = 'Completed'), 0) AS hours FROM training_records GROUP BY employee_id)"""


@query(
    "a7_current_compensation",
    "employees departments compensation_history",
    f"""WITH {LATEST_PAY} SELECT department_name, COUNT(*) AS active_employee_count, ROUND(AVG(base_salary), 2) AS average_base_salary,
    ROUND(MIN(base_salary), 2) AS minimum_base_salary, ROUND(MAX(base_salary), 2) AS maximum_base_salary,
    ROUND(AVG(bonus_target), 2) AS average_bonus_target, ROUND(AVG(equity_value), 2) AS average_equity_value
    FROM employees JOIN departments USING (department_id) JOIN lc USING (employee_id) WHERE employment_status = 'Active' GROUP BY department_name""",
)
def _(t: Tables):
    return reports.current_compensation_by_department(t["employees"], t["departments"], t["compensation_history"], AS_OF)


@query(
    "a8_latest_performance",
    "employees departments performance_reviews",
    f"""WITH {LATEST_REVIEW} SELECT department_name, COUNT(*) AS reviewed_employee_count,
    ROUND(AVG(performance_rating), 2) AS average_performance_rating, ROUND(AVG(goal_completion), 2) AS average_goal_completion,
    ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE promotion_recommended) / NULLIF(COUNT(employee_id), 0), 2) AS promotion_recommendation_rate_percent
    FROM employees JOIN departments USING (department_id) JOIN lr USING (employee_id) WHERE employment_status = 'Active' GROUP BY department_name""",
)
def _(t: Tables):
    return reports.latest_performance_by_department(t["employees"], t["departments"], t["performance_reviews"], REVIEW)


@query(
    "a9_training_by_department",
    "employees departments training_records",
    f"""WITH {TRAINED} SELECT department_name, COUNT(employee_id) AS active_employee_count,
    ROUND(AVG(COALESCE(programs, 0)), 2) AS average_completed_programs, ROUND(AVG(COALESCE(hours, 0)), 2) AS average_completed_training_hours
    FROM employees JOIN departments USING (department_id) LEFT JOIN ts USING (employee_id) WHERE employment_status = 'Active' GROUP BY department_name""",
)
def _(t: Tables):
    return reports.training_by_department(t["employees"], t["departments"], t["training_records"])


@query(
    "a10_active_profile",
    "employees departments locations job_roles compensation_history performance_reviews training_records",
    f"""WITH {LATEST_PAY}, {LATEST_REVIEW}, {TRAINED} SELECT employee_id, hire_date, employment_type, education_level, organizational_level,
    department_name, l.city, l.region, job_title, job_family, job_level, base_salary, bonus_target, equity_value, performance_rating,
    goal_completion, promotion_recommended, COALESCE(programs, 0) AS completed_training_programs, COALESCE(hours, 0) AS completed_training_hours
    FROM employees e JOIN departments USING (department_id) JOIN locations l ON e.location_id = l.location_id
    JOIN job_roles USING (job_role_id) LEFT JOIN lc USING (employee_id) LEFT JOIN lr USING (employee_id) LEFT JOIN ts USING (employee_id)
    WHERE employment_status = 'Active'""",
)
def _(t: Tables):
    names = "employees departments locations job_roles compensation_history performance_reviews training_records".split()
    return reports.active_profile(t.pick(*names), REVIEW)


@query(
    "a11_overview_kpis",
    "employees job_requisitions applications",
    f"""WITH k AS (SELECT {_headcount_sql(AS_OF)} AS a, {_headcount_sql(YEAR[0])} AS s, {_headcount_sql(YEAR[1])} AS e,
      COUNT(*) FILTER (WHERE termination_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}') AS x FROM employees),
    act AS (SELECT * FROM employees WHERE hire_date <= DATE '{AS_OF}' AND (termination_date IS NULL OR termination_date > DATE '{AS_OF}'))
    SELECT DATE '{AS_OF}' AS as_of_date, a AS active_headcount, (SELECT COUNT(DISTINCT department_id) FROM act) AS active_department_count,
    (SELECT COUNT(DISTINCT location_id) FROM act) AS active_location_count, x AS terminations,
    ROUND(100.0::DOUBLE * x / NULLIF((s + e) / 2.0::DOUBLE, 0), 2) AS turnover_rate_percent,
    (SELECT COUNT(*) FROM job_requisitions WHERE requisition_status = 'Open') AS open_requisitions,
    (SELECT COUNT(*) FROM applications) AS total_applications,
    (SELECT COUNT(*) FROM applications WHERE application_status = 'Hired') AS hired_applications FROM k""",
)
def _(t: Tables):
    return reports.overview_kpis(t["employees"], t["job_requisitions"], t["applications"], AS_OF, *YEAR)


@query(
    "a12_headcount_share",
    "employees departments",
    """SELECT department_name, COUNT(*) AS active_headcount, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS headcount_percent
    FROM employees JOIN departments USING (department_id) WHERE employment_status = 'Active' GROUP BY department_name""",
)
def _(t: Tables):
    out = reports.active_headcount(t["employees"], t["departments"], "department_id", ["department_name"])
    return reports.with_share(out, "active_headcount", "headcount_percent")


@query(
    "a13_load_sanity",
    "employees applications job_requisitions",
    """SELECT 'employees by status' AS report, employment_status AS category, COUNT(*) AS value FROM employees GROUP BY 2
    UNION ALL SELECT 'employees by department', CAST(department_id AS VARCHAR), COUNT(*) FROM employees GROUP BY 2
    UNION ALL SELECT 'applications by status', application_status, COUNT(*) FROM applications GROUP BY 2
    UNION ALL SELECT 'distinct hired employees', 'all', COUNT(DISTINCT employee_id) FROM applications WHERE application_status = 'Hired'
    UNION ALL SELECT 'filled headcount', 'all', CAST(SUM(target_headcount) AS BIGINT) FROM job_requisitions WHERE requisition_status = 'Filled'""",
)
def _(t: Tables):
    return reports.load_sanity(t.pick("employees", "applications", "job_requisitions"))


@query(
    "a13_joined_sample",
    "employees departments locations",
    """SELECT employee_id, department_name, city, employment_status FROM employees e JOIN departments USING (department_id)
    JOIN locations l ON l.location_id = e.location_id ORDER BY employee_id LIMIT 20""",
)
def _(t: Tables):
    return reports.joined_sample(t["employees"], t["departments"], t["locations"])


FEATURES = ["department_name", "region", "employment_type", "job_level", "birth_year"]


def _long_sql(columns: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COALESCE(CAST({c} AS VARCHAR), 'Missing') AS category {keep} FROM scored" for c in columns
    )


@query(
    "a14_composition_shares",
    "scored",
    f"""SELECT feature, category, COUNT(*) AS headcount, ROUND(COUNT(*) / (SELECT COUNT(*) FROM scored)::DOUBLE, 6) AS workforce_share
    FROM ({_long_sql(FEATURES)}) GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(reports.composition(t["scored"], FEATURES))


@query(
    "a15_rate_and_lift",
    "scored",
    f"""WITH b AS (SELECT AVG(actual_attrition) AS base FROM scored) SELECT feature, category, COUNT(*) AS sample_size,
    CAST(SUM(actual_attrition) AS BIGINT) AS attrition_cases, ROUND(AVG(actual_attrition), 6) AS attrition_rate,
    ROUND(ANY_VALUE(base), 6) AS baseline_attrition_rate, ROUND(AVG(actual_attrition) / ANY_VALUE(base), 6) AS lift_vs_baseline,
    COUNT(*) >= 50 AS large_enough FROM ({_long_sql(FEATURES, ', actual_attrition')}), b GROUP BY feature, category""",
)
def _(t: Tables):
    return round_all(reports.rate_by_category(t["scored"], FEATURES, "actual_attrition"))


@query(
    "a16_target_balance",
    "scored",
    """SELECT actual_attrition, COUNT(*) AS rows, ROUND(COUNT(*) / (SELECT COUNT(*) FROM scored)::DOUBLE, 6) AS share
    FROM scored GROUP BY actual_attrition""",
)
def _(t: Tables):
    return round_all(reports.target_balance(t["scored"], "actual_attrition"))


CHECKED = ["birth_year", "region", "base_salary"]


@query(
    "a17_missingness",
    "scored",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*)::DOUBLE, 6) AS missing_rate FROM scored"
        for c in CHECKED
    ),
)
def _(t: Tables):
    return round_all(reports.missingness(t["scored"], CHECKED))


@query(
    "a18_missingness_vs_outcome",
    "scored",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_rows,
        ROUND(AVG(actual_attrition) FILTER (WHERE {c} IS NULL), 6) AS rate_when_missing,
        ROUND(AVG(actual_attrition) FILTER (WHERE {c} IS NOT NULL), 6) AS rate_when_present,
        ROUND(AVG(actual_attrition) FILTER (WHERE {c} IS NULL) - AVG(actual_attrition) FILTER (WHERE {c} IS NOT NULL), 6) AS difference FROM scored"""
        for c in CHECKED
    ),
)
def _(t: Tables):
    return round_all(reports.missingness_vs_outcome(t["scored"], CHECKED, "actual_attrition"))


NUMERIC = ["base_salary", "attrition_probability", "birth_year"]


@query(
    "a19_numeric_summary",
    "scored",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
        ROUND(MIN({c})::DOUBLE, 6) AS minimum, ROUND(MAX({c})::DOUBLE, 6) AS maximum, """
        + ", ".join(f"ROUND(quantile_cont({c}::DOUBLE, {p}), 6) AS {n}" for n, p in reports.SUMMARY_QUANTILES.items())
        + " FROM scored"
        for c in NUMERIC
    ),
)
def _(t: Tables):
    return round_all(reports.numeric_summary(t["scored"], NUMERIC))


@query(
    "a20_observed_vs_expected",
    "employees",
    f"""WITH p AS (SELECT *, DATE '{AS_OF}' - hire_date AS d, employment_status = 'Terminated' AS gone,
      organizational_level = 'Individual Contributor' AS ic FROM employees),
    q AS (SELECT *, CASE WHEN ic AND d >= 120 THEN GREATEST(0.05, LEAST(0.4, 0.18 + CASE WHEN department_id IN (2, 8) THEN 0.06 ELSE 0 END
      + CASE WHEN location_id = 3 THEN 0.03 ELSE 0 END - CASE WHEN d < 365 THEN 0.05 ELSE 0 END))::DOUBLE ELSE 0 END AS expected FROM p)
    SELECT department_id, COUNT(*) AS headcount, COUNT(*) FILTER (WHERE gone) AS terminations, ROUND(AVG(gone::INT), 8) AS observed_attrition_rate,
    ROUND(AVG(expected), 8) AS expected_attrition_rate, ROUND(AVG(ic::INT), 8) AS individual_contributor_share,
    ROUND(AVG(gone::INT) - AVG(expected), 8) AS rate_difference FROM q GROUP BY department_id""",
)
def _(t: Tables):
    served = F.datediff(today(), "hire_date")
    contributor = F.col("organizational_level") == "Individual Contributor"
    expected = reports.rule_probability(
        contributor & (served >= 120),
        0.18,
        [(F.col("department_id").isin(2, 8), 0.06), (F.col("location_id") == 3, 0.03), (served < 365, -0.05)],
        0.05,
        0.40,
    )
    gone = F.col("employment_status") == "Terminated"
    return round_all(reports.observed_vs_expected(t["employees"], "department_id", gone, expected, contributor), 8)


@query(
    "a21_exits_per_month",
    "employees",
    """SELECT strftime(termination_date, '%Y-%m') AS month, COUNT(*) AS exits FROM employees
    WHERE termination_date IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return reports.events_per_month(t["employees"], "termination_date", "exits")


LOCATED_SQL = """loc AS (SELECT c.*, e.location_id AS current_location, COALESCE(CAST(x.new_value AS INT), CAST(f.old_value AS INT), e.location_id) AS historical_location
    FROM compensation_history c JOIN employees e ON c.employee_id = e.employee_id
    ASOF LEFT JOIN (SELECT employee_id, event_date, arg_max(new_value, event_id) AS new_value FROM employee_events
      WHERE event_type = 'Transfer' GROUP BY ALL) x ON c.employee_id = x.employee_id AND c.effective_date >= x.event_date
    LEFT JOIN (SELECT employee_id, arg_min(old_value, (event_date, event_id)) AS old_value FROM employee_events
      WHERE event_type = 'Transfer' GROUP BY employee_id) f ON f.employee_id = c.employee_id)"""
LOCATED_NEEDS = "employees employee_events compensation_history"


@query(
    "a22_attribution_comparison",
    LOCATED_NEEDS,
    f"""WITH {LOCATED_SQL}, c AS (SELECT current_location AS location, AVG(base_salary) AS cv FROM loc GROUP BY 1),
    h AS (SELECT historical_location AS location, AVG(base_salary) AS hv FROM loc GROUP BY 1)
    SELECT 'Compensation records' AS domain, 'average_base_salary' AS metric, location, ROUND(COALESCE(cv, 0), 4) AS current_value,
    ROUND(COALESCE(hv, 0), 4) AS historical_value, ROUND(COALESCE(hv, 0) - COALESCE(cv, 0), 4) AS difference,
    ROUND(ABS(COALESCE(hv, 0) - COALESCE(cv, 0)), 4) AS absolute_difference,
    ROUND((COALESCE(hv, 0) - COALESCE(cv, 0)) / NULLIF(COALESCE(cv, 0), 0), 4) AS relative_difference FROM c FULL JOIN h USING (location)""",
)
def _(t: Tables):
    records = located(t, "compensation_history", "effective_date")
    return round_all(
        reports.attribution_comparison(records, "Compensation records", "average_base_salary", F.avg("base_salary")), 4
    )


@query(
    "a22_reassignment_rate",
    LOCATED_NEEDS,
    f"""WITH {LOCATED_SQL} SELECT 'Compensation records' AS domain, COUNT(*) AS total_records,
    COUNT(*) FILTER (WHERE current_location <> historical_location) AS reassigned_records,
    COUNT(DISTINCT employee_id) FILTER (WHERE current_location <> historical_location) AS reassigned_employees,
    ROUND(COUNT(*) FILTER (WHERE current_location <> historical_location) / COUNT(*)::DOUBLE, 6) AS reassignment_rate FROM loc""",
)
def _(t: Tables):
    records = located(t, "compensation_history", "effective_date")
    return round_all(reports.reattribution_summary(records, "Compensation records"))


@query(
    "a23_transition_flows",
    "employee_events",
    """SELECT old_value AS from_value, new_value AS to_value, COUNT(*) AS transitions FROM employee_events
    WHERE event_type = 'Transfer' GROUP BY ALL""",
)
def _(t: Tables):
    return reports.transition_flows(t["employee_events"], "Transfer")


@query(
    "a24_hire_vs_current",
    "employees employee_events departments",
    """WITH h AS (SELECT employee_id, CAST(NULLIF(regexp_extract(arg_min(notes, (event_date, event_id)), 'location_id=([0-9]+)', 1), '') AS INT) AS hired_into
      FROM employee_events WHERE event_type = 'Hire' GROUP BY employee_id)
    SELECT department_name, COUNT(*) AS employees, COUNT(*) FILTER (WHERE hired_into IS DISTINCT FROM location_id) AS mismatches,
    ROUND(AVG((hired_into IS DISTINCT FROM location_id)::INT), 6) AS mismatch_rate
    FROM employees LEFT JOIN h USING (employee_id) JOIN departments USING (department_id) GROUP BY department_name""",
)
def _(t: Tables):
    people = t["employees"].join(t["departments"], "department_id")
    hired = panel.hire_notes(t["employee_events"], r"location_id=([0-9]+)", "hired_into")
    return round_all(reports.hire_mismatch_by(people, hired, "hired_into", "location_id", "department_name"))


@query(
    "a25_segment_summary",
    "scored",
    """WITH q AS (SELECT quantile_cont(attrition_probability, 0.9) AS hi, quantile_cont(attrition_probability, 0.7) AS mid FROM scored),
    b AS (SELECT *, CASE WHEN attrition_probability >= hi THEN 'High' WHEN attrition_probability >= mid THEN 'Medium' ELSE 'Low' END
      AS probability_band FROM scored, q)
    SELECT probability_band, COUNT(*) AS employee_count, ROUND(AVG(attrition_probability), 6) AS average_attrition_probability,
    ROUND(AVG(base_salary), 6) AS average_base_salary, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS population_percent,
    CASE probability_band WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS sort_order FROM b GROUP BY probability_band""",
)
def _(t: Tables):
    means = {"average_attrition_probability": "attrition_probability", "average_base_salary": "base_salary"}
    order = {"High": 1, "Medium": 2, "Low": 3}
    return round_all(reports.segment_summary(bands(t["scored"]), "probability_band", means, order))


@query(
    "a26_wide_to_long",
    "candidates applications",
    "WITH w AS (SELECT application_source, "
    + ", ".join(f"COUNT(*) FILTER (WHERE application_status = '{s}') AS {c}" for c, s in STATUSES.items())
    + " FROM applications JOIN candidates USING (candidate_id) GROUP BY application_source) "
    + " UNION ALL ".join(f"SELECT application_source, '{c}' AS status, {c} AS applications FROM w" for c in STATUSES),
)
def _(t: Tables):
    wide = reports.funnel_by_status(t["candidates"], t["applications"], STATUSES)
    return reports.wide_to_long(wide, ["application_source"], list(STATUSES), "status", "applications")


@query(
    "a27_population_reconciliation",
    "employees scored",
    f"""WITH a AS (SELECT * FROM employees WHERE hire_date <= DATE '{AS_OF}' AND (termination_date IS NULL OR termination_date > DATE '{AS_OF}')),
    e AS (SELECT employee_id FROM a WHERE organizational_level IN ('Individual Contributor', 'Manager')),
    s AS (SELECT employee_id FROM employees WHERE account_balance >= 0)
    SELECT (SELECT COUNT(*) FROM a) AS active_workforce_employees, (SELECT COUNT(*) FROM e) AS model_eligible_active_employees,
    (SELECT COUNT(*) FROM a) - (SELECT COUNT(*) FROM e) AS protected_active_employees, (SELECT COUNT(*) FROM s) AS scored_employees,
    (SELECT COUNT(*) FROM s ANTI JOIN a USING (employee_id)) AS scored_not_active,
    (SELECT COUNT(*) FROM e ANTI JOIN s USING (employee_id)) AS eligible_not_scored,
    (SELECT COUNT(*) FROM s ANTI JOIN e USING (employee_id)) AS scored_not_eligible,
    (SELECT ROUND(quantile_cont(attrition_probability, 0.7), 6) FROM scored) AS medium_probability_threshold,
    (SELECT ROUND(quantile_cont(attrition_probability, 0.9), 6) FROM scored) AS high_probability_threshold""",
)
def _(t: Tables):
    from stayline.operators import asof, rank

    people = t["employees"]
    active = people.where(x.active_on("hire_date", "termination_date", today()))
    allowed = F.col("organizational_level").isin("Individual Contributor", "Manager")
    scored = people.where(F.col("account_balance") >= 0)
    head = active.agg(
        F.count(F.lit(1)).alias("active_workforce_employees"),
        x.count_if(allowed).alias("model_eligible_active_employees"),
        x.count_if(~allowed).alias("protected_active_employees"),
    )
    size = scored.agg(F.count(F.lit(1)).alias("scored_employees"))
    differ = asof.reconcile_ids(scored, active, active.where(allowed), "employee_id").drop("scored_unknown", "agreed")
    cuts = rank.exact_quantiles(
        t["scored"], "attrition_probability", {"medium_probability_threshold": 0.7, "high_probability_threshold": 0.9}
    ).drop("_n")
    return round_all(reports.beside(head, size, differ, cuts))


@query(
    "a28_dataset_comparison",
    "scored",
    """WITH m AS (SELECT period, COUNT(*)::DOUBLE AS rows, SUM(actual_attrition)::DOUBLE AS positives, AVG(actual_attrition) AS positive_rate,
      AVG(base_salary) AS mean_salary FROM scored GROUP BY period),
    l AS (SELECT period, u.metric, u.value FROM m, LATERAL (VALUES ('rows', rows), ('positives', positives), ('positive_rate', positive_rate), ('mean_salary', mean_salary)) u(metric, value))
    SELECT a.metric, ROUND(a.value, 6) AS version_1, ROUND(b.value, 6) AS version_2, ROUND(b.value - a.value, 6) AS absolute_change,
    ROUND((b.value - a.value) / NULLIF(ABS(a.value), 0), 6) AS relative_change FROM l a JOIN l b USING (metric)
    WHERE a.period = 'train' AND b.period = 'validation'""",
)
def _(t: Tables):
    def profile(period: str):
        return t["scored"].where(F.col("period") == period).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("actual_attrition").alias("positives"),
            F.avg("actual_attrition").alias("positive_rate"),
            F.avg("base_salary").alias("mean_salary"),
        )

    return round_all(reports.dataset_comparison(profile("train"), profile("validation")))
