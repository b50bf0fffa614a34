"""Queries for association, survival, data-quality rules, table comparison and history correction."""

from __future__ import annotations

import re

from itertools import combinations

from pyspark.sql import functions as F

from stayline.operators import association, diff, history, panel, policy, quality, resample, survival
from stayline.operators.rank import keys
from stayline.plans.binding import AS_OF, SNAPSHOTS, snapshot_values
from stayline.plans.decisions import FROZEN, planned
from stayline.plans.features import HR, PANEL_SQL, TIE, WIDE, full_panel, hr
from stayline.plans.ranking import SPLITS, labelled_snapshots
from stayline.plans.registry import Tables, query, round_all
from stayline.session import settle

P, Y, ID, S = "attrition_probability", "actual_attrition", "employee_id", "base_salary"


# ---- association ------------------------------------------------------------------------------------

NUMERIC = ["base_salary", "attrition_probability", "birth_year", "user_id"]
CATEGORICAL = ["department_name", "region", "employment_type", "job_level"]


@query(
    "d1_numeric_correlations",
    "scored",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS first_feature, '{b}' AS second_feature, ROUND(CORR({a}, {b}), 6) AS correlation, ROUND(ABS(CORR({a}, {b})), 6) AS absolute_correlation,
        ABS(CORR({a}, {b})) >= 0.8 AS above_threshold FROM scored"""
        for a, b in combinations(NUMERIC, 2)
    ),
)
def _(t: Tables):
    return round_all(association.numeric_correlations(t["scored"], NUMERIC))


def cramers_sql(a: str, b: str, degenerate: str = "0.0::DOUBLE") -> str:
    return f"""(WITH c AS (SELECT COALESCE(CAST({a} AS VARCHAR), '<MISSING>') AS a, COALESCE(CAST({b} AS VARCHAR), '<MISSING>') AS b, COUNT(*) AS o FROM scored GROUP BY ALL),
      m AS (SELECT *, SUM(o) OVER (PARTITION BY a) AS r, SUM(o) OVER (PARTITION BY b) AS q FROM c),
      s AS (SELECT SUM(o)::DOUBLE AS n, SUM(o * o / (r::DOUBLE * q)) AS k, COUNT(DISTINCT a) AS nr, COUNT(DISTINCT b) AS nc FROM m),
      z AS (SELECT *, GREATEST(0, k - 1 - (nc - 1) * (nr - 1) / (n - 1)) AS phi, LEAST(nr - (nr - 1) * (nr - 1) / (n - 1), nc - (nc - 1) * (nc - 1) / (n - 1)) - 1 AS lim FROM s)
      SELECT '{a}' AS first_feature, '{b}' AS second_feature, ROUND(CASE WHEN nr > 1 AND nc > 1 AND lim > 0 THEN sqrt(phi / lim) ELSE {degenerate} END, 6) AS cramers_v,
      nr AS first_cardinality, nc AS second_cardinality FROM z)"""


@query(
    "d2_cramers_v",
    "scored",
    " UNION ALL ".join(f"SELECT * FROM {cramers_sql(a, b)}" for a, b in combinations(CATEGORICAL, 2)),
)
def _(t: Tables):
    return round_all(association.cramers_v(t["scored"], list(combinations(CATEGORICAL, 2))))


@query(
    "d3_numeric_signal",
    "scored",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, ROUND(m0, 6) AS active_mean, ROUND(m1, 6) AS attrition_mean, ROUND(m1 - m0, 6) AS mean_difference, ROUND((m1 - m0) / sd, 6) AS standardized_mean_difference,
        ROUND(r, 6) AS point_biserial_correlation, ROUND(ABS((m1 - m0) / sd), 6) AS absolute_standardized_difference FROM
        (SELECT AVG({c}) FILTER (WHERE actual_attrition = 0) AS m0, AVG({c}) FILTER (WHERE actual_attrition = 1) AS m1,
          sqrt((VAR_SAMP({c}) FILTER (WHERE actual_attrition = 0) + VAR_SAMP({c}) FILTER (WHERE actual_attrition = 1)) / 2) AS sd, CORR({c}, actual_attrition) AS r FROM scored)"""
        for c in NUMERIC
    ),
)
def _(t: Tables):
    return round_all(association.numeric_signal(t["scored"], NUMERIC, Y))


@query(
    "d4_categorical_strength",
    "scored",
    " UNION ALL ".join(
        f"""SELECT first_feature AS feature, cramers_v AS cramers_v_with_target, ROUND(sp, 6) AS attrition_rate_spread, n AS eligible_category_count FROM {cramers_sql(c, 'actual_attrition', 'NULL')},
        (SELECT MAX(r) - MIN(r) AS sp, COUNT(*) AS n FROM (SELECT AVG(actual_attrition) AS r FROM scored GROUP BY COALESCE({c}, 'Missing') HAVING COUNT(*) >= 50))"""
        for c in CATEGORICAL
    ),
)
def _(t: Tables):
    return round_all(association.categorical_strength(t["scored"], CATEGORICAL, Y))


ROLES = {
    **{c: ("KEEP", "Numerical model feature") for c in NUMERIC},
    **{c: ("KEEP", "Categorical model feature") for c in CATEGORICAL},
    "period": ("EXCLUDE", "Metadata"),
    Y: ("TARGET", "Outcome"),
}


@query(
    "d5_feature_inventory",
    "scored",
    "WITH nc AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ABS(CORR({a}, {b})) AS v, 'Pearson correlation' AS m FROM scored" for a, b in combinations(NUMERIC, 2))
    + "), cc AS ("
    + " UNION ALL ".join(f"SELECT first_feature AS a, second_feature AS b, cramers_v AS v, 'Corrected Cramer''s V' AS m FROM {cramers_sql(a, b)}" for a, b in combinations(CATEGORICAL, 2))
    + """), al AS (SELECT * FROM nc UNION ALL SELECT b, a, v, m FROM nc UNION ALL SELECT * FROM cc UNION ALL SELECT b, a, v, m FROM cc),
    be AS (SELECT * FROM al QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY v DESC, b) = 1), st AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{d}' AS decision, '{r}' AS role, ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*)::DOUBLE, 6) AS missing_rate,
        COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_values FROM scored"""
        for c, (d, r) in ROLES.items()
    )
    + ") SELECT st.*, b AS strongest_associated_feature, ROUND(v, 6) AS association_strength, m AS association_method FROM st LEFT JOIN be ON be.a = st.feature",
)
def _(t: Tables):
    return round_all(association.feature_inventory(t["scored"], ROLES, NUMERIC, CATEGORICAL).drop("raw_dtype"))


@query(
    "d6_matrix_diagnostics",
    "scored",
    # variance inflation of two columns is 1 / (1 - r²)
    """WITH r AS (SELECT CORR(base_salary, attrition_probability) AS r FROM scored)
    SELECT unnest(['base_salary', 'attrition_probability']) AS encoded_feature, ROUND(1 / (1 - r * r), 6) AS vif,
    CASE WHEN 1 / (1 - r * r) <= 5 THEN 'Acceptable' WHEN 1 / (1 - r * r) <= 10 THEN 'Elevated' ELSE 'High' END AS assessment FROM r""",
)
def _(t: Tables):
    return round_all(association.matrix_diagnostics(t["scored"], ["base_salary", "attrition_probability"])[0])


@query("d6_matrix_summary", "scored")
def _(t: Tables):
    return round_all(association.matrix_diagnostics(t["scored"], NUMERIC)[1])


@query(
    "d7_dataset_profile",
    "scored",
    """SELECT u.metric, ROUND(u.value, 6) AS value FROM (SELECT COUNT(*)::DOUBLE AS n, 12.0::DOUBLE AS c, SUM(actual_attrition)::DOUBLE AS p, AVG(actual_attrition) AS r,
      COUNT(*) FILTER (WHERE birth_year IS NULL)::DOUBLE AS m FROM scored), LATERAL (VALUES ('rows', n), ('columns', c), ('positive_cases', p), ('positive_rate', r), ('missing_cells', m)) u(metric, value)""",
)
def _(t: Tables):
    return round_all(association.dataset_profile(t["scored"], Y))


# ---- survival -----------------------------------------------------------------------------------------

LEVELS = ["Individual Contributor", "Manager"]
COHORT_SQL = f"""hr AS (SELECT employee_id, CAST(NULLIF(regexp_extract(notes, 'location_id=([0-9]+)', 1), '') AS INT) AS loc, CAST(NULLIF(regexp_extract(notes, 'job_role_id=([0-9]+)', 1), '') AS INT) AS rol
      FROM employee_events WHERE event_type = 'Hire'),
    fs AS (SELECT employee_id, arg_min(base_salary, (effective_date, compensation_id)) AS sal FROM compensation_history GROUP BY employee_id),
    co AS (SELECT e.employee_id, COALESCE(termination_date, DATE '{AS_OF}') - hire_date + 1 AS duration_days, (COALESCE(termination_date, DATE '{AS_OF}') - hire_date + 1) / 30.4375::DOUBLE AS duration_months,
      CAST(termination_date IS NOT NULL AS INT) AS event_observed, CAST(year(hire_date) - birth_year AS DOUBLE) AS age_at_hire,
      sal / NULLIF((salary_band_min + salary_band_max) / 2, 0) AS salary_position_at_hire, employment_type, education_level, organizational_level, l.region AS hire_region,
      r.job_family AS hire_job_family, CAST(r.job_level AS VARCHAR) AS hire_job_level, organizational_level IN ('Individual Contributor', 'Manager') AS survival_model_eligible
      FROM employees e LEFT JOIN hr USING (employee_id) LEFT JOIN fs USING (employee_id) LEFT JOIN locations l ON l.location_id = loc LEFT JOIN job_roles r ON r.job_role_id = rol)"""
COHORT_NEEDS = "employees employee_events compensation_history locations job_roles"


def cohort(t: Tables):
    hire = survival.parse_hire_notes(
        t["employee_events"], {"location_id": "hire_location_id", "job_role_id": "hire_job_role_id"}
    )
    first = t["compensation_history"].groupBy(ID).agg(
        F.min_by("base_salary", F.struct("effective_date", "compensation_id")).alias("hire_base_salary")
    )
    return survival.survival_cohort(t["employees"], hire, first, t["locations"], t["job_roles"], AS_OF, LEVELS)


@query(
    "v1_survival_cohort",
    COHORT_NEEDS,
    f"WITH {COHORT_SQL} SELECT * REPLACE (ROUND(duration_months, 6) AS duration_months, ROUND(salary_position_at_hire, 6) AS salary_position_at_hire) FROM co",
)
def _(t: Tables):
    return round_all(cohort(t))


def km_sql(source: str, by: str = "") -> str:
    """CTEs ending in ``km``: the product-limit curve of ``source`` over days."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""kt AS (SELECT {lead}duration_months AS t, COUNT(*) AS l, COUNT(*) FILTER (WHERE event_observed = 1) AS d FROM {source} GROUP BY {lead}duration_months),
    kr AS (SELECT *, SUM(l) OVER ({part} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM kt),
    kk AS (SELECT *, SUM(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER w AS lg, SUM(CASE WHEN d < n THEN d / (n::DOUBLE * (n - d)) ELSE 0 END) OVER w AS va,
      SUM(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w AS gone FROM kr WINDOW w AS ({part} ORDER BY t ROWS UNBOUNDED PRECEDING)),
    km AS (SELECT *, CASE WHEN gone = 0 THEN exp(lg) ELSE 0 END AS s, CASE WHEN gone = 0 AND lg < 0 THEN exp(-exp(ln(-lg) - 1.959963984540054 * sqrt(va) / lg)) WHEN gone = 0 THEN 1.0 END AS lo,
      CASE WHEN gone = 0 AND lg < 0 THEN exp(-exp(ln(-lg) + 1.959963984540054 * sqrt(va) / lg)) WHEN gone = 0 THEN 1.0 END AS hi FROM kk)"""


MODEL_SQL = f"{COHORT_SQL}, mo AS (SELECT * FROM co WHERE survival_model_eligible)"


def model_cohort(t: Tables):
    return cohort(t).where("survival_model_eligible")


@query(
    "v2_kaplan_meier",
    COHORT_NEEDS,
    f"""WITH {MODEL_SQL}, {km_sql('mo')} SELECT ROUND(t, 6) AS duration_months, CAST(n AS BIGINT) AS at_risk, d AS events, l - d AS censored, ROUND(s, 8) AS survival,
    ROUND(lo, 8) AS survival_lower_95, ROUND(hi, 8) AS survival_upper_95 FROM km""",
)
def _(t: Tables):
    out = survival.kaplan_meier(model_cohort(t), "duration_months", "event_observed")
    return round_all(out.withColumn("duration_months", F.round("duration_months", 6)), 8)


@query(
    "v3_horizon_retention",
    COHORT_NEEDS,
    f"""WITH {MODEL_SQL}, {km_sql('mo')}, hz AS (SELECT h::DOUBLE AS h, arg_max(s, t) FILTER (WHERE t <= h) AS s, arg_max(lo, t) FILTER (WHERE t <= h) AS lo, arg_max(hi, t) FILTER (WHERE t <= h) AS hi
      FROM km, (VALUES (6), (12), (24), (36), (48), (60)) v(h) GROUP BY h)
    SELECT h AS horizon_months, ROUND(COALESCE(s, 1), 8) AS retention_probability, ROUND(COALESCE(lo, 1), 8) AS retention_lower_95, ROUND(COALESCE(hi, 1), 8) AS retention_upper_95,
    ROUND(1 - COALESCE(s, 1), 8) AS cumulative_attrition_probability FROM hz""",
)
def _(t: Tables):
    curve = survival.kaplan_meier(model_cohort(t), "duration_months", "event_observed")
    return round_all(survival.horizon_summary(settle(curve), "duration_months"), 8)


GROUPS = ["employment_type", "hire_region", "hire_job_level", "hire_job_family"]
GROUPED_SQL = "gp AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS attribute, COALESCE(CAST({c} AS VARCHAR), 'Missing') AS "group", duration_months, event_observed FROM mo""" for c in GROUPS
) + ")"


@query(
    "v4_grouped_curves",
    COHORT_NEEDS,
    f"""WITH {MODEL_SQL}, {GROUPED_SQL}, {km_sql('gp', 'attribute, "group"')},
    sz AS (SELECT attribute, "group", COUNT(*) AS employees, SUM(event_observed) AS x FROM gp GROUP BY ALL HAVING COUNT(*) >= 100),
    va AS (SELECT attribute, "group", MIN(t) FILTER (WHERE s <= 0.5) AS med, {', '.join(f"COALESCE(arg_max(s, t) FILTER (WHERE t <= {h}), 1) AS r{h}" for h in survival.HORIZONS)} FROM km GROUP BY ALL)
    SELECT attribute, "group", employees, CAST(x AS BIGINT) AS observed_exits, CAST(employees - x AS BIGINT) AS right_censored, ROUND(med, 6) AS median_retention_months,
    {', '.join(f'ROUND(r{h}, 6) AS retention_{h}m' for h in survival.HORIZONS)}, ROUND(x / employees::DOUBLE, 6) AS observed_exit_share FROM sz JOIN va USING (attribute, "group")""",
)
def _(t: Tables):
    return round_all(survival.grouped_curves(model_cohort(t), GROUPS, "duration_months", "event_observed"))


@query(
    "v5_log_rank",
    COHORT_NEEDS,
    # two groups: the statistic is (O - E)² / V of the first one
    f"""WITH {MODEL_SQL}, tt AS (SELECT DISTINCT duration_days AS t FROM mo WHERE event_observed = 1),
    rk AS (SELECT t, COUNT(*) AS n, COUNT(*) FILTER (WHERE employment_type = 'Hourly') AS n1, COUNT(*) FILTER (WHERE duration_days = t AND event_observed = 1) AS d,
      COUNT(*) FILTER (WHERE duration_days = t AND event_observed = 1 AND employment_type = 'Hourly') AS d1 FROM tt JOIN mo ON duration_days >= t GROUP BY t)
    SELECT 'employment_type' AS group_feature, CAST(2 AS INT) AS groups, ROUND(pow(SUM(d1 - d * n1 / n::DOUBLE), 2) / SUM(CASE WHEN n > 1 THEN d * (n - d) / (n - 1)::DOUBLE * n1 / n::DOUBLE * (1 - n1 / n::DOUBLE) ELSE 0 END), 4) AS test_statistic FROM rk""",
)
def _(t: Tables):
    out = survival.log_rank_test(settle(model_cohort(t)), ["employment_type"], "duration_days", "event_observed")
    return round_all(out.select("group_feature", "groups", "test_statistic"), 4)


@query("v5_log_rank_many_groups", COHORT_NEEDS)
def _(t: Tables):
    out = survival.log_rank_test(settle(model_cohort(t)), GROUPS, "duration_days", "event_observed")
    return round_all(out, 8)


COX_NUMERIC = ["age_at_hire", "salary_position_at_hire"]
COX_CATEGORICAL = {"employment_type": "Salaried", "hire_region": "AFRICA"}


def design(t: Tables):
    frame, manifest = survival.cox_design(
        settle(model_cohort(t)), COX_NUMERIC, COX_CATEGORICAL, [ID, "duration_days", "event_observed"]
    )
    return settle(frame), [m["encoded_feature"] for m in manifest]


@query(
    "v6_cox_design",
    COHORT_NEEDS,
    f"""WITH {MODEL_SQL} SELECT employee_id, duration_days, event_observed, ROUND((age_at_hire - AVG(age_at_hire) OVER ()) / STDDEV_POP(age_at_hire) OVER (), 6) AS age_at_hire_z,
    ROUND((salary_position_at_hire - AVG(salary_position_at_hire) OVER ()) / STDDEV_POP(salary_position_at_hire) OVER (), 6) AS salary_position_at_hire_z,
    CAST(employment_type = 'Hourly' AS INT)::DOUBLE AS employment_type_hourly, {', '.join(f"CAST(hire_region = '{r}' AS INT)::DOUBLE AS hire_region_{n}" for r, n in [('AMERICA', 'america'), ('ASIA', 'asia'), ('EUROPE', 'europe'), ('MIDDLE EAST', 'middle_east')])} FROM mo""",
)
def _(t: Tables):
    return round_all(design(t)[0])


@query("v7_hazard_ratios", COHORT_NEEDS)
def _(t: Tables):
    frame, features = design(t)
    return round_all(survival.hazard_ratios(survival.fit_cox(frame, features, "duration_days", "event_observed"), frame))


@query(
    "v8_concordance",
    "employees",
    f"""WITH p AS (SELECT employment_type AS g, COALESCE(termination_date, DATE '{AS_OF}') - hire_date + 1 AS t, CAST(termination_date IS NOT NULL AS INT) AS e, CAST(round(account_balance / 100) AS BIGINT) AS s FROM employees)
    SELECT a.g AS employment_type, COUNT(*) AS comparable_pairs, COUNT(*) FILTER (WHERE a.s > b.s) AS concordant_pairs, COUNT(*) FILTER (WHERE a.s = b.s) AS tied_pairs,
    ROUND((COUNT(*) FILTER (WHERE a.s > b.s) + COUNT(*) FILTER (WHERE a.s = b.s) / 2.0::DOUBLE) / COUNT(*), 8) AS concordance_index
    FROM p a JOIN p b ON a.g = b.g AND a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)) GROUP BY a.g""",
)
def _(t: Tables):
    end = F.coalesce("termination_date", F.lit(AS_OF).cast("date"))
    people = t["employees"].select(
        "employment_type",
        (F.datediff(end, "hire_date") + 1).alias("days"),
        F.col("termination_date").isNotNull().cast("int").alias("event"),
        F.round(F.col("account_balance") / 100).cast("bigint").alias("score"),
    )
    return round_all(survival.concordance(people, "score", "days", "event", ["employment_type"]), 8)


@query("v8_cross_validated_concordance", COHORT_NEEDS)
def _(t: Tables):
    frame, features = design(t)
    return round_all(survival.cross_validated_concordance(frame, features, ID, "duration_days", "event_observed"))


@query("v9_proportional_hazards_check", COHORT_NEEDS)
def _(t: Tables):
    frame, features = design(t)
    fit = survival.fit_cox(frame, features, "duration_days", "event_observed")
    return round_all(survival.proportionality_check(frame, fit, "duration_days", "event_observed"))


@query(
    "v10_cohort_summary",
    COHORT_NEEDS,
    f"""WITH {MODEL_SQL}, {km_sql('mo')} SELECT (SELECT COUNT(*) FROM co) AS all_employees, COUNT(*) AS model_eligible_employees, (SELECT COUNT(*) FROM co WHERE NOT survival_model_eligible) AS protected_employees_excluded,
    COUNT(*) FILTER (WHERE event_observed = 1) AS observed_exits, COUNT(*) FILTER (WHERE event_observed = 0) AS right_censored_active_employees, ROUND(MAX(duration_months), 6) AS maximum_observed_duration_months,
    ROUND(quantile_cont(duration_months, 0.5), 6) AS median_observed_duration_months, (SELECT ROUND(MIN(t), 6) FROM km WHERE s <= 0.5) AS median_retention_months,
    ROUND(AVG(event_observed), 6) AS observed_exit_share, (SELECT COUNT(*) > 0 FROM km WHERE s <= 0.5) AS kaplan_meier_median_reached FROM mo""",
)
def _(t: Tables):
    people = settle(cohort(t))
    curve = survival.kaplan_meier(people.where("survival_model_eligible"), "duration_months", "event_observed")
    return round_all(survival.cohort_summary(people, "duration_months", "event_observed", curve, "survival_model_eligible"))


# ---- data-quality rules -------------------------------------------------------------------------------


def checks_sql(*checks: tuple[str, str, str]) -> str:
    """Check rows from (name, requirement, scalar SQL that counts violations)."""
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, v::DOUBLE AS observed, '{need}' AS requirement FROM (SELECT COALESCE(({sql}), 0) AS v)"""
        for name, need, sql in checks
    )


@query(
    "q1_check_report",
    "employees applications",
    checks_sql(
        ("employee_id null", "no null key", "SELECT COUNT(*) FROM employees WHERE employee_id IS NULL"),
        ("employee_id repeated", "each key once", "SELECT COUNT(*) - COUNT(DISTINCT employee_id) FROM employees"),
        ("end before start", "end >= start", "SELECT COUNT(*) FROM employees WHERE termination_date < hire_date"),
        ("hired without employee", "hired has an employee", "SELECT COUNT(*) FROM applications WHERE application_status = ''Hired'' AND employee_id IS NULL".replace("''", "'")),
    ),
)
def _(t: Tables):
    people = quality.row_rules(t["employees"], {"end before start": (F.col("termination_date") < F.col("hire_date"), "end >= start")})
    hired = (F.col("application_status") == "Hired") & F.col("employee_id").isNull()
    return quality.report(
        [
            quality.key_rules(t["employees"], ID),
            people,
            quality.row_rules(t["applications"], {"hired without employee": (hired, "hired has an employee")}),
        ],
        raise_on_failure=True,
    )


@query(
    "q2_key_rules",
    oracle=checks_sql(
        ("o_orderkey null", "no null key", "SELECT COUNT(*) FROM orders WHERE o_orderkey IS NULL"),
        ("o_orderkey repeated", "each key once", "SELECT COUNT(*) - COUNT(DISTINCT o_orderkey) FROM orders"),
        ("o_orderkey sequence", "ids run from 0 without gaps", "SELECT ABS(MIN(o_orderkey)) + ABS(MAX(o_orderkey) - COUNT(*) + 1) FROM orders"),
    ),
)
def _(t: Tables):
    return quality.key_rules(t.raw("orders"), "o_orderkey", 0)


@query(
    "q3_domain_rules",
    oracle=checks_sql(
        ("o_orderstatus outside domain", "only listed values", "SELECT COUNT(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'X')"),
        ("o_orderstatus unused values", "every listed value occurs", "SELECT 3 - COUNT(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus IN ('F', 'O', 'X')"),
    ),
)
def _(t: Tables):
    return quality.domain_rules(t.raw("orders"), "o_orderstatus", ["F", "O", "X"])


@query(
    "q4_referential",
    "applications employees",
    checks_sql(
        ("order parent", "every foreign key exists", "SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
        ("part parent", "every foreign key exists", "SELECT COUNT(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)"),
    ),
)
def _(t: Tables):
    lines = t.raw("lineitem")
    return quality.report(
        [
            quality.referential(lines, "l_orderkey", t.raw("orders"), "o_orderkey", "order parent"),
            quality.referential(lines, "l_partkey", t.raw("part").where("p_size > 10"), "p_partkey", "part parent"),
        ]
    )


@query(
    "q5_composite_key",
    oracle=checks_sql(("l_orderkey+l_linenumber repeated", "each combination once", "SELECT COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem")),
)
def _(t: Tables):
    return quality.composite_key(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "q6_child_counts",
    "employees employee_events",
    checks_sql(
        ("hire events", "exactly one child", "SELECT COUNT(*) FROM employees WHERE (SELECT COUNT(*) FROM employee_events v WHERE v.employee_id = employees.employee_id AND event_type = 'Hire') <> 1"),
        ("promotions", "at least one child", "SELECT COUNT(*) FROM employees WHERE employee_id NOT IN (SELECT employee_id FROM employee_events WHERE event_type = 'Promotion')"),
    ),
)
def _(t: Tables):
    events = t["employee_events"]
    return quality.report(
        [
            quality.child_counts(t["employees"], events.where("event_type = 'Hire'"), ID, "hire events"),
            quality.child_counts(t["employees"], events.where("event_type = 'Promotion'"), ID, "promotions", exactly_one=False),
        ]
    )


@query(
    "q7_conditional_ranges",
    "training_records",
    checks_sql(
        ("completed hours", "hours > 0", "SELECT COUNT(*) FROM training_records WHERE completion_status = 'Completed' AND NOT training_hours > 0"),
        ("completed score", "score in 0..100", "SELECT COUNT(*) FROM training_records WHERE completion_status = 'Completed' AND NOT score BETWEEN 0 AND 100"),
        ("failed score", "score below 60", "SELECT COUNT(*) FROM training_records WHERE completion_status = 'Failed' AND score >= 60"),
    ),
)
def _(t: Tables):
    done, failed = F.col("completion_status") == "Completed", F.col("completion_status") == "Failed"
    return quality.row_rules(
        t["training_records"],
        {
            "completed hours": (done & ~(F.col("training_hours") > 0), "hours > 0"),
            "completed score": (done & ~F.col("score").between(0, 100), "score in 0..100"),
            "failed score": (failed & (F.col("score") >= 60), "score below 60"),
        },
    )


@query(
    "q8_null_patterns",
    "job_requisitions training_records",
    checks_sql(
        ("open without close", "open <=> no close date", "SELECT COUNT(*) FROM job_requisitions WHERE (requisition_status = 'Open') <> (close_date IS NULL)"),
        ("in progress without date", "in progress <=> no completion", "SELECT COUNT(*) FROM training_records WHERE (completion_status = 'In Progress') <> (completion_date IS NULL)"),
    ),
)
def _(t: Tables):
    opened = (F.col("requisition_status") == "Open") != F.col("close_date").isNull()
    running = (F.col("completion_status") == "In Progress") != F.col("completion_date").isNull()
    return quality.report(
        [
            quality.row_rules(t["job_requisitions"], {"open without close": (opened, "open <=> no close date")}),
            quality.row_rules(t["training_records"], {"in progress without date": (running, "in progress <=> no completion")}),
        ]
    )


@query(
    "q9_date_order",
    "applications",
    checks_sql(
        ("offer before application", "application <= offer", "SELECT COUNT(*) FROM applications WHERE offer_date < application_date"),
        ("decision before offer", "offer <= decision", "SELECT COUNT(*) FROM applications WHERE decision_date < offer_date"),
    ),
)
def _(t: Tables):
    return quality.row_rules(
        t["applications"],
        {
            "offer before application": (F.col("offer_date") < F.col("application_date"), "application <= offer"),
            "decision before offer": (F.col("decision_date") < F.col("offer_date"), "offer <= decision"),
        },
    )


@query(
    "q10_inside_employment",
    "training_records employees",
    checks_sql(
        ("completion outside employment", "start <= date <= end", f"SELECT COUNT(*) FROM training_records JOIN employees USING (employee_id) WHERE completion_date < hire_date OR completion_date > COALESCE(termination_date, DATE '{AS_OF}')")
    ),
)
def _(t: Tables):
    return quality.inside_interval(
        t["training_records"], "completion_date", t["employees"], ID, "hire_date", "termination_date", AS_OF, "completion outside employment"
    )


@query(
    "q11_monotone_salary",
    "compensation_history",
    checks_sql(
        ("base_salary decreases", "no decrease over time", "SELECT COUNT(*) FROM (SELECT base_salary < LAG(base_salary) OVER (PARTITION BY employee_id ORDER BY effective_date, compensation_id) AS b FROM compensation_history) WHERE b")
    ),
)
def _(t: Tables):
    return quality.monotone(t["compensation_history"], ID, keys("effective_date", "compensation_id"), "base_salary")


@query(
    "q12_salary_in_band",
    "compensation_history employees job_roles",
    checks_sql(
        ("salary outside band", "low <= value <= 1.08 high", "SELECT COUNT(*) FROM compensation_history JOIN employees USING (employee_id) JOIN job_roles USING (job_role_id) WHERE NOT base_salary BETWEEN salary_band_min AND salary_band_max * 1.08")
    ),
)
def _(t: Tables):
    paid = t["compensation_history"].join(t["employees"].select(ID, "job_role_id"), ID)
    return quality.within_band(paid, "base_salary", t["job_roles"], "job_role_id", "salary_band_min", "salary_band_max", 1.08, "salary outside band")


@query(
    "q13_first_row",
    "employee_events employees",
    "WITH f AS (SELECT employee_id, arg_min(event_type, (event_date, event_id)) AS k, arg_min(event_date, (event_date, event_id)) AS d, COUNT(*) FILTER (WHERE event_type = 'Hire') AS n FROM employee_events GROUP BY employee_id), "
    "j AS (SELECT * FROM employees LEFT JOIN f USING (employee_id)) "
    + checks_sql(
        ("first row kind", "earliest row is Hire", "SELECT COUNT(*) FROM j WHERE k IS DISTINCT FROM 'Hire'"),
        ("first row date", "on the start date", "SELECT COUNT(*) FROM j WHERE d IS DISTINCT FROM hire_date"),
        ("first row count", "exactly one", "SELECT COUNT(*) FROM j WHERE COALESCE(n, 0) <> 1"),
    ),
)
def _(t: Tables):
    return quality.first_row_rules(
        t["employee_events"], ID, ["event_date", "event_id"], "event_type", "Hire", t["employees"], "event_date", "hire_date"
    )


@query(
    "q14_histories_agree",
    "employee_events compensation_history",
    "WITH a AS (SELECT employee_id, event_date AS d FROM employee_events WHERE event_type IN ('Promotion', 'Transfer')), b AS (SELECT employee_id, effective_date AS d FROM compensation_history WHERE change_reason = 'Promotion') "
    + checks_sql(
        ("promotions only first", "no row on one side only", "SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"),
        ("promotions only second", "no row on one side only", "SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"),
    ),
)
def _(t: Tables):
    events = t["employee_events"].where("event_type in ('Promotion', 'Transfer')").select(ID, F.col("event_date").alias("d"))
    pay = t["compensation_history"].where("change_reason = 'Promotion'").select(ID, F.col("effective_date").alias("d"))
    return quality.same_rows(events, pay, [ID, "d"], "promotions")


@query(
    "q15_latest_equals_current",
    "employee_events employees",
    "WITH l AS (SELECT employee_id, arg_max(new_value, (event_date, event_id)) AS v, COUNT(*) AS n FROM employee_events WHERE event_type = 'Transfer' GROUP BY employee_id), "
    "j AS (SELECT l.*, location_id FROM l JOIN employees USING (employee_id)) "
    + checks_sql(
        ("location", "last change equals current value", "SELECT COUNT(*) FROM j WHERE CAST(v AS BIGINT) IS DISTINCT FROM location_id"),
        ("location repeats", "at most 1", "SELECT COUNT(*) FROM j WHERE n > 1"),
    ),
)
def _(t: Tables):
    return quality.latest_matches(t["employee_events"], "Transfer", t["employees"], ID, "location_id", "location", maximum=1)


@query(
    "q16_leave_pairs",
    "employee_events",
    "WITH n AS (SELECT employee_id, event_type AS k, event_date AS d, ROW_NUMBER() OVER (PARTITION BY employee_id, event_type ORDER BY event_date, event_id) AS i FROM employee_events WHERE event_type IN ('Leave', 'Return From Leave')), "
    "p AS (SELECT employee_id, i, MAX(d) FILTER (WHERE k = 'Leave') AS s, MAX(d) FILTER (WHERE k <> 'Leave') AS e FROM n GROUP BY ALL) "
    + checks_sql(
        ("start without end", "each start has an end", "SELECT COUNT(*) FROM p WHERE e IS NULL"),
        ("end without start", "each end has a start", "SELECT COUNT(*) FROM p WHERE s IS NULL"),
        ("end before start", "ends later", "SELECT COUNT(*) FROM p WHERE e < s"),
    ),
)
def _(t: Tables):
    return quality.pairing_rules(t["employee_events"], ID, "event_date", "event_type", "Leave", "Return From Leave")


ALLOWED = [("Individual Contributor", "Manager"), ("Individual Contributor", "Senior Manager"), ("Manager", "Senior Manager"), ("Senior Manager", "Department Head")]
CHAIN = ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED)


@query(
    "q17_hierarchy",
    "employees",
    "WITH j AS (SELECT e.*, m.employee_id AS mid, m.employment_status AS ms, m.department_id AS md, m.organizational_level AS ml FROM employees e LEFT JOIN employees m ON e.manager_id = m.employee_id) "
    + checks_sql(
        ("self managed", "none", "SELECT COUNT(*) FROM j WHERE employee_id = manager_id"),
        ("manager missing", "none", "SELECT COUNT(*) FROM j WHERE manager_id IS NOT NULL AND mid IS NULL"),
        ("manager inactive", "none", "SELECT COUNT(*) FROM j WHERE employment_status = 'Active' AND ms <> 'Active'"),
        ("manager of other department", "none", "SELECT COUNT(*) FROM j WHERE department_id <> md"),
        ("manager level", "none", f"SELECT COUNT(*) FROM j WHERE mid IS NOT NULL AND (organizational_level, ml) NOT IN ({CHAIN})"),
        ("head with manager", "none", "SELECT COUNT(*) FROM j WHERE organizational_level = 'Department Head' AND manager_id IS NOT NULL"),
        ("no manager", "none", "SELECT COUNT(*) FROM j WHERE organizational_level <> 'Department Head' AND manager_id IS NULL"),
    ),
)
def _(t: Tables):
    return quality.hierarchy_rules(t["employees"], ALLOWED, ["Department Head"])


@query(
    "q18_span_of_control",
    "employees",
    checks_sql(
        ("span of control", "reports within the limit", "SELECT COUNT(*) FROM (SELECT manager_id, COUNT(*) AS n FROM employees WHERE employment_status = 'Active' AND manager_id IS NOT NULL GROUP BY manager_id) l JOIN employees e ON e.employee_id = l.manager_id WHERE n > CASE organizational_level WHEN 'Manager' THEN 4 WHEN 'Senior Manager' THEN 6 WHEN 'Department Head' THEN 6 END")
    ),
)
def _(t: Tables):
    return quality.span_limits(t["employees"], {"Manager": 4, "Senior Manager": 6, "Department Head": 6})


@query(
    "q19_required_training",
    "employees training_records",
    checks_sql(
        ("leadership training", "required record exists", "SELECT COUNT(*) FROM employees WHERE organizational_level <> 'Individual Contributor' AND employee_id NOT IN (SELECT employee_id FROM training_records WHERE program_id < 5)")
    ),
)
def _(t: Tables):
    return quality.required_child(
        t["employees"], F.col("organizational_level") != "Individual Contributor", t["training_records"], F.col("program_id") < 5, ID, "leadership training"
    )


@query(
    "q20_totals_agree",
    oracle="WITH a AS (SELECT l_orderkey AS k, COUNT(*) AS v FROM lineitem WHERE l_quantity > 2 GROUP BY ALL), b AS (SELECT l_orderkey AS k, COUNT(*) AS v FROM lineitem GROUP BY ALL) "
    + checks_sql(("order lines", "group totals agree", "SELECT COUNT(*) FROM a FULL JOIN b USING (k) WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v")),
)
def _(t: Tables):
    lines = t.raw("lineitem").withColumn("one", F.lit(1))
    return quality.totals_agree(lines.where("l_quantity > 2"), lines, ["l_orderkey"], "one", "order lines")


@query(
    "q21_text_pattern",
    "employee_events candidates",
    checks_sql(
        ("hire note", "note names the location", "SELECT COUNT(*) FROM employee_events WHERE event_type = 'Hire' AND NOT regexp_matches(notes, 'location_id=[0-9]+')"),
        ("candidate location", "City, State", "SELECT COUNT(*) FROM candidates WHERE NOT regexp_matches(candidate_location, '^[A-Za-z#0-9]+, [A-Z]+$')"),
        ("candidate number", "two digits", "SELECT COUNT(*) FROM candidates WHERE NOT regexp_matches(candidate_location, '#[0-9][0-9],')"),
    ),
)
def _(t: Tables):
    note = (F.col("event_type") == "Hire") & ~F.col("notes").rlike("location_id=[0-9]+")
    return quality.report(
        [
            quality.row_rules(t["employee_events"], {"hire note": (note, "note names the location")}),
            quality.row_rules(
                t["candidates"],
                {
                    "candidate location": (~F.col("candidate_location").rlike("^[A-Za-z#0-9]+, [A-Z]+$"), "City, State"),
                    "candidate number": (~F.col("candidate_location").rlike("#[0-9][0-9],"), "two digits"),
                },
            ),
        ]
    )


@query(
    "q22_attributes_equal",
    "employees applications job_requisitions",
    "WITH h AS (SELECT requisition_id, employee_id FROM applications WHERE employee_id IS NOT NULL), j AS (SELECT r.department_id AS a, r.job_role_id AS b, e.department_id AS c, e.job_role_id AS d FROM h JOIN job_requisitions r USING (requisition_id) JOIN employees e USING (employee_id)) "
    + checks_sql(
        ("hired department_id", "equal on both sides", "SELECT COUNT(*) FROM j WHERE a IS DISTINCT FROM c"),
        ("hired job_role_id", "equal on both sides", "SELECT COUNT(*) FROM j WHERE b IS DISTINCT FROM d"),
    ),
)
def _(t: Tables):
    hired = t["applications"].where(F.col(ID).isNotNull()).select("requisition_id", ID)
    wanted = hired.join(t["job_requisitions"], "requisition_id").select(ID, F.col("department_id").cast("bigint").alias("department_id"), "job_role_id")
    people = t["employees"].select(ID, F.col("department_id").cast("bigint").alias("department_id"), "job_role_id")
    return quality.attributes_equal(wanted, people, [ID], ["department_id", "job_role_id"], "hired")


@query(
    "q23_leaky_columns",
    HR,
    f"""SELECT 'leaky columns' AS "check", CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, COUNT(*)::DOUBLE AS observed, 'none of: {', '.join(panel.LEAKY_COLUMNS)}' AS requirement
    FROM (SELECT unnest({list(panel.PANEL_COLUMNS)}) AS c) WHERE c IN ({', '.join(f"'{c}'" for c in panel.LEAKY_COLUMNS)})""",
)
def _(t: Tables):
    return quality.forbidden_columns(full_panel(t), panel.LEAKY_COLUMNS)


AUDIT_DATES = ["latest_compensation_date", "latest_review_date", "latest_training_date", "latest_event_date"]


@query(
    "q24_no_future_dates",
    HR,
    f"WITH {WIDE} "
    + checks_sql(*[(f"{c} in the future", "date <= snapshot", f"SELECT COUNT(*) FROM based WHERE {c} > snapshot_date") for c in AUDIT_DATES]),
)
def _(t: Tables):
    audit = settle(panel.row_audit(panel.panel_with_audit(hr(t), SNAPSHOTS, review_tie_break=TIE)))
    return quality.no_future_dates(audit, "snapshot_date", AUDIT_DATES)


@query(
    "q25_label_rebuild",
    HR,
    f"WITH p AS ({PANEL_SQL}) "
    + checks_sql(
        ("label mismatches", "labels can be rebuilt", "SELECT COUNT(*) FROM p JOIN employees e USING (employee_id) WHERE attrition_next_12m IS DISTINCT FROM CASE WHEN prediction_end_date IS NOT NULL THEN CASE WHEN termination_date BETWEEN snapshot_date + 1 AND prediction_end_date THEN 1 ELSE 0 END END")
    ),
)
def _(t: Tables):
    master = t["employees"].select(ID, "termination_date")
    expected = panel.future_label(F.col("termination_date"), F.col("snapshot_date"), F.col("prediction_end_date"))
    rows = full_panel(t).select(ID, "snapshot_date", "prediction_end_date", "attrition_next_12m")
    return quality.label_rebuild(rows, master, ID, "attrition_next_12m", expected)


@query(
    "q26_windows_disjoint",
    "employees",
    f"WITH c AS (SELECT DISTINCT snapshot_sequence, snapshot_date, prediction_end_date FROM employees, {snapshot_values()} WHERE hire_date <= snapshot_date), "
    "g AS (SELECT LEAD(snapshot_date) OVER (ORDER BY snapshot_sequence) - prediction_end_date AS gap FROM c) "
    + checks_sql(("overlapping windows", "next snapshot >= horizon end", "SELECT COUNT(*) FROM g WHERE gap < 0")),
)
def _(t: Tables):
    windows = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(d).cast("date").alias("d"), F.lit(h).cast("date").alias("h")) for s, _, d, h in SNAPSHOTS])
    hired = t["employees"].select("hire_date", F.explode(windows).alias("w")).where("hire_date <= w.d").select("w.*")
    return quality.windows_disjoint(hired, "s", "d", "h")


@query(
    "q27_same_population",
    "employees",
    f"WITH a AS (SELECT employee_id FROM employees WHERE hire_date <= DATE '{SNAPSHOTS[3][2]}' AND (termination_date IS NULL OR termination_date > DATE '{SNAPSHOTS[3][2]}')), b AS (SELECT employee_id FROM employees WHERE employment_status = 'Active') "
    + checks_sql(
        ("population only first", "no row on one side only", "SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
        ("population only second", "no row on one side only", "SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    ),
)
def _(t: Tables):
    scored = full_panel(t).where("dataset_type = 'current_scoring'").select(ID)
    return quality.same_population(scored, t["employees"].where("employment_status = 'Active'").select(ID), ID)


@query(
    "q28_volume_bounds",
    HR,
    f"""WITH p AS ({PANEL_SQL}), g AS (SELECT CAST(snapshot_date AS VARCHAR) AS s, COUNT(*) AS n, AVG(attrition_next_12m) AS r FROM p GROUP BY ALL)
    SELECT 'rows ' || s AS "check", CASE WHEN n BETWEEN 10 AND 1300 THEN 'PASS' ELSE 'FAIL' END AS status, n::DOUBLE AS observed, 'between 10 and 1300' AS requirement FROM g
    UNION ALL SELECT 'rate ' || s, CASE WHEN r BETWEEN 0.05 AND 0.3 THEN 'PASS' ELSE 'FAIL' END, ROUND(r, 6), 'between 0.05 and 0.3' FROM g WHERE r IS NOT NULL""",
)
def _(t: Tables):
    rows = full_panel(t).select("snapshot_date", "attrition_next_12m")
    return quality.volume_bounds(rows, "snapshot_date", "attrition_next_12m", (10, 1300), (0.05, 0.3))


@query("q29_split_safety", "employees")
def _(t: Tables):
    split = settle(resample.temporal_split(labelled_snapshots(t), "snapshot_date", SPLITS, "label"))
    folds = settle(resample.grouped_folds(split.where("split <> 'test'"), ID, "label", 5, 42))
    assignment = resample.assignments(split, [ID, "snapshot_date"])
    return round_all(quality.split_safety(split, assignment, folds, ID, "snapshot_date", "label", ["train", "validation", "test"], 0.05))


@query("q30_policy_coverage", "scored")
def _(t: Tables):
    people = t["scored"].select(*NUMERIC, *CATEGORICAL, "period", Y)
    roles = {"numerical": NUMERIC, "categorical": CATEGORICAL, "metadata": ["period"], "target": [Y]}
    return quality.policy_coverage(people, roles, {"employment_type": "Hourly", "region": "Nowhere"})


@query(
    "q31_scores_and_curves",
    COHORT_NEEDS + " scored",
    f"WITH {MODEL_SQL}, {km_sql('mo')}, ls AS (SELECT s, LAG(s) OVER (ORDER BY t) AS b FROM km), "
    "cf AS (SELECT region, COUNT(*) AS n, COUNT(*) FILTER (WHERE actual_attrition = 0 AND attrition_probability < 0.4) + COUNT(*) FILTER (WHERE actual_attrition = 0 AND attrition_probability >= 0.4) "
    "+ COUNT(*) FILTER (WHERE actual_attrition = 1 AND attrition_probability < 0.4) + COUNT(*) FILTER (WHERE actual_attrition = 1 AND attrition_probability >= 0.4) AS m FROM scored GROUP BY region) "
    + checks_sql(
        ("score missing", "no null", "SELECT COUNT(*) FROM scored WHERE attrition_probability IS NULL"),
        ("score outside [0,1]", "in [0, 1]", "SELECT COUNT(*) FROM scored WHERE NOT attrition_probability BETWEEN 0 AND 1"),
        ("label outside {0,1}", "0 or 1", "SELECT COUNT(*) FROM scored WHERE actual_attrition NOT IN (0, 1)"),
        ("survival rises", "non-increasing", "SELECT COUNT(*) FROM ls WHERE s > b + 1e-12"),
        ("confusion sum", "tn + fp + fn + tp = rows", "SELECT COUNT(*) FROM cf WHERE n <> m"),
    ),
)
def _(t: Tables):
    from stayline.operators import metrics

    curve = settle(survival.kaplan_meier(model_cohort(t), "duration_days", "event_observed"))
    table = metrics.confusion(t["scored"], Y, F.col(P) >= 0.4, ["region"]).join(
        t["scored"].groupBy("region").agg(F.count(F.lit(1)).alias("rows")), "region"
    )
    return quality.report(
        [
            quality.score_rules(t["scored"], P, Y),
            quality.non_increasing(curve, [], "duration_days", "survival", "survival rises"),
            quality.confusion_rules(table),
        ]
    )


@query("q32_plan_reconciliation", "scored")
def _(t: Tables):
    rows = settle(planned(t).where("period = 'test'"))
    plan = policy.planning_rollup(rows, ["department_name"], "budget_expected_value")
    return quality.plan_rules(
        plan, rows, "department_name", "budget_expected_value", FROZEN["cost"], int(FROZEN["maximum"]), FROZEN["budget"],
        t["scored"].where("period = 'test'"), ID,
    )


# ---- two implementations -------------------------------------------------------------------------------


def orders_twice(t: Tables):
    """The orders, and a copy with known differences."""
    first = t.raw("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"),
        (F.col("o_totalprice") > 250_000).alias("large"),
    )
    k = F.col("o_orderkey")
    second = first.where(k % 1000 != 3).select(
        "o_orderkey",
        F.when(k % 50 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 70 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 90 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice") * (1 + 1e-13)).alias("o_totalprice"),
        F.when(k % 110 == 0, F.date_add("o_orderdate", 1)).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(k % 130 == 0, ~F.col("large")).otherwise(F.col("large")).alias("large"),
    )
    return first, second


CLASSES = {
    "o_custkey": "exact_numeric", "o_orderstatus": "exact_text", "o_totalprice": "tolerant_numeric", "o_orderdate": "date", "large": "boolean",
}
GAP = "COUNT(*) FILTER (WHERE k % 1000 = 3)"


def _differs(step: int) -> str:
    return f"COUNT(*) FILTER (WHERE k % 1000 = 3 OR k % {step} = 0)"


@query(
    "x1_table_comparison",
    oracle=f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
    SELECT 'o_custkey' AS feature, 'exact_numeric' AS comparison_type, COUNT(*) AS rows_compared, {_differs(50)} AS null_pattern_mismatches, {_differs(50)} AS value_mismatches, 0.0::DOUBLE AS maximum_absolute_difference FROM o
    UNION ALL SELECT 'o_orderstatus', 'exact_text', COUNT(*), {GAP}, {_differs(70)}, NULL FROM o
    UNION ALL SELECT 'o_totalprice', 'tolerant_numeric', COUNT(*), {GAP}, {_differs(90)}, 0.5 FROM o
    UNION ALL SELECT 'o_orderdate', 'date', COUNT(*), {GAP}, {_differs(110)}, NULL FROM o
    UNION ALL SELECT 'large', 'boolean', COUNT(*), {GAP}, {_differs(130)}, NULL FROM o""",
)
def _(t: Tables):
    first, second = orders_twice(t)
    return round_all(diff.compare_tables(first, second, ["o_orderkey"], CLASSES))


@query(
    "x1_panel_two_ways",
    HR,
)
def _(t: Tables):
    frame = full_panel(t)
    tables = hr(t)
    # passed in by name, so no temporary view of the caller is touched
    used = re.findall(r"{(hr_\w+)}", PANEL_SQL_SPARK)
    second = t.spark.sql(PANEL_SQL_SPARK, **{name: tables[name[3:]] for name in used})
    columns = ["employee_id", "snapshot_date", *[c for c in second.columns if c not in ("employee_id", "snapshot_date")]]
    first = frame.select(*columns)
    classes = diff.infer_classes(first.drop("employee_id", "snapshot_date"))
    return round_all(diff.compare_tables(settle(first), settle(second.select(*columns)), ["employee_id", "snapshot_date"], classes), 9)


# The compensation and event figures of the panel, written as correlated SQL.
PANEL_SQL_SPARK = f"""WITH cal AS (SELECT * FROM VALUES {', '.join(f"({s}, DATE '{d}')" for s, _, d, _ in SNAPSHOTS)} AS c(sequence, snapshot_date)),
  people AS (SELECT employee_id, snapshot_date FROM {{hr_employees}} JOIN cal ON hire_date <= snapshot_date AND (termination_date IS NULL OR termination_date > snapshot_date)),
  pay AS (SELECT p.employee_id, p.snapshot_date, h.base_salary, h.effective_date, ROW_NUMBER() OVER (PARTITION BY p.employee_id, p.snapshot_date ORDER BY effective_date DESC, compensation_id DESC) AS r,
    COUNT(*) OVER (PARTITION BY p.employee_id, p.snapshot_date) AS n FROM people p JOIN {{hr_compensation_history}} h ON h.employee_id = p.employee_id AND h.effective_date <= p.snapshot_date),
  ev AS (SELECT p.employee_id, p.snapshot_date, COUNT_IF(event_type = 'Promotion') AS promotions, COUNT_IF(event_type = 'Leave' AND event_date > ADD_MONTHS(p.snapshot_date, -12)) AS leaves
    FROM people p JOIN {{hr_employee_events}} e ON e.employee_id = p.employee_id AND e.event_date <= p.snapshot_date GROUP BY ALL)
  SELECT p.employee_id, p.snapshot_date, base_salary, CAST(DATEDIFF(p.snapshot_date, effective_date) AS BIGINT) AS days_since_compensation_change, n AS compensation_record_count,
    promotions AS prior_promotion_events, leaves AS leaves_12m FROM people p LEFT JOIN pay ON pay.employee_id = p.employee_id AND pay.snapshot_date = p.snapshot_date AND r = 1
    LEFT JOIN ev ON ev.employee_id = p.employee_id AND ev.snapshot_date = p.snapshot_date"""


@query(
    "x1_comparison_summary",
    "compensation_history",
    """WITH c AS (SELECT compensation_id AS id, base_salary * (1 + 1e-15) AS v FROM compensation_history)
    SELECT true AS columns_match, COUNT(*) FILTER (WHERE id IS NULL OR compensation_id IS NULL) = 0 AS keys_match,
    COUNT(*) FILTER (WHERE (v IS NULL) <> (base_salary IS NULL)) AS total_null_pattern_mismatches,
    COUNT(*) FILTER (WHERE ABS(v - base_salary) > 1e-9 + 1e-9 * ABS(v)) AS total_value_mismatches,
    COUNT(*) FILTER (WHERE printf('%.4f', v) <> printf('%.4f', base_salary)) = 0 AS fingerprints_match FROM compensation_history FULL JOIN c ON id = compensation_id""",
)
def _(t: Tables):
    pay = t["compensation_history"]
    copy = pay.withColumn("base_salary", F.col("base_salary") * (1 + 1e-15))
    classes = diff.infer_classes(pay.drop("compensation_id"))
    return diff.comparison_summary(pay, copy, ["compensation_id"], classes, decimals=4)


@query(
    "x2_key_equality",
    oracle="""SELECT COUNT(*) FILTER (WHERE o_orderkey % 1000 = 3) AS only_in_first, 0::BIGINT AS only_in_second,
    COUNT(*) FILTER (WHERE o_orderkey % 1000 = 3) = 0 AS keys_match FROM orders""",
)
def _(t: Tables):
    return diff.key_differences(*orders_twice(t), ["o_orderkey"])


@query(
    "x3_value_normalisers",
    oracle="""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' END AS b, CASE WHEN doc_id % 3 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS d,
      CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS n FROM documents)
    SELECT 'b' AS column_name, COUNT(*) FILTER (WHERE doc_id % 4 = 2) AS invalid_values FROM t UNION ALL SELECT 'd', COUNT(*) FILTER (WHERE doc_id % 3 = 0) FROM t
    UNION ALL SELECT 'n', COUNT(*) FILTER (WHERE doc_id % 5 = 0) FROM t""",
)
def _(t: Tables):
    k = F.col("doc_id")
    texts = t.raw("documents").select(
        F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "0").when(k % 4 == 2, "maybe").alias("b"),
        F.when(k % 3 == 0, "2024-02-30").otherwise("2024-02-28").alias("d"),
        F.when(k % 5 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("n"),
    )
    return diff.invalid_values(texts, {"b": "boolean", "d": "date", "n": "exact_numeric"})


@query(
    "x4_partition_counts",
    oracle="""SELECT o_orderstatus, a AS first_rows, b AS second_rows, a = b AS row_count_match FROM
    (SELECT o_orderstatus, COUNT(*) AS a FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus, COUNT(*) AS b FROM orders WHERE o_orderkey % 1000 <> 3 GROUP BY 1) USING (o_orderstatus)""",
)
def _(t: Tables):
    first = t.raw("orders")
    return diff.partition_counts(first, first.where("o_orderkey % 1000 <> 3"), "o_orderstatus")


# ---- history correction ----------------------------------------------------------------------------------

ENDS = f"en AS (SELECT employee_id AS eid, COALESCE(termination_date, DATE '{AS_OF}') AS e FROM employees)"


@query(
    "h1_apply_outcomes",
    "employees",
    """SELECT employee_id, CASE WHEN employee_id % 5 <> 0 THEN CASE WHEN employee_id % 2 = 0 THEN 'Active' ELSE 'Terminated' END END AS employment_status,
    CASE WHEN employee_id % 5 <> 0 AND employee_id % 2 = 1 THEN DATE '2001-01-31' END AS termination_date, hire_date, department_id FROM employees""",
)
def _(t: Tables):
    people = t["employees"].select(ID, "employment_status", "termination_date", "hire_date", "department_id")
    outcomes = people.where(F.col(ID) % 5 != 0).select(
        ID,
        F.when(F.col(ID) % 2 == 0, "Active").otherwise("Terminated").alias("employment_status"),
        F.when(F.col(ID) % 2 == 1, F.lit("2001-01-31").cast("date")).alias("termination_date"),
    )
    return history.apply_outcomes(people, outcomes, ["employment_status", "termination_date"])


@query(
    "h2_censor_records",
    "employees training_records",
    f"WITH {ENDS} SELECT training_record_id, employee_id, completion_date, completion_status FROM training_records JOIN en ON eid = employee_id WHERE completion_date <= e",
)
def _(t: Tables):
    kept = history.censor(t["training_records"], "completion_date", history.end_dates(t["employees"], AS_OF))
    return kept.select("training_record_id", ID, "completion_date", "completion_status")


@query(
    "h3_censor_with_rewrite",
    "employees training_records",
    f"""WITH {ENDS}, pr AS (SELECT program_id, ROUND(AVG(training_hours), 1) AS q FROM training_records GROUP BY program_id),
    j AS (SELECT *, COALESCE(completion_date > e, false) AS late FROM training_records JOIN en ON eid = employee_id LEFT JOIN pr USING (program_id) WHERE start_date <= e)
    SELECT training_record_id, employee_id, CASE WHEN NOT late THEN completion_date END AS completion_date, CASE WHEN late THEN 'Incomplete' ELSE completion_status END AS completion_status,
    CASE WHEN NOT late THEN score END AS score, ROUND(CASE WHEN late THEN LEAST(training_hours, GREATEST(q - 0.1::DOUBLE, 0)) ELSE training_hours END, 4) AS training_hours FROM j""",
)
def _(t: Tables):
    programs = t["training_records"].groupBy("program_id").agg(F.round(F.avg("training_hours"), 1).alias("required_hours"))
    out = history.censor_training(t["training_records"], programs, history.end_dates(t["employees"], AS_OF))
    return round_all(out.select("training_record_id", ID, "completion_date", "completion_status", "score", "training_hours"), 4)


@query(
    "h4_assignments_at_exit",
    "employees employee_events",
    """WITH a AS (SELECT e.employee_id, arg_max(new_value, (event_date, event_id)) FILTER (WHERE event_type = 'Transfer' AND event_date <= termination_date) AS lt,
      arg_min(old_value, (event_date, event_id)) FILTER (WHERE event_type = 'Transfer') AS lo, arg_max(new_value, (event_date, event_id)) FILTER (WHERE event_type = 'Manager Change' AND event_date <= termination_date) AS mt,
      arg_min(old_value, (event_date, event_id)) FILTER (WHERE event_type = 'Manager Change') AS mo FROM employees e LEFT JOIN employee_events v USING (employee_id) GROUP BY e.employee_id)
    SELECT employee_id, CASE WHEN employment_status = 'Terminated' THEN COALESCE(CAST(lt AS INT), CAST(lo AS INT), location_id) ELSE location_id END AS location_id,
    CASE WHEN employment_status = 'Terminated' THEN COALESCE(CAST(mt AS BIGINT), CAST(mo AS BIGINT), manager_id) ELSE manager_id END AS manager_id FROM employees JOIN a USING (employee_id)""",
)
def _(t: Tables):
    return history.assignments_at_exit(t["employees"], t["employee_events"]).select(ID, "location_id", "manager_id")


REPAIR_SQL = """mc AS (SELECT v.*, (o.termination_date IS NULL OR o.termination_date > event_date) AND (n.termination_date IS NULL OR n.termination_date > event_date) AS valid
      FROM employee_events v LEFT JOIN employees o ON o.employee_id = CAST(old_value AS BIGINT) LEFT JOIN employees n ON n.employee_id = CAST(new_value AS BIGINT) WHERE event_type = 'Manager Change')"""


@query(
    "h5_repair_manager_changes",
    "employees employee_events",
    f"""WITH {REPAIR_SQL}, f AS (SELECT employee_id, COALESCE(arg_max(new_value, (event_date, event_id)) FILTER (WHERE valid), arg_min(old_value, (event_date, event_id))) AS m FROM mc GROUP BY employee_id)
    SELECT employee_id, COALESCE(CAST(m AS BIGINT), manager_id) AS manager_id FROM employees LEFT JOIN f USING (employee_id)""",
)
def _(t: Tables):
    return history.repair_manager_changes(t["employees"], t["employee_events"])[0].select(ID, "manager_id")


@query(
    "h5_valid_manager_events",
    "employees employee_events",
    f"WITH {REPAIR_SQL} SELECT event_id, employee_id, event_type FROM employee_events WHERE event_type <> 'Manager Change' UNION ALL SELECT event_id, employee_id, event_type FROM mc WHERE valid",
)
def _(t: Tables):
    return history.repair_manager_changes(t["employees"], t["employee_events"])[1].select("event_id", ID, "event_type")


@query(
    "h6_rebuild_events",
    "employees employee_events",
    f"""WITH {ENDS}, k AS (SELECT v.* FROM employee_events v JOIN en ON eid = employee_id WHERE event_date <= e),
    p AS (SELECT employee_id FROM k WHERE event_type = 'Leave' GROUP BY employee_id HAVING COUNT(*) = 2)
    SELECT employee_id, event_date, event_type, old_value, new_value, notes FROM k WHERE event_type <> 'Leave' OR employee_id IN (SELECT employee_id FROM p)
    UNION ALL SELECT employee_id, termination_date, 'Termination', 'Active', 'Terminated', termination_type || ' termination.' FROM employees WHERE employment_status = 'Terminated'""",
)
def _(t: Tables):
    return history.rebuild_events(t["employee_events"], t["employees"], AS_OF)


VALID_LEVELS = {
    "Individual Contributor": ["Manager", "Senior Manager"],
    "Manager": ["Senior Manager", "Department Head"],
    "Senior Manager": ["Department Head"],
    "Department Head": ["Department Head"],
}
CAPACITY = {"Manager": 12, "Senior Manager": 15, "Department Head": 20}


@query("h7_reassign_reports", "employees")
def _(t: Tables):
    return history.reassign_reports(t["employees"], AS_OF, VALID_LEVELS, CAPACITY)


