"""Queries for economics, selection policies, planning, subgroup metrics and allocation audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import fairness, metrics, policy, resample
from stayline.operators.rank import Key, flag_top_fraction
from stayline.plans.ranking import draw_sql
from stayline.plans.registry import Tables, query, round_all
from stayline.session import settle, store

P, Y, ID, S = "attrition_probability", "actual_attrition", "employee_id", "base_salary"
NET = "(attrition_probability * 0.25 * base_salary - 2500)"


# ---- economics ------------------------------------------------------------------------------------


@query(
    "c1_expected_value",
    "scored",
    f"""SELECT employee_id, ROUND(base_salary, 4) AS replacement_cost_usd, ROUND(attrition_probability * 0.25 * base_salary, 4) AS predicted_avoidable_cost_usd,
    ROUND({NET}, 4) AS predicted_net_value_usd FROM scored""",
)
def _(t: Tables):
    out = policy.with_economics(t["scored"], P, S)
    return round_all(out.select(ID, "replacement_cost_usd", "predicted_avoidable_cost_usd", "predicted_net_value_usd"), 4)


@query(
    "c2_salary_summary",
    "scored",
    """SELECT department_name, COUNT(*) AS rows, ROUND(AVG(base_salary), 4) AS mean_salary, ROUND(quantile_cont(base_salary, 0.5), 4) AS median_salary,
    ROUND(AVG(base_salary) * 1.5, 4) AS mean_replacement_cost, ROUND(quantile_cont(base_salary, 0.5) * 1.5, 4) AS median_replacement_cost
    FROM scored GROUP BY department_name""",
)
def _(t: Tables):
    return round_all(policy.salary_summary(t["scored"], ["department_name"], S, 1.5), 4)


def scenario_values() -> str:
    rows = ", ".join(
        f"('{s['scenario_id']}', '{s['replacement']}', '{s['intervention']}', '{s['effectiveness']}', {s['multiplier']}::DOUBLE, {s['cost']}::DOUBLE, "
        f"{s['success']}::DOUBLE, {s['vacancy_days']}::DOUBLE, {s['productivity_days']}::DOUBLE, {s['training_hours']}::DOUBLE, {s['coverage_hours']}::DOUBLE)"
        for s in policy.scenarios()
    )
    return f"(VALUES {rows}) sc(scenario_id, r, i, e, m, c, s, vacancy_days, time_to_productivity_days, training_hours_per_replacement, coverage_hours_per_replacement)"


@query(
    "u2_scenario_cross_product",
    "scored",
    f"""SELECT period, scenario_id, r AS replacement_impact_scenario, i AS intervention_cost_scenario, e AS effectiveness_scenario,
    COUNT(*) AS population_rows, ROUND(AVG(base_salary), 4) AS average_base_salary, ROUND(quantile_cont(base_salary, 0.5), 4) AS median_base_salary,
    ROUND(AVG(base_salary * m), 4) AS average_replacement_cost_usd, ROUND(quantile_cont(base_salary * m, 0.5), 4) AS median_replacement_cost_usd,
    ROUND(AVG(base_salary * m * s), 4) AS average_maximum_avoidable_cost_usd, ROUND(quantile_cont(base_salary * m * s, 0.5), 4) AS median_maximum_avoidable_cost_usd,
    ROUND(AVG(c / (base_salary * m * s)), 4) AS average_break_even_attrition_probability,
    ROUND(quantile_cont(c / (base_salary * m * s), 0.5), 4) AS median_break_even_attrition_probability,
    ROUND(COUNT(*) FILTER (WHERE c / (base_salary * m * s) <= 1) / COUNT(*)::DOUBLE, 4) AS share_break_even_at_or_below_100_percent,
    vacancy_days, time_to_productivity_days, training_hours_per_replacement, coverage_hours_per_replacement
    FROM scored, {scenario_values()} GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(policy.scenario_table(t["scored"], "period", S), 4)


PREFIX_SQL = f"""px AS (SELECT period, attrition_probability AS p, ROW_NUMBER() OVER w AS n, SUM({NET}) OVER (PARTITION BY period ORDER BY attrition_probability DESC, employee_id ROWS UNBOUNDED PRECEDING) AS total
    FROM scored WINDOW w AS (PARTITION BY period ORDER BY attrition_probability DESC, employee_id)),
    bp AS (SELECT * FROM px QUALIFY ROW_NUMBER() OVER (PARTITION BY period ORDER BY total DESC, n) = 1)"""


@query(
    "c3_cost_optimal_threshold",
    "scored",
    f"""WITH {PREFIX_SQL}, gs AS (SELECT period, COUNT(*) AS population_rows FROM scored GROUP BY period)
    SELECT period, population_rows, CASE WHEN total > 0 THEN p ELSE 1 END AS probability_threshold, CASE WHEN total > 0 THEN n ELSE 0 END AS selected_count,
    ROUND(CASE WHEN total > 0 THEN total ELSE 0 END, 2) AS best_net_value_usd FROM gs JOIN bp USING (period)""",
)
def _(t: Tables):
    net = t["scored"].withColumn("net", policy.expected_net(F.col(P), F.col(S)))
    out = policy.cost_threshold(net, P, ID, "net", ["period"])
    return out.withColumn("best_net_value_usd", F.round("best_net_value_usd", 2))


# Frozen rules and limits for the test tables.
FROZEN = {
    "multiplier": 1.0, "success": 0.25, "cost": 2500.0, "fixed_threshold": 0.50, "cost_optimal_threshold": 0.35,
    "fraction": 0.10, "count": 700, "maximum": 700, "budget": 1_250_000.0,
}
RANKS_SQL = f"""rk AS (SELECT *, {NET} AS net, ROW_NUMBER() OVER (PARTITION BY period ORDER BY attrition_probability DESC, employee_id) AS rp,
    ROW_NUMBER() OVER (PARTITION BY period ORDER BY {NET} DESC, employee_id) AS rn, COUNT(*) OVER (PARTITION BY period) AS n FROM scored)"""
FLAG_SQL = {
    "no_intervention": "false",
    "fixed_threshold": "attrition_probability >= 0.5",
    "cost_optimal_threshold": "attrition_probability >= 0.35",
    "top_fraction": "rp <= CEIL(n * 0.1)",
    "top_count": "rp <= 700",
    "budget_expected_value": "rn <= 500 AND net > 0",
}


def flagged(t: Tables):
    return policy.policy_flags(t["scored"], P, S, ID, FROZEN, ["period"])


@query(
    "c4_policy_flags",
    "scored",
    f"WITH {RANKS_SQL} SELECT employee_id, period, {', '.join(f'{c} AS {n}' for n, c in FLAG_SQL.items())} FROM rk",
)
def _(t: Tables):
    return flagged(t).select(ID, "period", *policy.POLICIES)


@query(
    "c5_budget_selection",
    "scored",
    f"WITH {RANKS_SQL} SELECT employee_id, period, ROUND(net, 4) AS net FROM rk WHERE rn <= 700 AND net > 0",
)
def _(t: Tables):
    net = t["scored"].withColumn("net", policy.expected_net(F.col(P), F.col(S)))
    return round_all(policy.select_within(net, "net", ID, "chosen", ["period"]).where("chosen").select(ID, "period", "net"), 4)


def policy_figures_sql(m: str = "1", s: str = "0.25", c: str = "2500", extra: str = "", source: str = "fl", group: str = "period, policy_key") -> str:
    spend = f"COUNT(*) FILTER (WHERE sel) * {c}"
    avoided = f"COALESCE(SUM(attrition_probability * {s} * base_salary * {m}) FILTER (WHERE sel), 0)"
    outcome = f"COALESCE(SUM(actual_attrition * {s} * base_salary * {m}) FILTER (WHERE sel), 0)"
    hits, n, pos = "COUNT(*) FILTER (WHERE sel AND actual_attrition = 1)", "COUNT(*) FILTER (WHERE sel)", "SUM(actual_attrition)"
    precision = f"COALESCE({hits} / NULLIF({n}, 0)::DOUBLE, 0)"
    return f"""SELECT {group}, {extra} COUNT(*) AS population_rows, CAST({pos} AS BIGINT) AS positive_cases, ROUND(AVG(actual_attrition), 4) AS observed_attrition_rate,
    {n} AS selected_count, ROUND({n} / COUNT(*)::DOUBLE, 4) AS selection_rate, {hits} AS selected_positive_cases, ROUND({precision}, 4) AS precision,
    ROUND({hits} / {pos}::DOUBLE, 4) AS capture_rate, ROUND({precision} / AVG(actual_attrition), 4) AS lift, ROUND(({spend})::DOUBLE, 4) AS intervention_spend_usd,
    ROUND(COALESCE(SUM(attrition_probability * {s}) FILTER (WHERE sel), 0), 4) AS expected_prevented_departures,
    ROUND({avoided}, 4) AS expected_avoided_replacement_cost_usd, ROUND({avoided} - {spend}, 4) AS expected_net_value_usd,
    ROUND(({avoided} - {spend}) / NULLIF({spend}, 0)::DOUBLE, 4) AS expected_roi, ROUND({hits} * {s}::DOUBLE, 4) AS outcome_aligned_expected_preventions,
    ROUND({outcome}, 4) AS outcome_aligned_avoided_replacement_cost_usd, ROUND({outcome} - {spend}, 4) AS outcome_aligned_net_value_usd,
    ROUND(({outcome} - {spend}) / NULLIF({spend}, 0)::DOUBLE, 4) AS outcome_aligned_roi,
    ROUND(AVG(attrition_probability) FILTER (WHERE sel), 4) AS average_selected_probability, ROUND(AVG(base_salary) FILTER (WHERE sel), 4) AS average_selected_salary
    FROM {source} GROUP BY ALL"""


LONG_FLAGS_SQL = "fl AS (" + " UNION ALL ".join(
    f"SELECT period, '{n}' AS policy_key, ({c}) AS sel, attrition_probability, base_salary, actual_attrition FROM rk" for n, c in FLAG_SQL.items()
) + ")"


@query("c6_policy_comparison", "scored", f"WITH {RANKS_SQL}, {LONG_FLAGS_SQL} {policy_figures_sql()}")
def _(t: Tables):
    return round_all(policy.policy_comparison(flagged(t), ["period"], P, S, Y), 4)


@query(
    "c7_policy_sensitivity",
    "scored",
    f"WITH {RANKS_SQL}, {LONG_FLAGS_SQL}, fx AS (SELECT * FROM fl, {scenario_values()}) "
    + policy_figures_sql(
        "m", "s", "c", "m AS replacement_cost_salary_multiplier, c AS intervention_cost_usd, s AS success_probability,", "fx", "period, policy_key, scenario_id"
    ).replace("COUNT(*) FILTER (WHERE sel) * c", "ANY_VALUE(c) * COUNT(*) FILTER (WHERE sel)").replace(
        "COUNT(*) FILTER (WHERE sel AND actual_attrition = 1) * s::DOUBLE", "COUNT(*) FILTER (WHERE sel AND actual_attrition = 1) * ANY_VALUE(s)"
    ),
)
def _(t: Tables):
    return round_all(policy.policy_sensitivity(flagged(t), ["period"], P, S, Y), 4)


TEST_BOOT = 500


@query(
    "c7_policy_bootstrap",
    "scored",
    f"""WITH {RANKS_SQL}, q AS (SELECT employee_id, actual_attrition AS y, attrition_probability AS p, base_salary AS s, ({FLAG_SQL['budget_expected_value']}) AS sel,
      ROW_NUMBER() OVER (PARTITION BY actual_attrition ORDER BY employee_id) AS slot, COUNT(*) OVER (PARTITION BY actual_attrition) AS m FROM rk WHERE period = 'test'),
    dr AS (SELECT iteration, y, {draw_sql("'42'", 'iteration', 'y', 'slot')} % m + 1 AS slot FROM q, (SELECT CAST(unnest(range(1, {TEST_BOOT + 1})) AS INT) AS iteration))
    SELECT iteration, COUNT(*) FILTER (WHERE sel) AS selected_count, COUNT(*) FILTER (WHERE sel AND q.y = 1) AS selected_positive_cases,
    ROUND(COUNT(*) FILTER (WHERE sel AND q.y = 1) / SUM(q.y)::DOUBLE, 4) AS capture_rate,
    ROUND(COALESCE(SUM(p * s * 0.25) FILTER (WHERE sel), 0) - 2500 * COUNT(*) FILTER (WHERE sel), 2) AS expected_net_value_usd,
    ROUND(COALESCE(SUM(q.y * s * 0.25) FILTER (WHERE sel), 0) - 2500 * COUNT(*) FILTER (WHERE sel), 2) AS outcome_aligned_net_value_usd
    FROM dr JOIN q ON q.y = dr.y AND q.slot = dr.slot GROUP BY iteration""",
)
def _(t: Tables):
    test = settle(flagged(t).where(F.col("period") == "test").select(ID, Y, P, S, "budget_expected_value"))
    out = policy.policy_bootstrap(test, ID, TEST_BOOT, 42, "budget_expected_value", P, S, Y)
    return out.withColumn("capture_rate", F.round("capture_rate", 4)).withColumn(
        "expected_net_value_usd", F.round("expected_net_value_usd", 2)
    ).withColumn("outcome_aligned_net_value_usd", F.round("outcome_aligned_net_value_usd", 2))


ALT_SQL = f"""th AS (SELECT quantile_cont(base_salary, 0.75) AS cap, quantile_cont(base_salary, 0.5) AS flat FROM scored WHERE period = 'validation'),
    sc AS (SELECT scored.*, {NET} AS s0, attrition_probability AS s1, attrition_probability * 0.25 * LEAST(base_salary, cap) - 2500 AS s2,
      attrition_probability * 0.25 * flat - 2500 AS s3 FROM scored, th),
    rr AS (SELECT *, {', '.join(f"ROW_NUMBER() OVER (PARTITION BY period ORDER BY s{i} DESC, employee_id) <= 700 {'' if i == 1 else f'AND s{i} > 0'} AS f{i}" for i in range(4))} FROM sc)"""


def alternatives(t: Tables):
    thresholds = policy.frozen_thresholds(t["scored"].where(F.col("period") == "validation"), S)
    return policy.alternative_selections(t["scored"], thresholds, P, S, ID, ["period"])


@query(
    "c8_alternative_policies",
    "scored",
    f"WITH {ALT_SQL}, lg AS ("
    + " UNION ALL ".join(f"SELECT rr.*, '{n}' AS policy_key, f{i} AS sel FROM rr" for i, n in enumerate(policy.ALTERNATIVES))
    + """) SELECT period, policy_key, COUNT(*) AS population_rows, COUNT(*) FILTER (WHERE sel) AS selected_count,
    ROUND(COUNT(*) FILTER (WHERE sel) / COUNT(*)::DOUBLE, 4) AS selection_rate, ROUND(AVG(base_salary), 4) AS population_mean_salary_usd,
    ROUND(AVG(base_salary) FILTER (WHERE sel), 4) AS selected_mean_salary_usd, ROUND(quantile_cont(base_salary, 0.5) FILTER (WHERE sel), 4) AS selected_median_salary_usd,
    ROUND(AVG(base_salary) FILTER (WHERE sel) / AVG(base_salary), 4) AS selected_to_population_mean_salary_ratio,
    ROUND(AVG(attrition_probability) FILTER (WHERE sel), 4) AS selected_mean_probability,
    ROUND(COALESCE(SUM(s0) FILTER (WHERE sel), 0), 4) AS predicted_net_value_under_original_economics_usd,
    COUNT(*) FILTER (WHERE sel AND f0) AS overlap_with_frozen_policy,
    ROUND(COUNT(*) FILTER (WHERE sel AND f0) / COUNT(*) FILTER (WHERE sel OR f0)::DOUBLE, 4) AS jaccard_with_frozen_policy FROM lg GROUP BY period, policy_key""",
)
def _(t: Tables):
    return round_all(policy.alternative_comparison(settle(alternatives(t)), ["period"], P, S), 4)


PLAN_SQL = f"""pl AS (SELECT *, rn <= 500 AND net > 0 AS sel FROM rk),
    pc AS (SELECT *, CASE WHEN sel THEN attrition_probability * 0.25 ELSE 0 END AS prevented, attrition_probability * base_salary AS exposure,
      CASE WHEN sel THEN attrition_probability * 0.25 * base_salary ELSE 0 END AS avoided, CASE WHEN sel THEN 2500.0::DOUBLE ELSE 0 END AS spend FROM pl)"""


def planned(t: Tables):
    base = policy.with_economics(flagged(t), P, S)
    return policy.planning_columns(base, P, "budget_expected_value")


@query(
    "c9_planning_columns",
    "scored",
    f"""WITH {RANKS_SQL}, {PLAN_SQL} SELECT employee_id, ROUND(prevented, 6) AS expected_prevented_departure_contribution,
    ROUND(attrition_probability - prevented, 6) AS residual_backfill_contribution, ROUND(exposure, 4) AS replacement_cost_exposure_usd,
    ROUND(avoided - spend, 4) AS planned_net_value_usd, ROUND((attrition_probability - prevented) * 60, 4) AS residual_vacancy_days,
    ROUND((attrition_probability - prevented) * 180, 4) AS residual_coverage_hours FROM pc""",
)
def _(t: Tables):
    return planned(t).select(
        ID,
        F.round("expected_prevented_departure_contribution", 6).alias("expected_prevented_departure_contribution"),
        F.round("residual_backfill_contribution", 6).alias("residual_backfill_contribution"),
        F.round("replacement_cost_exposure_usd", 4).alias("replacement_cost_exposure_usd"),
        F.round("planned_net_value_usd", 4).alias("planned_net_value_usd"),
        F.round("residual_vacancy_days", 4).alias("residual_vacancy_days"),
        F.round("residual_coverage_hours", 4).alias("residual_coverage_hours"),
    )


@query(
    "c10_planning_rollup",
    "scored",
    f"""WITH {RANKS_SQL}, {PLAN_SQL}, ac AS (SELECT 'D' || CAST(user_id % 7 AS VARCHAR) AS department_name, COUNT(*) AS active_workforce_employees FROM events GROUP BY 1)
    SELECT department_name, COUNT(*) AS model_eligible_employees, COUNT(*) FILTER (WHERE sel) AS selected_for_human_review,
    ROUND(SUM(attrition_probability), 4) AS expected_departures_12m, ROUND(SUM(prevented), 4) AS expected_prevented_departures,
    ROUND(SUM(attrition_probability - prevented), 4) AS residual_expected_backfills, ROUND(SUM(exposure), 4) AS replacement_cost_exposure_usd,
    ROUND(SUM(avoided), 4) AS planned_avoided_cost_usd, ROUND(SUM(spend), 4) AS planned_intervention_spend_usd, ROUND(SUM(avoided - spend), 4) AS planned_net_value_usd,
    ROUND(SUM(exposure - avoided), 4) AS residual_replacement_cost_exposure_usd, ROUND(SUM((attrition_probability - prevented) * 60), 4) AS residual_vacancy_days,
    ROUND(SUM((attrition_probability - prevented) * 90), 4) AS residual_time_to_productivity_days, ROUND(SUM((attrition_probability - prevented) * 80), 4) AS residual_training_hours,
    ROUND(SUM((attrition_probability - prevented) * 180), 4) AS residual_coverage_hours, ANY_VALUE(active_workforce_employees) AS active_workforce_employees,
    ANY_VALUE(active_workforce_employees) - COUNT(*) AS protected_active_employees, ROUND(SUM(attrition_probability) / COUNT(*), 4) AS expected_departure_rate,
    ROUND(COUNT(*) FILTER (WHERE sel) / COUNT(*)::DOUBLE, 4) AS selection_rate, ROUND(COALESCE(SUM(prevented) / NULLIF(SUM(attrition_probability), 0), 0), 4) AS intervention_offset_rate
    FROM pc JOIN ac USING (department_name) WHERE period = 'test' GROUP BY department_name""",
)
def _(t: Tables):
    active = t["scored"].groupBy("department_name").agg(F.count(F.lit(1)).alias("active_workforce_employees"))
    plan = policy.planning_rollup(
        planned(t).where(F.col("period") == "test"), ["department_name"], "budget_expected_value", active
    )
    return round_all(plan, 4)


@query(
    "c11_score_reconciliation",
    "scored",
    """WITH l AS (SELECT * FROM scored WHERE period <> 'train'), r AS (SELECT employee_id, department_name, CASE WHEN employee_id % 10 = 0 THEN 'Other' ELSE region END AS region,
      CASE WHEN employee_id % 7 = 0 THEN base_salary + 1 ELSE base_salary END AS base_salary, period FROM scored WHERE period <> 'test'),
    j AS (SELECT l.employee_id AS a, r.employee_id AS b, l.department_name AS ld, r.department_name AS rd, l.region AS lr, r.region AS rr, l.base_salary AS ls, r.base_salary AS rs, r.period AS d
      FROM l FULL JOIN r ON l.employee_id = r.employee_id)
    SELECT COUNT(*) FILTER (WHERE b IS NULL) AS missing_scores, COUNT(*) FILTER (WHERE a IS NULL) AS unexpected_scores,
    COUNT(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND ld IS DISTINCT FROM rd) AS department_name_mismatches,
    COUNT(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND lr IS DISTINCT FROM rr) AS region_mismatches,
    COUNT(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND ABS(ls - rs) > 1e-6) AS salary_mismatches, COUNT(DISTINCT d) AS as_of_dates FROM j""",
)
def _(t: Tables):
    people = t["scored"].where(F.col("period") != "train")
    scores = (
        t["scored"]
        .where(F.col("period") != "test")
        .withColumn("region", F.when(F.col(ID) % 10 == 0, "Other").otherwise(F.col("region")))
        .withColumn(S, F.when(F.col(ID) % 7 == 0, F.col(S) + 1).otherwise(F.col(S)))
    )
    return policy.reconcile_scores(people, scores, ID, ["department_name", "region"], S, "period")


@query("c12_policy_digest", "scored")
def _(t: Tables):
    net = t["scored"].withColumn("net", policy.expected_net(F.col(P), F.col(S)))
    rules = policy.cost_threshold(net, P, ID, "net", ["period"]).drop("population_rows")
    return policy.policy_digest(round_all(rules, 2))


# ---- subgroup metrics ---------------------------------------------------------------------------

ATTRIBUTES = ["department_name", "region", "employment_type", "job_level", "age_band"]
AGE_SQL = """CASE WHEN 2024 - birth_year < 30 THEN 'Under 30' WHEN 2024 - birth_year < 40 THEN '30-39' WHEN 2024 - birth_year < 50 THEN '40-49'
    WHEN 2024 - birth_year < 60 THEN '50-59' WHEN birth_year IS NOT NULL THEN '60+' END"""
GROUPED_SQL = f"""gr AS (SELECT *, {AGE_SQL} AS age_band, ROW_NUMBER() OVER (ORDER BY attrition_probability DESC, employee_id) <= CEIL(COUNT(*) OVER () * 0.1) AS sel,
      ROW_NUMBER() OVER (ORDER BY {NET} DESC, employee_id) <= 700 AND {NET} > 0 AS deployed, {NET} AS net FROM scored)"""


def melted_sql(source: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, COALESCE(CAST({a} AS VARCHAR), 'Missing') AS "group", {columns} FROM {source}""" for a in ATTRIBUTES
    )


def with_flags(t: Tables):
    people = t["scored"].withColumn("age_band", fairness.age_band(F.lit(2024) - F.col("birth_year")))
    people = policy.with_economics(people, P, S)
    people = flag_top_fraction(people, [Key(P, True), Key(ID)], 0.10, out="sel")
    return policy.select_within(people, "predicted_net_value_usd", ID, "deployed")


def wilson_sql(k: str, n: str, name: str) -> str:
    z = x.normal_z(0.95)
    p, nn = f"({k} / NULLIF({n}, 0)::DOUBLE)", f"NULLIF({n}, 0)::DOUBLE"
    centre = f"({p} + {z * z} / (2 * {nn})) / (1 + {z * z} / {nn})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {nn} + {z * z} / (4 * {nn} * {nn})) / (1 + {z * z} / {nn})"
    low = f"CASE WHEN {n} > 0 THEN GREATEST(0, LEAST(1, {centre} - {half})) END"
    high = f"CASE WHEN {n} > 0 THEN GREATEST(0, LEAST(1, {centre} + {half})) END"
    return f"ROUND({low}, 6) AS {name}_lower_95, ROUND({high}, 6) AS {name}_upper_95"


@query(
    "e1_wilson_interval",
    "scored",
    f"""WITH g AS (SELECT department_name, COUNT(*) AS n, SUM(actual_attrition) AS k FROM scored GROUP BY department_name)
    SELECT department_name, {wilson_sql('k', 'n', 'rate')} FROM g""",
)
def _(t: Tables):
    grouped = t["scored"].groupBy("department_name").agg(F.count(F.lit(1)).alias("n"), F.sum(Y).alias("k"))
    low, high = x.wilson(F.col("k"), F.col("n"))
    return round_all(grouped.select("department_name", low.alias("rate_lower_95"), high.alias("rate_upper_95")))


def group_metrics_sql(flag: str, means: str = "", selected: int = 10) -> str:
    """CTEs ending in ``gm``: the subgroup table for a flag column of ``gr``."""
    return f"""{GROUPED_SQL}, ml AS ({melted_sql('gr', f'attrition_probability AS p, actual_attrition AS y, {flag} AS sel, base_salary, net')}),
    ct AS (SELECT attribute, "group", COUNT(*) AS sample_size, COUNT(*) FILTER (WHERE y = 1) AS positive_cases, COUNT(*) FILTER (WHERE y = 0) AS negative_cases,
      AVG(y) AS observed_attrition_rate, AVG(p) AS mean_predicted_probability, AVG(pow(p - y, 2)) AS brier_score, COUNT(*) FILTER (WHERE sel) AS selected_count,
      COUNT(*) FILTER (WHERE sel AND y = 1) AS true_positive, COUNT(*) FILTER (WHERE sel AND y = 0) AS false_positive,
      COUNT(*) FILTER (WHERE NOT sel AND y = 1) AS false_negative, COUNT(*) FILTER (WHERE NOT sel AND y = 0) AS true_negative {means} FROM ml GROUP BY ALL),
    st AS (SELECT attribute, "group", p, SUM(y) AS pos, SUM(1 - y) AS neg FROM ml GROUP BY ALL),
    cu AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn FROM st WINDOW w AS (PARTITION BY attribute, "group" ORDER BY p DESC)),
    rm AS (SELECT attribute, "group", SUM(neg * (cp - pos / 2.0::DOUBLE)) / NULLIF(SUM(pos)::DOUBLE * SUM(neg), 0) AS roc_auc,
      SUM(pos * cp / (cp + cn)::DOUBLE) / NULLIF(SUM(pos), 0)::DOUBLE AS pr_auc FROM cu GROUP BY ALL),
    gm AS (SELECT ct.*, roc_auc, pr_auc, mean_predicted_probability - observed_attrition_rate AS calibration_gap,
      ABS(mean_predicted_probability - observed_attrition_rate) AS absolute_calibration_gap, selected_count / sample_size::DOUBLE AS selection_rate,
      true_positive / NULLIF(selected_count, 0)::DOUBLE AS precision, true_positive / NULLIF(positive_cases, 0)::DOUBLE AS true_positive_rate,
      false_positive / NULLIF(negative_cases, 0)::DOUBLE AS false_positive_rate,
      sample_size >= 100 AND positive_cases >= 20 AND negative_cases >= 50 AND selected_count >= {selected} AS eligible_for_disparity_comparison
      FROM ct JOIN rm USING (attribute, "group"))"""


GROUP_OUT = (
    """SELECT attribute, "group", sample_size, positive_cases, negative_cases, selected_count, true_positive, false_positive, false_negative, true_negative,
    eligible_for_disparity_comparison, """
    + ", ".join(
        f"ROUND({c}, 6) AS {c}"
        for c in "observed_attrition_rate mean_predicted_probability brier_score roc_auc pr_auc calibration_gap absolute_calibration_gap selection_rate precision true_positive_rate false_positive_rate".split()
    )
    + ", "
    + ", ".join(
        wilson_sql(*a)
        for a in [
            ("selected_count", "sample_size", "selection_rate"),
            ("true_positive", "selected_count", "precision"),
            ("true_positive", "positive_cases", "true_positive_rate"),
            ("false_positive", "negative_cases", "false_positive_rate"),
        ]
    )
)


@query("e2_subgroup_metrics", "scored", f"WITH {group_metrics_sql('sel')} {GROUP_OUT} FROM gm")
def _(t: Tables):
    return round_all(fairness.group_metrics(settle(with_flags(t)), ATTRIBUTES, P, Y, "sel"))


def extreme_sql(c: str, highest: bool) -> str:
    return f"""COALESCE(arg_min("group", ({'-' if highest else ''}{c}, "group")) FILTER (WHERE ok AND {c} IS NOT NULL), '')"""


def disparity_sql(cte: str, having: str = "") -> str:
    top, low = (lambda c: f"MAX({c}) FILTER (WHERE ok)"), (lambda c: f"MIN({c}) FILTER (WHERE ok)")
    spread = lambda c: f"({top(c)} - {low(c)})"
    return f"""WITH {cte}, ok AS (SELECT *, eligible_for_disparity_comparison AS ok FROM gm)
    SELECT attribute, COUNT(*) FILTER (WHERE ok) AS eligible_groups, COUNT(*) AS total_groups, ROUND({spread('selection_rate')}, 6) AS demographic_parity_difference,
    ROUND({low('selection_rate')} / NULLIF({top('selection_rate')}, 0), 6) AS selection_rate_ratio, {extreme_sql('selection_rate', False)} AS lowest_selection_group,
    {extreme_sql('selection_rate', True)} AS highest_selection_group, ROUND({spread('true_positive_rate')}, 6) AS equal_opportunity_difference,
    {extreme_sql('true_positive_rate', False)} AS lowest_recall_group, {extreme_sql('true_positive_rate', True)} AS highest_recall_group,
    ROUND({spread('false_positive_rate')}, 6) AS false_positive_rate_difference, {extreme_sql('false_positive_rate', False)} AS lowest_fpr_group,
    {extreme_sql('false_positive_rate', True)} AS highest_fpr_group, ROUND({spread('precision')}, 6) AS precision_difference,
    ROUND({spread('calibration_gap')}, 6) AS calibration_gap_range, ROUND({top('absolute_calibration_gap')}, 6) AS maximum_absolute_calibration_gap,
    ROUND(GREATEST({spread('true_positive_rate')}, {spread('false_positive_rate')}), 6) AS equalized_odds_max_difference,
    COALESCE({spread('selection_rate')} > 0.1, false) AS review_demographic_parity_difference, COALESCE({spread('true_positive_rate')} > 0.1, false) AS review_equal_opportunity_difference,
    COALESCE({spread('false_positive_rate')} > 0.1, false) AS review_false_positive_rate_difference,
    COALESCE({top('absolute_calibration_gap')} > 0.05, false) AS review_maximum_absolute_calibration_gap FROM ok GROUP BY attribute {having}"""


@query("e3_disparity_summary", "scored", disparity_sql(group_metrics_sql("sel")))
def _(t: Tables):
    return round_all(fairness.disparities(fairness.group_metrics(settle(with_flags(t)), ATTRIBUTES, P, Y, "sel")))


DEPLOYED_MEANS = {"mean_salary": S, "mean_net_value": "predicted_net_value_usd"}
DEPLOYED_LIMITS = {**fairness.ELIGIBILITY, "selected": 5}


@query(
    "e4_deployed_rule_metrics",
    "scored",
    f"WITH {group_metrics_sql('deployed', ', AVG(base_salary) AS mean_salary, AVG(net) AS mean_net_value', 5)} {GROUP_OUT}, ROUND(mean_salary, 6) AS mean_salary, ROUND(mean_net_value, 6) AS mean_net_value FROM gm",
)
def _(t: Tables):
    return round_all(
        fairness.group_metrics(settle(with_flags(t)), ATTRIBUTES, P, Y, "deployed", eligibility=DEPLOYED_LIMITS, means=DEPLOYED_MEANS)
    )


@query(
    "e5_rule_vs_proxy",
    "scored",
    f"""WITH {GROUPED_SQL}, ml AS ({melted_sql('gr', 'sel, deployed')}) SELECT attribute, "group", COUNT(*) AS sample_size,
    COUNT(*) FILTER (WHERE deployed) AS deployed_selected_count, ROUND(COUNT(*) FILTER (WHERE deployed) / COUNT(*)::DOUBLE, 6) AS deployed_selection_rate,
    COUNT(*) FILTER (WHERE sel) AS probability_proxy_selected_count, ROUND(COUNT(*) FILTER (WHERE sel) / COUNT(*)::DOUBLE, 6) AS probability_proxy_selection_rate,
    ROUND(COUNT(*) FILTER (WHERE deployed) / COUNT(*)::DOUBLE - COUNT(*) FILTER (WHERE sel) / COUNT(*)::DOUBLE, 6) AS selection_rate_difference_deployed_minus_proxy,
    COUNT(*) FILTER (WHERE deployed AND sel) AS selection_overlap_count FROM ml GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(fairness.rule_comparison(with_flags(t), ATTRIBUTES, "deployed", "sel"))


@query("e6_deployed_rule_disparity", "scored", disparity_sql(group_metrics_sql("deployed", "", 5), "HAVING COUNT(*) FILTER (WHERE ok) >= 2"))
def _(t: Tables):
    table = fairness.group_metrics(settle(with_flags(t)), ATTRIBUTES, P, Y, "deployed", eligibility=DEPLOYED_LIMITS)
    return round_all(fairness.disparities(table, minimum_groups=2))


@query(
    "e7_rule_overview",
    "scored",
    f"WITH {GROUPED_SQL}, o AS (SELECT COUNT(*) FILTER (WHERE sel AND deployed) AS b, COUNT(*) FILTER (WHERE sel OR deployed) AS u FROM gr) "
    + " UNION ALL ".join(
        f"""SELECT '{label}' AS selection_rule, COUNT(*) FILTER (WHERE {f}) AS selected_count, ROUND(COUNT(*) FILTER (WHERE {f}) / COUNT(*)::DOUBLE, 4) AS selection_rate,
        COUNT(*) FILTER (WHERE {f} AND actual_attrition = 1) AS selected_positive_cases, ROUND(COUNT(*) FILTER (WHERE {f} AND actual_attrition = 1) / COUNT(*) FILTER (WHERE {f})::DOUBLE, 4) AS precision,
        ROUND(COUNT(*) FILTER (WHERE {f} AND actual_attrition = 1) / SUM(actual_attrition)::DOUBLE, 4) AS capture_rate, ROUND(AVG(attrition_probability) FILTER (WHERE {f}), 4) AS mean_selected_probability,
        ROUND(AVG(base_salary) FILTER (WHERE {f}), 4) AS mean_selected_salary_usd, ROUND(SUM(net) FILTER (WHERE {f}), 4) AS predicted_net_value_usd,
        ANY_VALUE(b) AS cross_rule_overlap_count, ROUND(ANY_VALUE(b) / ANY_VALUE(u)::DOUBLE, 4) AS cross_rule_jaccard FROM gr, o"""
        for label, f in (("Expected value", "deployed"), ("Probability top 10%", "sel"))
    ),
)
def _(t: Tables):
    rules = {"Expected value": "deployed", "Probability top 10%": "sel"}
    return round_all(fairness.rule_overview(settle(with_flags(t)), rules, P, Y, S, "predicted_net_value_usd"), 4)


VARIANT_METRICS = ["pr_auc", "roc_auc", "brier_score", "precision_at_k"]


@query(
    "e8_variant_comparison",
    "scored",
    """WITH v AS (SELECT 'baseline' AS model_variant, employee_id, attrition_probability AS p, actual_attrition AS y FROM scored
      UNION ALL SELECT 'reduced', employee_id, ROUND(attrition_probability, 1), actual_attrition FROM scored),
    st AS (SELECT model_variant, p, SUM(y) AS pos, SUM(1 - y) AS neg FROM v GROUP BY ALL),
    cu AS (SELECT *, SUM(pos) OVER w AS cp, SUM(neg) OVER w AS cn FROM st WINDOW w AS (PARTITION BY model_variant ORDER BY p DESC)),
    rm AS (SELECT model_variant, SUM(neg * (cp - pos / 2.0::DOUBLE)) / (SUM(pos)::DOUBLE * SUM(neg)) AS roc_auc, SUM(pos * cp / (cp + cn)::DOUBLE) / SUM(pos)::DOUBLE AS pr_auc FROM cu GROUP BY ALL),
    br AS (SELECT model_variant, AVG(pow(p - y, 2)) AS brier_score, AVG(y) FILTER (WHERE r <= CEIL(n * 0.1)) AS precision_at_k FROM
      (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_variant ORDER BY p DESC, employee_id) AS r, COUNT(*) OVER (PARTITION BY model_variant) AS n FROM v) GROUP BY ALL),
    l AS (SELECT model_variant, u.metric, u.value FROM rm JOIN br USING (model_variant), LATERAL (VALUES ('pr_auc', pr_auc), ('roc_auc', roc_auc), ('brier_score', brier_score), ('precision_at_k', precision_at_k)) u(metric, value))
    SELECT b.model_variant, b.metric, ROUND(a.value, 6) AS baseline_value, ROUND(b.value, 6) AS variant_value, ROUND(b.value - a.value, 6) AS difference
    FROM l a JOIN l b USING (metric) WHERE a.model_variant = 'baseline' AND b.model_variant = 'reduced'""",
)
def _(t: Tables):
    variants = F.array(
        F.struct(F.lit("baseline").alias("model_variant"), F.col(P).alias("score")),
        F.struct(F.lit("reduced").alias("model_variant"), F.round(P, 1).alias("score")),
    )
    long = t["scored"].select(ID, Y, F.explode(variants).alias("_v")).select(ID, Y, "_v.*")
    table = metrics.calibration_metrics(settle(long), "score", Y, ID, ["model_variant"])
    return round_all(fairness.variant_comparison(table, "model_variant", "baseline", VARIANT_METRICS))


# ---- allocation by salary -------------------------------------------------------------------------

QUINTILES_SQL = f"""{ALT_SQL}, qr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY period ORDER BY base_salary, employee_id) AS a, ROW_NUMBER() OVER (PARTITION BY period ORDER BY attrition_probability, employee_id) AS b,
      ROW_NUMBER() OVER (PARTITION BY period, job_level ORDER BY base_salary, employee_id) AS c, COUNT(*) OVER (PARTITION BY period) AS n, COUNT(*) OVER (PARTITION BY period, job_level) AS nl FROM rr),
    qq AS (SELECT *, CAST(GREATEST(1, CEIL((a - 1) * 5 / (n - 1)::DOUBLE)) AS INT) AS salary_quintile, CAST(GREATEST(1, CEIL((b - 1) * 5 / (n - 1)::DOUBLE)) AS INT) AS risk_quintile,
      CAST(GREATEST(1, CEIL((c - 1) * 5 / (nl - 1)::DOUBLE)) AS INT) AS within_quintile, CASE WHEN base_salary < 60000 THEN 'Under $60k' WHEN base_salary < 80000 THEN '$60k-$79,999'
      WHEN base_salary < 100000 THEN '$80k-$99,999' WHEN base_salary < 125000 THEN '$100k-$124,999' WHEN base_salary < 150000 THEN '$125k-$149,999' ELSE '$150k+' END AS band FROM qr)"""
FLAGS = [f"selected_{n}" for n in policy.ALTERNATIVES]


def allocated(t: Tables):
    return fairness.salary_groups(alternatives(t), S, P, ID, "job_level", ["period"], t["scored"])


@query(
    "e9_salary_band_selection",
    "scored",
    f"WITH {QUINTILES_SQL}, bl AS (SELECT *, 'absolute_salary_band' AS band_type, 'All job levels' AS segment, band AS salary_band FROM qq UNION ALL SELECT *, 'population_salary_quintile', 'All job levels', CAST(salary_quintile AS VARCHAR) FROM qq "
    + "UNION ALL SELECT *, 'within_job_level_salary_quintile', job_level, CAST(within_quintile AS VARCHAR) FROM qq) "
    + " UNION ALL ".join(
        f"""SELECT period, band_type, segment, salary_band, COUNT(*) AS employees, ROUND(AVG(base_salary), 4) AS mean_salary_usd, ROUND(AVG(attrition_probability), 4) AS mean_probability,
        '{f}' AS policy_key, COUNT(*) FILTER (WHERE f{i}) AS selected_count, ROUND(COUNT(*) FILTER (WHERE f{i}) / COUNT(*)::DOUBLE, 4) AS selection_rate FROM bl GROUP BY ALL"""
        for i, f in enumerate(FLAGS)
    ),
)
def _(t: Tables):
    return round_all(fairness.band_selection(allocated(t), FLAGS, S, P, "job_level", "period"), 4)


@query(
    "e10_risk_by_salary",
    "scored",
    f"""WITH {QUINTILES_SQL} SELECT period, risk_quintile, salary_quintile, COUNT(*) AS employees, ROUND(AVG(attrition_probability), 4) AS mean_probability,
    ROUND(AVG(base_salary), 4) AS mean_salary_usd, COUNT(*) FILTER (WHERE f0) AS selected_count, ROUND(AVG(f0::INT), 4) AS selection_rate FROM qq GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(fairness.risk_by_salary(allocated(t), FLAGS[0], S, P, "period"), 4)


@query(
    "e11_department_allocation",
    "scored",
    f"""WITH {ALT_SQL} SELECT period, department_name, COUNT(*) AS eligible_employees, COUNT(*) FILTER (WHERE f0) AS selected_employees, ROUND(AVG(f0::INT), 4) AS selection_rate,
    ROUND(AVG(base_salary), 4) AS population_mean_salary_usd, ROUND(AVG(base_salary) FILTER (WHERE f0), 4) AS selected_mean_salary_usd,
    ROUND(AVG(base_salary) FILTER (WHERE f0) - AVG(base_salary), 4) AS selected_salary_difference_usd, ROUND(AVG(attrition_probability), 4) AS mean_probability FROM rr GROUP BY ALL""",
)
def _(t: Tables):
    return round_all(fairness.department_allocation(alternatives(t), "department_name", FLAGS[0], S, P, "period"), 4)


RATE = "AVG(f0::INT) FILTER (WHERE salary_quintile = {q} {r})"


@query(
    "e12_allocation_headline",
    "scored",
    f"""WITH {QUINTILES_SQL}, a AS (SELECT period, COUNT(*) AS population_rows, COUNT(*) FILTER (WHERE f0) AS selected_count, AVG(base_salary) AS pm, AVG(base_salary) FILTER (WHERE f0) AS sm,
      {RATE.format(q=1, r='')} AS lo, {RATE.format(q=5, r='')} AS hi, {RATE.format(q=5, r='AND risk_quintile = 5')} - {RATE.format(q=1, r='AND risk_quintile = 5')} AS gap,
      COUNT(*) FILTER (WHERE f0 AND f1) AS b, COUNT(*) FILTER (WHERE f0 AND NOT f1) AS o, COUNT(*) FILTER (WHERE f1 AND NOT f0) AS p,
      quantile_cont(base_salary, 0.5) AS pmed, quantile_cont(base_salary, 0.5) FILTER (WHERE f0) AS smed FROM qq GROUP BY period),
    g AS (SELECT *, sm / pm AS ratio, CASE WHEN lo > 0 THEN hi / lo ELSE 'inf'::DOUBLE END AS rates FROM a),
    w AS (SELECT *, concat_ws(', ', CASE WHEN ratio > 1.1 THEN 'selected_mean_salary' END, CASE WHEN rates > 2 THEN 'salary_quintile_selection' END, CASE WHEN gap > 0.1 THEN 'within_risk_salary_selection' END) AS tr FROM g)
    SELECT period, population_rows, selected_count, ROUND(pm, 4) AS population_mean_salary_usd, ROUND(sm, 4) AS selected_mean_salary_usd, ROUND(lo, 4) AS lowest_salary_quintile_selection_rate,
    ROUND(hi, 4) AS highest_salary_quintile_selection_rate, ROUND(gap, 4) AS highest_risk_quintile_salary_selection_gap, b AS overlap_with_probability_selection,
    o AS frozen_policy_only_selections, p AS probability_policy_only_selections, ROUND(pmed, 4) AS population_median_salary_usd, ROUND(smed, 4) AS selected_median_salary_usd,
    ROUND(ratio, 4) AS selected_to_population_mean_salary_ratio, CASE WHEN isinf(rates) THEN rates ELSE ROUND(rates, 4) END AS highest_to_lowest_selection_rate_ratio,
    tr <> '' AS review_flag, CASE WHEN tr = '' THEN 'None' ELSE tr END AS review_triggers FROM w""",
)
def _(t: Tables):
    rows = store(allocated(t).select("period", S, *FLAGS[:2], "salary_quintile", "risk_quintile"))
    out = fairness.allocation_headline(rows, FLAGS[0], FLAGS[1], S, "period")
    return _finite_rounding(out)


def _finite_rounding(out):
    """Round, but leave the infinite ratio of an empty lowest quintile alone."""
    name = "highest_to_lowest_selection_rate_ratio"
    finite = out.withColumn(name, F.when(F.col(name) < float("inf"), F.col(name)))
    return round_all(finite, 4).withColumn(name, F.coalesce(F.col(name), F.lit(float("inf"))))


@query(
    "e13_frozen_quantiles",
    "scored",
    """SELECT ROUND(quantile_cont(base_salary, 0.75), 4) AS salary_cap_usd, ROUND(quantile_cont(base_salary, 0.5), 4) AS constant_cost_usd
    FROM scored WHERE period = 'validation'""",
)
def _(t: Tables):
    return round_all(policy.frozen_thresholds(t["scored"].where(F.col("period") == "validation"), S), 4)

