"""Expected-value economics, selection under capacity and budget, scenario tables, planning rollups.

Costs are linear in a few sums, so scenario tables never multiply the population:
the sums are taken once and the scenarios are applied to the grouped rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import count_if, safe_div, zero_div
from stayline.operators.rank import Key, attach, best_prefix, exact_quantiles, group_size, ranked, top_count
from stayline.operators.resample import bootstrap_sums
from stayline.session import store

# The three families of cost assumptions.
REPLACEMENT = {
    "Low": {"salary_multiplier": 0.50, "vacancy_days": 30, "productivity_days": 60, "training_hours": 40, "coverage_per_day": 2},
    "Base": {"salary_multiplier": 1.00, "vacancy_days": 60, "productivity_days": 90, "training_hours": 80, "coverage_per_day": 3},
    "High": {"salary_multiplier": 1.50, "vacancy_days": 90, "productivity_days": 150, "training_hours": 120, "coverage_per_day": 4},
}
INTERVENTION_COST = {"Lean": 1000.0, "Standard": 2500.0, "Intensive": 5000.0}
EFFECTIVENESS = {"Conservative": 0.10, "Base": 0.25, "Optimistic": 0.40}

# The reference economics and limits.
ECONOMICS = {"multiplier": 1.0, "success": 0.25, "cost": 2500.0}
LIMITS = {"maximum": 700, "budget": 1_750_000.0}


def scenarios() -> list[dict]:
    """Every combination of the three assumption families."""
    return [
        {
            "scenario_id": f"{r}-{i}-{e}".lower(),
            "replacement": r,
            "intervention": i,
            "effectiveness": e,
            "multiplier": REPLACEMENT[r]["salary_multiplier"],
            "cost": INTERVENTION_COST[i],
            "success": EFFECTIVENESS[e],
            "vacancy_days": float(REPLACEMENT[r]["vacancy_days"]),
            "productivity_days": float(REPLACEMENT[r]["productivity_days"]),
            "training_hours": float(REPLACEMENT[r]["training_hours"]),
            "coverage_hours": float(REPLACEMENT[r]["vacancy_days"] * REPLACEMENT[r]["coverage_per_day"]),
        }
        for r, i, e in product(REPLACEMENT, INTERVENTION_COST, EFFECTIVENESS)
    ]


def _scenario_array() -> Column:
    text = ("scenario_id", "replacement", "intervention", "effectiveness")
    return F.array(
        *[F.struct(*[F.lit(v).alias(k) if k in text else F.lit(float(v)).alias(k) for k, v in s.items()]) for s in scenarios()]
    )


def expected_net(probability: Column, salary: Column, economics: dict[str, float] = ECONOMICS) -> Column:
    return probability * economics["success"] * (salary * economics["multiplier"]) - economics["cost"]


def with_economics(df: DataFrame, probability: str, salary: str, economics: dict[str, float] = ECONOMICS) -> DataFrame:
    """Replacement cost, expected avoidable cost and expected net value per row."""
    cost = F.col(salary) * economics["multiplier"]
    avoidable = F.col(probability) * economics["success"] * cost
    return df.select(
        "*",
        cost.alias("replacement_cost_usd"),
        avoidable.alias("predicted_avoidable_cost_usd"),
        (avoidable - economics["cost"]).alias("predicted_net_value_usd"),
    )


def salary_summary(df: DataFrame, by: Sequence[str], salary: str, multiplier: float = 1.0) -> DataFrame:
    means = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(salary).alias("mean_salary"))
    medians = exact_quantiles(df, salary, {"median_salary": 0.5}, by).drop("_n")
    return attach(means, medians, by).select(
        "*",
        (F.col("mean_salary") * multiplier).alias("mean_replacement_cost"),
        (F.col("median_salary") * multiplier).alias("median_replacement_cost"),
    )


def scenario_table(df: DataFrame, population: str, salary: str) -> DataFrame:
    """Cost, avoidable cost and break-even probability per population and scenario.

    Break-even is cost over avoidable cost, so its mean and median follow from those
    of 1/salary; rows without a positive salary have none.
    """
    table = scenarios()
    inverse = F.when(F.col(salary) > 0, 1.0 / F.col(salary))
    source = df.select(population, F.col(salary).alias("_s"), inverse.alias("_i"))
    sums = source.groupBy(population).agg(
        F.count(F.lit(1)).alias("population_rows"),
        F.avg("_s").alias("average_base_salary"),
        F.avg("_i").alias("_mean_i"),
        F.array(
            *[count_if((F.col("_s") > 0) & (F.lit(s["cost"]) / (F.col("_s") * s["multiplier"] * s["success"]) <= 1.0)) for s in table]
        ).alias("_reach"),
    )
    mid = exact_quantiles(source, "_s", {"median_base_salary": 0.5}, [population]).drop("_n")
    mid_i = exact_quantiles(source, "_i", {"_median_i": 0.5}, [population]).drop("_n")
    joined = sums.join(mid, population).join(mid_i, population, "left")
    rows = joined.select("*", F.posexplode(_scenario_array()).alias("_k", "_c"))
    m, s, c = F.col("_c.multiplier"), F.col("_c.success"), F.col("_c.cost")
    scale = c / (m * s)
    return rows.select(
        population,
        "_c.scenario_id",
        F.col("_c.replacement").alias("replacement_impact_scenario"),
        F.col("_c.intervention").alias("intervention_cost_scenario"),
        F.col("_c.effectiveness").alias("effectiveness_scenario"),
        "population_rows",
        "average_base_salary",
        "median_base_salary",
        (F.col("average_base_salary") * m).alias("average_replacement_cost_usd"),
        (F.col("median_base_salary") * m).alias("median_replacement_cost_usd"),
        (F.col("average_base_salary") * m * s).alias("average_maximum_avoidable_cost_usd"),
        (F.col("median_base_salary") * m * s).alias("median_maximum_avoidable_cost_usd"),
        (F.col("_mean_i") * scale).alias("average_break_even_attrition_probability"),
        (F.col("_median_i") * scale).alias("median_break_even_attrition_probability"),
        safe_div(F.element_at("_reach", F.col("_k") + 1), F.col("population_rows")).alias(
            "share_break_even_at_or_below_100_percent"
        ),
        F.col("_c.vacancy_days").alias("vacancy_days"),
        F.col("_c.productivity_days").alias("time_to_productivity_days"),
        F.col("_c.training_hours").alias("training_hours_per_replacement"),
        F.col("_c.coverage_hours").alias("coverage_hours_per_replacement"),
    )


def cost_threshold(
    df: DataFrame, probability: str, row_id: str, net: str, by: Sequence[str] = ()
) -> DataFrame:
    """Probability at which the running net value, best scores first, peaks.

    (1.0, 0 rows) for a group where no prefix has a positive total. A tie at the
    threshold later selects all its rows, which may be more than the prefix.
    """
    best = best_prefix(df, [Key(probability, True), Key(row_id)], net, by, [probability]).select(
        *by, F.col(probability).alias("_t"), "prefix_rows", "prefix_total"
    )
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("population_rows"))
    joined = groups.join(best, list(by), "left") if by else groups.join(F.broadcast(best), F.lit(True), "left")
    return joined.select(
        *by,
        "population_rows",
        F.coalesce("_t", F.lit(1.0)).alias("probability_threshold"),
        F.coalesce("prefix_rows", F.lit(0)).cast("bigint").alias("selected_count"),
        F.coalesce("prefix_total", F.lit(0.0)).alias("best_net_value_usd"),
    )


def affordable(maximum: int, budget: float, unit_cost: float) -> int:
    """How many reviews fit both limits; the unit cost is constant, so the selection is a prefix."""
    return maximum if unit_cost <= 0 else min(maximum, math.floor((budget + 1e-9) / unit_cost))


def select_within(
    df: DataFrame,
    score: str,
    row_id: str,
    out: str,
    by: Sequence[str] = (),
    maximum: int = LIMITS["maximum"],
    budget: float = LIMITS["budget"],
    unit_cost: float = ECONOMICS["cost"],
    require_positive: bool = True,
    base: DataFrame | None = None,
) -> DataFrame:
    """Flag the best rows that fit capacity and budget, in each group. ``base`` is that of ``ranked``."""
    k = affordable(maximum, budget, unit_cost)
    numbered = ranked(df, [Key(score, True), Key(row_id)], by, out="_r", base=base)
    chosen = F.col("_r") <= k
    if require_positive:
        chosen = chosen & (F.col(score) > 0)
    return numbered.withColumn(out, chosen).drop("_r")


POLICIES = (
    "no_intervention",
    "fixed_threshold",
    "cost_optimal_threshold",
    "top_fraction",
    "top_count",
    "budget_expected_value",
)


def policy_flags(
    df: DataFrame,
    probability: str,
    salary: str,
    row_id: str,
    frozen: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """One flag column per policy under rules that were frozen beforehand."""
    base = df.withColumn("_net", expected_net(F.col(probability), F.col(salary), frozen))
    numbered = ranked(base, [Key(probability, True), Key(row_id)], by, out="_rp")
    numbered = ranked(numbered, [Key("_net", True), Key(row_id)], by, out="_rn")
    sized = attach(numbered, group_size(df, by, "_n"), by)
    limit = affordable(int(frozen["maximum"]), frozen["budget"], frozen["cost"])
    flags = {
        "no_intervention": F.lit(False),
        "fixed_threshold": F.col(probability) >= frozen["fixed_threshold"],
        "cost_optimal_threshold": F.col(probability) >= frozen["cost_optimal_threshold"],
        "top_fraction": F.col("_rp") <= top_count(F.col("_n"), float(frozen["fraction"])),
        "top_count": F.col("_rp") <= int(frozen["count"]),
        "budget_expected_value": (F.col("_rn") <= limit) & (F.col("_net") > 0),
    }
    return sized.select(*df.columns, *[c.alias(n) for n, c in flags.items()])


def _flag_sums(df: DataFrame, by: Sequence[str], flags: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Per group and flag: rows with the flag and sums of ``values`` over them, from one aggregate."""
    entries = [
        F.struct(
            F.lit(flag).alias("policy_key"),
            count_if(F.col(flag)).alias("selected_count"),
            *[F.sum(F.when(F.col(flag), v)).alias(n) for n, v in values.items()],
        )
        for flag in flags
    ]
    totals = [F.count(F.lit(1)).alias("population_rows"), *[F.sum(v).alias(f"total_{n}") for n, v in values.items()]]
    grouped = df.groupBy(*by).agg(*totals, F.array(*entries).alias("_f"))
    kept = [*by, "population_rows", *[f"total_{n}" for n in values]]
    return grouped.select(*kept, F.explode("_f").alias("_e")).select(*kept, "_e.*")


def _policy_sums(df: DataFrame, by: Sequence[str], flags: Sequence[str], probability: str, salary: str, label: str) -> DataFrame:
    p, s, y = F.col(probability), F.col(salary), F.col(label).cast("double")
    return _flag_sums(df, by, flags, {"y": y, "p": p, "s": s, "ps": p * s, "ys": y * s})


def _policy_figures(sums: DataFrame, keep: Sequence[str], multiplier: Column, success: Column, cost: Column) -> DataFrame:
    n, y = F.col("selected_count"), F.coalesce("y", F.lit(0.0))
    spend = n * cost
    avoided = F.coalesce("ps", F.lit(0.0)) * success * multiplier
    outcome = F.coalesce("ys", F.lit(0.0)) * success * multiplier
    precision, base = zero_div(y, n), safe_div(F.col("total_y"), F.col("population_rows"))
    return sums.select(
        *keep,
        "policy_key",
        "population_rows",
        F.col("total_y").cast("bigint").alias("positive_cases"),
        base.alias("observed_attrition_rate"),
        "selected_count",
        safe_div(n, F.col("population_rows")).alias("selection_rate"),
        y.cast("bigint").alias("selected_positive_cases"),
        precision.alias("precision"),
        zero_div(y, F.col("total_y")).alias("capture_rate"),
        zero_div(precision, base).alias("lift"),
        spend.alias("intervention_spend_usd"),
        (F.coalesce("p", F.lit(0.0)) * success).alias("expected_prevented_departures"),
        avoided.alias("expected_avoided_replacement_cost_usd"),
        (avoided - spend).alias("expected_net_value_usd"),
        safe_div(avoided - spend, spend).alias("expected_roi"),
        (y * success).alias("outcome_aligned_expected_preventions"),
        outcome.alias("outcome_aligned_avoided_replacement_cost_usd"),
        (outcome - spend).alias("outcome_aligned_net_value_usd"),
        safe_div(outcome - spend, spend).alias("outcome_aligned_roi"),
        safe_div(F.col("p"), n).alias("average_selected_probability"),
        safe_div(F.col("s"), n).alias("average_selected_salary"),
    )


def policy_comparison(
    flagged: DataFrame,
    by: Sequence[str],
    probability: str,
    salary: str,
    label: str,
    economics: dict[str, float] = ECONOMICS,
    policies: Sequence[str] = POLICIES,
) -> DataFrame:
    """Expected and outcome-aligned figures per group and policy."""
    sums = _policy_sums(flagged, by, policies, probability, salary, label)
    return _policy_figures(
        sums, by, F.lit(economics["multiplier"]), F.lit(economics["success"]), F.lit(economics["cost"])
    )


def policy_sensitivity(
    flagged: DataFrame, by: Sequence[str], probability: str, salary: str, label: str, policies: Sequence[str] = POLICIES
) -> DataFrame:
    """The comparison of fixed selections under every cost scenario."""
    sums = _policy_sums(flagged, by, policies, probability, salary, label)
    crossed = sums.select("*", F.explode(_scenario_array()).alias("_c"))
    keep = [
        *by,
        F.col("_c.scenario_id").alias("scenario_id"),
        F.col("_c.multiplier").alias("replacement_cost_salary_multiplier"),
        F.col("_c.cost").alias("intervention_cost_usd"),
        F.col("_c.success").alias("success_probability"),
    ]
    return _policy_figures(crossed, keep, F.col("_c.multiplier"), F.col("_c.success"), F.col("_c.cost"))


def policy_bootstrap(
    df: DataFrame, row_id: str, iterations: int, seed: int, flag: str, probability: str, salary: str, label: str,
    economics: dict[str, float] = ECONOMICS,
) -> DataFrame:
    """Figures of one frozen selection in each resample, drawn within the classes of ``label``."""
    on, y = F.col(flag), F.col(label).cast("double")
    sums = {
        "selected": F.when(on, 1.0),
        "hits": F.when(on, y),
        "positives": y,
        "ps": F.when(on, F.col(probability) * F.col(salary)),
        "ys": F.when(on, y * F.col(salary)),
    }
    drawn = bootstrap_sums(df, row_id, iterations, seed, sums, label)
    selected = F.col("selected").cast("bigint")
    unit = economics["success"] * economics["multiplier"]
    spend = selected * economics["cost"]
    return drawn.select(
        "iteration",
        selected.alias("selected_count"),
        F.col("hits").cast("bigint").alias("selected_positive_cases"),
        zero_div(F.col("hits"), F.col("positives")).alias("capture_rate"),
        (F.col("ps") * unit - spend).alias("expected_net_value_usd"),
        (F.col("ys") * unit - spend).alias("outcome_aligned_net_value_usd"),
    )


def overlap(df: DataFrame, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows both select, rows either selects, and their ratio."""
    out = df.groupBy(*by).agg(count_if(first & second).alias("overlap"), count_if(first | second).alias("either"))
    return out.withColumn("jaccard", safe_div(F.col("overlap"), F.col("either")))


# ---- alternative ranking policies -------------------------------------------------------------

ALTERNATIVES = ("frozen_expected_value", "probability_only", "salary_capped_expected_value", "constant_cost")


def frozen_thresholds(validation: DataFrame, salary: str) -> DataFrame:
    """Salary cap (upper quartile) and constant cost (median), from the validation split only."""
    return exact_quantiles(validation, salary, {"salary_cap_usd": 0.75, "constant_cost_usd": 0.5}).drop("_n")


def alternative_selections(
    df: DataFrame, thresholds: DataFrame, probability: str, salary: str, row_id: str, by: Sequence[str] = ()
) -> DataFrame:
    """Score and selection flag of each alternative ranking, under the same capacity and budget."""
    joined = attach(df, store(thresholds), [])  # one row
    p, s = F.col(probability), F.col(salary)
    scores = {
        "frozen_expected_value": expected_net(p, s),
        "probability_only": p,
        "salary_capped_expected_value": expected_net(p, F.least(s, F.col("salary_cap_usd"))),
        "constant_cost": expected_net(p, F.col("constant_cost_usd")),
    }
    base = out = joined.select("*", *[c.alias(f"score_{n}") for n, c in scores.items()]).drop(*thresholds.columns)
    for name in ALTERNATIVES:
        out = select_within(
            out, f"score_{name}", row_id, f"selected_{name}", by, require_positive=name != "probability_only", base=base
        )
    return out


def alternative_comparison(selected: DataFrame, by: Sequence[str], probability: str, salary: str) -> DataFrame:
    """Salary mix, value under the original economics and overlap with the frozen policy."""
    flags = [f"selected_{n}" for n in ALTERNATIVES]
    frozen = F.col(flags[0])
    values = {
        "s": F.col(salary),
        "p": F.col(probability),
        "net": F.col("score_frozen_expected_value"),
        "both": frozen.cast("int"),
    }
    sums = _flag_sums(selected, by, flags, values)
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("policy_key"), F.col(f).alias("on")) for f in flags]))
    chosen = selected.select(*by, salary, long.alias("_x")).where(F.col("_x.on")).select(*by, salary, "_x.policy_key")
    medians = exact_quantiles(chosen, salary, {"selected_median_salary_usd": 0.5}, [*by, "policy_key"]).drop("_n")
    joined = sums.join(medians, [*by, "policy_key"], "left")
    n, population = F.col("selected_count"), F.col("population_rows")
    frozen_count = F.max(F.when(F.col("policy_key") == flags[0], n)).over(Window.partitionBy(*by))
    both = F.coalesce("both", F.lit(0))
    mean, everyone = safe_div(F.col("s"), n), safe_div(F.col("total_s"), population)
    return joined.select(
        *by,
        F.regexp_replace("policy_key", "^selected_", "").alias("policy_key"),
        "population_rows",
        "selected_count",
        safe_div(n, population).alias("selection_rate"),
        everyone.alias("population_mean_salary_usd"),
        mean.alias("selected_mean_salary_usd"),
        "selected_median_salary_usd",
        safe_div(mean, everyone).alias("selected_to_population_mean_salary_ratio"),
        safe_div(F.col("p"), n).alias("selected_mean_probability"),
        F.coalesce("net", F.lit(0.0)).alias("predicted_net_value_under_original_economics_usd"),
        both.cast("bigint").alias("overlap_with_frozen_policy"),
        safe_div(both, n + frozen_count - both).alias("jaccard_with_frozen_policy"),
    )


# ---- planning ---------------------------------------------------------------------------------

# The planning assumptions.
PLANNING = {"success": 0.25, "cost": 2500.0, "vacancy_days": 60.0, "productivity_days": 90.0, "training_hours": 80.0, "coverage_hours": 180.0}

PLAN_SUMS = {
    "expected_departures_12m": "expected_departure_contribution",
    "expected_prevented_departures": "expected_prevented_departure_contribution",
    "residual_expected_backfills": "residual_backfill_contribution",
    "replacement_cost_exposure_usd": "replacement_cost_exposure_usd",
    "planned_avoided_cost_usd": "planned_avoided_cost_usd",
    "planned_intervention_spend_usd": "planned_intervention_spend_usd",
    "planned_net_value_usd": "planned_net_value_usd",
    "residual_replacement_cost_exposure_usd": "residual_replacement_cost_exposure_usd",
    "residual_vacancy_days": "residual_vacancy_days",
    "residual_time_to_productivity_days": "residual_time_to_productivity_days",
    "residual_training_hours": "residual_training_hours",
    "residual_coverage_hours": "residual_coverage_hours",
}


def planning_columns(df: DataFrame, probability: str, selected: str, assumptions: dict[str, float] = PLANNING) -> DataFrame:
    """Departures, preventions, backfills, cost exposure and operational units contributed by each row."""
    p, on = F.col(probability), F.coalesce(F.col(selected), F.lit(False))
    prevented = F.when(on, p * assumptions["success"]).otherwise(0.0)
    residual = p - prevented
    exposure = p * F.col("replacement_cost_usd")
    avoided = F.when(on, F.col("predicted_avoidable_cost_usd")).otherwise(0.0)
    spend = F.when(on, F.lit(assumptions["cost"])).otherwise(0.0)
    return df.select(
        "*",
        p.alias("expected_departure_contribution"),
        prevented.alias("expected_prevented_departure_contribution"),
        residual.alias("residual_backfill_contribution"),
        exposure.alias("replacement_cost_exposure_usd"),
        avoided.alias("planned_avoided_cost_usd"),
        spend.alias("planned_intervention_spend_usd"),
        (avoided - spend).alias("planned_net_value_usd"),
        (exposure - avoided).alias("residual_replacement_cost_exposure_usd"),
        (residual * assumptions["vacancy_days"]).alias("residual_vacancy_days"),
        (residual * assumptions["productivity_days"]).alias("residual_time_to_productivity_days"),
        (residual * assumptions["training_hours"]).alias("residual_training_hours"),
        (residual * assumptions["coverage_hours"]).alias("residual_coverage_hours"),
    )


def planning_rollup(planned: DataFrame, by: Sequence[str], selected: str, active: DataFrame | None = None) -> DataFrame:
    """Plan totals and rates per group; ``active`` adds the headcount that is not scored."""
    plan = planned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("model_eligible_employees"),
        count_if(F.col(selected)).alias("selected_for_human_review"),
        *[F.sum(c).alias(n) for n, c in PLAN_SUMS.items()],
    )
    if active is None:
        plan = plan.withColumn("active_workforce_employees", F.col("model_eligible_employees"))
    else:
        plan = plan.join(active, list(by), "left")
    eligible, leaving = F.col("model_eligible_employees"), F.col("expected_departures_12m")
    return plan.select(
        "*",
        (F.col("active_workforce_employees") - eligible).alias("protected_active_employees"),
        safe_div(leaving, eligible).alias("expected_departure_rate"),
        safe_div(F.col("selected_for_human_review"), eligible).alias("selection_rate"),
        zero_div(F.col("expected_prevented_departures"), leaving).alias("intervention_offset_rate"),
    )


def reconcile_scores(population: DataFrame, scores: DataFrame, key: str, attributes: Sequence[str], salary: str, as_of: str, tolerance: float = 1e-6) -> DataFrame:
    """Coverage, attribute and salary disagreements of a score table against its population."""
    left = population.select(key, *[F.col(c).alias(f"l_{c}") for c in [*attributes, salary]], F.lit(True).alias("in_l"))
    right = scores.select(key, *[F.col(c).alias(f"r_{c}") for c in [*attributes, salary]], F.col(as_of).alias("_d"), F.lit(True).alias("in_r"))
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    return left.join(right, key, "full").agg(
        count_if(F.col("in_r").isNull()).alias("missing_scores"),
        count_if(F.col("in_l").isNull()).alias("unexpected_scores"),
        *[count_if(both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(f"{c}_mismatches") for c in attributes],
        count_if(both & (F.abs(F.col(f"l_{salary}") - F.col(f"r_{salary}")) > tolerance)).alias("salary_mismatches"),
        F.count_distinct("_d").alias("as_of_dates"),
    )


def policy_digest(policies: DataFrame) -> DataFrame:
    """Each frozen rule with a digest of its own content."""
    ordered = sorted(policies.columns)
    return policies.withColumn("policy_digest", F.sha2(F.to_json(F.struct(*ordered)), 256))


def join_reserved_target(frozen: DataFrame, digest: str, features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Join the reserved target, only for a policy table that carries the expected digest."""
    same = F.col("policy_digest").eqNullSafe(F.lit(digest))
    seen = frozen.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(same, 1)).alias("same")).first()
    if not seen["rows"] or seen["rows"] != seen["same"]:
        raise ValueError("the policy table differs from the one that was frozen")
    return features.join(target, key)


