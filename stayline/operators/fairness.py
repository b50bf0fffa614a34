"""Subgroup metrics, disparities and allocation audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import count_if, cut, missing_label, safe_div, wilson
from stayline.operators.metrics import rank_metrics
from stayline.operators.policy import overlap
from stayline.operators.rank import Key, attach, exact_quantiles, quantile_groups

# When a group is large enough to be compared, and when a gap is worth a look.
ELIGIBILITY = {"rows": 100, "positives": 20, "negatives": 50, "selected": 10}
SCREENING = {
    "demographic_parity_difference": 0.10,
    "equal_opportunity_difference": 0.10,
    "false_positive_rate_difference": 0.10,
    "maximum_absolute_calibration_gap": 0.05,
}
AGE_BANDS = ([0, 30, 40, 50, 60, 200], ["Under 30", "30-39", "40-49", "50-59", "60+"])
SALARY_BANDS = (
    [0, 60_000, 80_000, 100_000, 125_000, 150_000, 1_000_000_000],
    ["Under $60k", "$60k-$79,999", "$80k-$99,999", "$100k-$124,999", "$125k-$149,999", "$150k+"],
)


def age_band(age: Column | str) -> Column:
    return cut(age, *AGE_BANDS)


def by_attribute(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and attribute with the group as text; a row-local expansion."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), missing_label(a).alias("group")) for a in attributes])
    return df.select(*keep, F.explode(pairs).alias("_a")).select(*keep, "_a.*")


def group_metrics(
    df: DataFrame,
    attributes: Sequence[str],
    score: str,
    label: str,
    flag: str,
    variant: str | None = None,
    eligibility: dict[str, int] = ELIGIBILITY,
    means: dict[str, str] | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """Rates, calibration, ranking and selection figures per attribute and group.

    ``variant`` names a column of model variants; ``means`` adds plain averages.
    Undefined rates are null.
    """
    means = means or {}
    lead = [variant] if variant else []
    keep = list(dict.fromkeys([*lead, score, label, flag, *means.values()]))
    long = by_attribute(df, attributes, keep)
    by = [*lead, "attribute", "group"]
    y, on = F.col(label) == 1, F.col(flag)
    counts = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"),
        count_if(y).alias("positive_cases"),
        count_if(~y).alias("negative_cases"),
        F.avg(label).alias("observed_attrition_rate"),
        F.avg(score).alias("mean_predicted_probability"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier_score"),
        count_if(on).alias("selected_count"),
        count_if(y & on).alias("true_positive"),
        count_if(~y & on).alias("false_positive"),
        count_if(y & ~on).alias("false_negative"),
        count_if(~y & ~on).alias("true_negative"),
        *[F.avg(c).alias(n) for n, c in means.items()],
    )
    curves = rank_metrics(long, score, label, by)
    joined = counts.join(curves, by, "left")
    gap = F.col("mean_predicted_probability") - F.col("observed_attrition_rate")
    rates = {
        "selection_rate": ("selected_count", "sample_size"),
        "precision": ("true_positive", "selected_count"),
        "true_positive_rate": ("true_positive", "positive_cases"),
        "false_positive_rate": ("false_positive", "negative_cases"),
    }
    extra = [gap.alias("calibration_gap"), F.abs(gap).alias("absolute_calibration_gap")]
    for name, (top, bottom) in rates.items():
        low, high = wilson(F.col(top), F.col(bottom), confidence)
        extra += [
            safe_div(F.col(top), F.col(bottom)).alias(name),
            low.alias(f"{name}_lower_95"),
            high.alias(f"{name}_upper_95"),
        ]
    eligible = (
        (F.col("sample_size") >= eligibility["rows"])
        & (F.col("positive_cases") >= eligibility["positives"])
        & (F.col("negative_cases") >= eligibility["negatives"])
        & (F.col("selected_count") >= eligibility["selected"])
    )
    return joined.select("*", *extra, eligible.alias("eligible_for_disparity_comparison"))


def disparities(
    metrics: DataFrame, by: Sequence[str] = ("attribute",), minimum_groups: int = 0, limits: dict[str, float] = SCREENING
) -> DataFrame:
    """Spread of the rates over the eligible groups, the extreme groups and review flags.

    With ``minimum_groups`` an attribute that has fewer eligible groups is left out.
    """
    ok = F.col("eligible_for_disparity_comparison")

    def top(c: str) -> Column:
        return F.max(F.when(ok, F.col(c)))

    def low(c: str) -> Column:
        return F.min(F.when(ok, F.col(c)))

    def label(c: str, highest: bool) -> Column:
        known = ok & F.col(c).isNotNull()
        # the first group name wins a tie
        order = F.struct(F.when(F.lit(highest), -F.col(c)).otherwise(F.col(c)), "group")
        return F.coalesce(F.min_by("group", F.when(known, order)), F.lit(""))

    grouped = metrics.groupBy(*by).agg(
        count_if(ok).alias("eligible_groups"),
        F.count(F.lit(1)).alias("total_groups"),
        (top("selection_rate") - low("selection_rate")).alias("demographic_parity_difference"),
        safe_div(low("selection_rate"), top("selection_rate")).alias("selection_rate_ratio"),
        label("selection_rate", False).alias("lowest_selection_group"),
        label("selection_rate", True).alias("highest_selection_group"),
        (top("true_positive_rate") - low("true_positive_rate")).alias("equal_opportunity_difference"),
        label("true_positive_rate", False).alias("lowest_recall_group"),
        label("true_positive_rate", True).alias("highest_recall_group"),
        (top("false_positive_rate") - low("false_positive_rate")).alias("false_positive_rate_difference"),
        label("false_positive_rate", False).alias("lowest_fpr_group"),
        label("false_positive_rate", True).alias("highest_fpr_group"),
        (top("precision") - low("precision")).alias("precision_difference"),
        (top("calibration_gap") - low("calibration_gap")).alias("calibration_gap_range"),
        top("absolute_calibration_gap").alias("maximum_absolute_calibration_gap"),
    )
    flags = [F.coalesce(F.col(c) > limit, F.lit(False)).alias(f"review_{c}") for c, limit in limits.items()]
    return grouped.where(F.col("eligible_groups") >= minimum_groups).select(
        "*",
        F.greatest("equal_opportunity_difference", "false_positive_rate_difference").alias("equalized_odds_max_difference"),
        *flags,
    )


def rule_comparison(df: DataFrame, attributes: Sequence[str], deployed: str, proxy: str) -> DataFrame:
    """Selection by the deployed rule and by a proxy rule in each group."""
    long = by_attribute(df, attributes, [deployed, proxy])
    a, b = F.col(deployed), F.col(proxy)
    n = F.count(F.lit(1))
    return long.groupBy("attribute", "group").agg(
        n.alias("sample_size"),
        count_if(a).alias("deployed_selected_count"),
        safe_div(count_if(a), n).alias("deployed_selection_rate"),
        count_if(b).alias("probability_proxy_selected_count"),
        safe_div(count_if(b), n).alias("probability_proxy_selection_rate"),
        (safe_div(count_if(a), n) - safe_div(count_if(b), n)).alias("selection_rate_difference_deployed_minus_proxy"),
        count_if(a & b).alias("selection_overlap_count"),
    )


def rule_overview(df: DataFrame, flags: dict[str, str], score: str, label: str, salary: str, net: str) -> DataFrame:
    """Whole-population figures per rule, with the overlap and Jaccard of the two rules."""
    first, second = list(flags.values())
    y = F.col(label) == 1
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("selection_rule"),
                count_if(F.col(c)).alias("selected_count"),
                count_if(F.col(c) & y).alias("selected_positive_cases"),
                F.avg(F.when(F.col(c), F.col(score))).alias("mean_selected_probability"),
                F.avg(F.when(F.col(c), F.col(salary))).alias("mean_selected_salary_usd"),
                F.coalesce(F.sum(F.when(F.col(c), F.col(net))), F.lit(0.0)).alias("predicted_net_value_usd"),
            )
            for name, c in flags.items()
        ]
    )
    sums = df.agg(F.count(F.lit(1)).alias("_n"), count_if(y).alias("_p"), entries.alias("_e"))
    rows = sums.select("_n", "_p", F.explode("_e").alias("_e")).select("_n", "_p", "_e.*")
    both = overlap(df, F.col(first), F.col(second))
    return attach(rows, both, []).select(
        "selection_rule",
        "selected_count",
        safe_div(F.col("selected_count"), F.col("_n")).alias("selection_rate"),
        "selected_positive_cases",
        safe_div(F.col("selected_positive_cases"), F.col("selected_count")).alias("precision"),
        safe_div(F.col("selected_positive_cases"), F.col("_p")).alias("capture_rate"),
        "mean_selected_probability",
        "mean_selected_salary_usd",
        "predicted_net_value_usd",
        F.col("overlap").alias("cross_rule_overlap_count"),
        F.col("jaccard").alias("cross_rule_jaccard"),
    )


def variant_comparison(metrics: DataFrame, variant: str, baseline: str, names: Sequence[str]) -> DataFrame:
    """Change of each metric of every other variant against the baseline."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select(variant, F.explode(pairs).alias("_m")).select(variant, "_m.*")
    base = long.where(F.col(variant) == baseline).select("metric", F.col("value").alias("baseline_value"))
    return (
        long.where(F.col(variant) != baseline)
        .join(F.broadcast(base), "metric")
        .select(
            variant,
            "metric",
            "baseline_value",
            F.col("value").alias("variant_value"),
            (F.col("value") - F.col("baseline_value")).alias("difference"),
        )
    )


def salary_groups(
    df: DataFrame, salary: str, score: str, row_id: str, level: str, by: Sequence[str] = (), base: DataFrame | None = None
) -> DataFrame:
    """Absolute bands, pay and risk quintiles of the population, and pay quintiles within the level.

    ``base`` is that of ``ranked``: the same rows before steps that are dear to repeat.
    """
    base = df if base is None else base
    out = df.withColumn("absolute_salary_band", cut(salary, *SALARY_BANDS, include_lowest=True))
    out = quantile_groups(out, [Key(salary), Key(row_id)], 5, by, "salary_quintile", base)
    out = quantile_groups(out, [Key(score), Key(row_id)], 5, by, "risk_quintile", base)
    return quantile_groups(out, [Key(salary), Key(row_id)], 5, [*by, level], "within_level_salary_quintile", base)


def band_selection(
    df: DataFrame, flags: Sequence[str], salary: str, score: str, level: str, period: str
) -> DataFrame:
    """Selection per period, band type, segment, band and policy."""
    everyone = F.lit("All job levels")
    bands = F.array(
        *[
            F.struct(F.lit(kind).alias("band_type"), segment.alias("segment"), F.col(band).cast("string").alias("salary_band"))
            for kind, segment, band in (
                ("absolute_salary_band", everyone, "absolute_salary_band"),
                ("population_salary_quintile", everyone, "salary_quintile"),
                ("within_job_level_salary_quintile", F.col(level).cast("string"), "within_level_salary_quintile"),
            )
        ]
    )
    by = [period, "band_type", "segment", "salary_band"]
    long = df.select(period, salary, score, *flags, F.explode(bands).alias("_b")).select(period, salary, score, *flags, "_b.*")
    grouped = long.where(F.col("salary_band").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("employees"),
        F.avg(salary).alias("mean_salary_usd"),
        F.avg(score).alias("mean_probability"),
        F.array(
            *[F.struct(F.lit(f).alias("policy_key"), count_if(F.col(f)).alias("selected_count")) for f in flags]
        ).alias("_f"),
    )
    return grouped.select(*by, "employees", "mean_salary_usd", "mean_probability", F.explode("_f").alias("_e")).select(
        *by,
        "employees",
        "mean_salary_usd",
        "mean_probability",
        "_e.*",
        safe_div(F.col("_e.selected_count"), F.col("employees")).alias("selection_rate"),
    )


def risk_by_salary(df: DataFrame, flag: str, salary: str, score: str, period: str) -> DataFrame:
    return df.groupBy(period, "risk_quintile", "salary_quintile").agg(
        F.count(F.lit(1)).alias("employees"),
        F.avg(score).alias("mean_probability"),
        F.avg(salary).alias("mean_salary_usd"),
        count_if(F.col(flag)).alias("selected_count"),
        F.avg(F.col(flag).cast("int")).alias("selection_rate"),
    )


def department_allocation(df: DataFrame, department: str, flag: str, salary: str, score: str, period: str) -> DataFrame:
    chosen = F.avg(F.when(F.col(flag), F.col(salary)))
    return df.groupBy(period, department).agg(
        F.count(F.lit(1)).alias("eligible_employees"),
        count_if(F.col(flag)).alias("selected_employees"),
        F.avg(F.col(flag).cast("int")).alias("selection_rate"),
        F.avg(salary).alias("population_mean_salary_usd"),
        chosen.alias("selected_mean_salary_usd"),
        (chosen - F.avg(salary)).alias("selected_salary_difference_usd"),
        F.avg(score).alias("mean_probability"),
    )


def allocation_headline(
    df: DataFrame,
    flag: str,
    other_flag: str,
    salary: str,
    period: str,
    ratio_limit: float = 1.10,
    rate_limit: float = 2.0,
    gap_limit: float = 0.10,
) -> DataFrame:
    """Mean-salary ratio, top to bottom quintile rate ratio, gap inside the highest risk quintile, and triggers."""
    on, other = F.col(flag), F.col(other_flag)

    def rate(quintile: int, risk: int | None = None) -> Column:
        inside = F.col("salary_quintile") == quintile
        if risk is not None:
            inside = inside & (F.col("risk_quintile") == risk)
        return F.avg(F.when(inside, on.cast("int")))

    grouped = df.groupBy(period).agg(
        F.count(F.lit(1)).alias("population_rows"),
        count_if(on).alias("selected_count"),
        F.avg(salary).alias("population_mean_salary_usd"),
        F.avg(F.when(on, F.col(salary))).alias("selected_mean_salary_usd"),
        rate(1).alias("lowest_salary_quintile_selection_rate"),
        rate(5).alias("highest_salary_quintile_selection_rate"),
        (rate(5, 5) - rate(1, 5)).alias("highest_risk_quintile_salary_selection_gap"),
        count_if(on & other).alias("overlap_with_probability_selection"),
        count_if(on & ~other).alias("frozen_policy_only_selections"),
        count_if(~on & other).alias("probability_policy_only_selections"),
    )
    medians = exact_quantiles(df, salary, {"population_median_salary_usd": 0.5}, [period]).drop("_n")
    chosen = exact_quantiles(df.where(on), salary, {"selected_median_salary_usd": 0.5}, [period]).drop("_n")
    joined = grouped.join(medians, period, "left").join(chosen, period, "left")
    ratio = safe_div(F.col("selected_mean_salary_usd"), F.col("population_mean_salary_usd"))
    low, high = F.col("lowest_salary_quintile_selection_rate"), F.col("highest_salary_quintile_selection_rate")
    rates = F.when(low > 0, high / F.nullif(low, F.lit(0.0))).otherwise(F.lit(float("inf")))
    triggers = F.concat_ws(
        ", ",
        F.when(ratio > ratio_limit, "selected_mean_salary"),
        F.when(rates > rate_limit, "salary_quintile_selection"),
        F.when(F.col("highest_risk_quintile_salary_selection_gap") > gap_limit, "within_risk_salary_selection"),
    )
    return joined.select(
        "*",
        ratio.alias("selected_to_population_mean_salary_ratio"),
        rates.alias("highest_to_lowest_selection_rate_ratio"),
        (triggers != "").alias("review_flag"),
        F.when(triggers == "", "None").otherwise(triggers).alias("review_triggers"),
    )
