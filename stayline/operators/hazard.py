"""Person-month risk set, lagged features and the two-cause hazard score.

All cutoffs are month starts, so the records of an entity are first collapsed to
one row per month, with partial aggregation. After that an entity has at most as
many rows as there are months, whatever the number of its records, and the
as-of values come from windows over these few rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import calendar_months, clip, count_if, safe_div, transform_feature
from stayline.operators.rank import Key, exact_quantiles, top_per_group
from stayline.session import store

ENTITY = "employee_id"


def month_of(date: Column | str) -> Column:
    return F.trunc(date, "MM")


def person_months(
    employees: DataFrame, as_of: str, lag_months: int = 1, allow_first_month: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per employee and month at risk, with the exclusive feature cutoff.

    A terminated employee leaves the risk set after the month of the exit. The
    hire month is at risk only with ``allow_first_month``.
    """
    if lag_months < 1:
        raise ValueError("the feature lag is at least one month")
    first = month_of("hire_date")
    first = first if allow_first_month else F.add_months(first, 1)
    last = month_of(F.least(F.coalesce("termination_date", F.lit(as_of).cast("date")), F.lit(as_of).cast("date")))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )
    out = employees.select(ENTITY, "hire_date", "termination_date", *keep, F.explode(months).alias("month_start"))
    return out.withColumn("cutoff", F.add_months("month_start", 1 - lag_months)).withColumn(
        "tenure_months", calendar_months(F.col("month_start"), F.col("hire_date"), floor_zero=True).cast("double")
    )


def _monthly(facts: DataFrame, month: Column, *aggregates: Column) -> DataFrame:
    return facts.groupBy(ENTITY, month.alias("_m")).agg(*aggregates)


def monthly_reviews(reviews: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """The latest two ratings per month; at most two rows of a group pass the shuffle."""
    order = [Key("review_date", True), *[Key(c, True) for c in tie_break]]
    two = top_per_group(reviews.withColumn("_m", month_of("review_date")), [ENTITY, "_m"], order, 2)
    rating = F.col("performance_rating")
    return two.groupBy(ENTITY, "_m").agg(
        F.max(F.when(F.col("position") == 1, rating)).alias("_rating"),
        F.max(F.when(F.col("position") == 2, rating)).alias("_rating_before"),
    )


def monthly_pay(compensation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last salary and last promotion per month, and the salary shifted a year ahead.

    A year-ago record dated on the first of the month still counts, so the second
    table cuts its months one day later. The shift turns the year-ago lookup into the
    same "before the cutoff" form as the others.
    """
    order = F.struct("effective_date", "compensation_id")
    now = _monthly(
        compensation,
        month_of("effective_date"),
        F.max_by("base_salary", order).alias("_salary"),
        F.max(F.when(F.col("change_reason") == "Promotion", month_of("effective_date"))).alias("_promoted"),
    )
    shifted = F.add_months(month_of(F.date_sub("effective_date", 1)), 12)
    return now, _monthly(compensation, shifted, F.max_by("base_salary", order).alias("_year_ago"))


def monthly_training(training: DataFrame) -> DataFrame:
    done = F.col("completion_status") == "Completed"
    return _monthly(
        training.where(F.col("completion_date").isNotNull()),
        month_of("completion_date"),
        F.sum(F.when(done, F.col("training_hours")).otherwise(0.0)).alias("_hours"),
        count_if(F.col("completion_status") == "Failed").alias("_failed"),
    )


def monthly_manager_changes(events: DataFrame) -> DataFrame:
    return _monthly(events.where(F.col("event_type") == "Manager Change"), month_of("event_date"), F.count(F.lit(1)).alias("_moves"))


def lagged_features(
    risk: DataFrame,
    compensation: DataFrame,
    reviews: DataFrame,
    training: DataFrame,
    events: DataFrame,
    review_tie_break: Sequence[str] = ("review_id",),
    default_growth: float = 0.03,
) -> DataFrame:
    """Risk set with what was known strictly before each cutoff.

    Rating level and change (3.5, 0 and a flag where there is no review), salary,
    growth over a year, months since promotion, and training and manager changes of
    the year before. The risk rows and all monthly rows of an entity form one time
    line, so one exchange and one sort serve every feature and nothing is joined back.
    """
    now, year_ago = monthly_pay(compensation)
    line = risk.select(ENTITY, F.col("cutoff").alias("_m"), F.lit(0).alias("_side"), F.struct(*risk.columns).alias("_row"))
    for part in (monthly_reviews(reviews, review_tie_break), now, year_ago, monthly_training(training), monthly_manager_changes(events)):
        line = line.unionByName(part.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # a risk row sorts before the monthly rows of its cutoff month, which it must not see
    seen = Window.partitionBy(ENTITY).orderBy("_m", "_side").rowsBetween(Window.unboundedPreceding, -1)
    trailing = Window.partitionBy(ENTITY).orderBy(F.year("_m") * 12 + F.month("_m")).rangeBetween(-12, -1)

    def known(c: str) -> Column:
        return F.last(c, ignorenulls=True).over(seen)

    def year_sum(c: str) -> Column:
        return F.coalesce(F.sum(c).over(trailing), F.lit(0))

    earlier = F.coalesce("_rating_before", known("_rating"))
    line = line.withColumn("_pair", F.when(F.col("_rating").isNotNull(), F.struct(F.col("_rating").alias("now"), earlier.alias("before"))))
    line = line.select(
        "_row",
        known("_pair").alias("_pair"),
        known("_salary").alias("current_salary"),
        known("_promoted").alias("_promoted"),
        known("_year_ago").alias("_year_ago"),
        year_sum("_hours").alias("completed_training_hours"),
        year_sum("_failed").alias("failed_training_count"),
        year_sum("_moves").alias("manager_changes"),
    ).where(F.col("_row").isNotNull())
    growth = safe_div(F.col("current_salary"), F.col("_year_ago")) - 1.0
    return line.select(
        "_row.*",
        F.coalesce("_pair.now", F.lit(3.5)).alias("performance_level"),
        F.coalesce(F.col("_pair.now") - F.col("_pair.before"), F.lit(0.0)).alias("performance_trend"),
        F.col("_pair").isNull().cast("double").alias("no_prior_review"),
        "current_salary",
        F.coalesce(growth, F.lit(default_growth)).alias("trailing_compensation_growth"),
        F.coalesce(calendar_months(F.col("_row.cutoff"), F.col("_promoted"), True), F.lit(0)).cast("double").alias("months_since_promotion"),
        F.col("_promoted").isNull().cast("double").alias("no_prior_promotion"),
        "completed_training_hours",
        "failed_training_count",
        "manager_changes",
    )


def robust_peer_z(df: DataFrame, value: str, peers: Sequence[str], out: str) -> DataFrame:
    """(value − median) / (1.4826 · MAD) in the peer group; the std, then 1, where the MAD is 0.

    A row with no value gets 0.
    """
    peers = list(peers)
    medians = exact_quantiles(df, value, {"_median": 0.5}, peers).drop("_n")
    spread = df.groupBy(*peers).agg(F.stddev_samp(value).alias("_std"))
    # a row per group, in files whose size the planner knows: no job makes it again, and rows are not exchanged for it
    centres = store(spread.join(medians, peers, "left"))
    centred = df.join(centres, peers, "left").withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    mad = store(exact_quantiles(centred, "_dev", {"_mad": 0.5}, peers).drop("_n"))
    joined = centred.join(mad, peers, "left")
    scaled = F.lit(1.4826) * F.col("_mad")
    denominator = F.when(scaled > 0, scaled).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    return joined.withColumn(
        out, F.coalesce((F.col(value) - F.col("_median")) / denominator, F.lit(0.0))
    ).drop("_median", "_dev", "_mad", "_std")


def cause_probabilities(voluntary: Column, involuntary: Column, limits: dict[str, float]) -> tuple[Column, Column, Column]:
    """Stay, voluntary and involuntary probability from two logits, with floors, caps and a joint cap."""
    ev, ei = F.exp(clip(voluntary, -20, 20)), F.exp(clip(involuntary, -20, 20))
    total = 1.0 + ev + ei
    floor = limits["minimum_cause_probability"]
    pv = clip(ev / total, floor, limits["maximum_voluntary_probability"])
    pi = clip(ei / total, floor, limits["maximum_involuntary_probability"])
    cap = limits["maximum_combined_probability"]
    scale = F.when(pv + pi > cap, F.lit(cap) / (pv + pi)).otherwise(1.0)
    return 1.0 - pv * scale - pi * scale, pv * scale, pi * scale


def hazard_score(df: DataFrame, config: dict) -> DataFrame:
    """Two-cause monthly exit probabilities from tenure curves, features, level and season."""
    months = F.col("tenure_months")
    curves = {
        "onboarding_protection": F.exp(-months / 3.0),
        "early_tenure_peak": F.exp(-F.pow((months - 18.0) / 12.0, F.lit(2.0))),
        "long_tenure_stability": F.log1p(months) / F.lit(math.log(73.0)),
    }
    season = F.sin(F.lit(2.0 * math.pi) * F.month("month_start") / 12.0)
    logits = {}
    for cause in ("voluntary", "involuntary"):
        logit = F.lit(float(config["intercepts"][cause]))
        for name, curve in curves.items():
            logit = logit + curve * float(config["tenure_effects"][name][cause])
        for name, spec in config["features"].items():
            logit = logit + transform_feature(name, spec["transform"]) * float(spec["coefficients"][cause])
        level = F.lit(0.0)
        for label, effect in config["organizational_level_effects"].items():
            level = F.when(F.col("organizational_level") == label, float(effect[cause])).otherwise(level)
        logits[cause] = logit + level + season * float(config["seasonality"][cause])
    scored = df.withColumn("_v", logits["voluntary"]).withColumn("_i", logits["involuntary"])
    stay, voluntary, involuntary = cause_probabilities(F.col("_v"), F.col("_i"), config["probability_limits"])
    return scored.select(
        *df.columns,
        stay.alias("stay_probability"),
        voluntary.alias("voluntary_probability"),
        involuntary.alias("involuntary_probability"),
    )


def monthly_diagnostics(scored: DataFrame, protected_levels: Sequence[str] = ()) -> DataFrame:
    """Per month: risk-set size, mean probabilities, exits by cause, protected employees."""
    exits = month_of("termination_date") == F.col("month_start")
    return scored.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("at_risk"),
        F.avg("voluntary_probability").alias("mean_voluntary_probability"),
        F.avg("involuntary_probability").alias("mean_involuntary_probability"),
        count_if(exits & (F.col("termination_type") == "Voluntary")).alias("voluntary_exits"),
        count_if(exits & (F.col("termination_type") == "Involuntary")).alias("involuntary_exits"),
        count_if(F.col("organizational_level").isin(*protected_levels)).alias("protected_employees"),
    )
