"""Queries for encoding, fitting, calibration and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as x
from stayline.operators import metrics, model, reports, resample
from stayline.operators.rank import Key, ranked
from stayline.plans.foundations import bands
from stayline.plans.registry import Tables, query, round_all
from stayline.session import settle

Y, ID, USER = "actual_attrition", "employee_id", "user_id"
NUMERIC = ["base_salary", "birth_year"]
CATEGORICAL = {"region": ["Hot", "R0", "R1", "R2", "R3", "R4", "R5"], "employment_type": ["Salaried", "Hourly"], "job_level": ["L1", "L2", "L3", "L4"]}


def split(t: Tables, period: str):
    return t["scored"].where(F.col("period") == period).drop("attrition_probability")


def encoder(t: Tables) -> model.Encoder:
    return model.fit_encoder(split(t, "train"), NUMERIC, CATEGORICAL)


def z_sql(c: str) -> str:
    value = f"COALESCE({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM tr))"
    return f"ROUND(({value} - (SELECT AVG({value}) FROM tr)) / (SELECT STDDEV_POP({value}) FROM tr), 6) AS n_{c}"


@query(
    "l1_preprocessing",
    "scored",
    "WITH tr AS (SELECT * FROM scored WHERE period = 'train') SELECT employee_id, "
    + ", ".join(z_sql(c) for c in NUMERIC)
    + ", "
    + ", ".join(f"CAST({c} = '{v}' AS INT)::DOUBLE AS c_{c}_{v.lower()}" for c, vs in CATEGORICAL.items() for v in vs[1:])
    + " FROM scored WHERE period = 'validation'",
)
def _(t: Tables):
    return round_all(encoder(t).transform(split(t, "validation"), [ID]))


@query("l1_fitted_values", "scored")
def _(t: Tables):
    return round_all(encoder(t).table(t.spark))


def fitted(t: Tables):
    enc = encoder(t)
    encoded = settle(enc.transform(split(t, "train"), [ID, USER, Y]))
    return enc, encoded, model.fit_logistic(encoded, enc.columns, Y)


@query("l2_logistic_scores", "scored")
def _(t: Tables):
    enc = encoder(t)
    fit = model.fit_candidate("Logistic Regression", enc.transform(split(t, "train"), [Y]), enc.columns, Y)
    scored = model.score_candidate(fit, enc.transform(split(t, "validation"), [ID, Y]), enc.columns, [ID, Y])
    return round_all(metrics.rank_metrics(scored, "score", Y), 4)


@query("l2_grouped_logistic", "scored")
def _(t: Tables):
    return round_all(fitted(t)[2].table(t.spark), 4)


@query("l3_tree_ensembles", "scored")
def _(t: Tables):
    enc = encoder(t)
    scores, table = model.compare_candidates(
        split(t, "train"), split(t, "validation"), enc, Y, ID, ("Random Forest", "Gradient Boosting")
    )
    return round_all(table.select("model", "rows", "pr_auc", "roc_auc", "brier_score"), 4)


@query(
    "l4_prior_baseline",
    "scored",
    "SELECT employee_id, ROUND((SELECT AVG(actual_attrition) FROM scored WHERE period = 'train'), 8) AS score FROM scored WHERE period = 'validation'",
)
def _(t: Tables):
    return round_all(model.prior_score(split(t, "train"), split(t, "validation"), Y).select(ID, "score"), 8)


SIMPLEST_FIRST = ["Logistic Regression", "Gradient Boosting", "Random Forest"]


def candidates(t: Tables):
    return model.compare_candidates(split(t, "train"), split(t, "validation"), encoder(t), Y, ID, SIMPLEST_FIRST)


@query("l5_candidate_choice", "scored")
def _(t: Tables):
    scores, table = candidates(t)
    rows = scores.select(ID, Y).distinct()
    counted = resample.bootstrap_counts(rows, ID, 500, 42, Y).join(scores.drop(Y), ID)
    drawn = settle(metrics.resampled_metrics(counted, "score", Y, ID, ["model"]).select("iteration", "model", "pr_auc"))
    pairs = resample.paired_differences(drawn, table, "model", "pr_auc")
    return round_all(model.choose_model(table, pairs, SIMPLEST_FIRST), 4)


def calibrated(t: Tables):
    enc = encoder(t)
    train = split(t, "train")
    oof = settle(model.out_of_fold_scores(train, enc, USER, ID, Y))
    calibration = model.fit_calibration(oof, Y)
    fits = model.fit_logistic(enc.transform(train, [Y]), enc.columns, Y)
    scored = fits.score(enc.transform(split(t, "validation"), [ID, Y]), out="raw_score").select(ID, Y, "raw_score")
    return oof, calibration, settle(calibration.apply(scored, "raw_score"))


@query("l6_calibration_methods", "scored")
def _(t: Tables):
    _, _, scored = calibrated(t)
    long = settle(model.calibrated_long(scored, "raw_score", [ID, Y]))
    table = metrics.calibration_metrics(long, "probability", Y, ID, ["method"])
    return round_all(table.select("method", "rows", "brier_score", "log_loss", "expected_calibration_error", "pr_auc", "roc_auc"), 4)


@query("l6_calibration_choice", "scored")
def _(t: Tables):
    _, _, scored = calibrated(t)
    long = settle(model.calibrated_long(scored, "raw_score", [ID, Y]))
    table = settle(metrics.calibration_metrics(long, "probability", Y, ID, ["method"]))
    drawn = model.calibration_bootstrap(scored, "raw_score", ID, Y, 500, 42)
    observed = table.select(F.col("method").alias("model"), "brier_score")
    pairs = resample.paired_differences(settle(drawn), observed, "model", "brier_score")
    return round_all(model.choose_calibration(table, pairs), 4)


@query("l6_out_of_fold_coverage", "scored", """SELECT COUNT(*) AS rows, COUNT(actual_attrition) AS scored, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS entity_folds FROM scored WHERE period = 'train'""")
def _(t: Tables):
    oof = model.out_of_fold_scores(split(t, "train"), encoder(t), USER, ID, Y)
    return oof.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("raw_score").alias("scored"),
        F.count_distinct(USER, "fold").alias("entity_folds"),
    )


@query("r5_repeated_model_out_of_fold", "scored")
def _(t: Tables):
    people = t["scored"].drop("attrition_probability")
    return round_all(model.repeated_out_of_fold_models(people, NUMERIC, CATEGORICAL, ID, Y, 5, 10, 9), 6)


@query(
    "l7_logit",
    "scored",
    """SELECT employee_id, ROUND(ln(p / (1 - p)), 8) AS log_odds FROM (SELECT employee_id, GREATEST(0.05, LEAST(0.95, attrition_probability))::DOUBLE AS p FROM scored)""",
)
def _(t: Tables):
    return round_all(t["scored"].select(ID, x.logit("attrition_probability", 0.05).alias("log_odds")), 8)


@query("l8_scored_population", "scored")
def _(t: Tables):
    enc = encoder(t)
    history = t["scored"].where(F.col("period") != "test").drop("attrition_probability")
    current = split(t, "test")
    oof = settle(model.out_of_fold_scores(history, enc, USER, ID, Y))
    scored = model.score_population(history, current, enc, Y, [ID, "department_name"], model.fit_calibration(oof, Y))
    scored = settle(scored.select(ID, "department_name", "attrition_probability"))
    banded = bands(scored)
    out = ranked(banded, [Key("attrition_probability", True), Key(ID)], out="risk_rank")
    summary = reports.segment_summary(
        out, "probability_band", {"average_attrition_probability": "attrition_probability", "average_rank": "risk_rank"}, {"High": 1, "Medium": 2, "Low": 3}
    )
    return round_all(summary, 3)


@query("l9_coefficient_table", "scored")
def _(t: Tables):
    enc, _, fit = fitted(t)
    return round_all(model.coefficient_table(fit, enc, t.spark), 4)


@query("l9_importance_by_source", "scored")
def _(t: Tables):
    enc, _, fit = fitted(t)
    return round_all(model.importance_by_source(model.coefficient_table(fit, enc, t.spark)), 4)


@query("l9_coefficient_stability", "scored")
def _(t: Tables):
    enc = encoder(t)
    train = split(t, "train")
    placed = settle(train.join(resample.grouped_folds(train, USER, Y, 5, 42), USER))
    copies = model.fit_copies(placed, 5)
    encoded, _, names = model.encode_per_fit(copies, copies, NUMERIC, enc.levels, [Y])
    fits = model.fit_logistic(encoded, names, Y, "fit")
    return round_all(model.coefficient_stability(fits.table(t.spark)), 4)


@query("r8_cluster_bootstrap_coefficients", "scored")
def _(t: Tables):
    enc, encoded, _ = fitted(t)
    return round_all(model.cluster_bootstrap_coefficients(encoded, enc.columns, Y, USER, 200, 11), 4)


def explained(t: Tables):
    enc, encoded, fit = fitted(t)
    beta = fit.groups[0]
    rows = fit.score(enc.transform(split(t, "test"), [ID]), out="score")
    means = model.background_means(encoded, enc.columns)
    return enc, settle(model.linear_contributions(rows, enc, beta, means, [ID, "score"]))


@query(
    "l10_linear_contributions",
    "scored",
    "SELECT employee_id, true AS adds_up FROM scored WHERE period = 'test'",
)
def _(t: Tables):
    enc, rows = explained(t)
    total = F.col("base_value")
    for raw in enc.raw_features:
        total = total + F.col(f"phi_{raw}")
    return rows.select(ID, (F.abs(total - x.logit("score", 1e-12)) < 1e-8).alias("adds_up"))


@query("l11_global_importance", "scored")
def _(t: Tables):
    enc, rows = explained(t)
    return round_all(model.global_importance(rows, enc.raw_features), 4)


@query("l12_quartile_contributions", "scored")
def _(t: Tables):
    enc, rows = explained(t)
    return round_all(model.quartile_summary(rows, enc.raw_features, "score", ID), 4)


@query("l13_driver_frequency", "scored")
def _(t: Tables):
    enc, rows = explained(t)
    return round_all(model.driver_frequency(rows, enc.raw_features), 4)


def stability(t: Tables):
    enc, _, fit = fitted(t)
    current = split(t, "test")
    scores = fit.score(enc.transform(current, [ID]), out="score").select(ID, "score")
    return model.explanation_stability(split(t, "train"), current.join(scores, ID), enc, USER, ID, Y, "score", top_k=3)


@query("l14_explanation_stability", "scored")
def _(t: Tables):
    return round_all(stability(t)[2], 4)


@query("l14_fold_agreement", "scored")
def _(t: Tables):
    return round_all(stability(t)[1], 4)


@query("m11_grouped_fold_fits", "scored")
def _(t: Tables):
    train = split(t, "train")
    oof = settle(model.out_of_fold_scores(train, encoder(t), USER, ID, Y).withColumn("model", F.lit("Logistic Regression")))
    return round_all(metrics.fold_robustness(oof, "raw_score", Y, ID, "model", "fold")[0], 4)

