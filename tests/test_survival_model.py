"""Survival tables, Cox fits, concordance and logistic fits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import metrics, model, resample, survival


@pytest.fixture(scope="module")
def lives(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(40 * np.exp(-0.6 * x[:, 0] + 0.3 * x[:, 1])))
    e = (rng.random(n) < 0.7).astype(int)
    rows = [(i, float(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, t double, e int, a double, b double").persist()


def test_curve_is_the_product_limit_in_small_ranges(lives):
    rows = survival.kaplan_meier(lives, "t", "e", rows_per_bucket=20).orderBy("t").collect()
    data = lives.toPandas()
    s = 1.0
    for r in rows:
        n, d = (data.t >= r.t).sum(), ((data.t == r.t) & (data.e == 1)).sum()
        s *= 1 - d / n
        assert r.at_risk == n and r.events == d and abs(r.survival - s) < 1e-9


def test_last_exit_ends_the_curve(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "t double, e int")
    rows = survival.kaplan_meier(df, "t", "e").orderBy("t").collect()
    assert [round(r.survival, 6) for r in rows] == [0.666667, 0.666667, 0.0]
    horizons = survival.horizon_summary(survival.kaplan_meier(df, "t", "e"), "t", [0.5, 1, 3]).orderBy("horizon_months").collect()
    assert [round(r.retention_probability, 6) for r in horizons] == [1.0, 0.666667, 0.0]


def test_chi_square_tail():
    assert abs(survival.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(survival.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9


def efron(data, beta, penalizer):
    ll, x = 0.0, data[["a", "b"]].to_numpy()
    eta = x @ beta
    r = np.exp(eta)
    for t in sorted(set(data.t[data.e == 1])):
        risk, dead = (data.t >= t).to_numpy(), ((data.t == t) & (data.e == 1)).to_numpy()
        d = dead.sum()
        ll += eta[dead].sum() - sum(math.log(r[risk].sum() - l / d * r[dead].sum()) for l in range(d))
    return ll / len(data) - 0.5 * penalizer * (beta**2 @ x.var(axis=0, ddof=1))


def test_cox_maximises_the_penalised_efron_likelihood(lives, monkeypatch):
    monkeypatch.setattr(survival, "TIES_PER_ROW", 2)
    fit = survival.fit_cox(lives, ["a", "b"], "t", "e", 0.05)
    data = lives.toPandas()
    best = efron(data, fit.beta, 0.05)
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert efron(data, fit.beta + np.array(step), 0.05) < best
    assert fit.converged and fit.beta[0] > 0.3 and fit.beta[1] < 0.0
    table = survival.hazard_ratios(fit, lives).collect()
    assert all(r.hazard_ratio_lower_95 < r.hazard_ratio < r.hazard_ratio_upper_95 for r in table)
    check = survival.proportionality_check(lives, fit, "t", "e").collect()
    assert all(0 <= r.p <= 1 for r in check)


def test_cox_does_not_depend_on_the_unit_of_a_feature(lives):
    fit = survival.fit_cox(lives, ["a", "b"], "t", "e", 0.5)
    other = survival.fit_cox(lives.withColumn("a", F.col("a") * 1000), ["a", "b"], "t", "e", 0.5)
    assert np.allclose(fit.beta * [1e-3, 1], other.beta, rtol=1e-4)
    with pytest.warns(RuntimeWarning):
        assert not survival.fit_cox(lives, ["a", "b"], "t", "e", 0.05, maximum=1).converged


def schoenfeld(data, beta):
    """Per exit time: the exits' features minus the Efron means of the risk set."""
    x, out = data[["a", "b"]].to_numpy(), []
    r = np.exp(x @ beta)
    for t in sorted(set(data.t[data.e == 1])):
        risk, dead = (data.t >= t).to_numpy(), ((data.t == t) & (data.e == 1)).to_numpy()
        d, total = dead.sum(), x[dead].sum(axis=0)
        for l in range(d):
            w = np.where(risk, r, 0) - l / d * np.where(dead, r, 0)
            total = total - w @ x / w.sum()
        out.append((t, d, total))
    return out


def test_proportionality_uses_the_tied_means_of_the_fit(lives):
    fit = survival.fit_cox(lives, ["a", "b"], "t", "e", 0.05)
    times = schoenfeld(lives.toPandas(), fit.beta)
    sizes = np.array([d for _, d, _ in times], float)
    ranks = np.cumsum(sizes) - (sizes - 1) / 2
    centred = ranks - (sizes @ ranks) / sizes.sum()
    u = centred @ np.array([r for _, _, r in times])
    spread, events = sizes @ centred**2, sizes.sum()
    want = (events * fit.covariance @ u) ** 2 / (events * np.diag(fit.covariance) * spread)
    got = [r.test_statistic for r in survival.proportionality_check(lives, fit, "t", "e").collect()]
    assert np.allclose(got, want, rtol=1e-6)


def test_concordance_counts_pairs_exactly(lives):
    scored = lives.withColumn("s", F.round("a", 1))
    row = survival.concordance(scored, "s", "t", "e").first()
    d = scored.toPandas()
    comparable = concordant = tied = 0
    for i in d.itertuples():
        if i.e != 1:
            continue
        later = d[(d.t > i.t) | ((d.t == i.t) & (d.e == 0))]
        comparable += len(later)
        concordant += (later.s < i.s).sum()
        tied += (later.s == i.s).sum()
    assert (row.comparable_pairs, row.concordant_pairs, row.tied_pairs) == (comparable, concordant, tied)


def test_hire_notes_must_parse(spark):
    events = spark.createDataFrame([(1, "Hire", "location_id=3"), (2, "Hire", "none")], "employee_id int, event_type string, notes string")
    with pytest.raises(ValueError, match="lack"):
        survival.parse_hire_notes(events, {"location_id": "loc"})
    twice = events.where("employee_id = 1").unionAll(events.where("employee_id = 1"))
    with pytest.raises(ValueError, match="repeat"):
        survival.parse_hire_notes(twice, {"location_id": "loc"})


def test_inclusive_duration(spark):
    import datetime as dt

    people = spark.createDataFrame(
        [(1, dt.date(2025, 1, 1), dt.date(2025, 12, 31), 1990, "Salaried", "Master", "Manager")],
        "employee_id int, hire_date date, termination_date date, birth_year int, employment_type string, education_level string, organizational_level string",
    )
    hire = spark.createDataFrame([(1, 5, 7)], "employee_id int, hire_location_id int, hire_job_role_id int")
    pay = spark.createDataFrame([(1, 70e3)], "employee_id int, hire_base_salary double")
    places = spark.createDataFrame([(5, "North")], "location_id int, region string")
    roles = spark.createDataFrame([(7, "Ops", 2, 60e3, 100e3)], "job_role_id int, job_family string, job_level int, salary_band_min double, salary_band_max double")
    row = survival.survival_cohort(people, hire, pay, places, roles, "2026-06-30", ["Manager"]).first()
    assert row.duration_days == 365 and row.event_observed == 1 and row.salary_position_at_hire == 0.875


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(11)
    n = 600
    z, g = rng.normal(size=n), rng.integers(0, 3, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.8 * z + 0.5 * (g == 1))))).astype(int)
    rows = [(i, i // 3, float(z[i]) if i % 20 else None, f"g{g[i]}", int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, who int, z double, g string, y int").persist()


@pytest.fixture(scope="module")
def encoded(cases):
    enc = model.fit_encoder(cases, ["z"], {"g": ["g0", "g1", "g2"]})
    return enc, enc.transform(cases, ["id", "who", "y"]).persist()


def penalised_logit(x, y, w, c):
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    ridge = np.r_[0.0, np.full(x.shape[1] - 1, 1 / c)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
    return beta


def test_logistic_matches_numpy(encoded):
    enc, frame = encoded
    fit = model.fit_logistic(frame, enc.columns, "y").groups[0]
    d = frame.toPandas()
    w = np.where(d.y == 1, len(d) / (2 * d.y.sum()), len(d) / (2 * (1 - d.y).sum()))
    assert np.allclose(fit, penalised_logit(d[enc.columns].to_numpy(), d.y.to_numpy(), w, 1.0), atol=1e-6)


def test_separable_rows_are_reported(spark):
    frame = spark.createDataFrame([(float(i), int(i > 100)) for i in range(200)], "v double, y int")
    with pytest.warns(RuntimeWarning):
        fit = model.fit_logistic(frame, ["v"], "y", c=1e12)
    assert fit.unfinished == {0} and not fit.table(spark).first().converged


def test_single_and_grouped_fits_agree(encoded):
    enc, frame = encoded
    mllib = model.fit_candidate("Logistic Regression", frame, enc.columns, "y")
    ours = model.fit_logistic(frame, enc.columns, "y").groups[0]
    assert np.allclose(np.r_[mllib.intercept, mllib.coefficients.toArray()], ours, atol=1e-3)


def test_contributions_add_up(encoded):
    enc, frame = encoded
    fit = model.fit_logistic(frame, enc.columns, "y")
    scored = fit.score(frame)
    means = model.background_means(frame, enc.columns)
    out = model.linear_contributions(scored, enc, fit.groups[0], means, ["score"]).collect()
    for r in out:
        assert abs(r.base_value + r.phi_z + r.phi_g - math.log(r.score / (1 - r.score))) < 1e-9


def test_out_of_fold_scores_and_calibration(cases, encoded):
    enc, _ = encoded
    oof = model.out_of_fold_scores(cases, enc, "who", "id", "y", folds=4).persist()
    assert oof.count() == 600 and oof.where("raw_score is null").count() == 0
    assert oof.select("who", "fold").distinct().count() == 200
    calibrated = model.fit_calibration(oof, "y").apply(oof, "raw_score")
    rows = calibrated.orderBy("raw_score").collect()
    for name in ("sigmoid", "isotonic"):
        values = [r[name] for r in rows]
        assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))
    assert abs(np.mean([r.sigmoid for r in rows]) - np.mean([r.y for r in rows])) < 1e-4


def test_repeated_models_match_one_encoder_and_fit_per_fold(cases):
    levels = {"g": ["g0", "g1", "g2"]}
    got = {r.id: r for r in model.repeated_out_of_fold_models(cases, ["z"], levels, "id", "y", folds=3, repeats=2, seed=5).collect()}
    data = cases.toPandas().merge(resample.row_folds(cases, "id", "y", 3, 5, 2).toPandas(), on="id")
    data["score"] = 0.0
    for (_, k), held in data.groupby(["repeat", "fold"]):
        train = data[(data["repeat"] == held["repeat"].iloc[0]) & (data.fold != k)]
        filled = train.z.fillna(train.z.median())
        x = [np.c_[(d.z.fillna(train.z.median()) - filled.mean()) / filled.std(ddof=0), d.g == "g1", d.g == "g2"] for d in (train, held)]
        w = np.where(train.y == 1, len(train) / (2 * train.y.sum()), len(train) / (2 * (1 - train.y).sum()))
        beta = penalised_logit(x[0].astype(float), train.y.to_numpy(), w, 1.0)
        data.loc[held.index, "score"] = 1 / (1 + np.exp(-(beta[0] + x[1].astype(float) @ beta[1:])))
    want = data.groupby("id").score.mean()
    assert len(got) == 600 and all(r.covered and r.scores == 2 and abs(r.mean_score - want[i]) < 1e-6 for i, r in got.items())


def test_encoder_round_trip(spark, cases, encoded):
    enc, frame = encoded
    again = model.Encoder.from_table(enc.table(spark))
    assert again.transform(cases, ["id"]).exceptAll(frame.select("id", *enc.columns)).count() == 0


def test_unknown_category_is_all_zero(spark, encoded):
    enc, _ = encoded
    row = enc.transform(spark.createDataFrame([(0.0, "new")], "z double, g string"), []).first()
    assert row.c_g_g1 == 0.0 and row.c_g_g2 == 0.0


def test_bootstrap_keeps_class_sizes(cases):
    weights = resample.bootstrap_weights(cases, "id", 20, 1, "y")
    sizes = cases.groupBy("y").count().collect()
    totals = weights.groupBy("iteration", "y").agg(F.sum("weight").alias("n")).collect()
    assert len(totals) == 40 and {(r.y, r.n) for r in totals} == {(r.y, r["count"]) for r in sizes}


def test_grouped_folds_are_disjoint_and_balanced(cases):
    folds = resample.grouped_folds(cases, "who", "y", 5, 42)
    assert folds.count() == 200 and folds.select("who").distinct().count() == 200
    rates = [r.positive_rate for r in resample.fold_summary(cases, folds, "who", "y").collect()]
    assert max(rates) - min(rates) < 0.06


def test_auc_and_average_precision_with_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    r = metrics.rank_metrics(df, "s", "y").first()
    wins = sum((a > b) + 0.5 * (a == b) for a, ya in rows if ya for b, yb in rows if not yb)
    assert abs(r.roc_auc - wins / 9) < 1e-12
    assert abs(r.pr_auc - (1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 6)) < 1e-12
    assert metrics.rank_metrics(df.where("y = 0"), "s", "y").first().roc_auc is None


def test_explanations_of_folds_store_no_copies_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, i // 2, float(a), "xyz"[i % 3], int(a + rng.normal() > 0), float(rng.random())) for i, a in enumerate(rng.normal(size=300))]
    frame = spark.createDataFrame(rows, "id long, who long, a double, kind string, y int, score double")
    encoder = model.fit_encoder(frame, ["a"], {"kind": ["x", "y", "z"]})
    stored, keep = [], model.settle

    def counted(df):
        out = keep(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(model, "settle", counted)
    features, agreement, _ = model.explanation_stability(frame, frame, encoder, "who", "id", "y", "score", top_k=1)
    found = {(r.fold, r.raw_feature): r for r in features.collect()}
    assert len(found) == 10 and agreement.count() == 10
    assert all(found[k, "a"].importance_rank == 1 and found[k, "a"].mean_absolute_shap_log_odds > 0.5 for k in range(1, 6))
    assert stored and max(stored) <= len(rows)
