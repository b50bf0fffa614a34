"""Isotonic fits of many groups, bootstrap counts in place, blocked sums and the triangular factor against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import association, diff, gram, isotonic, metrics, model, multinomial, resample, survival
from stayline.sources import tables
from stayline.sources.contracts import Contract


def naive_isotonic(x, y, w):
    """Fitted value per distinct score: the largest over left ends of the least mean over right ends."""
    out = {}
    xs = sorted(set(x))
    s = [sum(b * c for a, b, c in zip(x, y, w) if a == v) for v in xs]
    n = [sum(c for a, c in zip(x, w) if a == v) for v in xs]
    for i, v in enumerate(xs):
        out[v] = max(min(sum(s[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(xs))) for a in range(i + 1))
    return out


@pytest.mark.parametrize("block", [2, 5, 50_000])
def test_isotonic_groups(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", "b", None):
        for _ in range(60):
            x = float(rng.integers(0, 25))
            rows.append((g, x, int(rng.random() < (x / 25 if g != "b" else 1 - x / 25)), float(rng.integers(1, 4))))
    rows += [("a", None, 1, 1.0), ("a", 3.0, None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y int, w double")
    pools = isotonic.isotonic_pools(frame, "x", "y", ["g"], "w", block).collect()
    for g in ("a", "b", None):
        mine = [r for r in rows if r[0] == g and r[1] is not None and r[2] is not None]
        want = naive_isotonic(*zip(*[r[1:] for r in mine]))
        got = sorted((p.low, p.high, p.value) for p in pools if p.g == g)
        assert [v for _, _, v in got] == sorted(v for _, _, v in got) and len({v for _, _, v in got}) == len(got)
        assert {x: next(v for a, b, v in got if a <= x <= b) for x in want} == pytest.approx(want)
    assert isotonic.isotonic_pools(frame.limit(0), "x", "y", ["g"]).count() == 0


@pytest.mark.parametrize("block", [3, 50_000])
def test_isotonic_between_pools(spark, block):
    pools = spark.createDataFrame([("a", 1.0, 2.0, 0.1), ("a", 4.0, 4.0, 0.5), ("a", 6.0, 9.0, 0.9)], "g string, low double, high double, value double")
    xs = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0]
    rows = spark.createDataFrame([("a", x, i) for i, x in enumerate([*xs, None])] + [("none", 1.0, 99)], "g string, x double, i int")
    got = {r.i: r.isotonic for r in isotonic.apply_isotonic(rows, pools, "x", ["g"], block=block).collect()}
    assert [got[i] for i in range(len(xs))] == pytest.approx(np.interp(xs, [1, 2, 4, 6, 9], [0.1, 0.1, 0.5, 0.9, 0.9]))
    assert got[len(xs)] is None and got[99] is None and len(got) == len(xs) + 2


def test_count_tree(monkeypatch):
    monkeypatch.setattr(multinomial, "LEAF", 16)
    tree = multinomial.CountTree(301, 40, 7, 1)
    before, whole = tree.range(0, 301)
    assert not before.any() and (whole.sum(axis=0) == 301).all()
    for begin, end in ((0, 10), (13, 14), (15, 120), (290, 301), (301, 301), (50, 50)):
        before, part = tree.range(begin, end)
        assert (before == whole[:begin].sum(axis=0)).all() and (part == whole[begin:end]).all()
    counts = multinomial.CountTree(97, 4000, 1, 0).range(0, 97)[1]
    assert abs(counts.mean(axis=1) - 1).max() < 0.1 and abs(counts.var(axis=1) - (1 - 1 / 97)).max() < 0.15
    assert abs(np.cov(counts[3], counts[60])[0, 1] + 1 / 97) < 0.06
    assert multinomial.CountTree(0, 3, 1, 0).range(0, 0)[1].shape == (0, 3)


@pytest.mark.parametrize("rows", [7, 20_000])
def test_grid_of_resamples(spark, rows, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, float(rng.integers(0, 12)) / 12, int(rng.random() < 0.3)) for i in range(60)]
    frame = spark.createDataFrame(data, "id long, s double, y int").repartition(5)
    fractions, iterations = [0.05, 0.1, 0.5, 1.0], 30
    got = {(r.requested_fraction, r.iteration): r for r in multinomial.bootstrap_grid(frame, "s", "y", "id", fractions, iterations, 5, rows).collect()}
    ordered = sorted(data, key=lambda r: (-r[1], r[0]))
    label = np.array([r[2] for r in ordered])
    weights = np.zeros((60, iterations), int)
    for c in (0, 1):
        n = int((label == c).sum())
        weights[label == c] = multinomial.CountTree(n, iterations, 5, c).range(0, n)[1]
    assert len(got) == len(fractions) * iterations
    for f in fractions:
        k = max(1, math.ceil(60 * f))
        for t in range(iterations):
            drawn = np.repeat(label, weights[:, t])
            assert got[f, t + 1].selected_count == k and got[f, t + 1].captured_positive_cases == drawn[:k].sum()
    intervals = multinomial.grid_intervals(multinomial.bootstrap_grid(frame, "s", "y", "id", fractions, iterations, 5)).collect()
    assert len(intervals) == 3 * len(fractions) and all(r.lower <= r.bootstrap_mean <= r.upper for r in intervals)
    counts = multinomial.bootstrap_counts(frame, "id", "y", iterations, 5, 7).collect()
    assert (np.sum([r.counts for r in counts], axis=0) == 60).all() and len(counts) == 60


def test_blocked_sums(spark):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(200, 60)), rng.integers(0, 2, 200), rng.random(200)
    names = [f"x{i}" for i in range(60)]
    rows = [(int(i % 3), float(w[i]), float(y[i]), *map(float, x[i])) for i in range(200)]
    frame = spark.createDataFrame(rows, "_g int, _w double, _y double, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    betas = {g: rng.normal(size=61) / 10 for g in (0, 2)}
    got = gram.logistic_sums(frame, names, betas)
    assert set(got) == {0, 2}
    for g, beta in betas.items():
        at = np.arange(200) % 3 == g
        design = np.column_stack([np.ones(at.sum()), x[at]])
        p = 1 / (1 + np.exp(-design @ beta))
        assert got[g][0] == pytest.approx(-(w[at] * (y[at] * np.log(p) + (1 - y[at]) * np.log(1 - p))).sum())
        assert got[g][1] == pytest.approx(design.T @ (w[at] * (y[at] - p)))
        assert got[g][2] == pytest.approx(design.T @ (design * (w[at] * p * (1 - p))[:, None]))


def test_triangular_factor_keeps_small_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x = np.column_stack([x, x[:, 0] + 1e-10 * rng.normal(size=400)])
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(40)
    vif, summary = association.matrix_diagnostics(frame, ["a", "b", "c", "d"])
    values = {r.metric: r.value for r in summary.collect()}
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    s = np.linalg.svd(scaled, compute_uv=False)
    assert values["Matrix rank"] == 4 and values["Condition number"] == pytest.approx(s[0] / s[-1], rel=1e-3) and values["Condition number"] > 1e10
    levels = {r.encoded_feature: r.assessment for r in vif.collect()}
    assert levels == {"a": "High", "b": "Acceptable", "c": "Acceptable", "d": "High"}
    twice = association.matrix_diagnostics(frame.withColumn("d", 2 * F.col("a")).withColumn("e", F.lit(1.0)), ["a", "b", "c", "d", "e"])[1]
    assert {r.metric: r.value for r in twice.collect()}["Matrix rank"] == 3


def test_calibrated_folds(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        x = rng.normal()
        rows.append((i, float(x) if i % 17 else None, "ab"[i % 2], int(rng.random() < 1 / (1 + math.exp(-2 * x)))))
    frame = spark.createDataFrame(rows, "id long, x double, k string, y int")
    for method in ("isotonic", "sigmoid"):
        got = model.repeated_calibrated_models(frame, ["x"], {"k": ["a", "b"]}, "id", "y", 3, 2, 2, 1, method=method).collect()
        assert len(got) == 240 and all(r.covered and 0 <= r.mean_score <= 1 for r in got)
        scored = spark.createDataFrame([(r.id, r.mean_score, rows[r.id][3]) for r in got], "id long, s double, y int")
        assert metrics.rank_metrics(scored, "s", "y").first().roc_auc > 0.75
        assert abs(np.mean([r.mean_score for r in got]) - np.mean([r[3] for r in rows])) < 0.08


def test_held_out_rows_do_not_encode(spark):
    """A held-out row's own value moves no median, mean or deviation of the fit that scores it."""
    rows = [(i, i // 2, float(i % 7), "ab"[i % 2], int(i % 3 == 0)) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, user long, x double, k string, y int")
    encoder = model.fit_encoder(frame, ["x"], {"k": ["a", "b"]})
    base = {r.id: (r.fold, r.raw_score) for r in model.out_of_fold_scores(frame, encoder, "user", "id", "y", 3, 1).collect()}
    moved = frame.withColumn("x", F.when(F.col("user") == 4, 1e6).otherwise(F.col("x")))
    other = {r.id: (r.fold, r.raw_score) for r in model.out_of_fold_scores(moved, encoder, "user", "id", "y", 3, 1).collect()}
    fold = base[8][0]
    same = [i for i in base if base[i][0] == fold and i not in (8, 9)]
    assert same and all(base[i][1] == pytest.approx(other[i][1], abs=1e-9) for i in same)


def test_balanced_folds(spark):
    """Rows and positives of the folds differ by no more than the largest entity, however unequal entities are."""
    rng = np.random.default_rng(12)
    for sizes in ([1] * 200, [100, 60, 50, 40, 40, 30, 30] + [3] * 40 + [1] * 90, [1, 2]):
        rows, key = [], 0
        for entity, n in enumerate(sizes):
            for _ in range(n):
                rows.append((entity, int(rng.random() < 0.3)))
                key += 1
        frame = spark.createDataFrame(rows, "e long, y int")
        folds = {r.e: r.fold for r in resample.balanced_folds(frame, "e", "y", 5, 3).collect()}
        assert len(folds) == len(sizes) and set(folds.values()) <= {1, 2, 3, 4, 5}
        n = [sum(folds[e] == f for e, _ in rows) for f in range(1, 6)]
        p = [sum(y for e, y in rows if folds[e] == f) for f in range(1, 6)]
        most = max(sum(y for e, y in rows if e == k) for k in range(len(sizes)))
        assert max(n) - min(n) <= max(sizes) and max(p) - min(p) <= most + 1


def test_log_rank_of_many_groups(spark):
    rng = np.random.default_rng(9)
    k = 300
    rows = [(f"g{int(rng.integers(0, k))}", int(rng.exponential(40)) + 1, int(rng.random() < 0.6)) for _ in range(3000)] + [(None, 3, 1), (None, 9, 0)]
    frame = spark.createDataFrame(rows, "g string, t int, e int").repartition(5)
    names = sorted({g or "Missing" for g, _, _ in rows})
    group = np.array([names.index(g or "Missing") for g, _, _ in rows])
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    gap, covariance = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for moment in np.unique(t[e == 1]):
        at = np.bincount(group[t >= moment], minlength=len(names)).astype(float)
        here = np.bincount(group[(t == moment) & (e == 1)], minlength=len(names)).astype(float)
        n, d = at.sum(), here.sum()
        if n > 1:
            gap += here - d * at / n
            covariance += d * (n - d) / (n - 1) * (np.diag(at / n) - np.outer(at, at) / n**2)
    want = gap @ np.linalg.pinv(covariance) @ gap
    got = survival.log_rank_test(frame, ["g"], "t", "e").first()
    assert got.groups == len(names) and got.test_statistic == pytest.approx(want, rel=1e-6)
    assert survival.log_rank_test(frame.where("g = 'g1'"), ["g"], "t", "e").first().p_value == 1.0


def test_located_differences(spark):
    rows = [(i, f"t{i % 5}", i / 7, None if i % 11 == 0 else i % 2 == 0) for i in range(500)]
    first = spark.createDataFrame(rows, "k long, s string, v double, b boolean")
    changed = [(k, "new" if k == 17 else s, v + (1e-12 if k % 2 else 0) + (k == 300), None if k == 40 else b) for k, s, v, b in rows if k != 99] + [(900, "x", 1.0, None)]
    second = spark.createDataFrame(changed, first.schema).repartition(4)
    classes = {"s": "exact_text", "v": "tolerant_numeric", "b": "boolean"}
    for per, fan in ((10, 2), (10, 64), (1000, 64)):
        found = {(r.k, r.feature) for r in diff.located_differences(first, second, ["k"], classes, 8, per, fan).collect()}
        assert found == {(17, "s"), (300, "v"), (40, "b")} | {(k, c) for k in (99, 900) for c in "svb"}
    assert diff.located_differences(first, first.repartition(9), ["k"], classes, 8, 10, 4).count() == 0


def test_counts_while_loading(spark, tmp_path):
    contract = Contract("things", ("k",), "k int, name string, day date")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "things.csv").write_text("k,name,day\n" + "".join(f"{i},n{i},2020-01-0{1 + i % 9}\n" for i in range(50)))
    loaded = tables.bulk_load(spark, str(tmp_path / "in"), str(tmp_path / "out"), [contract]).first().asDict()
    assert loaded.pop("table_name") == "things" and loaded == tables.fingerprint(spark.read.parquet(str(tmp_path / "out/things"))).first().asDict()


def test_tied_sums_in_closed_form(monkeypatch):
    d, s0, d0 = np.array([5000.0, 3000.0, 7.0]), np.array([9000.0, 2000.5, 30.0]), np.array([4500.0, 1999.0, 4.0])
    direct = survival.efron_sums(d, s0, d0)
    monkeypatch.setattr(survival, "DIRECT_TIES", 100)
    assert survival.efron_sums(d, s0, d0) == pytest.approx(direct, rel=1e-9)


def test_cox_of_all_folds_together(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    t = np.ceil(rng.exponential(12 * np.exp(-x[:, 0]))).astype(int)
    rows = [(i, int(i % 3) + 1, int(t[i]), int(rng.random() < 0.7), *map(float, x[i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, fold int, t int, e int, a double, b double, c double").repartition(6)
    together = survival.fit_cox_without(frame, ["a", "b", "c"], "t", "e", [1, 2, 3], "fold")
    assert set(together) == {1, 2, 3}
    for k, fit in together.items():
        alone = survival.fit_cox(frame.where(F.col("fold") != k), ["a", "b", "c"], "t", "e")
        assert fit.beta == pytest.approx(alone.beta, abs=1e-6) and fit.converged
        assert fit.covariance == pytest.approx(alone.covariance, rel=1e-5) and fit.log_likelihood == pytest.approx(alone.log_likelihood)
