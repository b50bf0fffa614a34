"""Calibrated folds with a row per row: each step against the one that copies rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions.expr import draw
from stayline.operators import calibrated, isotonic, model, rank, resample

NUMERIC, KINDS = ["pay", "age"], {"kind": ["a", "b", "c"]}
FOLDS, REPEATS, INNER, SEED = 3, 2, 2, 5
FITS = FOLDS * REPEATS * INNER


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        pay, age = float(np.round(rng.normal(), 2)), None if i % 13 == 0 else int(rng.integers(20, 40))
        rows.append((i, None if i % 11 == 0 else pay, age, None if i % 7 == 0 else "abcdx"[i % 5], int(rng.random() < 1 / (1 + np.exp(-pay)))))
    rows += rows[:30]
    return spark.createDataFrame(rows, "id long, pay double, age int, kind string, y int").repartition(3)


@pytest.fixture(scope="module")
def dealt(people):
    patch = pytest.MonkeyPatch()
    patch.setattr(calibrated, "ORDERED", 150)
    patch.setattr(calibrated, "BLOCK_BITS", 6)
    number = ((F.col("repeat") - 1) * FOLDS + F.col("fold")).cast("int")
    held = resample.row_folds(people, "id", "y", FOLDS, SEED, REPEATS).groupBy("id").agg(F.collect_list(number).alias("_held"))
    out = calibrated.deal_parts(people.join(held, "id"), "id", "y", FOLDS, REPEATS, INNER, SEED)
    patch.undo()
    return out


@pytest.fixture(scope="module")
def copies(dealt):
    return dealt.withColumn("fit", F.explode(F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i + 1, n)))))


def test_parts_are_ranks_by_hash(dealt):
    entries = dealt.select("id", "y", F.explode("_held").alias("k"))
    head = F.col("k") - F.pmod(F.col("k") - 1, F.lit(FOLDS))
    outer = entries.withColumn("outer", F.explode(F.sequence(head, head + FOLDS - 1))).where("outer <> k")
    hashed = outer.withColumn("_h", draw(str(SEED), F.lit("inner"), F.col("outer"), F.col("id")))
    ranks = rank.ranked(hashed, [rank.Key("_h"), rank.Key("id")], ["outer", "y"], out="_r").withColumn("part", (F.col("_r") - 1) % INNER)
    expected = {}
    for r in ranks.collect():
        counts = expected.setdefault(r.id, np.zeros(FITS, int))
        for part in range(INNER):
            counts[(r.outer - 1) * INNER + part] += part != r.part
    found = {}
    for r in dealt.collect():
        found[r.id] = found.get(r.id, 0) + np.array(r.counts)
    assert found.keys() == expected.keys() and all((found[i] == expected[i]).all() for i in found)


def test_encoders_equal_those_of_copies(dealt, copies, monkeypatch):
    expected = {r["fit"]: r.asDict() for r in model.encoders_per_fit(copies, NUMERIC, KINDS).collect()}
    for cells in (4096, 5):
        monkeypatch.setattr(calibrated, "VALUE_CELLS", cells)
        got = calibrated.encoders_of_counts(dealt, NUMERIC, list(KINDS), FITS)
        assert sorted(got) == sorted(expected) == list(range(1, FITS + 1))
        for g, values in got.items():
            assert values.pop("_o_0") == expected[g]["_o_0"]
            assert all(v == pytest.approx(expected[g][k], rel=1e-12) for k, v in values.items())


def test_scores_pools_and_values_equal_those_of_copies(dealt, copies, monkeypatch):
    train, held, names = model.encode_per_fit(copies, dealt.withColumn("fit", F.explode(F.sequence(F.lit(1), F.lit(FITS)))), NUMERIC, KINDS, ["id", "y"])
    fits = model.fit_logistic(train, names, "y", "fit")
    expected = {(r.id, r.fit): r.raw for r in model.score_by_fit(held, fits, "raw").collect()}
    found = calibrated.encoders_of_counts(dealt, NUMERIC, list(KINDS), FITS)
    scorer, features = calibrated.FoldScorer.of(fits.groups, found, NUMERIC, KINDS), calibrated.feature_columns(NUMERIC, list(KINDS))
    known = calibrated.known_scores(dealt, "y", scorer, features, INNER)
    asked = calibrated.held_scores(dealt, "id", scorer, features, FOLDS, INNER)
    assert known.count() == (FOLDS - 1) * asked.count() // INNER
    assert all(r.raw == pytest.approx(expected[r.id, r.fit], abs=1e-9) for r in asked.collect())
    whole = isotonic.isotonic_pools(known, "raw", "y", ["fit"])
    plain = sorted(tuple(r) for r in whole.collect())
    for cells in (8192, 40, 6):
        monkeypatch.setattr(calibrated, "SCORE_CELLS", cells)
        pools = calibrated.pools_of_known(dealt, "id", "y", scorer, features, INNER)
        assert sorted(tuple(r) for r in pools.collect()) == plain
    few = whole.select("fit", "low", "high", "value").collect()
    means = calibrated.mean_calibrated(dealt, "id", scorer, features, few, FOLDS, REPEATS, INNER)
    long = isotonic.apply_isotonic(asked, whole, "raw", ["fit"], "score").groupBy("id", "repeat").agg(F.avg("score").alias("score"))
    found, expected = ({(r["id"], r["repeat"]): r["score"] for r in t.collect()} for t in (means, long))
    assert len(found) == 900 * REPEATS and found == pytest.approx(expected, abs=1e-12)


def test_cells_without_ends_of_pools_stay_closed():
    rng = np.random.default_rng(1)
    n = np.full(4000, 50.0)
    p = rng.binomial(50, 0.3, 4000).astype(float)
    open_, runs = calibrated._open_cells(n, p)
    assert len(open_) < 1000
    assert sum(r[1] for r in runs) + n[open_].sum() == n.sum() and sum(r[2] for r in runs) + p[open_].sum() == p.sum()


def test_many_pools_are_joined_to_the_rows(people, monkeypatch):
    few = model.repeated_calibrated_models(people, NUMERIC, KINDS, "id", "y", FOLDS, REPEATS, INNER, SEED)
    few = {r.id: (r.mean_score, r.scores, r.covered) for r in few.collect()}
    monkeypatch.setattr(model, "MAX_POOLS", 3)
    many = model.repeated_calibrated_models(people, NUMERIC, KINDS, "id", "y", FOLDS, REPEATS, INNER, SEED)
    many = {r.id: (r.mean_score, r.scores, r.covered) for r in many.collect()}
    assert len(few) == 900 and all(few[i][1:] == many[i][1:] == (REPEATS, True) and few[i][0] == pytest.approx(many[i][0], abs=1e-12) for i in few)


def test_a_column_without_values_leaves_no_calibration(people):
    rows = people.withColumn("pay", F.lit(None).cast("double"))
    assert model.repeated_calibrated_models(rows, NUMERIC, KINDS, "id", "y", FOLDS, REPEATS, INNER, SEED).count() == 0
