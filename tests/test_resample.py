"""Bootstrap draws counted in blocks, and what is computed from the counts, against a replay of every draw."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.operators import metrics, model, resample


def replay(ids, iterations, seed, stratum=None):
    """Draws of each (iteration, id): slot i of an iteration takes the row that its md5 names."""
    ids = sorted(ids)
    out = Counter()
    for i in range(1, iterations + 1):
        for slot in range(1, len(ids) + 1):
            text = "|".join(str(p) for p in (seed, i, stratum, slot) if p is not None)
            out[i, ids[int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(ids)]] += 1
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "PACK", 50)


def rows(n):
    """(id, label, score with ties, other score with nulls)"""
    return [(i * 7 % n, i % 3 % 2, (i * 13 % 9) / 10.0, None if i % 4 == 0 else (i * 31 % n) / n) for i in range(n)]


SHAPE = "id long, y int, tied double, fine double"


def test_draws_in_blocks(spark, small_blocks):
    data = rows(101)
    frame = spark.createDataFrame([*data, (999, None, 0.5, 0.5)], SHAPE)
    got = {(r.iteration, r.id): r.weight for r in resample.bootstrap_weights(frame, "id", 9, 5, "y").collect()}
    assert got == replay([r[0] for r in data if r[1] == 0], 9, 5, 0) | replay([r[0] for r in data if r[1] == 1], 9, 5, 1)
    whole = resample.bootstrap_counts(frame, "id", 4, 6, values=["fine"])
    assert whole.columns == ["id", "fine", "counts"] and whole.count() == 102
    got = {(i, r.id): c for r in whole.collect() for i, c in enumerate(r.counts, 1) if c}
    assert got == replay([*[r[0] for r in data], 999], 4, 6)


def test_sums_of_resamples(spark, small_blocks):
    data = rows(60)
    frame = spark.createDataFrame(data, SHAPE)
    sums = {"n": F.lit(1.0), "tied": F.col("tied"), "fine": F.col("fine")}
    got = {r.iteration: r for r in resample.bootstrap_sums(frame, "id", 6, 3, sums, "y").collect()}
    drawn = replay([r[0] for r in data if r[1] == 0], 6, 3, 0) | replay([r[0] for r in data if r[1] == 1], 6, 3, 1)
    by_id = {r[0]: r for r in data}
    for i in range(1, 7):
        mine = {k: c for (j, k), c in drawn.items() if j == i}
        assert got[i].n == 60 and got[i].tied == pytest.approx(sum(c * by_id[k][2] for k, c in mine.items()))
        assert got[i].fine == pytest.approx(sum(c * (by_id[k][3] or 0.0) for k, c in mine.items()))


@pytest.mark.parametrize("size", [5, 4096])
def test_metrics_of_counts(spark, size):
    """Equal to the metrics of a row per draw, with ties over many blocks and missing scores."""
    frame = spark.createDataFrame(rows(90), SHAPE)
    scores = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("score")) for c in ("tied", "fine")])
    counted = resample.bootstrap_counts(frame, "id", 8, 2, "y", ["tied", "fine"]).withColumn("_m", F.explode(scores)).select("*", "_m.*")
    got = metrics.resampled_metrics(counted, "score", "y", "id", ["model"], rows=size)
    weights = resample.bootstrap_weights(frame, "id", 8, 2, "y", ["tied", "fine"]).withColumn("_m", F.explode(scores)).select("*", "_m.*")
    want = {(r.iteration, r.model): r for r in metrics.bootstrap_metrics(weights, "score", "y", "id", ["iteration", "model"]).collect()}
    found = {(r.iteration, r.model): r for r in got.collect()}
    assert found.keys() == want.keys() and len(want) == 16
    for k, r in found.items():
        assert [r[c] for c in got.columns[2:]] == pytest.approx([want[k][c] for c in got.columns[2:]])


def test_fits_of_counts(spark):
    """One pass over rows with counts gives the fits of a copy of the row per draw."""
    frame = spark.createDataFrame([(i, i % 30, int((i * 7 % 11) + i % 5 > 7), i % 13 / 6.0 - 1, (i * i) % 17 / 8.0) for i in range(300)], "id int, who int, y int, a double, b double")
    people = frame.select("who").distinct()
    got = model.fit_resampled_logistic(frame.join(resample.bootstrap_counts(people, "who", 5, 8), "who"), ["a", "b"], "y")
    want = model.fit_logistic(frame.join(resample.bootstrap_weights(people, "who", 5, 8), "who"), ["a", "b"], "y", "iteration", "weight")
    assert got.groups.keys() == want.groups.keys() == set(range(1, 6)) and not got.unfinished
    for g, beta in want.groups.items():
        assert got.groups[g] == pytest.approx(beta, abs=1e-7)


def test_calibration_of_resamples(spark):
    """An id with two rows has the scores of both, as in a join by id."""
    frame = spark.createDataFrame([(i % 38, i % 2, i / 50.0, i * i % 40 / 40.0, 0.5) for i in range(40)], "id long, y int, raw double, sigmoid double, isotonic double")
    got = {(r.iteration, r.model): r.brier_score for r in model.calibration_bootstrap(frame, "raw", "id", "y", 4, 3).collect()}
    long = model.calibrated_long(frame, "raw", ["id", "y"])
    weights = resample.bootstrap_weights(frame.select("id", "y"), "id", 4, 3, "y").join(long.drop("y"), "id")
    want = metrics.probability_metrics(weights, "probability", "y", ["iteration", "method"], weight="weight").collect()
    assert got == pytest.approx({(r.iteration, r.method): r.brier_score for r in want}) and len(got) == 12


def test_counts_travel_as_bytes_unless_one_is_large():
    for rows, head, kind in (([[0, 3], [255, 1]], b"b", np.uint8), ([[0, 3], [256, 1]], b"i", np.int32)):
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(rows, pa.list_(pa.int32()))], names=["k", "counts"])
        (packed,) = metrics._packed_counts(iter([batch]))
        assert [np.frombuffer(r, kind, offset=1).tolist() for r in packed["counts"].to_pylist()] == rows
        assert all(r[:1] == head for r in packed["counts"].to_pylist())


def test_resampled_metrics_of_many_and_few_draws(spark):
    """Blocks with counts above 255 and blocks without give the same as rows that are repeated."""
    rows = [(i, (i * 37 % 50) / 50.0, int(i % 3 == 0), [300 if i == 4 else i % 3, 1]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, s double, y int, counts array<int>").repartition(6, "id")
    got = {r.iteration: r for r in metrics.resampled_metrics(frame, "s", "y", "id", rows=7).collect()}
    long = frame.select("id", "s", "y", F.posexplode("counts").alias("i", "weight")).withColumn("iteration", F.col("i") + 1).where("weight > 0")
    expected = {r.iteration: r for r in metrics.bootstrap_metrics(long, "s", "y", "id", ["iteration"]).collect()}
    assert got.keys() == expected.keys() == {1, 2}
    assert all(got[i][c] == pytest.approx(expected[i][c]) for i in got for c in ("roc_auc", "pr_auc", "brier_score", "top_precision"))
