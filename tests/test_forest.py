"""Tree models from counted cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import forest, model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    pay, age, kind = rng.normal(size=4000), rng.integers(0, 9, 4000), rng.integers(0, 3, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(pay + (age > 4) - kind)))
    return spark.createDataFrame(list(zip(range(4000), pay.tolist(), age.astype(float).tolist(), kind.astype(float).tolist(), y.astype(int).tolist())), "id long, pay double, age double, kind double, y int")


def encoder():
    return model.Encoder({"pay": (0.0, 0.0, 1.0), "age": (4.0, 4.0, 2.0)}, {"kind": (["0.0", "1.0", "2.0"], "0.0")})


def test_cells_hold_every_row(rows):
    edges = forest.bin_edges(rows, ["pay", "age"])
    assert edges[1] == [i + 0.5 for i in range(8)] and len(edges[0]) == 31
    cells = forest.counted_cells(rows, ["pay", "age"], edges, "y")
    found = {(bytes(r["_cell"]), r["y"]): r["_rows"] for r in cells.collect()}
    expected = {}
    for r in rows.collect():
        key = (bytes([int(np.searchsorted(edges[0], r.pay)), int(r.age)]), r.y)
        expected[key] = expected.get(key, 0) + 1
    assert found == expected
    sizes = [int(c) for (c,) in forest.binned(rows, ["pay"], edges[:1], []).groupBy("_cell").count().select("count").collect()]
    assert len(sizes) == 32 and max(sizes) < 2 * min(sizes)


def test_a_row_without_a_value_is_refused(spark):
    frame = spark.createDataFrame([(1.0, 1), (None, 0)], "v double, y int")
    with pytest.raises(Exception, match="v has rows without a value"):
        forest.binned(frame, ["v"], [[0.5]], ["y"]).collect()


def test_best_splits_against_brute_force():
    rng = np.random.default_rng(2)
    counts, weight = rng.integers(0, 9, (5, 3, 6, 2)), np.array([0.7, 2.1])
    counts[:, 2, 4:] = 0  # a feature of fewer bins
    got = forest._best_splits(counts, weight)

    def gini(c):
        share = c * weight / (c * weight).sum()
        return 1 - (share**2).sum()

    for node in range(5):
        gains = {}
        for j in range(3):
            for b in range(5):
                left, right = counts[node, j, : b + 1].sum(axis=0), counts[node, j, b + 1 :].sum(axis=0)
                if left.sum() and right.sum():
                    n, a, c = ((x * weight).sum() for x in (left + right, left, right))
                    gains[j, b] = gini(left + right) - (a * gini(left) + c * gini(right)) / n
        best = max(gains, key=gains.get)
        assert tuple(got[node, :2].astype(int)) == best and got[node, 2] == pytest.approx(gains[best])
        assert got[node, 3:5] == pytest.approx(counts[node, best[0], : best[1] + 1].sum(axis=0) * weight)


def test_pruned_leaves_of_one_class_become_one():
    tree = forest.Tree(np.array([0, 1, -1, -1, -1], np.int16), np.zeros(5, np.uint8), np.array([1, 3, 0, 0, 0], np.int32), np.array([[5, 5], [4, 1], [1, 4], [3, 0], [1, 0.5]]))
    pruned = tree.pruned()
    assert pruned.feature.tolist() == [0, -1, -1, -1, -1]
    assert pruned.leaves(np.array([[0, 0], [0, 1], [1, 0]], np.uint8)).tolist() == [1, 1, 2]


def test_large_tables_are_fitted_by_cell(rows, monkeypatch):
    def only_linear(name, *given, **options):
        assert name == "Logistic Regression"
        return fit(name, *given, **options)

    names, fit = ["Logistic Regression", "Random Forest", "Gradient Boosting"], model.fit_candidate
    by_row, _ = model.compare_candidates(rows, rows, encoder(), "y", "id", names, trees=60, rounds=12)
    monkeypatch.setattr(model, "CELL_ROWS", 1000)
    monkeypatch.setattr(model, "fit_candidate", only_linear)
    by_cell, table = model.compare_candidates(rows, rows, encoder(), "y", "id", names, trees=60, rounds=12)
    joined = by_row.join(by_cell.withColumnRenamed("score", "other"), ["id", "model", "y"])
    near = {r["model"]: r for r in joined.where("model <> 'Prior'").groupBy("model").agg(F.count("other").alias("n"), F.corr("score", "other").alias("c"), F.avg(F.abs(F.col("score") - F.col("other"))).alias("d")).collect()}
    assert {r["n"] for r in near.values()} == {4000} and table.count() == 4
    assert near["Logistic Regression"]["d"] < 1e-6
    assert near["Random Forest"]["c"] > 0.98 and near["Random Forest"]["d"] < 0.03
    assert near["Gradient Boosting"]["c"] > 0.99 and near["Gradient Boosting"]["d"] < 0.01


def test_boosting_by_cell_equals_boosting_by_row(rows):
    few = rows.withColumn("pay", F.round("pay")).where(F.abs("pay") < 4)
    encoded = encoder().transform(few, ["id", "y"])
    columns = encoder().columns
    plain = model.score_candidate(model.fit_candidate("Gradient Boosting", encoded, columns, "y", rounds=10), encoded, columns, ["id"], "a")
    cells = model.CellModels(encoded, columns, "y").score("Gradient Boosting", encoded, ["id"], "b", rounds=10)
    joined = plain.join(cells, "id").select("a", "b").collect()
    assert len(joined) == few.count() and all(r.a == pytest.approx(r.b, abs=1e-9) for r in joined)


def test_draws_do_not_depend_on_partitions(rows):
    encoded = encoder().transform(rows, ["id", "y"])
    scores = []
    for n in (1, 7):
        cells = model.CellModels(encoded.repartition(n), encoder().columns, "y")
        scores.append({r.id: r.s for r in cells.score("Random Forest", encoded, ["id"], "s", trees=14).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)
