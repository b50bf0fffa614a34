"""Ranks, running totals and quantiles against plain Python, with ranges small enough to split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import asof, quality, rank, resample
from stayline.operators.rank import Key, keys


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one score, and one group holds most rows."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        score = 0.5 if i % 3 == 0 else rng.random()
        rows.append((i, "hot" if i % 4 else f"g{i % 7}", score if i % 50 else None, rng.uniform(-5, 9)))
    return spark.createDataFrame(rows, "id long, g string, score double, v double").persist()


def ordered(rows, desc=True):
    return sorted(rows, key=lambda r: (r.score is None, (-r.score if desc else r.score) if r.score is not None else 0, r.id))


def test_plan_splits_a_hot_score_by_the_tie_break(skewed):
    plan = rank.plan_ranges(skewed, [Key("score", True), Key("id")], 100)
    assert len(plan.edges) > 10 and -0.5 in plan.hot and len(plan.tie_edges) >= 5
    largest = plan.assign(skewed).groupBy("_b1", "_b2").count().agg(F.max("count")).first()[0]
    assert largest < 400


@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_matches_a_full_sort(skewed, by):
    out = rank.ranked(skewed, [Key("score", True), Key("id")], by, rows_per_bucket=100).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g if by else "", []).append(r)
    for rows in groups.values():
        assert [r["rank"] for r in ordered(rows)] == list(range(1, len(rows) + 1))
    assert len(out) == 3000


def test_running_totals_match(skewed):
    out = rank.running_totals(skewed, [Key("score", True), Key("id")], {"cum": "v"}, ["g"], rows_per_bucket=100).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        rows = ordered(rows)
        assert np.allclose([r.cum for r in rows], np.cumsum([r.v for r in rows]))


def test_quantiles_match_numpy(skewed):
    out = rank.exact_quantiles(skewed, "score", {"a": 0.1, "b": 0.5, "c": 0.975}, ["g"], rows_per_bucket=100).collect()
    data = skewed.where("score is not null").toPandas()
    for r in out:
        values = data.loc[data.g == r.g, "score"]
        assert r._n == len(values)
        assert np.allclose([r.a, r.b, r.c], np.quantile(values, [0.1, 0.5, 0.975]))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 11, 23])
def test_quantile_groups_and_bins_for_small_inputs(spark, n):
    df = spark.range(n).withColumn("v", F.col("id") * 1.0)
    groups = [r.quantile for r in rank.quantile_groups(df, keys("v", "id"), 5).orderBy("id").collect()]
    edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 6))
    assert groups == [max(1, int(np.searchsorted(edges, r, side="left"))) for r in range(1, n + 1)]
    bins = [r["bin"] for r in rank.equal_frequency_bins(df, keys("v", "id"), 4).orderBy("id").collect()]
    assert [bins.count(b) for b in sorted(set(bins))] == [len(a) for a in np.array_split(np.arange(n), 4) if len(a)]


def test_equal_scores_take_the_lower_id_first(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9)], "id int, s double")
    flagged = rank.flag_top_fraction(df, [Key("s", True), Key("id")], 0.5).where("selected").collect()
    assert {r.id for r in flagged} == {2, 1}


def test_best_prefix_and_no_positive_prefix(spark):
    df = spark.createDataFrame([(1, 0.9, 5.0), (2, 0.8, -1.0), (3, 0.7, 3.0), (4, 0.6, -9.0)], "id int, p double, net double")
    best = rank.best_prefix(df, [Key("p", True), Key("id")], "net", keep=["p"]).first()
    assert (best.prefix_rows, best.prefix_total, best.p) == (3, 7.0, 0.7)
    assert rank.best_prefix(df.withColumn("net", F.lit(-1.0)), [Key("p", True)], "net").count() == 0


def test_previous_value_across_ranges(skewed):
    order = keys("v", "id")
    out = quality.with_previous(skewed, "g", order, "id", "before", rows_per_bucket=100).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (r.v, r.id))
        assert [r.before for r in rows] == [None, *[r.id for r in rows[:-1]]]


def test_no_window_over_raw_rows_without_partition(skewed):
    plan = rank.ranked(skewed, [Key("score", True), Key("id")], rows_per_bucket=100)._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert row_windows and all("_b1" in line for line in row_windows)


def test_top_per_group_limits_before_the_shuffle(skewed):
    plan = rank.top_per_group(skewed, ["g"], keys("-score", "id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_decimals_that_share_a_double(spark):
    base = 2**53
    df = spark.range(400).select("id", (F.lit(base).cast("decimal(38,0)") + (F.col("id") * 7 % 400).cast("decimal(38,0)")).alias("d"))
    out = rank.ranked(df, keys("-d", "id"), rows_per_bucket=20).orderBy("rank").collect()
    assert [r.d for r in out] == sorted((r.d for r in out), reverse=True)


@pytest.mark.parametrize("order", [("g", "name"), ("name",), ("-name",), ("g", "same", "name")])
def test_string_keys_with_a_common_prefix(spark, order):
    df = spark.range(600).select(
        F.lit(1).alias("g"), F.lit("x").alias("same"), F.concat(F.lit("customer-é-"), F.lpad((F.col("id") * 7 % 600).cast("string"), 6, "0")).alias("name")
    )
    plan = rank.plan_ranges(df, keys(*order), 50)
    assert plan.assign(df).groupBy("_b1", "_b2").count().agg(F.max("count")).first()[0] <= 150
    out = [r.name for r in rank.ranked(df, keys(*order), rows_per_bucket=50).orderBy("rank").collect()]
    assert out == sorted(out, reverse=order[0] == "-name")


@pytest.mark.parametrize("desc", [False, True])
def test_nan_infinities_and_nulls_rank_alike_at_every_size(spark, desc):
    special = [float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, special[i % 8] if i % 8 < 4 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double")
    order = [Key("v", desc), Key("id")]
    small, large = (rank.ranked(df, order, rows_per_bucket=n).select("id", "rank") for n in (1000, 20))
    assert small.exceptAll(large).count() == 0


@pytest.mark.parametrize("size", [1000, 20])
def test_previous_value_of_null_entities_on_descending_dates(spark, size):
    df = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("e"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 300).cast("int")).alias("day"),
    )
    groups = {}
    for r in quality.with_previous(df, "e", keys("-day", "id"), "id", "before", rows_per_bucket=size).collect():
        groups.setdefault(r.e, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (-r.day.toordinal(), r.id))
        assert [r.before for r in rows] == [None, *[r.id for r in rows[:-1]]]


@pytest.mark.parametrize("size", [1000, 20])
def test_asof_join_matches_null_entities_at_every_size(spark, size):
    right = spark.range(200).select(F.when(F.col("id") % 2 == 0, 1).alias("e"), F.timestamp_seconds("id").alias("t"), F.col("id").alias("v"))
    left = spark.range(200).select(F.when(F.col("id") % 2 == 1, 1).alias("e"), F.timestamp_seconds("id").alias("at"), "id")
    out = asof.asof_join(left, right, "e", "at", "t", ["v"], ["v"], rows_per_bucket=size).collect()
    assert {r.id: r.v for r in out} == {i: i - 1 if i else None for i in range(200)}


def test_grouped_folds_balance_distinct_positive_counts(spark):
    rows = [(e, int(i < e)) for e in range(60) for i in range(60)]
    df = spark.createDataFrame(rows, "e int, y int")
    found = resample.fold_summary(df, resample.grouped_folds(df, "e", "y", 5, 3), "e", "y").collect()
    assert len(found) == 5 and {r.entities for r in found} == {12} and {r.rows for r in found} == {720}
    assert max(r.positives for r in found) - min(r.positives for r in found) <= 60
