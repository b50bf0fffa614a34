"""Association and redundancy diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import count_if, safe_div
from stayline.operators.gram import triangular_factor
from stayline.operators.reports import rate_by_category

MISSING = "<MISSING>"


def numeric_correlations(df: DataFrame, features: Sequence[str], threshold: float = 0.80) -> DataFrame:
    """Pearson correlation of every feature pair over the rows that have both, from one aggregate."""
    pairs = list(combinations(features, 2))
    corr = F.array(
        *[
            F.struct(
                F.lit(a).alias("first_feature"),
                F.lit(b).alias("second_feature"),
                F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("correlation"),
            )
            for a, b in pairs
        ]
    )
    rows = df.agg(corr.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    size = F.abs("correlation")
    return rows.where(F.col("correlation").isNotNull() & ~F.isnan("correlation")).select(
        "*", size.alias("absolute_correlation"), (size >= threshold).alias("above_threshold")
    )


def cramers_v(
    df: DataFrame, pairs: Sequence[tuple[str, str]], degenerate: float | None = 0.0
) -> DataFrame:
    """Bias-corrected Cramér's V per column pair.

    Chi-square is taken as n·(Σ o²/(row·column) − 1), which needs the occupied cells
    only. ``degenerate`` is the value where a column has a single category.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("first_feature"),
                F.lit(b).alias("second_feature"),
                F.coalesce(F.col(a).cast("string"), F.lit(MISSING)).alias("a"),
                F.coalesce(F.col(b).cast("string"), F.lit(MISSING)).alias("b"),
            )
            for a, b in pairs
        ]
    )
    by = ["first_feature", "second_feature"]
    cells = df.select(F.explode(entries).alias("_e")).select("_e.*").groupBy(*by, "a", "b").agg(
        F.count(F.lit(1)).alias("o")
    )
    marginal = cells.select(
        "*",
        F.sum("o").over(Window.partitionBy(*by, "a")).alias("r"),
        F.sum("o").over(Window.partitionBy(*by, "b")).alias("c"),
    )
    sums = marginal.groupBy(*by).agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("_q"),
        F.count_distinct("a").alias("first_cardinality"),
        F.count_distinct("b").alias("second_cardinality"),
    )
    n, rows, columns = F.col("n").cast("double"), F.col("first_cardinality"), F.col("second_cardinality")
    free = F.nullif(n - 1.0, F.lit(0.0))
    phi = F.greatest(F.lit(0.0), (F.col("_q") - 1.0) - (columns - 1) * (rows - 1) / free)
    limit = F.least(rows - F.pow(rows - 1, F.lit(2.0)) / free, columns - F.pow(columns - 1, F.lit(2.0)) / free) - 1.0
    usable = (n > 1) & (rows > 1) & (columns > 1) & (limit > 0)
    value = F.when(usable, F.sqrt(phi / F.when(limit > 0, limit))).otherwise(F.lit(degenerate).cast("double"))
    return sums.select(*by, value.alias("cramers_v"), "first_cardinality", "second_cardinality")


def numeric_signal(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Class means, standardised difference and point-biserial correlation per feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = df.select(F.col(label).alias("_y"), F.explode(pairs).alias("_p")).select("_y", "_p.*")
    yes, no = F.when(F.col("_y") == 1, F.col("v")), F.when(F.col("_y") == 0, F.col("v"))
    grouped = long.where(F.col("v").isNotNull()).groupBy("feature").agg(
        F.avg(no).alias("active_mean"),
        F.avg(yes).alias("attrition_mean"),
        F.sqrt((F.var_samp(no) + F.var_samp(yes)) / 2.0).alias("_s"),
        F.corr("v", F.col("_y").cast("double")).alias("point_biserial_correlation"),
    )
    gap = F.col("attrition_mean") - F.col("active_mean")
    effect = safe_div(gap, F.col("_s"))
    return grouped.select(
        "feature",
        "active_mean",
        "attrition_mean",
        gap.alias("mean_difference"),
        effect.alias("standardized_mean_difference"),
        "point_biserial_correlation",
        F.abs(effect).alias("absolute_standardized_difference"),
    )


def categorical_strength(df: DataFrame, features: Sequence[str], label: str, minimum: int = 50) -> DataFrame:
    """Cramér's V with the target and the spread of the rates of large enough categories."""
    strength = cramers_v(df, [(f, label) for f in features], None).select(
        F.col("first_feature").alias("feature"), F.col("cramers_v").alias("cramers_v_with_target")
    )
    large = F.col("large_enough")
    spread = rate_by_category(df, features, label, minimum).groupBy("feature").agg(
        (F.max(F.when(large, F.col("attrition_rate"))) - F.min(F.when(large, F.col("attrition_rate")))).alias(
            "attrition_rate_spread"
        ),
        count_if(large).alias("eligible_category_count"),
    )
    return strength.join(spread, "feature")


def feature_inventory(
    df: DataFrame, roles: dict[str, tuple[str, str]], numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Decision, role, type, missing rate, distinct values and strongest partner per column.

    ``roles`` maps a column to its (decision, role); a null counts as a value.
    """
    columns = list(roles)
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(roles[c][0]).alias("decision"),
                    F.lit(roles[c][1]).alias("role"),
                    F.lit(df.schema[c].dataType.simpleString()).alias("raw_dtype"),
                    count_if(F.col(c).isNull()).alias("_missing"),
                    (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias("unique_values"),
                )
                for c in columns
            ]
        ).alias("_s"),
    )
    rows = stats.select("_n", F.explode("_s").alias("_s")).select("_n", "_s.*")
    linked = numeric_correlations(df, numeric).select(
        "first_feature", "second_feature", F.col("absolute_correlation").alias("strength"), F.lit("Pearson correlation").alias("method")
    ).unionByName(
        cramers_v(df, list(combinations(categorical, 2))).select(
            "first_feature", "second_feature", F.col("cramers_v").alias("strength"), F.lit("Corrected Cramer's V").alias("method")
        )
    )
    both = linked.unionByName(
        linked.select(F.col("second_feature").alias("first_feature"), F.col("first_feature").alias("second_feature"), "strength", "method")
    )
    best = both.groupBy(F.col("first_feature").alias("feature")).agg(
        F.min_by(F.struct("second_feature", "strength", "method"), F.struct(-F.col("strength"), "second_feature")).alias("_b")
    )
    return rows.join(best, "feature", "left").select(
        "feature",
        "decision",
        "role",
        "raw_dtype",
        safe_div(F.col("_missing"), F.col("_n")).alias("missing_rate"),
        "unique_values",
        F.col("_b.second_feature").alias("strongest_associated_feature"),
        F.col("_b.strength").alias("association_strength"),
        F.col("_b.method").alias("association_method"),
    )


def matrix_diagnostics(df: DataFrame, features: Sequence[str], acceptable: float = 5.0, elevated: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Variance inflation per feature, and rank and condition number of the standardised matrix.

    The matrix is centred and scaled by one aggregate and reduced to its triangular factor R, d x d numbers, whose
    singular values are the matrix's own; so a condition number of 10^10 is told apart from a lower rank. Rows with a
    null are left out; a constant column has no scale and stays zero.
    """
    d = len(features)
    cast = [F.col(f).cast("double").alias(f) for f in features]
    complete = df.select(*cast).dropna()
    row = complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"a_{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
    ).first()
    n = int(row["n"])
    scaled = complete.select(
        *[((F.col(f) - F.lit(row[f"a_{i}"])) / F.lit(row[f"s_{i}"] or 1.0)).alias(f) for i, f in enumerate(features)]
    )
    factor = triangular_factor(scaled, list(features)) if n else np.zeros((0, d))
    left, values, right = np.linalg.svd(factor, full_matrices=False)
    least = (values[0] if len(values) else 0.0) * max(n, d) * np.finfo(float).eps
    rank = int((values > least).sum())
    full = rank == d
    kept = values > least
    # the diagonal of n (X'X)^-1 in the singular basis; directions without spread are left out, as in a pseudo-inverse
    inflation = n * ((right[kept] / values[kept, None]) ** 2).sum(axis=0)
    condition = float(values[0] / values[-1]) if full else float("inf")
    spark = df.sparkSession
    vif = spark.createDataFrame(
        [
            (f, float(v), "Acceptable" if v <= acceptable else "Elevated" if v <= elevated else "High")
            for f, v in zip(features, inflation, strict=True)
        ],
        "encoded_feature string, vif double, assessment string",
    )
    summary = spark.createDataFrame(
        [
            ("Development rows", float(n)),
            ("Encoded features", float(d)),
            ("Matrix rank", float(rank)),
            ("Condition number", condition),
            ("Maximum VIF", float(inflation.max()) if d else 0.0),
        ],
        "metric string, value double",
    )
    return vif, summary


def dataset_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns, positives and missing cells, long."""
    missing = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("columns"),
        count_if(F.col(label) == 1).cast("double").alias("positive_cases"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("double").alias("missing_cells"),
    )
    return one.unpivot([], one.columns, "metric", "value")


