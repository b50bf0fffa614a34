"""Encoding, fitting, comparison, calibration and explanation of attrition models.

Single models come from MLlib. Where many logistic fits are wanted at once (folds,
resamples) they are Newton steps over all groups together: one exchange per step of
a buffer per partition and group gives every group's gradient and curvature.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import count_if, logit, safe_div
from stayline.operators import forest
from stayline.operators.calibrated import FoldScorer, deal_parts, encoders_of_counts, feature_columns, held_scores, known_scores, mean_calibrated, pools_of_known
from stayline.operators.fairness import by_attribute
from stayline.operators.gram import fit_counts, logistic_sums, resampled_logistic_sums, resampled_sizes
from stayline.operators.isotonic import apply_isotonic
from stayline.operators.metrics import calibration_metrics
from stayline.operators.rank import Key, exact_quantiles, quantile_groups, spearman
from stayline.operators.resample import average_out_of_fold, bootstrap_counts, bootstrap_sums, grouped_folds, row_folds
from stayline.session import settle, store

MAX_CATEGORIES = 1000
#: Pools of all calibrations that every task may hold; more are joined to the rows.
MAX_POOLS = 1_000_000


def _safe(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in str(text)).lower()


# ---- preprocessing ----------------------------------------------------------------------------------


@dataclass
class Encoder:
    """Fitted preprocessing: (median, mean, deviation) per numeric, (categories, mode) per categorical.

    The first category is the reference and gets no column; an unknown one is all zero.
    """

    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, tuple[list[str], str]]
    encoded: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.encoded = [(f"n_{_safe(c)}", c) for c in self.numeric]
        for c, (levels, _) in self.categorical.items():
            self.encoded += [(f"c_{_safe(c)}_{_safe(v)}", c) for v in levels[1:]]

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.encoded]

    @property
    def raw_features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def levels(self) -> dict[str, list[str]]:
        return {c: levels for c, (levels, _) in self.categorical.items()}

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        out: list[Column] = []
        for c, (median, mean, deviation) in self.numeric.items():
            value = F.coalesce(F.col(c).cast("double"), F.lit(median))
            out.append(((value - mean) / (deviation or 1.0)).alias(f"n_{_safe(c)}"))
        for c, (levels, mode) in self.categorical.items():
            value = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out += [(value == v).cast("double").alias(f"c_{_safe(c)}_{_safe(v)}") for v in levels[1:]]
        return df.select(*keep, *out)

    def table(self, spark: SparkSession) -> DataFrame:
        """The fitted values as rows, so that they can be stored and read back for scoring."""
        rows = [(c, "numeric", m, a, s, None, None) for c, (m, a, s) in self.numeric.items()]
        rows += [(c, "categorical", None, None, None, levels, mode) for c, (levels, mode) in self.categorical.items()]
        return spark.createDataFrame(
            rows, "feature string, kind string, median double, mean double, deviation double, categories array<string>, mode string"
        )

    @staticmethod
    def from_table(table: DataFrame) -> Encoder:
        rows = table.collect()  # one row per feature, written by to_table
        return Encoder(
            {r["feature"]: (r["median"], r["mean"], r["deviation"]) for r in rows if r["kind"] == "numeric"},
            {r["feature"]: (list(r["categories"]), r["mode"]) for r in rows if r["kind"] == "categorical"},
        )


def fit_encoder(df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str] | None]) -> Encoder:
    """Exact medians, modes (smallest value on ties), and mean and population deviation after imputing.

    A categorical maps to its ordered categories; None takes the observed ones in order.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*")
    medians = {r["c"]: r["m"] for r in exact_quantiles(long, "v", {"m": 0.5}, ["c"]).collect()}
    moments = df.agg(
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))).alias(f"a_{i}") for i, c in enumerate(numeric)],
        *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))).alias(f"s_{i}") for i, c in enumerate(numeric)],
    ).first()
    counts = by_attribute(df, list(categorical), []).where(F.col("group") != "Missing").groupBy("attribute", "group").agg(
        F.count(F.lit(1)).alias("n")
    )
    modes = {
        r["attribute"]: r["mode"]
        for r in counts.groupBy("attribute").agg(F.min_by("group", F.struct(-F.col("n"), "group")).alias("mode")).collect()
    }
    fitted = {}
    for c, given in categorical.items():
        levels = list(given) if given else None
        if levels is None:
            rows = counts.where(F.col("attribute") == c).select("group").orderBy("group").limit(MAX_CATEGORIES + 1).collect()
            if len(rows) > MAX_CATEGORIES:
                raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
            levels = [r["group"] for r in rows]
        fitted[c] = (levels, modes.get(c, levels[0]))
    return Encoder(
        {c: (medians[c], moments[f"a_{i}"], moments[f"s_{i}"]) for i, c in enumerate(numeric)}, fitted
    )


def class_weights(df: DataFrame, label: str, by: Sequence[str] = (), weight: str | None = None, out: str = "class_weight") -> DataFrame:
    """n / (2·n_class) per row, within each group."""
    w = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*by).agg(
        F.sum(w).cast("double").alias("_n"), F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("double").alias("_p")
    )
    joined = df.join(F.broadcast(counts), list(by)) if by else df.crossJoin(F.broadcast(counts))  # one row per fit
    size = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return joined.withColumn(out, F.col("_n") / (2.0 * size)).drop("_n", "_p")


# ---- grouped logistic regression ----------------------------------------------------------------------


@dataclass
class LogisticFits:
    """Intercept first, then one coefficient per feature, for each group of a fit."""

    features: list[str]
    groups: dict[int, np.ndarray]
    iterations: int
    unfinished: frozenset[int] = frozenset()  # groups that ran out of steps

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (int(g), name, float(v), g not in self.unfinished)
            for g, beta in self.groups.items()
            for name, v in zip(["intercept", *self.features], beta, strict=True)
        ]
        return spark.createDataFrame(rows, "fit int, encoded_feature string, coefficient double, converged boolean")

    def score(self, df: DataFrame, group: Column | None = None, out: str = "score") -> DataFrame:
        """Probability under the fit named by ``group`` (the only fit by default)."""
        rows = F.create_map(*[x for g, b in self.groups.items() for x in (F.lit(int(g)), F.array(*[F.lit(float(v)) for v in b]))])
        key = group if group is not None else F.lit(int(next(iter(self.groups))))
        beta = F.element_at(rows, key.cast("int"))
        linear = beta[0]
        for i, name in enumerate(self.features):
            linear = linear + beta[i + 1] * F.col(name)
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-linear)))


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: str | None = None,
    weight: str | None = None,
    c: float = 1.0,
    balanced: bool = True,
    tolerance: float = 1e-8,
    maximum: int = 30,
) -> LogisticFits:
    """Ridge-penalised logistic regression for every group at once; the intercept is free.

    Minimises Σ weight·loss + ‖β‖²/(2c) per group. ``group`` holds small integers, one
    per fit, whose number is set by the caller (folds or resamples). Fits that run out
    of steps cause a warning and are named in ``unfinished``.
    """
    features = list(features)
    d = len(features) + 1
    frame = df.withColumn("_g", F.col(group).cast("int") if group else F.lit(0))
    frame = frame.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    if balanced:
        frame = class_weights(frame, label, ["_g"], "_w", "_cw").withColumn("_w", F.col("_w") * F.col("_cw"))
    frame = settle(frame.select("_g", "_w", F.col(label).cast("double").alias("_y"), *features).dropna())
    betas = {r["_g"]: np.zeros(d) for r in frame.select("_g").distinct().collect()}
    return _newton(lambda current: logistic_sums(frame, features, current), features, betas, c, tolerance, maximum)


def fit_resampled_logistic(
    counted: DataFrame, features: Sequence[str], label: str, c: float = 1.0, tolerance: float = 1e-8, maximum: int = 30,
    maps: tuple[Sequence[str], dict[int, np.ndarray]] | None = None,
) -> LogisticFits:
    """``fit_logistic`` of every resample, numbered from 1, with balanced classes; a row has ``counts`` of all resamples.

    Rows are not copied: a step finds the sums of all fits from one pass, as products of matrices. Where the fits' own
    features are linear in the given ones, ``maps`` names them and has a matrix per fit (intercept first on both
    sides); a fit without a matrix is left out.
    """
    features = list(features)
    frame = store(counted.select("counts", F.col(label).cast("double").alias("_y"), *features))
    drawn, positive = resampled_sizes(frame)
    frame = frame.dropna()
    kept, _ = resampled_sizes(frame)
    size = {1: positive, 0: drawn - positive}
    weight = {k: np.divide(drawn, 2.0 * n, out=np.zeros(len(n)), where=n > 0) for k, n in size.items()}
    names, turn = (list(maps[0]), maps[1]) if maps else (features, None)
    betas = {g + 1: np.zeros(len(names) + 1) for g in np.flatnonzero(kept).tolist() if turn is None or g + 1 in turn}

    def sums_at(current: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        if turn is None:
            return resampled_logistic_sums(frame, features, current, weight)
        found = resampled_logistic_sums(frame, features, {g: turn[g] @ b for g, b in current.items()}, weight)
        return {g: (loss, turn[g].T @ slope, turn[g].T @ curve @ turn[g]) for g, (loss, slope, curve) in found.items()}

    return _newton(sums_at, names, betas, c, tolerance, maximum)


def _newton(
    sums_at: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray, np.ndarray]]], features: list[str],
    betas: dict[int, np.ndarray], c: float, tolerance: float, maximum: int,
) -> LogisticFits:
    """Newton steps of all fits together; ``sums_at`` gives loss, gradient and curvature of the fits that still move."""
    d = len(features) + 1
    ridge = np.full(d, 1.0 / c)
    ridge[0] = 0.0
    best = {g: math.inf for g in betas}
    moves: dict[int, np.ndarray] = {}
    active, step = set(betas), 0
    for step in range(1, maximum + 1):
        sums = sums_at({g: betas[g] for g in active})
        settled = set()
        for g, (loss, slope, information) in sums.items():
            value = loss + 0.5 * float(ridge @ betas[g] ** 2)
            if value > best[g] + 1e-9 * abs(value):
                moves[g] = moves[g] / 2.0  # the step was too long: go half way back
                betas[g] = betas[g] - moves[g]
                continue
            best[g] = value
            gradient = slope - ridge * betas[g]
            moves[g] = np.linalg.solve(information + np.diag(ridge) + 1e-10 * np.eye(d), gradient)
            betas[g] = betas[g] + moves[g]
            if np.max(np.abs(moves[g])) < tolerance:
                settled.add(g)
        active -= settled
        if not active:
            break
    if active:
        warnings.warn(f"{len(active)} of {len(betas)} logistic fits did not converge in {maximum} steps", RuntimeWarning, stacklevel=3)
    return LogisticFits(features, betas, step, frozenset(active))


def fit_copies(df: DataFrame, folds: int, fold: str = "fold", out: str = "fit") -> DataFrame:
    """One copy of a row for every fold it is trained in, that is all but its own."""
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda k: k != F.col(fold))
    return df.withColumn(out, F.explode(others))


# ---- MLlib candidates ---------------------------------------------------------------------------------


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_candidate(
    name: str, encoded: DataFrame, features: Sequence[str], label: str, c: float = 1.0, trees: int = 300, rounds: int = 150, seed: int = 42
):
    """Balanced logistic regression, random forest (depth 10) or gradient boosting (depth 2, rate 0.05)."""
    weighted = _assembled(class_weights(encoded, label), features)
    if name == "Logistic Regression":
        total = weighted.agg(F.sum("class_weight").alias("w")).first()["w"]
        estimator = LogisticRegression(
            **_columns(label), regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
        )
    else:
        estimator = _estimator(name, label, trees, rounds, seed)
    return estimator.fit(weighted)


def _columns(label: str) -> dict[str, str]:
    return {"featuresCol": "features", "labelCol": label, "weightCol": "class_weight"}


def _estimator(name: str, label: str, trees: int, rounds: int, seed: int):
    if name == "Random Forest":
        return RandomForestClassifier(**_columns(label), numTrees=trees, maxDepth=10, seed=seed)
    if name == "Gradient Boosting":
        return GBTClassifier(**_columns(label), maxIter=rounds, maxDepth=2, stepSize=0.05, seed=seed)
    raise ValueError(f"unknown candidate: {name}")


def score_candidate(model, encoded: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "score") -> DataFrame:
    scored = model.transform(_assembled(encoded, features))
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def prior_score(train: DataFrame, df: DataFrame, label: str, out: str = "score") -> DataFrame:
    """Constant class prior of the training rows."""
    prior = train.agg(F.avg(label).alias("p")).first()["p"]
    return df.withColumn(out, F.lit(float(prior)))


#: Rows below which a further task does not help a fit.
TASK_ROWS = 10_000


def _wide(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as there are cores: a fit that reads them hundreds of times keeps their partitions."""
    cores = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(cores) if cores > df.rdd.getNumPartitions() else df


#: Training rows above which trees are fitted to counted cells; MLlib's passes over the rows themselves end soon below.
CELL_ROWS = 100_000
TREES = ("Random Forest", "Gradient Boosting")


class CellModels:
    """Random forest and gradient boosting of large tables, fitted to the counted cells of equal bins (``forest``).

    Boosting is MLlib's on a row per cell and class, weighted by its rows. MLlib's forest draws its samples row by row, so
    the forest is grown here, from draws per cell. Distinct cells are scored and meet their rows by cell.
    """

    def __init__(self, encoded: DataFrame, features: Sequence[str], label: str) -> None:
        self.features, self.label = list(features), label
        self.edges = forest.bin_edges(encoded, self.features)
        counted = forest.counted_cells(encoded, self.features, self.edges, label)
        self.cells = settle(class_weights(counted, label, weight="_rows"))

    def score(self, name: str, scoring: DataFrame, keep: Sequence[str], out: str, trees: int = 300, rounds: int = 150, seed: int = 42) -> DataFrame:
        asked = settle(forest.binned(scoring, self.features, self.edges, keep))
        distinct = settle(asked.select("_cell").distinct())
        if name == "Random Forest":
            weight = {r[self.label]: r["class_weight"] for r in self.cells.select(self.label, "class_weight").distinct().collect()}
            grown = forest.grow_forest(
                self.cells, [len(e) + 1 for e in self.edges], self.label, [weight.get(k, 0.0) for k in (0, 1)], trees, 10, seed
            )
            scored = forest.forest_scores(_wide(distinct), grown, len(self.features), out)
        else:
            weighted = self.cells.withColumn("class_weight", F.col("class_weight") * F.col("_rows"))
            rows = settle(_wide(forest.bins_as_columns(weighted, self.features, [self.label, "class_weight"])))
            model = _estimator(name, self.label, trees, rounds, seed).fit(_assembled(rows, self.features))
            scored = score_candidate(model, forest.bins_as_columns(distinct, self.features, ["_cell"]), self.features, ["_cell"], out)
        return asked.join(settle(scored), "_cell").drop("_cell")


def compare_candidates(
    train: DataFrame,
    validation: DataFrame,
    encoder: Encoder,
    label: str,
    row_id: str,
    candidates: Sequence[str] = ("Logistic Regression", "Random Forest", "Gradient Boosting"),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fit each candidate on the earlier split, score the later one: (long scores, metric table)."""
    fitted = settle(_wide(settle(encoder.transform(train, [label]))))
    scoring = settle(encoder.transform(validation, [row_id, label]))
    large = fitted.count() > CELL_ROWS and set(candidates) & set(TREES)
    cells = CellModels(fitted, encoder.columns, label) if large else None
    frames = []
    for name in candidates:
        if cells and name in TREES:
            scored = cells.score(name, scoring, [row_id, label], "score", **{k: v for k, v in options.items() if k != "c"})
        else:
            scored = score_candidate(fit_candidate(name, fitted, encoder.columns, label, **options), scoring, encoder.columns, [row_id, label])
        frames.append(scored.withColumn("model", F.lit(name)))
    frames.append(prior_score(train, scoring.select(row_id, label), label).withColumn("model", F.lit("Prior")))
    scores = frames[0]
    for frame in frames[1:]:
        scores = scores.unionByName(frame)
    scores = settle(scores)
    return scores, calibration_metrics(scores, "score", label, row_id, ["model"])


def choose_model(metrics: DataFrame, pairwise: DataFrame, complexity: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Simplest candidate whose average precision is within tolerance of the best, or not clearly below it."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(complexity):
        rank = F.when(F.col("model") == name, i + 1).otherwise(rank)
    table = metrics.select("model", F.col("pr_auc").alias("validation_pr_auc"), rank.alias("complexity_rank")).where(
        F.col("complexity_rank").isNotNull()
    )
    best = table.agg(F.max_by(F.struct("model", "validation_pr_auc"), F.col("validation_pr_auc")).alias("b")).select(
        F.col("b.model").alias("best_observed_model"), F.col("b.validation_pr_auc").alias("_top")
    )
    both = pairwise.select("model_a", "model_b", F.col("difference_lower").alias("lo"), F.col("difference_upper").alias("hi"))
    both = both.unionByName(
        both.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi"))
    )
    joined = table.crossJoin(F.broadcast(best)).join(  # one row
        both, (F.col("model_a") == F.col("best_observed_model")) & (F.col("model_b") == F.col("model")), "left"
    )
    same = F.col("model") == F.col("best_observed_model")
    low = F.when(same, 0.0).otherwise(F.col("lo"))
    high = F.when(same, 0.0).otherwise(F.col("hi"))
    gap = F.col("_top") - F.col("validation_pr_auc")
    within = gap <= tolerance
    includes = F.coalesce((low <= 0) & (high >= 0), F.lit(False))
    decided = joined.select(
        "model",
        "validation_pr_auc",
        "best_observed_model",
        gap.alias("gap_from_best_pr_auc"),
        low.alias("best_minus_model_lower_95"),
        high.alias("best_minus_model_upper_95"),
        includes.alias("paired_interval_includes_zero"),
        within.alias("within_practical_tolerance"),
        (within | includes).alias("eligible_for_simplicity_selection"),
        "complexity_rank",
    )
    simplest = F.min(F.when(F.col("eligible_for_simplicity_selection"), F.col("complexity_rank"))).over(Window.partitionBy())
    return decided.withColumn("selected_model", F.col("complexity_rank") == simplest)  # a row per candidate


# ---- calibration --------------------------------------------------------------------------------------


@dataclass
class Calibration:
    """Sigmoid coefficients on the log odds and a fitted isotonic model."""

    intercept: float
    slope: float
    isotonic: object
    epsilon: float = 1e-6

    def apply(self, df: DataFrame, score: str, label: str | None = None) -> DataFrame:
        """Add the columns ``sigmoid`` and ``isotonic``."""
        out = df.withColumn(
            "sigmoid", 1.0 / (1.0 + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * logit(score, self.epsilon))))
        )
        return self.isotonic.transform(out).withColumnRenamed("prediction", "isotonic")


def out_of_fold_scores(
    df: DataFrame, encoder: Encoder, entity: str, row_id: str, label: str, folds: int = 5, seed: int = 42, c: float = 1.0
) -> DataFrame:
    """Score of each row by the fit that saw none of its entity's rows; all fits run together.

    ``encoder`` names the features and their categories. Medians, modes and deviations come from each fit's own
    training rows, so held-out rows take no part in what scores them.
    """
    placed = settle(df.join(grouped_folds(df, entity, label, folds, seed), entity))
    train, held, names = encode_per_fit(
        fit_copies(placed, folds), placed.withColumn("fit", F.col("fold")), list(encoder.numeric), encoder.levels, [row_id, entity, label]
    )
    fits = fit_logistic(train, names, label, "fit", c=c)
    scored = fits.score(held, F.col("fit"), "raw_score")
    return scored.select(row_id, entity, label, F.col("fit").alias("fold"), "raw_score")


def encoders_per_fit(train: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], fit: str = "fit") -> DataFrame:
    """A row per fit: median ``_m_``, mean ``_a_`` and deviation ``_s_`` of each numeric, mode ``_o_`` of each categorical."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(numeric)])
    long = train.select(fit, F.explode(pairs).alias("_p")).select(fit, "_p.*")
    medians = exact_quantiles(long, "v", {"m": 0.5}, [fit, "i"]).groupBy(fit).pivot("i", list(range(len(numeric)))).agg(F.first("m"))
    medians = settle(medians.select(fit, *[F.col(str(i)).alias(f"_m_{i}") for i in range(len(numeric))]))
    filled = train.join(F.broadcast(medians), fit)  # one row per fit
    values = [F.coalesce(F.col(c).cast("double"), F.col(f"_m_{i}")) for i, c in enumerate(numeric)]
    moments = filled.groupBy(fit).agg(
        *[F.avg(v).alias(f"_a_{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"_s_{i}") for i, v in enumerate(values)]
    )
    counts = by_attribute(train, list(categorical), [fit]).where(F.col("group") != "Missing").groupBy(fit, "attribute", "group").agg(
        F.count(F.lit(1)).alias("n")
    )
    modes = counts.groupBy(fit).pivot("attribute", list(categorical)).agg(F.min_by("group", F.struct(-F.col("n"), "group")))
    modes = modes.select(fit, *[F.col(f"`{c}`").alias(f"_o_{j}") for j, c in enumerate(categorical)])
    return settle(medians.join(moments, fit).join(modes, fit))


def encode_per_fit(
    train: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], keep: Sequence[str],
    fit: str = "fit", held_keep: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``train`` and ``df`` encoded by what the training rows of each row's own fit say, and the encoded names.

    The same values as one ``fit_encoder`` per fit with given categories; all fits share their jobs.
    """
    fitted = encoders_per_fit(train, numeric, categorical, fit)
    mine = [c for c in keep if c in train.columns]
    kept = keep if held_keep is None else held_keep
    return (
        encode_with(train, fitted, numeric, categorical, mine, fit), encode_with(df, fitted, numeric, categorical, kept, fit),
        _shape(numeric, categorical).columns,
    )


def _shape(numeric: Sequence[str], categorical: dict[str, Sequence[str]]) -> Encoder:
    return Encoder({c: (0.0, 0.0, 1.0) for c in numeric}, {c: (list(v), v[0]) for c, v in categorical.items()})


def encode_with(
    rows: DataFrame, fitted: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], keep: Sequence[str], fit: str = "fit"
) -> DataFrame:
    """Rows encoded by the encoder of the fit that each of them names."""
    out = []
    for i, c in enumerate(numeric):
        value = F.coalesce(F.col(c).cast("double"), F.col(f"_m_{i}"))
        out.append((value - F.col(f"_a_{i}")) / F.when(F.col(f"_s_{i}") > 0, F.col(f"_s_{i}")).otherwise(1.0))
    for j, (c, levels) in enumerate(categorical.items()):
        value = F.coalesce(F.col(c).cast("string"), F.col(f"_o_{j}"), F.lit(levels[0]))
        out += [(value == v).cast("double") for v in levels[1:]]
    joined = rows.join(F.broadcast(fitted), fit)  # one row per fit
    return joined.select(*keep, fit, *[o.alias(n) for o, n in zip(out, _shape(numeric, categorical).columns, strict=True)])


def repeated_out_of_fold_models(
    df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], row_id: str, label: str,
    folds: int = 5, repeats: int = 10, seed: int = 42, c: float = 1.0,
) -> DataFrame:
    """Mean held-out score per row over repeated stratified folds, with its coverage.

    Every repeat and fold has a logistic model and an encoder of its own, fitted without the fold's rows; the Newton
    steps of all folds times repeats are shared.
    """
    number = ((F.col("repeat") - 1) * folds + F.col("fold")).cast("int")
    dealt = row_folds(df, row_id, label, folds, seed, repeats).groupBy(row_id).agg(F.collect_list(number).alias("_held"))
    rows = store(df.select(row_id, label, *numeric, *categorical).join(dealt, row_id))
    # rows are not copied: a fit takes part in a row with the number of other folds of its repeat that the row is in
    heads = F.transform("_held", lambda k: k - F.pmod(k - 1, F.lit(folds)))
    others = F.transform(F.arrays_zip(heads.alias("h"), F.col("_held").alias("k")), lambda e: F.filter(F.sequence(e["h"], e["h"] + folds - 1), lambda j: j != e["k"]))
    trained = rows.withColumn("_train", F.flatten(others))
    fits, fitted = fit_fold_logistic(trained, numeric, categorical, label, folds * repeats, c)
    held = rows.select(row_id, *numeric, *categorical, F.explode("_held").alias("fit")).withColumn("repeat", F.floor((F.col("fit") - 1) / folds) + 1)
    encoded = encode_with(held, fitted, numeric, categorical, [row_id, "repeat"])
    return average_out_of_fold(score_by_fit(encoded, fits, "score"), row_id, "score", repeats)


def fit_fold_logistic(
    rows: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], label: str, number: int, c: float = 1.0
) -> tuple[LogisticFits, DataFrame]:
    """Fits 1 to ``number`` with encoders of their own, and these; ``_train`` lists the fits that a row is trained in.

    What a fit's encoder makes of a row is linear in the row's values and its missing ones, so all fits share one
    table of these and a step is one pass over it.
    """
    fitted = encoders_per_fit(rows.withColumn("fit", F.explode("_train")), numeric, categorical)
    found = {r["fit"]: r for r in fitted.collect()}  # one row per fit
    columns, maps = _shared_columns(found, numeric, categorical)
    if not maps[1]:
        return LogisticFits(maps[0], {}, 0), fitted
    frame = fit_counts(rows.select("_train", F.col(label).cast("double").alias("_y"), *columns), number)
    return fit_resampled_logistic(frame, frame.columns[2:], "_y", c, maps=maps), fitted


def _shared_columns(
    found: dict, numeric: Sequence[str], categorical: dict[str, Sequence[str]]
) -> tuple[list[Column], tuple[list[str], dict[int, np.ndarray]]]:
    """Columns in which what every fit's encoder makes of a row is linear, and the encoded names with a matrix per fit."""
    shape = _shape(numeric, categorical)
    scale = {g: [(r[f"_m_{i}"], r[f"_a_{i}"], r[f"_s_{i}"]) for i in range(len(numeric))] for g, r in found.items()}
    scale = {g: v for g, v in sorted(scale.items()) if all(x is not None and math.isfinite(x) for e in v for x in e)}
    if not scale:
        return [], (shape.columns, {})
    first = [(a, s if s > 0 else 1.0) for _, a, s in next(iter(scale.values()))]
    names, columns = [], []
    for i, ((a, s), name) in enumerate(zip(first, numeric)):
        v = (F.col(name).cast("double") - a) / s
        names += [f"_u_{i}", f"_z_{i}"]
        columns += [F.when(v.isNull(), 0.0).when(F.abs(v) < float("inf"), v).otherwise(float("nan")), F.col(name).isNull().cast("double")]
    for j, (name, levels) in enumerate(categorical.items()):
        v = F.col(name).cast("string")
        names += [*[f"_c_{j}_{k}" for k in range(1, len(levels))], f"_y_{j}"]
        columns += [*[F.coalesce((v == level).cast("double"), F.lit(0.0)) for level in levels[1:]], v.isNull().cast("double")]
    turns = {}
    for g, scales in scale.items():
        turn = np.zeros((len(names) + 1, len(shape.columns) + 1))
        turn[0, 0] = 1.0
        at, to = 1, 1
        for (a, s), (median, mean, deviation) in zip(first, scales):
            unit = deviation if deviation > 0 else 1.0
            turn[[0, at, at + 1], to] = (a - mean) / unit, s / unit, (median - a) / unit
            at, to = at + 2, to + 1
        for j, levels in enumerate(categorical.values()):
            mode = found[g][f"_o_{j}"]
            mode = levels[0] if mode is None else mode
            for k, level in enumerate(levels[1:]):
                turn[at + k, to + k] = 1.0
                turn[at + len(levels) - 1, to + k] = float(mode == level)
            at, to = at + len(levels), to + len(levels) - 1
        turns[int(g)] = turn
    return [v.alias(n) for v, n in zip(columns, names)], (shape.columns, turns)


def repeated_calibrated_models(
    df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], row_id: str, label: str,
    folds: int = 5, repeats: int = 10, inner: int = 3, seed: int = 42, c: float = 1.0, method: str = "isotonic", epsilon: float = 1e-6,
) -> DataFrame:
    """Mean held-out score per row of a calibrated model fitted anew in every fold of every repeat, with its coverage.

    The training rows of a fold are dealt to ``inner`` stratified parts. For each part a model is fitted to the others
    and its scores of the part are calibrated; the held-out rows' score is the mean over the parts. Models, encoders
    and calibrations of all folds, repeats and parts share their passes over one table with a row per row.
    """
    number = ((F.col("repeat") - 1) * folds + F.col("fold")).cast("int")
    dealt = row_folds(df, row_id, label, folds, seed, repeats).groupBy(row_id).agg(F.collect_list(number).alias("_held"))
    rows = df.select(row_id, label, *numeric, *categorical).join(dealt, row_id)
    rows = deal_parts(rows, row_id, label, folds, repeats, inner, seed)
    found = encoders_of_counts(rows, numeric, list(categorical), folds * repeats * inner)
    columns, maps = _shared_columns(found, numeric, categorical)
    groups: dict[int, np.ndarray] = {}
    if maps[1]:
        frame = rows.select("counts", F.col(label).cast("double").alias("_y"), *columns)
        groups = fit_resampled_logistic(frame, frame.columns[2:], "_y", c, maps=maps).groups
    scorer, features = FoldScorer.of(groups, found, numeric, categorical), feature_columns(numeric, list(categorical))
    if method == "isotonic":
        pools = pools_of_known(rows, row_id, label, scorer, features, inner).select("fit", "low", "high", "value")
        few = pools.limit(MAX_POOLS + 1).collect()
        if len(few) <= MAX_POOLS:
            return average_out_of_fold(mean_calibrated(rows, row_id, scorer, features, few, folds, repeats, inner), row_id, "score", repeats)
        calibrated = apply_isotonic(held_scores(rows, row_id, scorer, features, folds, inner), pools, "raw", ["fit"], "score")
    else:
        known, asked = known_scores(rows, label, scorer, features, inner), held_scores(rows, row_id, scorer, features, folds, inner)
        lines = fit_logistic(known.withColumn("_z", logit("raw", epsilon)), ["_z"], label, "fit", c=1e12, balanced=False)
        calibrated = score_by_fit(asked.withColumn("_z", logit("raw", epsilon)), lines, "score")
    mean = calibrated.groupBy(row_id, "repeat").agg(F.avg("score").alias("score"))
    return average_out_of_fold(mean, row_id, "score", repeats)


def score_by_fit(df: DataFrame, fits: LogisticFits, out: str) -> DataFrame:
    """Probability of each row under the fit that its column ``fit`` names."""
    betas = df.sparkSession.createDataFrame([(int(g), [float(v) for v in b]) for g, b in fits.groups.items()], "fit int, _b array<double>")
    linear = F.col("_b")[0]
    for i, name in enumerate(fits.features):
        linear = linear + F.col("_b")[i + 1] * F.col(name)
    return df.join(F.broadcast(betas), "fit").withColumn(out, 1.0 / (1.0 + F.exp(-linear))).drop("_b")  # one row per fit


def fit_calibration(oof: DataFrame, label: str, score: str = "raw_score", epsilon: float = 1e-6) -> Calibration:
    """Sigmoid on the log odds and isotonic regression, both fitted on out-of-fold scores."""
    frame = settle(oof.select(F.col(label).cast("double").alias("y"), F.col(score), logit(score, epsilon).alias("z")))
    sigmoid = fit_logistic(frame, ["z"], "y", c=1e12, balanced=False).groups[0]
    isotonic = IsotonicRegression(featuresCol=score, labelCol="y").fit(frame)
    return Calibration(float(sigmoid[0]), float(sigmoid[1]), isotonic, epsilon)


METHODS = ("Uncalibrated", "Sigmoid", "Isotonic")


def calibrated_long(df: DataFrame, score: str, keep: Sequence[str]) -> DataFrame:
    """Rows per method: the raw score and its two calibrated forms."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(c).alias("probability")) for m, c in zip(METHODS, (score, "sigmoid", "isotonic"), strict=True)]
    )
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.*")


def calibration_bootstrap(df: DataFrame, score: str, row_id: str, label: str, iterations: int, seed: int) -> DataFrame:
    """(iteration, model, brier_score) of the raw score and its calibrated forms on the same draws, within classes.

    A resample's Brier score is a ratio of two sums over its rows, so all resamples come from the counts of their draws.
    """
    forms = dict(zip(METHODS, (score, "sigmoid", "isotonic"), strict=True))
    # an id that stands for several rows has the scores of all of them
    scores = df.groupBy(row_id).agg(F.collect_list(F.struct(*forms.values())).alias("_scores"))
    rows = df.select(row_id, label).join(scores, row_id, "left")
    y = F.col(label).cast("double")

    def error(c: str) -> Column:
        squares = F.transform(F.col("_scores"), lambda s: F.pow(s[c] - y, F.lit(2.0)))
        return F.aggregate(squares, F.lit(0.0), lambda total, e: total + F.coalesce(e, F.lit(0.0)))

    known = F.col(row_id).isNotNull()
    sums = {f"_e{i}": F.when(known, error(c)) for i, c in enumerate(forms.values())} | {"_w": F.when(known, F.size("_scores"))}
    drawn = bootstrap_sums(rows, row_id, iterations, seed, sums, label)
    each = F.array(*[F.struct(F.lit(m).alias("model"), safe_div(F.col(f"_e{i}"), F.col("_w")).alias("brier_score")) for i, m in enumerate(forms)])
    return drawn.select("iteration", F.explode(each).alias("_m")).select("iteration", "_m.*")


def choose_calibration(
    metrics: DataFrame, differences: DataFrame, tolerance: float = 0.0005, minimum_gain: float = 0.001
) -> DataFrame:
    """Simplest calibrated method near the best Brier score, if calibration clearly helps; else none.

    ``differences`` holds paired Brier differences (model_a, model_b, bounds).
    """
    rank = F.when(F.col("method") == "Uncalibrated", 0).when(F.col("method") == "Sigmoid", 1).otherwise(2)
    table = metrics.select("method", F.col("brier_score").alias("validation_brier_score"), rank.alias("complexity_rank"))
    base = table.agg(
        F.min_by("method", "validation_brier_score").alias("best_observed_method"),
        F.min("validation_brier_score").alias("_best"),
        F.max(F.when(F.col("method") == "Uncalibrated", F.col("validation_brier_score"))).alias("_raw"),
    )
    signed = differences.select("model_a", "model_b", F.col("difference_lower").alias("lo"), F.col("difference_upper").alias("hi"))
    signed = signed.unionByName(
        signed.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi"))
    ).where(F.col("model_a") == "Uncalibrated").select(F.col("model_b").alias("method"), "lo", "hi")
    joined = table.crossJoin(F.broadcast(base)).join(signed, "method", "left")  # one row
    gap = F.col("validation_brier_score") - F.col("_best")
    gain = F.col("_raw") - F.col("validation_brier_score")
    low_of_best = F.max(F.when(F.col("method") == F.col("best_observed_method"), F.col("lo"))).over(Window.partitionBy())
    clear = (F.col("best_observed_method") != "Uncalibrated") & (F.col("_raw") - F.col("_best") >= minimum_gain) & F.coalesce(low_of_best > 0, F.lit(False))
    eligible = F.when(clear, (F.col("method") != "Uncalibrated") & (gap <= tolerance)).otherwise(F.col("method") == "Uncalibrated")
    decided = joined.select(
        "method",
        "validation_brier_score",
        "best_observed_method",
        gap.alias("gap_from_best_brier"),
        gain.alias("brier_improvement_vs_uncalibrated"),
        F.coalesce("lo", F.lit(0.0)).alias("improvement_lower_95"),
        F.coalesce("hi", F.lit(0.0)).alias("improvement_upper_95"),
        clear.alias("clear_calibration_gain"),
        (gap <= tolerance).alias("within_practical_tolerance"),
        eligible.alias("eligible_for_selection"),
        "complexity_rank",
    )
    simplest = F.min(F.when(F.col("eligible_for_selection"), F.col("complexity_rank"))).over(Window.partitionBy())
    return decided.withColumn("selected_method", F.col("complexity_rank") == simplest)  # a row per method


# ---- coefficients and importance ----------------------------------------------------------------------


def coefficient_table(fit: LogisticFits, encoder: Encoder, spark: SparkSession) -> DataFrame:
    """Coefficient, size and direction per encoded feature, with its source feature."""
    source = dict(encoder.encoded)
    beta = next(iter(fit.groups.values()))[1:]
    rows = [
        (name, source[name], float(b), abs(float(b)), "Higher attrition risk" if b > 0 else "Lower attrition risk" if b < 0 else "Neutral")
        for name, b in zip(fit.features, beta, strict=True)
    ]
    return spark.createDataFrame(
        rows, "transformed_feature string, source_feature string, raw_effect double, importance double, direction string"
    )


def tree_importance_table(model, encoder: Encoder, spark: SparkSession) -> DataFrame:
    source = dict(encoder.encoded)
    rows = [(n, source[n], float(v), float(v), "Non-directional") for n, v in zip(encoder.columns, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(
        rows, "transformed_feature string, source_feature string, raw_effect double, importance double, direction string"
    )


def importance_by_source(table: DataFrame) -> DataFrame:
    return table.groupBy("source_feature").agg(
        F.sum("importance").alias("total_importance"), F.count(F.lit(1)).alias("transformed_feature_count")
    )


def coefficient_stability(coefficients: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Median, interval and sign stability of each coefficient over its fits."""
    tail = (1.0 - confidence) / 2.0
    c = F.col("coefficient")
    grouped = coefficients.where(F.col("encoded_feature") != "intercept").groupBy("encoded_feature").agg(
        F.count(F.lit(1)).alias("fold_estimates"),
        F.percentile("coefficient", F.lit(0.5)).alias("coefficient_median"),
        F.percentile("coefficient", F.lit(tail)).alias("coefficient_lower_95"),
        F.percentile("coefficient", F.lit(1.0 - tail)).alias("coefficient_upper_95"),
        F.greatest(safe_div(count_if(c > 0), F.count(F.lit(1))), safe_div(count_if(c < 0), F.count(F.lit(1)))).alias("sign_stability"),
        F.avg("coefficient").alias("bootstrap_mean"),
        F.stddev_samp("coefficient").alias("bootstrap_standard_deviation"),
    )
    median = F.col("coefficient_median")
    excludes = (F.col("coefficient_lower_95") > 0) | (F.col("coefficient_upper_95") < 0)
    return grouped.select(
        "*",
        F.exp(median).alias("median_odds_ratio"),
        excludes.alias("interval_excludes_zero"),
        F.when(median > 0, "Higher modeled attrition association").otherwise("Lower modeled attrition association").alias("direction"),
        F.abs(median).alias("absolute_median"),
    )


def cluster_bootstrap_coefficients(
    encoded: DataFrame, features: Sequence[str], label: str, entity: str, iterations: int, seed: int, c: float = 1.0, minimum_stability: float = 0.9
) -> DataFrame:
    """Coefficient intervals from resampled entities; the fits of all resamples share their jobs."""
    entities = encoded.select(entity).distinct()
    drawn = bootstrap_counts(entities, entity, iterations, seed)
    fits = fit_resampled_logistic(encoded.join(drawn, entity), features, label, c)
    table = coefficient_stability(fits.table(encoded.sparkSession))
    reportable = F.col("interval_excludes_zero") & (F.col("sign_stability") >= minimum_stability)
    return table.withColumn("reportable_direction", reportable)


# ---- explanation --------------------------------------------------------------------------------------


def direction_label(value: Column, tolerance: float = 1e-12) -> Column:
    return (
        F.when(value > tolerance, "Higher modeled log-odds")
        .when(value < -tolerance, "Lower modeled log-odds")
        .otherwise("Near-zero mean contribution")
    )


def background_means(encoded: DataFrame, features: Sequence[str]) -> list[float]:
    row = encoded.agg(*[F.avg(f).alias(f) for f in features]).first()
    return [float(row[f]) for f in features]


def linear_contributions(
    encoded: DataFrame, encoder: Encoder, beta: np.ndarray, means: Sequence[float], keep: Sequence[str]
) -> DataFrame:
    """β·(x − mean) summed to the raw features as ``phi_<feature>``, and ``base_value``.

    ``base_value`` plus the contributions is the log odds of the row.
    """
    terms: dict[str, Column] = {}
    for (name, raw), b, m in zip(encoder.encoded, beta[1:], means, strict=True):
        term = (F.col(name) - float(m)) * float(b)
        terms[raw] = terms[raw] + term if raw in terms else term
    base = float(beta[0] + np.dot(beta[1:], means))
    return encoded.select(*keep, F.lit(base).alias("base_value"), *[c.alias(f"phi_{_safe(r)}") for r, c in terms.items()])


def _long_contributions(df: DataFrame, raw: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("raw_feature"), F.col(f"phi_{_safe(r)}").alias("phi")) for r in raw])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")


def global_importance(df: DataFrame, raw: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and signed contribution, share, rank (ties by name) and direction per raw feature."""
    grouped = _long_contributions(df, raw, by).groupBy(*by, "raw_feature").agg(
        F.avg(F.abs("phi")).alias("mean_absolute_shap_log_odds"), F.avg("phi").alias("mean_signed_shap_log_odds")
    )
    everything = Window.partitionBy(*by)  # a row per feature
    order = everything.orderBy(F.col("mean_absolute_shap_log_odds").desc(), "raw_feature")
    return grouped.select(
        "*",
        safe_div(F.col("mean_absolute_shap_log_odds"), F.sum("mean_absolute_shap_log_odds").over(everything)).alias("importance_share"),
        F.row_number().over(order).alias("importance_rank"),
        direction_label(F.col("mean_signed_shap_log_odds")).alias("mean_direction"),
    )


def quartile_summary(df: DataFrame, raw: Sequence[str], score: str, row_id: str) -> DataFrame:
    """Mean contributions per score quartile and raw feature."""
    quarters = quantile_groups(df, [Key(score), Key(row_id)], 4, out="probability_quartile")
    return _long_contributions(quarters, raw, ["probability_quartile", score]).groupBy("probability_quartile", "raw_feature").agg(
        F.count(F.lit(1)).alias("employees"),
        F.avg(score).alias("mean_probability"),
        F.avg("phi").alias("mean_signed_shap_log_odds"),
        F.avg(F.abs("phi")).alias("mean_absolute_shap_log_odds"),
        direction_label(F.avg("phi")).alias("mean_direction"),
    )


def driver_frequency(df: DataFrame, raw: Sequence[str]) -> DataFrame:
    """How often each feature is a row's largest and smallest contribution; zero where it never is."""
    entries = [
        F.struct(F.col(f"phi_{_safe(r)}").alias("v"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, r in enumerate(raw)
    ]
    lowest = [
        F.struct(F.col(f"phi_{_safe(r)}").alias("v"), F.lit(i).alias("o"), F.lit(r).alias("r")) for i, r in enumerate(raw)
    ]
    kinds = F.array(
        F.struct(F.lit("Strongest positive model driver").alias("driver_type"), F.array_max(F.array(*entries)).r.alias("raw_feature")),
        F.struct(F.lit("Strongest negative model driver").alias("driver_type"), F.array_min(F.array(*lowest)).r.alias("raw_feature")),
    )
    counts = df.select(F.explode(kinds).alias("_k")).select("_k.*").groupBy("driver_type", "raw_feature").agg(
        F.count(F.lit(1)).alias("n")
    )
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(k, r) for k in ("Strongest positive model driver", "Strongest negative model driver") for r in raw],
        "driver_type string, raw_feature string",
    )
    filled = grid.join(counts, ["driver_type", "raw_feature"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.sum("n").over(Window.partitionBy("driver_type"))
    return filled.select("driver_type", "raw_feature", F.col("n").alias("employee_appearances"), safe_div(F.col("n"), total).alias("appearance_share"))


def explanation_stability(
    history: DataFrame,
    current: DataFrame,
    encoder: Encoder,
    entity: str,
    row_id: str,
    label: str,
    score: str,
    folds: int = 5,
    seed: int = 42,
    top_k: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refit without each fold's entities and explain the same current rows.

    Gives (per fold and feature, per fold pair, per feature). The fold fits share their jobs. Each fold's encoder and
    background come from its own training rows; ``encoder`` names the features and their categories.
    """
    placed = settle(history.join(grouped_folds(history, entity, label, folds, seed), entity))
    quarters = settle(quantile_groups(current, [Key(score), Key(row_id)], 4, out="_q"))
    everywhere = quarters.withColumn("fit", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    numeric, levels = list(encoder.numeric), encoder.levels
    # rows are not copied for the fits, nor for the features
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda k: k != F.col("fold"))
    fits, fitted = fit_fold_logistic(placed.withColumn("_train", others), numeric, levels, label, folds)
    rows = encode_with(everywhere, fitted, numeric, levels, ["_q"])
    names = _shape(numeric, levels).columns
    means = encode_with(fit_copies(placed, folds), fitted, numeric, levels, []).groupBy("fit").agg(F.array(*[F.avg(c) for c in names]).alias("_m"))
    betas = history.sparkSession.createDataFrame([(int(g), [float(v) for v in b]) for g, b in fits.groups.items()], "fit int, _b array<double>")
    shifted = rows.join(F.broadcast(means.join(betas, "fit")), "fit")  # one row per fit
    terms: dict[str, Column] = {}
    for i, (name, raw) in enumerate(encoder.encoded):
        term = (F.col(name) - F.col("_m")[i]) * F.col("_b")[i + 1]
        terms[raw] = terms[raw] + term if raw in terms else term
    phis = shifted.select(F.col("fit").alias("fold"), "_q", *[c.alias(f"_p_{k}") for k, c in enumerate(terms.values())])
    sums = phis.groupBy("fold").agg(
        *[F.avg(F.abs(f"_p_{k}")).alias(f"_a_{k}") for k in range(len(terms))],
        *[F.avg(F.when(F.col("_q") == 4, F.col(f"_p_{k}"))).alias(f"_s_{k}") for k in range(len(terms))],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(raw).alias("raw_feature"), F.col(f"_a_{k}").alias("mean_absolute_shap_log_odds"),
                F.col(f"_s_{k}").alias("mean_signed_shap_highest_quartile"),
            )
            for k, raw in enumerate(terms)
        ]
    )
    grouped = sums.select("fold", F.explode(pairs).alias("_p")).select("fold", "_p.*")
    order = Window.partitionBy("fold").orderBy(F.col("mean_absolute_shap_log_odds").desc(), "raw_feature")
    features = settle(
        grouped.select(
            "*",
            F.row_number().over(order).alias("importance_rank"),
            direction_label(F.col("mean_signed_shap_highest_quartile")).alias("highest_quartile_direction"),
        )
    )
    a = features.select(F.col("fold").alias("first_fold"), "raw_feature", F.col("mean_absolute_shap_log_odds").alias("_a"), F.col("importance_rank").alias("_ka"))
    b = features.select(F.col("fold").alias("second_fold"), "raw_feature", F.col("mean_absolute_shap_log_odds").alias("_b"), F.col("importance_rank").alias("_kb"))
    # folds × features rows, not data rows
    paired = settle(a.join(b, "raw_feature").where(F.col("first_fold") < F.col("second_fold")))
    by = ["first_fold", "second_fold"]
    correlation = spearman(paired, "_a", "_b", by, "spearman_rank_correlation")
    shared = paired.groupBy(*by).agg(
        safe_div(
            count_if((F.col("_ka") <= top_k) & (F.col("_kb") <= top_k)), count_if((F.col("_ka") <= top_k) | (F.col("_kb") <= top_k))
        ).alias("top_k_jaccard")
    )
    return features, correlation.join(shared, by), summarize_stability(features, top_k)


def summarize_stability(features: DataFrame, top_k: int = 10) -> DataFrame:
    """Spread of importance, rank and direction of each feature over the folds."""
    middle = features.groupBy("raw_feature").agg(F.percentile("mean_signed_shap_highest_quartile", F.lit(0.5)).alias("_m"))
    joined = features.join(middle, "raw_feature")
    signed = F.col("mean_signed_shap_highest_quartile")
    stable = F.when(F.col("_m") == 0, F.abs(signed) <= 1e-12).otherwise(F.signum(signed) == F.signum("_m"))
    return joined.groupBy("raw_feature").agg(
        F.percentile("mean_absolute_shap_log_odds", F.lit(0.5)).alias("median_fold_mean_absolute_shap_log_odds"),
        F.min("mean_absolute_shap_log_odds").alias("minimum_fold_mean_absolute_shap_log_odds"),
        F.max("mean_absolute_shap_log_odds").alias("maximum_fold_mean_absolute_shap_log_odds"),
        F.avg("importance_rank").alias("mean_fold_rank"),
        F.min("importance_rank").alias("minimum_fold_rank"),
        F.max("importance_rank").alias("maximum_fold_rank"),
        count_if(F.col("importance_rank") <= top_k).alias("top_k_fold_count"),
        F.max("_m").alias("median_signed_shap_highest_quartile"),
        direction_label(F.max("_m")).alias("highest_quartile_direction"),
        F.avg(stable.cast("int")).alias("direction_stability"),
    )


def score_population(
    history: DataFrame, current: DataFrame, encoder: Encoder, label: str, keep: Sequence[str], calibration: Calibration | None = None
) -> DataFrame:
    """Refit on the whole history and score the current rows, calibrated if a calibration is given."""
    fits = fit_logistic(encoder.transform(history, [label]), encoder.columns, label)
    scored = fits.score(encoder.transform(current, keep), out="raw_score").select(*keep, "raw_score")
    if calibration is None:
        return scored.withColumn("attrition_probability", F.col("raw_score"))
    return calibration.apply(scored, "raw_score").withColumn("attrition_probability", F.col("sigmoid"))


