"""Exact ranking, classification and calibration metrics.

Curve metrics collapse the rows to distinct scores first; sums over them run in
score ranges, so neither ties nor size pull the scores into one task. Every
function takes ``by`` columns and then works per group in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import clip, count_if, safe_div, zero_div
from stayline.operators.rank import (
    Key,
    attach,
    equal_frequency_bins,
    ranked,
    running_totals,
    top_count,
    value_counts_running,
)
from stayline.session import store

# The fractions of the ranking grid.
GRID_FRACTIONS = (0.01, 0.025, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.75, 1.00)


def confusion(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*by).agg(
        count_if(~y & ~predicted).alias("true_negative"),
        count_if(~y & predicted).alias("false_positive"),
        count_if(y & ~predicted).alias("false_negative"),
        count_if(y & predicted).alias("true_positive"),
    )


def threshold_sweep(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Classification figures at each threshold, from one pass with two counts per threshold."""
    y = F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        count_if(y).alias("_p"),
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    count_if((F.col(score) >= t) & y).alias("tp"),
                    count_if((F.col(score) >= t) & ~y).alias("fp"),
                )
                for t in thresholds
            ]
        ).alias("_t"),
    )
    flat = counts.select(*by, "_n", "_p", F.explode("_t").alias("_x")).select(*by, "_n", "_p", "_x.*")
    fn = F.col("_p") - F.col("tp")
    tn = F.col("_n") - F.col("_p") - F.col("fp")
    predicted = F.col("tp") + F.col("fp")
    precision, recall = zero_div(F.col("tp"), predicted), zero_div(F.col("tp"), F.col("_p"))
    return flat.select(
        *by,
        "threshold",
        F.round(safe_div(F.col("tp") + tn, F.col("_n")), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(zero_div(2 * precision * recall, precision + recall), 4).alias("f1"),
        predicted.alias("predicted_attrition_count"),
        tn.alias("true_negative"),
        F.col("fp").alias("false_positive"),
        fn.alias("false_negative"),
        F.col("tp").alias("true_positive"),
    )


def recommended_threshold(sweep: DataFrame, minimum_recall: float = 0.60) -> DataFrame:
    """Best precision, F1, then highest threshold with enough recall; else the best F1."""
    enough = F.col("recall") >= minimum_recall
    order = F.struct(
        enough.cast("int"), F.when(enough, F.col("precision")).otherwise(F.col("f1")), "f1", "threshold"
    )
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("_b")).select("_b.*")


def score_steps(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Positives and negatives per distinct score, best score first, with running counts."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return value_counts_running(
        df.where(F.col(score).isNotNull()),
        Key(score, True),
        {
            "pos": F.sum(F.when(F.col(label) == 1, w).otherwise(zero)),
            "neg": F.sum(F.when(F.col(label) == 1, zero).otherwise(w)),
        },
        by,
    )


def rank_metrics(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """ROC-AUC with ties counted half and step-wise average precision; null where undefined."""
    steps = score_steps(df, score, label, by, weight)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    summed = steps.groupBy(*by).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("_above"),
        F.sum(F.col("pos") * precision).alias("_ap"),
    )
    return summed.select(
        *by,
        safe_div(F.col("_above"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.when(F.col("_n") > 0, safe_div(F.col("_ap"), F.col("_p"))).alias("pr_auc"),
    )


def probability_metrics(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), epsilon: float = 1e-6, weight: str | None = None
) -> DataFrame:
    """Rows, positives, Brier score and skill, log loss, mean gap."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p, y = F.col(score), F.col(label).cast("double")
    safe = clip(p, epsilon, 1.0 - epsilon)
    loss = -(y * F.log(safe) + (1.0 - y) * F.log(1.0 - safe))
    sums = df.groupBy(*by).agg(
        F.sum(w).alias("_w"),
        F.sum(w * y).alias("_y"),
        F.sum(w * p).alias("_p"),
        F.sum(w * F.pow(p - y, F.lit(2.0))).alias("_b"),
        F.sum(w * loss).alias("_l"),
    )
    rate, brier = F.col("_y") / F.col("_w"), F.col("_b") / F.col("_w")
    null_brier = rate * (1.0 - rate)
    gap = F.col("_p") / F.col("_w") - rate
    return sums.select(
        *by,
        F.col("_w").cast("bigint").alias("rows"),
        F.col("_y").cast("bigint").alias("positive_cases"),
        rate.alias("observed_attrition_rate"),
        (F.col("_p") / F.col("_w")).alias("mean_predicted_probability"),
        gap.alias("mean_calibration_gap"),
        brier.alias("brier_score"),
        F.when(null_brier > 0, 1.0 - brier / null_brier).otherwise(0.0).alias("brier_skill_score"),
        (F.col("_l") / F.col("_w")).alias("log_loss"),
    )


def _cumulative(steps: DataFrame, grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running figures over the steps of a small grid; a step without rows repeats the one before."""
    filled = grid.join(steps, [*by, "step"], "left")
    upto = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    return filled.select(
        *grid.columns,
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("selected_count"),
        F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("captured_positive_cases"),
        F.min("low").over(upto).alias("minimum_selected_probability"),
        F.max("high").over(after).alias("maximum_unselected_probability"),
    )


def _grid_output(cumulative: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    captured, selected = F.col("captured_positive_cases"), F.col("selected_count")
    base = safe_div(F.col("_pos"), F.col("_n"))
    precision = zero_div(captured, selected)
    return cumulative.select(
        *by,
        *keep,
        "selected_count",
        safe_div(selected, F.col("_n")).alias("actual_selected_fraction"),
        "captured_positive_cases",
        (selected - captured).alias("false_positive_cases"),
        precision.alias("precision_at_k"),
        zero_div(captured, F.col("_pos")).alias("capture_rate_at_k"),
        zero_div(precision, base).alias("lift_at_k"),
        (selected * base).alias("expected_random_positive_cases"),
        "minimum_selected_probability",
        "maximum_unselected_probability",
        safe_div(selected, captured).alias("reviews_per_captured_case"),
    )


def _step_totals(df: DataFrame, step: Column, score: str, label: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, step.cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col(label) == 1).alias("p"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
    )


def _population(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(label) == 1).alias("_pos"))


def ranking_grid(
    df: DataFrame,
    score: str,
    label: str,
    row_id: str,
    fractions: Sequence[float] = GRID_FRACTIONS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, capture and lift among the first ``ceil(n * f)`` rows, for each fraction.

    Rows are ranked once and counted per step between neighbouring cut-offs; the
    cumulative figures then run over the few steps.
    """
    numbered = ranked(df, [Key(score, True), Key(row_id)], by, out="_r")
    people = _population(df, label, by)
    sized = attach(numbered, people.drop("_pos"), by)
    step = F.lit(1)
    for f in fractions:
        step = step + F.when(F.col("_r") > top_count(F.col("_n"), float(f)), 1).otherwise(0)
    steps = _step_totals(sized, step, score, label, by)
    entries = [F.struct(F.lit(i + 1).alias("step"), F.lit(float(f)).alias("requested_fraction")) for i, f in enumerate(fractions)]
    # one further step holds the rows after the last cut-off
    entries.append(F.struct(F.lit(len(fractions) + 1).alias("step"), F.lit(None).cast("double").alias("requested_fraction")))
    grid = people.select(*by, "_n", "_pos", F.explode(F.array(*entries)).alias("_e")).select(*by, "_n", "_pos", "_e.*")
    cumulative = _cumulative(steps, grid, by).where(F.col("requested_fraction").isNotNull())
    return _grid_output(cumulative, by, ["requested_fraction"])


def gains_grid(
    df: DataFrame, score: str, label: str, row_id: str, points: int = 100, by: Sequence[str] = ()
) -> DataFrame:
    """The same figures on an even grid; the step of a row follows from its rank."""
    numbered = ranked(df, [Key(score, True), Key(row_id)], by, out="_r")
    people = _population(df, label, by)
    sized = attach(numbered, people.drop("_pos"), by)
    step = F.floor((F.col("_r") - 1) * F.lit(points) / F.col("_n")) + 1
    steps = _step_totals(sized, step, score, label, by)
    grid = people.select(*by, "_n", "_pos", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("step"))
    return _grid_output(_cumulative(steps, grid, by), by, ["step"])


def curve_points(df: DataFrame, score: str, label: str, row_id: str, points: int = 100) -> DataFrame:
    """Precision-recall, ROC, cumulative gains and lift points in one long table.

    The first two have a point per distinct score plus the end point of the empty
    selection; collinear ROC points are kept.
    """
    steps = score_steps(df, score, label)
    total = df.agg(count_if(F.col(label) == 1).alias("_pos"), count_if(F.col(label) != 1).alias("_neg"))
    steps = attach(steps, total, [])
    recall = safe_div(F.col("cum_pos"), F.col("_pos"))
    fallout = safe_div(F.col("cum_neg"), F.col("_neg"))
    precision = safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    curves = F.array(
        F.struct(F.lit("precision_recall").alias("curve_type"), recall.alias("x"), precision.alias("y")),
        F.struct(F.lit("roc").alias("curve_type"), fallout.alias("x"), recall.alias("y")),
    )
    observed = steps.select(F.explode(curves).alias("_c"), F.col(score).alias("threshold")).select("_c.*", "threshold")
    ends = F.array(
        F.struct(F.lit("precision_recall").alias("curve_type"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")),
        F.struct(F.lit("roc").alias("curve_type"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
    )
    empty = total.select(F.explode(ends).alias("_c")).select("_c.*", F.lit(None).cast("double").alias("threshold"))
    gains = gains_grid(df, score, label, row_id, points)
    pairs = F.array(
        F.struct(F.lit("cumulative_gains").alias("curve_type"), F.col("capture_rate_at_k").alias("y")),
        F.struct(F.lit("lift").alias("curve_type"), F.col("lift_at_k").alias("y")),
    )
    even = gains.select(
        F.explode(pairs).alias("_c"), F.col("actual_selected_fraction").alias("x"), F.col("minimum_selected_probability").alias("threshold")
    ).select("_c.curve_type", "x", "_c.y", "threshold")
    return observed.unionByName(empty).unionByName(even)


def calibration_table(
    df: DataFrame, score: str, label: str, row_id: str, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-frequency bins by score: mean score, observed rate and their gap."""
    binned = equal_frequency_bins(df, [Key(score), Key(row_id)], bins, by)
    grouped = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(label).cast("bigint").alias("positive_cases"),
        F.min(score).alias("minimum_probability"),
        F.max(score).alias("maximum_probability"),
        F.avg(score).alias("mean_predicted_probability"),
        F.avg(label).alias("observed_attrition_rate"),
    )
    gap = F.col("mean_predicted_probability") - F.col("observed_attrition_rate")
    return grouped.withColumn("calibration_gap", gap).withColumn("absolute_calibration_gap", F.abs(gap))


def calibration_errors(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected (size-weighted) and maximum absolute gap over the bins."""
    return table.groupBy(*by).agg(
        safe_div(F.sum(F.col("records") * F.col("absolute_calibration_gap")), F.sum("records")).alias(
            "expected_calibration_error"
        ),
        F.max("absolute_calibration_gap").alias("maximum_calibration_error"),
    )


def calibration_metrics(
    df: DataFrame, score: str, label: str, row_id: str, by: Sequence[str] = (), bins: int = 10, fraction: float = 0.10
) -> DataFrame:
    """Probability, calibration and ranking figures side by side, one row per group."""
    out = probability_metrics(df, score, label, by)
    parts = [
        calibration_errors(calibration_table(df, score, label, row_id, bins, by), by),
        rank_metrics(df, score, label, by),
        ranking_grid(df, score, label, row_id, [fraction], by).select(
            *by, "selected_count", "precision_at_k", "capture_rate_at_k", "lift_at_k"
        ),
    ]
    for part in parts:
        out = attach(out, part, by)
    return out


def weighted_top_fraction(
    weights: DataFrame, score: str, label: str, row_id: str, fraction: float, by: Sequence[str]
) -> DataFrame:
    """Precision, capture and lift of the top fraction when each row counts ``weight`` times."""
    y = (F.col(label) == 1).cast("bigint")
    totals = weights.groupBy(*by).agg(
        F.sum("weight").alias("_n"), F.sum(F.col("weight") * y).alias("_pos")
    )
    running = running_totals(weights, [Key(score, True), Key(row_id)], {"_cum": "weight"}, by)
    sized = attach(running, totals, by)
    k = top_count(F.col("_n"), fraction)
    taken = F.greatest(F.lit(0), F.least(F.col("weight"), k - (F.col("_cum") - F.col("weight"))))
    grouped = sized.groupBy(*by).agg(
        F.max(k).alias("_k"), F.sum(taken * y).alias("_hit"), F.max("_n").alias("_n"), F.max("_pos").alias("_pos")
    )
    precision = zero_div(F.col("_hit"), F.col("_k"))
    return grouped.select(
        *by,
        precision.alias("top_precision"),
        zero_div(F.col("_hit"), F.col("_pos")).alias("top_capture"),
        zero_div(precision, safe_div(F.col("_pos"), F.col("_n"))).alias("top_lift"),
    )


def bootstrap_metrics(
    weights: DataFrame, score: str, label: str, row_id: str, by: Sequence[str], fraction: float = 0.10
) -> DataFrame:
    """Ranking and probability metrics per resample (and per model, if ``by`` names one)."""
    out = rank_metrics(weights, score, label, by, "weight")
    brier = probability_metrics(weights, score, label, by, weight="weight").select(*by, "brier_score")
    top = weighted_top_fraction(weights, score, label, row_id, fraction, by)
    return out.join(brier, list(by)).join(top, list(by))


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of counts, the last column, as bytes: ``b`` and a byte per count, or ``i`` and four where one is above 255."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        counts = np.asarray(lists.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int32)
        head, kind = (b"b", np.uint8) if counts.max(initial=0) < 256 else (b"i", np.int32)
        packed = pa.array([head + r.tobytes() for r in counts.astype(kind)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


#: Ordered rows that one group of resampled metrics holds.
RESAMPLED_ROWS = 4096


def resampled_metrics(
    counted: DataFrame, score: str, label: str, row_id: str, by: Sequence[str] = (), fraction: float = 0.10, rows: int = RESAMPLED_ROWS
) -> DataFrame:
    """``bootstrap_metrics`` of all resamples from rows with their ``counts``, as one ordering of the rows.

    Rows are ordered by falling score once per group of ``by``. A block of neighbours holds its counts as a matrix, finds
    what precedes it in each resample from the totals of the blocks before, and sums all scores that lie inside it. The
    first and the last score of a block may go on in its neighbours: these are put together by score.
    """
    by = list(by)
    chosen = counted.select(
        *by, F.col(score).cast("double").alias("_s"), F.col(row_id).alias("_id"), (F.col(label) == 1).cast("int").alias("_y"),
        F.pow(F.col(score) - F.col(label).cast("double"), F.lit(2.0)).alias("_e"), "counts",
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("counts").schema)
    chosen = store(chosen.mapInArrow(_packed_counts, f"{kept}, counts binary"))
    numbered = ranked(chosen, [Key("_s", True), Key("_id")], by, out="_r").drop("_id")
    blocks = store(numbered.withColumn("_block", F.floor((F.col("_r") - 1) / rows)))
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    head = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def matrix(table: pa.Table) -> np.ndarray:
        rows = table["counts"].to_pylist()
        if len({len(r) for r in rows}) == 1 and rows[0][:1] == b"b":
            return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:]
        return np.array([np.frombuffer(r, np.uint8 if r[:1] == b"b" else np.int32, offset=1) for r in rows])

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, and which rows are positive, and have a score."""
        return matrix(table).astype(np.int64), table["_y"].fill_null(0).to_numpy() == 1, ~np.asarray(table["_s"].is_null())

    def named(table: pa.Table, columns: dict[str, np.ndarray | pa.Array]) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({c: pa.repeat(table[c][0], n) for c in by} | columns)

    def total(table: pa.Table) -> pa.Table:
        counts, y, known = parts(table)
        sums = {"pos": counts[known & y].sum(axis=0), "neg": counts[known & ~y].sum(axis=0), "all": counts.sum(axis=0)}
        turns = pa.array(np.arange(1, counts.shape[1] + 1), pa.int32())
        return named(table, {"_block": pa.repeat(table["_block"][0], len(turns)), "iteration": turns} | sums)

    totals = blocks.groupBy(*by, "_block").applyInArrow(total, f"{head}_block long, iteration int, pos long, neg long, all long")
    whole = Window.partitionBy(*by, "iteration")  # a row per block
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(
        "iteration", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("pos", "neg", "all")],
        top_count(F.sum("all").over(whole), fraction).alias("cut"),
    )
    before = totals.select(*by, "_block", entry.alias("_e")).groupBy(*by, "_block").agg(F.array_sort(F.collect_list("_e")).alias("_before"))
    before = before.select(*by, "_block", *[F.col(f"_before.{c}").alias(c) for c in ("pos", "neg", "all", "cut")])

    def answer(table: pa.Table, sofar: pa.Table) -> pa.Table:
        table = table.sort_by("_r")
        counts, y, known = parts(table)
        pos, neg, all_, cut = (np.asarray(sofar[c].combine_chunks().flatten()) for c in ("pos", "neg", "all", "cut"))
        turns = np.arange(1, counts.shape[1] + 1)
        reached = np.cumsum(counts, axis=0) + all_ - counts
        hit = np.clip(cut - reached, 0, counts)[y].sum(axis=0)
        error = table["_e"].fill_null(0.0).to_numpy() @ counts
        out = [{"edge": None, "hit": hit, "error": error, "drawn": counts.sum(axis=0), "drawn_pos": counts[y].sum(axis=0)}]
        if known.any():
            s, known_y = table["_s"].to_numpy()[known], y[known][:, None]
            changed = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            p = np.add.reduceat(counts[known] * known_y, starts, axis=0)
            n = np.add.reduceat(counts[known] * ~known_y, starts, axis=0)
            cp, cn = np.cumsum(p, axis=0) + pos, np.cumsum(n, axis=0) + neg
            inside = slice(1, len(starts) - 1)
            above = (n * (cp - p / 2.0))[inside].sum(axis=0)
            precise = (p * (cp / np.maximum(cp + cn, 1)))[inside].sum(axis=0)
            out[0] |= {"above": above, "precise": precise, "pos": p[inside].sum(axis=0), "neg": n[inside].sum(axis=0)}
            for k in sorted({0, len(starts) - 1}):
                out.append({"edge": float(s[starts[k]]), "pos": p[k], "neg": n[k], "cum_pos": cp[k], "cum_neg": cn[k]})
        columns = {"iteration": pa.array(np.tile(turns, len(out)), pa.int32()), "edge": pa.array([o["edge"] for o in out for _ in turns], pa.float64())}
        for name, kind in fields.items():
            column = np.concatenate([o.get(name, np.zeros(len(turns))) for o in out])
            columns[name] = pa.array(column.astype(np.int64 if kind == "long" else np.float64))
        return named(table, columns)

    fields = {c: "long" for c in ("hit", "drawn", "drawn_pos", "pos", "neg", "cum_pos", "cum_neg")} | {c: "double" for c in ("error", "above", "precise")}
    shape = f"{head}iteration int, edge double, " + ", ".join(f"{c} {k}" for c, k in fields.items())
    found = blocks.groupBy(*by, "_block").cogroup(before.groupBy(*by, "_block")).applyInArrow(answer, shape)
    cumulated = ("cum_pos", "cum_neg")
    steps = found.groupBy(*by, "iteration", "edge").agg(*[(F.max if c in cumulated else F.sum)(c).alias(c) for c in fields])
    edge, p, n = F.col("edge").isNotNull(), F.col("pos"), F.col("neg")
    reach = F.col("cum_pos") + F.col("cum_neg")
    summed = steps.groupBy("iteration", *by).agg(
        *[F.sum(c).alias(f"_{c}") for c in ("hit", "drawn", "drawn_pos", "pos", "neg", "error")],
        F.sum(F.when(edge, n * (F.col("cum_pos") - p / 2.0)).otherwise(F.col("above"))).alias("_above"),
        F.sum(F.when(edge & (reach > 0), p * (F.col("cum_pos") / F.nullif(reach, F.lit(0)))).otherwise(F.col("precise"))).alias("_ap"),
    )
    cut = top_count(F.col("_drawn"), fraction)
    precision = zero_div(F.col("_hit"), cut)
    drawn = summed.where(F.col("_pos") + F.col("_neg") > 0)  # a resample without any score has no metrics
    return drawn.select(
        "iteration",
        *by,
        safe_div(F.col("_above"), F.col("_pos").cast("double") * F.col("_neg")).alias("roc_auc"),
        F.when(F.col("_neg") > 0, safe_div(F.col("_ap"), F.col("_pos"))).alias("pr_auc"),
        (F.col("_error") / F.col("_drawn")).alias("brier_score"),
        precision.alias("top_precision"),
        zero_div(F.col("_hit"), F.col("_drawn_pos")).alias("top_capture"),
        zero_div(precision, safe_div(F.col("_drawn_pos"), F.col("_drawn"))).alias("top_lift"),
    )


def ranking_summary(df: DataFrame, score: str, label: str, row_id: str, fraction: float = 0.10) -> DataFrame:
    """Prevalence, average precision and its lift, AUC, and the reporting fraction's confusion counts."""
    people = _population(df, label, [])
    curve = rank_metrics(df, score, label)
    grid = ranking_grid(df, score, label, row_id, [fraction])
    joined = attach(attach(people, curve, []), grid, [])
    rate = safe_div(F.col("_pos"), F.col("_n"))
    tp, fp = F.col("captured_positive_cases"), F.col("false_positive_cases")
    return joined.select(
        F.col("_n").alias("validation_rows"),
        F.col("_pos").alias("positive_cases"),
        rate.alias("positive_rate"),
        "pr_auc",
        safe_div(F.col("pr_auc"), rate).alias("pr_auc_lift_over_no_skill"),
        "roc_auc",
        F.col("requested_fraction").alias("reporting_fraction"),
        F.col("selected_count").alias("reporting_selected_count"),
        F.col("precision_at_k").alias("reporting_precision"),
        F.col("capture_rate_at_k").alias("reporting_capture_rate"),
        F.col("lift_at_k").alias("reporting_lift"),
        F.col("minimum_selected_probability").alias("reporting_probability_cutoff"),
        (F.col("_n") - F.col("_pos") - fp).alias("true_negative"),
        fp.alias("false_positive"),
        (F.col("_pos") - tp).alias("false_negative"),
        tp.alias("true_positive"),
    )


def fold_robustness(
    df: DataFrame, score: str, label: str, row_id: str, model: str, fold: str, fraction: float = 0.10
) -> tuple[DataFrame, DataFrame]:
    """Metrics per model and fold, and their mean and standard deviation over the folds."""
    by = [model, fold]
    per_fold = calibration_metrics(df, score, label, row_id, by, fraction=fraction).select(
        *by, "rows", "positive_cases", "pr_auc", "roc_auc", "brier_score", "precision_at_k", "lift_at_k"
    )
    names = ["pr_auc", "roc_auc", "brier_score", "precision_at_k", "lift_at_k"]
    summary = per_fold.groupBy(model).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.stddev_samp(n).alias(f"{n}_std") for n in names],
    )
    return per_fold, summary


