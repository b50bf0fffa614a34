"""Splits, folds, bootstrap draws and percentile intervals.

All draws come from md5, so they do not depend on partitioning or on a retry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.expr import count_if, draw, safe_div
from stayline.operators.rank import Key, attach, group_size, ranked, top_count
from stayline.session import settle, store

#: Rows whose draws one group counts (below 65536), draws that are packed at a time, and draws of a task.
BLOCK, PACK, TASK_DRAWS = 8192, 2_000_000, 40_000_000

def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores before rows are multiplied; a small input may sit in one partition."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def temporal_split(
    df: DataFrame, date: str, splits: dict[str, str], target: str, reserved: Sequence[str] = ("test",)
) -> DataFrame:
    """Split by date; the target of a reserved split is null."""
    split = F.lit(None).cast("string")
    for day, name in splits.items():
        split = F.when(F.col(date) == F.lit(day).cast("date"), name).otherwise(split)
    out = df.withColumn("split", split).where(F.col("split").isNotNull())
    return out.withColumn(target, F.when(~F.col("split").isin(*reserved), F.col(target)))


def assignments(split_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split assignment without the target."""
    return split_df.select(*keys, "split")


def split_summary(df: DataFrame, entity: str, target: str, reserved: Sequence[str] = ("test",)) -> DataFrame:
    """Rows, entities, positives and rate per split; reserved splits show no outcome figures."""
    per_entity = df.groupBy("split", entity).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).alias("p"), F.count(target).alias("labelled")
    )
    grouped = per_entity.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("p").alias("_p"),
        safe_div(F.sum("p"), F.sum("labelled")).alias("_r"),
    )
    open_split = ~F.col("split").isin(*reserved)
    return grouped.select(
        "split",
        "rows",
        "entities",
        F.when(open_split, F.coalesce("_p", F.lit(0)).cast("string")).otherwise("RESERVED").alias("positives"),
        F.when(open_split, F.col("_r")).alias("positive_rate"),
    )


def grouped_folds(df: DataFrame, entity: str, target: str, folds: int, seed: int) -> DataFrame:
    """(entity, fold): all rows of an entity in one fold; entities are dealt out in turn, most positives first."""
    per_entity = df.groupBy(entity).agg(F.coalesce(F.sum(target), F.lit(0)).alias("_pos"))
    hashed = per_entity.withColumn("_h", draw(str(seed), F.col(entity)))
    numbered = ranked(hashed, [Key("_pos", True), Key("_h"), Key(entity)], out="_r")
    return numbered.select(entity, ((F.col("_r") - 1) % folds + 1).cast("int").alias("fold"))


def balanced_folds(df: DataFrame, entity: str, target: str, folds: int, seed: int) -> DataFrame:
    """(entity, fold): all rows of an entity in one fold, with rows and positives balanced over the folds.

    Entities with equal numbers of rows and positives are one profile. Its members are dealt out evenly; the few that
    are left go one by one to the fold with the least load, the sum of its shares of all rows and of all positives, the
    largest profiles first. Only profiles come to the driver, and members take their fold by their rank in a hash order.
    """
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum(target), F.lit(0)).cast("bigint").alias("_pos"))
    sizes = settle(sizes)
    profiles = sizes.groupBy("_rows", "_pos").agg(F.count(F.lit(1)).alias("m")).collect()
    rows, positives = sum(r["_rows"] * r["m"] for r in profiles), sum(r["_pos"] * r["m"] for r in profiles)
    load, dealt = [0] * folds, []
    for r in sorted(profiles, key=lambda r: (-r["_rows"], -r["_pos"])):
        even = r["m"] // folds * folds
        for place in range(even + 1, r["m"] + 1):
            fold = load.index(min(load))
            # shares as integers: no rounding decides between folds
            load[fold] += r["_rows"] * max(positives, 1) + r["_pos"] * rows
            dealt.append((r["_rows"], r["_pos"], place, fold + 1))
    left = df.sparkSession.createDataFrame(dealt, "_rows long, _pos long, _r long, _fold int")
    hashed = sizes.withColumn("_h", draw(str(seed), F.col(entity)))
    numbered = ranked(hashed, [Key("_h"), Key(entity)], ["_rows", "_pos"], out="_r")
    joined = numbered.join(left, ["_rows", "_pos", "_r"], "left")
    return joined.select(entity, F.coalesce("_fold", ((F.col("_r") - 1) % folds + 1).cast("int")).alias("fold"))


def row_folds(df: DataFrame, row_id: str, target: str, folds: int, seed: int, repeats: int = 1) -> DataFrame:
    """(row, repeat, fold) stratified by class; each repeat is dealt out anew."""
    rows = spread(df.select(row_id, target), row_id) if repeats > 1 else df.select(row_id, target)
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    hashed = rows.withColumn("_h", draw(str(seed), F.col("repeat"), F.col(row_id)))
    numbered = ranked(hashed, [Key("_h"), Key(row_id)], ["repeat", target], out="_r")
    return numbered.select(row_id, "repeat", ((F.col("_r") - 1) % folds + 1).cast("int").alias("fold"))


def fold_summary(df: DataFrame, folds: DataFrame, entity: str, target: str) -> DataFrame:
    """Rows, entities, positives and rate per fold, and the entities that sit in several folds."""
    joined = df.join(folds, entity)
    per_entity = joined.groupBy("fold", entity).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("p"))
    shared = folds.groupBy(entity).agg(F.count_distinct("fold").alias("f")).agg(
        count_if(F.col("f") > 1).alias("entities_in_several_folds")
    )
    grouped = per_entity.groupBy("fold").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("p").alias("positives"),
        safe_div(F.sum("p"), F.sum("n")).alias("positive_rate"),
    )
    return attach(grouped, shared, [])


def stratified_holdout(df: DataFrame, row_id: str, target: str, fraction: float, seed: int) -> DataFrame:
    """Mark ``holdout`` for the given share of each class, by hash order."""
    hashed = df.withColumn("_h", draw(str(seed), F.col(row_id)))
    numbered = ranked(hashed, [Key("_h"), Key(row_id)], [target], out="_r")
    sized = attach(numbered, group_size(df, [target], "_n"), [target])
    return sized.withColumn("holdout", F.col("_r") <= top_count(F.col("_n"), fraction)).drop("_h", "_r", "_n")


def repeated_out_of_fold(
    df: DataFrame, row_id: str, target: str, folds: int, repeats: int, seed: int, category: str
) -> DataFrame:
    """Mean out-of-fold rate score per row over repeated stratified folds, with its coverage.

    The score of a row is the positive rate of its category among the rows of the
    other folds, found by subtracting the fold from the total: no loop over folds.
    """
    placed = settle(df.select(row_id, target, category).join(row_folds(df, row_id, target, folds, seed, repeats), row_id))
    per_fold = placed.groupBy("repeat", category, "fold").agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("n"))
    totals = per_fold.groupBy("repeat", category).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    base = df.agg(F.avg(target).alias("_base"))
    rates = attach(per_fold.join(totals, ["repeat", category]), base, []).select(
        "repeat",
        category,
        "fold",
        F.coalesce(safe_div(F.col("tp") - F.col("p"), F.col("tn") - F.col("n")), F.col("_base")).alias("score"),
    )
    # in files whose size the planner knows: the copies of all rows are not sorted by a few hundred keys
    scored = placed.join(store(rates), ["repeat", category, "fold"])
    return average_out_of_fold(scored, row_id, "score", repeats)


def average_out_of_fold(scored: DataFrame, row_id: str, score: str, repeats: int) -> DataFrame:
    """Mean score per row over the repeats and whether every repeat scored it exactly once."""
    # a bit per repeat needs no second exchange
    seen = F.bit_count(F.bit_or(F.expr("shiftleft(1L, CAST(repeat AS INT))"))) if repeats < 63 else F.count_distinct("repeat")
    return scored.groupBy(row_id).agg(
        F.avg(score).alias("mean_score"),
        F.count(F.lit(1)).alias("scores"),
        ((F.count(F.lit(1)) == repeats) & (seen == repeats)).alias("covered"),
    )


def _placed(df: DataFrame, row_id: str, strata: str | None, values: Sequence[str]) -> DataFrame:
    """Rows with their slot in the stratum, its size, and the number ``_at`` (from 0) that no other row of any stratum has.

    A row without a stratum is neither drawn nor a slot.
    """
    by = [strata] if strata else []
    base = df.select(*dict.fromkeys([row_id, *by, *values]))
    for c in by:
        base = base.where(F.col(c).isNotNull())
    base = settle(base)
    # a row per stratum
    before = F.sum("_n").over(Window.orderBy(*by or ["_n"]).rowsBetween(Window.unboundedPreceding, -1))
    sizes = group_size(base, by, "_n").withColumn("_first", F.coalesce(before, F.lit(0)))
    numbered = attach(ranked(base, [Key(row_id)], by, out="_slot"), sizes, by)
    return settle(numbered.withColumn("_at", F.col("_first") + F.col("_slot") - 1))


def _packed_draws(placed: DataFrame, iterations: int, seed: int, by: Sequence[str]) -> DataFrame:
    """(block, lengths, places): the draws of a lot of slots by block of drawn rows, in the order of the iterations.

    ``lengths`` says how many draws each iteration has there, ``places`` which rows of the block they are.
    """
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, placed.count() * iterations // TASK_DRAWS)
    prefixes = [f"{seed}|{i}|".encode() for i in range(1, iterations + 1)]
    slots = placed.select(F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "_slot"]]).alias("_text"), "_n", "_first")
    step = max(1, PACK // iterations)

    def pack(lot: pa.RecordBatch) -> pa.RecordBatch:
        # the first 8 bytes of the md5 of the text that ``draw`` makes, which keeps 60 of their bits
        texts = [t.encode() for t in lot.column(0).to_pylist()]
        number = np.frombuffer(b"".join([hashlib.md5(prefix + t).digest() for t in texts for prefix in prefixes]), ">u8")[::2]
        turn = np.tile(np.arange(iterations), lot.num_rows)
        size, first = (np.repeat(lot.column(c).to_numpy(), iterations) for c in (1, 2))
        at = first + (number >> 4).astype(np.int64) % size
        low = int(at.min()) // BLOCK
        which, place = at // BLOCK - low, (at % BLOCK).astype(np.uint16)
        cells = np.bincount(which * iterations + turn)
        lengths = np.pad(cells, (0, -len(cells) % iterations)).reshape(-1, iterations)
        names = np.flatnonzero(lengths.any(axis=1))
        order = np.lexsort((turn.astype(np.uint16 if iterations < 65536 else np.int64), which.astype(np.uint16 if len(lengths) < 65536 else np.int64)))
        sizes = lengths[names].sum(axis=1)
        places = [place[order[e - n : e]].tobytes() for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
        heads = [row.astype(np.uint32).tobytes() for row in lengths[names]]
        return pa.RecordBatch.from_arrays([pa.array(names + low, pa.int64()), pa.array(heads, pa.binary()), pa.array(places, pa.binary())], ["_block", "_lengths", "_places"])

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield pack(batch.slice(start, step))

    return slots.repartition(tasks).mapInArrow(lots, "_block long, _lengths binary, _places binary")


def _count_draws(
    df: DataFrame, row_id: str, iterations: int, seed: int, strata: str | None, values: Sequence[str],
    answer: Callable[[pa.Table, np.ndarray], pa.Table], kinds: Callable[[DataFrame], str],
) -> DataFrame:
    """``answer(rows, counts)`` of every block of rows; ``counts`` has a row per row and a column per resample.

    Resamples are with replacement inside each stratum, to its own size. Every row is also a slot: slot ``i`` of an
    iteration draws one row of its stratum by hash. Draws travel as two bytes each to the block of rows that they hit.
    """
    placed = _placed(df, row_id, strata, values)
    draws = _packed_draws(placed, iterations, seed, [strata] if strata else [])
    kept = placed.drop("_slot", "_n", "_first", "_at")
    columns = kept.columns

    def count(rows: pa.Table, cells: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        n = rows.num_rows
        lengths = np.frombuffer(b"".join(cells["_lengths"].to_pylist()), np.uint32)
        places = np.frombuffer(b"".join(cells["_places"].to_pylist()), np.uint16)
        turn = np.repeat(np.tile(np.arange(iterations), len(lengths) // iterations), lengths)
        counts = np.bincount(places * np.int64(iterations) + turn, minlength=n * iterations).reshape(n, iterations)
        return answer(rows.select(columns), counts)

    blocks = placed.withColumn("_block", F.floor(F.col("_at") / BLOCK)).drop("_slot", "_n", "_first")
    return blocks.groupBy("_block").cogroup(draws.groupBy("_block")).applyInArrow(count, kinds(kept))


def bootstrap_counts(
    df: DataFrame, row_id: str, iterations: int, seed: int, strata: str | None = None, values: Sequence[str] = ()
) -> DataFrame:
    """(stratum, row, values, counts): how often each of the resamples holds the row.

    All scores of a row share its draws, which makes comparisons between them paired.
    """

    def answer(rows: pa.Table, counts: np.ndarray) -> pa.Table:
        bounds = np.arange(rows.num_rows + 1, dtype=np.int32) * np.int32(iterations)
        return rows.append_column("counts", pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.ravel().astype(np.int32))))

    def kinds(kept: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", counts array<int>"

    return _count_draws(df, row_id, iterations, seed, strata, values, answer, kinds)


def bootstrap_sums(
    df: DataFrame, row_id: str, iterations: int, seed: int, sums: dict[str, Column], strata: str | None = None
) -> DataFrame:
    """(iteration, sums): the sums of numbers over each resample, a row counting as often as it was drawn; nulls add nothing."""
    names = list(sums)
    by = [strata] if strata else []
    numbers = df.select(F.col(row_id).alias("_id"), *[F.col(c).alias("_stratum") for c in by], *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())])

    def answer(rows: pa.Table, counts: np.ndarray) -> pa.Table:
        v = np.column_stack([rows[f"_v{i}"].fill_null(0.0).to_numpy() for i in range(len(names))])
        wild = ~np.isfinite(v).all(axis=0)
        total = counts.T.astype(float) @ np.where(wild, 0.0, v)
        for i in np.flatnonzero(wild):  # a row that is not drawn adds nothing
            total[:, i] = [v[c > 0, i] @ c[c > 0] for c in counts.T]
        return pa.table({"iteration": pa.array(np.arange(1, iterations + 1), pa.int32())} | {f"_v{i}": total[:, i] for i in range(len(names))})

    shape = "iteration int, " + ", ".join(f"_v{i} double" for i in range(len(names)))
    values = [f"_v{i}" for i in range(len(names))]
    parts = _count_draws(numbers, "_id", iterations, seed, "_stratum" if by else None, values, answer, lambda _: shape)
    return parts.groupBy("iteration").agg(*[F.sum(f"_v{i}").alias(n) for i, n in enumerate(names)])


def bootstrap_weights(
    df: DataFrame, row_id: str, iterations: int, seed: int, strata: str | None = None, values: Sequence[str] = ()
) -> DataFrame:
    """(iteration, row, weight) of resamples with replacement inside each stratum; rows that were not drawn are left out."""
    counted = bootstrap_counts(df, row_id, iterations, seed, strata, values)
    by = [strata] if strata else []
    rest = [c for c in counted.columns if c not in (*by, "counts")]
    long = counted.select("*", F.posexplode("counts").alias("_i", "_w")).where(F.col("_w") > 0)
    return long.select(*by, (F.col("_i") + 1).alias("iteration"), F.col("_w").cast("bigint").alias("weight"), *rest)


def percentile_intervals(
    df: DataFrame, by: Sequence[str], metrics: Sequence[str], confidence: float = 0.95
) -> DataFrame:
    """Mean and percentile interval per metric and group, long. A group holds one row per iteration."""
    tail = (1.0 - confidence) / 2.0
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("bootstrap_mean"),
        F.percentile("value", F.lit(tail)).alias("lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("upper"),
    )


def paired_differences(
    bootstrap: DataFrame, observed: DataFrame, model: str, metric: str, confidence: float = 0.95
) -> DataFrame:
    """Observed and bootstrap difference of each model pair on the same draws, with a conclusion."""
    tail = (1.0 - confidence) / 2.0

    def pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        a = df.select(*keys, F.col(model).alias("model_a"), F.col(metric).alias("_a"))
        b = df.select(*keys, F.col(model).alias("model_b"), F.col(metric).alias("_b"))
        # per iteration there is one row per model, so the pairs stay few
        joined = a.join(b, list(keys)) if keys else a.join(F.broadcast(b))
        return joined.where(F.col("model_a") < F.col("model_b")).withColumn("_d", F.col("_a") - F.col("_b"))

    drawn = pairs(bootstrap, ["iteration"]).groupBy("model_a", "model_b").agg(
        F.avg("_d").alias("bootstrap_mean_difference"),
        F.percentile("_d", F.lit(tail)).alias("difference_lower"),
        F.percentile("_d", F.lit(1.0 - tail)).alias("difference_upper"),
    )
    seen = pairs(observed, []).select("model_a", "model_b", F.col("_d").alias("observed_difference"))
    low, high = F.col("difference_lower"), F.col("difference_upper")
    conclusion = (
        F.when(low > 0, F.concat("model_a", F.lit(" higher")))
        .when(high < 0, F.concat("model_b", F.lit(" higher")))
        .otherwise("Inconclusive")
    )
    return seen.join(drawn, ["model_a", "model_b"]).select(
        "*", ((low <= 0) & (high >= 0)).alias("interval_includes_zero"), conclusion.alias("conclusion")
    )


def pivot_metric(bootstrap: DataFrame, model: str, metric: str, models: Sequence[str]) -> DataFrame:
    """iteration by model matrix of a metric."""
    return bootstrap.groupBy("iteration").pivot(model, list(models)).agg(F.first(metric))
