"""Bootstrap counts in place: exact multinomial draws by splitting down a tree of row ranges.

A stratum of n rows gets n draws. They fall to the two halves of its range by a binomial draw, then to their halves, and
so on down to leaves, where they are dealt to the rows. Every node draws from its own seed, so any task finds the counts
of any rows, and the sum of the counts before them, from the path to their leaf. Rows never become slots and no counts
are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import safe_div, zero_div
from stayline.operators.rank import Key, ranked, running_totals
from stayline.operators.resample import percentile_intervals

#: Rows of a leaf, and ordered rows that one group of a metric holds.
LEAF, ROWS = 512, 20_000


class CountTree:
    """Counts of ``iterations`` resamples over rows 0 to n - 1 of one stratum."""

    def __init__(self, rows: int, iterations: int, seed: int, stratum: int):
        self.rows, self.iterations, self.key = rows, iterations, (seed, stratum)

    def _draws(self, *node: int) -> np.random.Generator:
        return np.random.default_rng([*self.key, *node])

    def leaf(self, row: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(first row, row after the last, draws before the leaf, draws in it), the last two per iteration."""
        low, high = 0, self.rows
        before = np.zeros(self.iterations, np.int64)
        inside = np.full(self.iterations, self.rows, np.int64)
        while high - low > LEAF:
            middle = (low + high) // 2
            left = self._draws(low, high).binomial(inside, (middle - low) / (high - low))
            if row < middle:
                high, inside = middle, left
            else:
                low, before, inside = middle, before + left, inside - left
        return low, high, before, inside

    def range(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws before ``begin`` per iteration, and the counts of rows ``begin`` to ``end`` - 1 (a row each)."""
        out = np.zeros((max(0, end - begin), self.iterations), np.int32)
        if begin >= self.rows:
            return np.full(self.iterations, self.rows, np.int64), out
        at, first = begin, None
        while first is None or at < end:
            low, high, before, inside = self.leaf(at)
            size = high - low
            places = self._draws(low, high, 1).integers(0, size, int(inside.sum()))
            owner = np.repeat(np.arange(self.iterations), inside)
            counts = np.bincount(places * self.iterations + owner, minlength=size * self.iterations).reshape(size, self.iterations)
            if first is None:
                first = before + counts[: at - low].sum(axis=0)
            stop = min(high, end)
            out[at - begin : stop - begin] = counts[at - low : stop - low]
            at = max(stop, at + 1)
        return first, out


def _sizes(df: DataFrame, strata: str) -> dict[int, int]:
    """Rows of each stratum; the strata are classes of a label, so few."""
    return {int(r[0]): int(r[1]) for r in df.groupBy(F.col(strata).cast("long")).count().collect()}


def bootstrap_counts(df: DataFrame, row_id: str, strata: str, iterations: int, seed: int, leaf_rows: int = ROWS) -> DataFrame:
    """Each row with ``counts``, how often each of the resamples of its stratum holds it.

    ``strata`` holds small integers. Each stratum is resampled to its own size; rows are numbered in the order of
    ``row_id``, which has no nulls.
    """
    sizes = _sizes(df, strata)
    numbered = ranked(df, [Key(row_id)], [strata], out="_i")
    grouped = numbered.withColumn("_leaf", F.floor((F.col("_i") - 1) / leaf_rows))
    fields = [f for f in grouped.schema if f.name not in ("_i", "_leaf")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", counts array<int>"

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        stratum = int(table[strata][0].as_py())
        begin = table["_i"][0].as_py() - 1
        _, counts = CountTree(sizes[stratum], iterations, seed, stratum).range(begin, begin + table.num_rows)
        bounds = np.arange(table.num_rows + 1, dtype=np.int32) * iterations
        column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.ravel()))
        return table.drop_columns(["_i", "_leaf"]).append_column("counts", column)

    return grouped.groupBy(strata, "_leaf").applyInArrow(draw, kinds)


def bootstrap_grid(
    df: DataFrame, score: str, label: str, row_id: str, fractions: Sequence[float], iterations: int, seed: int, rows: int = ROWS
) -> DataFrame:
    """(iteration, requested_fraction, selected_count, captured_positive_cases, precision, capture and lift at k) of
    every resample and fraction, from one ordering by falling score.

    Rows are numbered in that order within their class, and the classes are the strata. A task of neighbouring rows finds
    its counts and all counts before it from the trees, so running sums of all resamples need no second pass. Each
    cut-off lies in one task for each resample; that task alone answers it. Ties are ordered by ``row_id``; a row that is
    drawn several times counts as often.
    """
    y = (F.col(label) == 1).cast("bigint")
    chosen = df.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), F.col(row_id).alias("_id"), y.alias("_y"))
    sizes = {k: _sizes(chosen, "_y").get(k, 0) for k in (0, 1)}
    n, positives = sum(sizes.values()), sizes[1]
    fractions = [float(f) for f in fractions]
    cuts = [max(1, int(np.ceil(round(n * f, 9)))) for f in fractions]
    # both sums come from one ordering: the rank and the positives up to it
    one = F.lit(1).cast("bigint")
    running = running_totals(chosen.withColumn("_one", one), [Key("_s", True), Key("_id")], {"_r": "_one", "_p": "_y"})
    blocks = running.select("_r", "_p", "_y").withColumn("_block", F.floor((F.col("_r") - 1) / rows))

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("_r")
        label_, first, upto = np.asarray(table["_y"]), table["_r"][0].as_py() - 1, table["_p"][0].as_py()
        positive = upto - int(label_[0])
        weights = np.zeros((table.num_rows, iterations), np.int32)
        before = {}
        for stratum, begin in ((1, positive), (0, first - positive)):
            mine = label_ == stratum
            tree = CountTree(sizes[stratum], iterations, seed, stratum)
            before[stratum], weights[mine] = tree.range(begin, begin + int(mine.sum()))
        reached = np.cumsum(weights, axis=0) + before[0] + before[1]
        hits = np.cumsum(weights * label_[:, None], axis=0) + before[1]
        out = []
        for fraction, k in zip(fractions, cuts):
            at = (reached < k).sum(axis=0)  # the first row that reaches the cut-off
            here = (before[0] + before[1] < k) & (at < table.num_rows)
            for t in np.flatnonzero(here).tolist():
                over = int(reached[at[t], t]) - k if label_[at[t]] else 0
                out.append((t + 1, fraction, k, int(hits[at[t], t]) - over))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
        names = ("iteration", "requested_fraction", "selected_count", "captured_positive_cases")
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    shape = "iteration int, requested_fraction double, selected_count long, captured_positive_cases long"
    found = blocks.groupBy("_block").applyInArrow(answer, shape)
    precision = zero_div(F.col("captured_positive_cases"), F.col("selected_count"))
    return found.select(
        "*",
        precision.alias("precision_at_k"),
        zero_div(F.col("captured_positive_cases"), F.lit(positives)).alias("capture_rate_at_k"),
        zero_div(precision, safe_div(F.lit(positives), F.lit(n))).alias("lift_at_k"),
    )


GRID_METRICS = ("precision_at_k", "capture_rate_at_k", "lift_at_k")


def grid_intervals(drawn: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval per fraction and metric; a group holds one row per resample."""
    return percentile_intervals(drawn, ["requested_fraction", "selected_count"], list(GRID_METRICS), confidence)
