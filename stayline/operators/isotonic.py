"""Isotonic regression of many groups at once, without bringing a group's pools to one task or to the driver.

Scores are collapsed to distinct ones, numbered within their group and dealt to blocks of neighbours. Each block pools
adjacent violators with a stack. Blocks are then cut anew, half a block further, over the pools that are left, so that a
violation at a border falls inside a block; pooling stops when no border is out of order. The result is the only one:
pools are the maximal runs over which the cumulative mean is flat or falling.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.rank import Key, ranked
from stayline.session import settle

#: Pools in a block.
BLOCK = 50_000


def pool_adjacent(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(low, high, weight, total) of pools with rising means, from points or pools in ascending order."""
    stack: list[list[float]] = []
    for point in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        stack.append(list(point))
        # means are compared as cross products, which are exact for counts
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, high_, w, s = stack.pop()
            stack[-1][1] = high_
            stack[-1][2] += w
            stack[-1][3] += s
    return [tuple(p) for p in stack]


def isotonic_pools(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None, block: int = BLOCK
) -> DataFrame:
    """(by, low, high, weight, value): the fitted steps of each group; rows without a score or label are left out."""
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(*by, F.col(score).cast("double").alias("low")).agg(
        F.sum(w).alias("weight"), F.sum(w * F.col(label).cast("double")).alias("total")
    )
    return pool_points(points.where("weight > 0").select(*by, "low", F.col("low").alias("high"), "weight", "total"), by, block)


def pool_points(points: DataFrame, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``isotonic_pools`` of (by, low, high, weight, total): points or runs of points that no other lies between."""
    pools = settle(points)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pools.schema)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        merged = pool_adjacent(*(np.asarray(table[c]) for c in ("low", "high", "weight", "total")))
        columns = {c: pa.array([p[i] for p in merged], pa.float64()) for i, c in enumerate(("low", "high", "weight", "total"))}
        head = {c: pa.repeat(table[c][0], len(merged)) for c in by}
        return pa.table(head | columns)

    turn = 0
    while True:
        place = F.col("_r") - 1 + (block // 2 if turn % 2 else 0)
        numbered = ranked(pools, [Key("low")], by, out="_r").withColumn("_block", F.floor(place / block))
        pools = settle(numbered.groupBy(*by, "_block").applyInArrow(merge, kinds))
        turn += 1
        # only the borders of blocks can be out of order: a row per block is enough to see it
        edge = F.struct("low", "weight", "total")
        shift = F.floor(F.col("_p") / block)
        numbered = ranked(pools, [Key("low")], by, out="_p").withColumn("_part", shift)
        last = numbered.groupBy(*by, "_part").agg(F.max(edge).alias("_last"))
        before = last.select(*by, (F.col("_part") + 1).alias("_part"), F.col("_last").alias("_before"))
        inside = Window.partitionBy(*by, "_part").orderBy("low")
        joined = numbered.join(before, [*by, "_part"], "left").withColumn("_prev", F.coalesce(F.lag(edge).over(inside), F.col("_before")))
        falling = F.col("_prev.total") * F.col("weight") >= F.col("total") * F.col("_prev.weight")
        if not joined.where(falling).limit(1).count():
            break
    return pools.select(*by, "low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def apply_isotonic(df: DataFrame, pools: DataFrame, score: str, by: Sequence[str] = (), out: str = "isotonic", block: int = BLOCK) -> DataFrame:
    """Add the fitted value at each row's score: linear between two pools, the ends' values beyond them.

    Rows and the ends of pools are laid on one line per group and cut into blocks; only a block's last and first pool
    go to its neighbours. A null score, or a group without a fit, gives null.
    """
    by = list(by)
    kept = df.columns
    entry = F.struct(F.col("low").alias("x"), F.col("value").alias("v"))
    ends = pools.select(*by, F.explode(F.array(entry, F.struct(F.col("high").alias("x"), F.col("value").alias("v")))).alias("_end")).distinct()
    rows = df.select(*by, F.col(score).cast("double").alias("_x"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"))
    marks = ends.select(*by, F.col("_end.x").alias("_x"), F.lit(0).alias("_side"), "_end")
    line = settle(rows.unionByName(marks, allowMissingColumns=True))
    numbered = settle(ranked(line, [Key("_x"), Key("_side")], by, out="_r").withColumn("_block", F.floor((F.col("_r") - 1) / block)))
    place = F.when(F.col("_side") == 0, F.col("_r"))
    edges = numbered.groupBy(*by, "_block").agg(F.max_by("_end", place).alias("_last"), F.min_by("_end", place).alias("_first"))
    # a row per block; a frame that ends at the last row is recomputed from each row on, so what follows is read backwards
    before, group = Window.unboundedPreceding, Window.partitionBy(*by)
    carried = edges.select(
        *by, "_block",
        F.last("_last", True).over(group.orderBy("_block").rowsBetween(before, -1)).alias("_before"),
        F.last("_first", True).over(group.orderBy(F.col("_block").desc()).rowsBetween(before, -1)).alias("_after"),
    )
    joined = numbered.alias("n").join(
        carried.alias("c"), [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_block"]]
    ).select("n.*", "c._before", "c._after")
    inside = Window.partitionBy(*by, "_block")
    low = F.coalesce(F.last("_end", True).over(inside.orderBy("_r").rowsBetween(before, 0)), F.col("_before"))
    high = F.coalesce(F.last("_end", True).over(inside.orderBy(F.col("_r").desc()).rowsBetween(before, 0)), F.col("_after"))
    placed = joined.withColumn("_low", low).withColumn("_high", high).where(F.col("_side") == 1)
    share = (F.col("_x") - F.col("_low.x")) / (F.col("_high.x") - F.col("_low.x"))
    between = F.col("_low.v") + share * (F.col("_high.v") - F.col("_low.v"))
    value = (
        F.when(F.col("_x").isNull(), None).when(F.col("_low").isNull(), F.col("_high.v"))
        .when(F.col("_high").isNull() | (F.col("_x") == F.col("_low.x")), F.col("_low.v")).otherwise(between)
    )
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in kept], value.alias(out))
