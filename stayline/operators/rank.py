"""Ranks, running totals and exact quantiles without a one-task sort.

A window with no partition columns, or with one hot group, would pull its rows
into a single task. Here the ordering key is first cut into ranges that hold
about ``ROWS_PER_BUCKET`` rows each. The range edges come from one mergeable
sketch and are literals in the plan, so a lost task recomputes to the same
range. Windows then run per (group, range); what precedes a range is one small
row of totals per (group, range). A single value that fills several ranges is
split again on the tie-break key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.session import settle, store

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 10_000
TOP = 1.7e308  # stands for null, and for NaN as the largest number


@dataclass(frozen=True)
class Key:
    """One ordering column. ``desc=True`` puts large values first; nulls are always last."""

    name: str
    desc: bool = False

    def order(self) -> Column:
        c = F.col(self.name)
        return c.desc_nulls_last() if self.desc else c.asc_nulls_last()


def keys(*specs: str) -> list[Key]:
    """``"-score"`` means descending."""
    return [Key(s[1:], True) if s.startswith("-") else Key(s) for s in specs]


PREFIX_BYTES = 6  # as a number below 2**53


def _as_double(df: DataFrame, key: Key, skip: int = 0) -> Column:
    """A number that never falls along the key's order, for cutting ranges; different values may share one.

    Of a string it is the first bytes after the ``skip`` bytes that all strings of the column have in common.
    """
    kind = df.schema[key.name].dataType.typeName()
    c = F.col(key.name)
    if kind == "date":
        c = F.unix_date(c)
    elif kind == "timestamp":
        c = F.unix_micros(c)
    elif kind == "timestamp_ntz":
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "boolean":
        c = c.cast("int")
    elif kind == "string":
        head = F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, PREFIX_BYTES))
        c = F.conv(F.rpad(head, 2 * PREFIX_BYTES, "0"), 16, 10)
    c = c.cast("double")
    bounded = F.when(F.isnan(c), F.lit(TOP)).otherwise(F.greatest(F.least(c, F.lit(TOP)), F.lit(-TOP)))
    return F.when(c.isNull(), F.lit(TOP)).otherwise(-bounded if key.desc else bounded)  # nulls are last either way


def _common_bytes(df: DataFrame, key: Key) -> int:
    """Bytes with which all strings of the column begin."""
    if df.schema[key.name].dataType.typeName() != "string":
        return 0
    ends = df.agg(F.min(key.name).alias("low"), F.max(key.name).alias("high")).first()
    if ends["low"] is None:
        return 0
    low, high = ends["low"].encode(), ends["high"].encode()
    return next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


@dataclass(frozen=True)
class RangePlan:
    """Edges of the ranges over an ordering; no edges means one range is enough."""

    order: tuple[Key, ...]
    edges: tuple[float, ...] = ()
    hot: tuple[float, ...] = ()
    tie_edges: tuple[float, ...] = ()
    tie_key: int = 1
    skips: tuple[int, int] = (0, 0)

    @property
    def single(self) -> bool:
        return not self.edges

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the range columns ``_b1`` and ``_b2``; (b1, b2) follows the ordering."""
        if self.single:
            return df.withColumn("_b1", F.lit(0)).withColumn("_b2", F.lit(0))
        infinity = float("inf")
        out = df.withColumn("_k1", _as_double(df, self.order[0], self.skips[0]))
        out = _bucketize(out, "_k1", "_b1", [-infinity, *self.edges, infinity])
        after_ties = len(self.tie_edges) + 1
        if self.tie_edges:
            out = out.withColumn("_k2", _as_double(df, self.order[self.tie_key], self.skips[1]))
            out = _bucketize(out, "_k2", "_b2", [-infinity, *self.tie_edges, infinity])
            # a hot value is the lowest value of its range, so the other rows follow it
            out = out.withColumn("_b2", F.when(F.col("_k1").isin(*self.hot), F.col("_b2")).otherwise(after_ties))
            return out.drop("_k1", "_k2")
        return out.withColumn("_b2", F.lit(0)).drop("_k1")


def _bucketize(df: DataFrame, source: str, target: str, splits: list[float]) -> DataFrame:
    out = Bucketizer(splits=splits, inputCol=source, outputCol=target).transform(df)
    return out.withColumn(target, F.col(target).cast("int"))


def plan_ranges(
    df: DataFrame, order: Sequence[Key], rows_per_bucket: int | None = None, by: Sequence[str] = ()
) -> RangePlan:
    """Choose range edges with a count and, where a group is large, one sketch job.

    Groups that all fit a range need no edges. If one does not, the edges are those of
    all rows together, so that no (group, range) can hold more than a range of rows,
    whatever the scores inside the group look like. A value that fills ranges is cut
    on the first further key that varies under it, if the keys before are constant there.
    """
    order = tuple(order)
    size = rows_per_bucket or ROWS_PER_BUCKET
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("n")).first()
        if (sizes["largest"] or 0) <= size:
            return RangePlan(order)
        rows = sizes["n"]
    else:
        rows = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(rows / size))
    if buckets <= 1:
        return RangePlan(order)
    accuracy = max(10_000, 20 * buckets)
    points = [i / buckets for i in range(1, buckets)]
    skip = _common_bytes(df, order[0])
    number = _as_double(df, order[0], skip).alias("_k")
    edges = df.select(number).agg(F.percentile_approx("_k", points, accuracy).alias("e")).first()["e"]
    share = Counter(float(e) for e in edges)
    unique = tuple(sorted(share))
    # One quantile on a value already means it may fill a whole range.
    repeated = sorted(v for v, n in share.items() if n >= 2)
    if not repeated or len(order) < 2:
        return RangePlan(order, unique, skips=(skip, 0))
    heavy = df.select("*", number).where(F.col("_k").isin(*repeated))

    def constant(key: Key) -> Column:
        c = F.col(key.name)
        return (F.count(c) == 0) | ((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)))

    kinds = heavy.groupBy("_k").agg(*[constant(k).alias(f"c{i}") for i, k in enumerate(order)]).collect()
    # Several values may share a number (long decimals, say): the further keys do not order these.
    hot = sorted(float(r["_k"]) for r in kinds if r["c0"])
    varying = [i for i in range(1, len(order)) if any(r["c0"] and not r[f"c{i}"] for r in kinds)]
    if not hot or not varying:
        return RangePlan(order, unique, skips=(skip, 0))
    tie = varying[0]
    tie_skip = _common_bytes(df, order[tie])
    ties = heavy.where(F.col("_k").isin(*hot)).select("_k", _as_double(df, order[tie], tie_skip).alias("_t"))
    tie_edges: set[float] = set()
    for row in ties.groupBy("_k").agg(F.percentile_approx("_t", points, accuracy).alias("e")).collect():
        step = max(1, len(row["e"]) // (share[float(row["_k"])] + 1))
        tie_edges.update(float(e) for e in row["e"][step - 1 :: step])
    return RangePlan(order, unique, tuple(hot), tuple(sorted(tie_edges)), tie, (skip, tie_skip))


def _preceding(bucketed: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Totals of all earlier ranges, one row per (group, range)."""
    per_range = bucketed.groupBy(*by, "_b1", "_b2").agg(*[c.alias(n) for n, c in totals.items()])
    window = Window.partitionBy(*by).orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        *by, "_b1", "_b2", *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(n) for n in totals]
    )


def _join_preceding(ranked: DataFrame, before: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    if not by:
        before = F.broadcast(before)  # at most one row per range
    left, right = ranked.alias("l"), before.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_b1", "_b2")]
    same += [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    kept = [F.col(f"l.{c}") for c in ranked.columns if c not in names]
    return left.join(right, reduce(lambda a, b: a & b, same), "left").select(
        *kept, *[(F.col(f"l.{n}") + F.col(f"r.{n}")).alias(n) for n in names]
    )


def ranked(
    df: DataFrame,
    order: Sequence[Key],
    by: Sequence[str] = (),
    out: str = "rank",
    plan: RangePlan | None = None,
    rows_per_bucket: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Row number over ``order`` in each group of ``by`` (the whole table when empty).

    ``order`` must end in a unique key for the result to be deterministic. ``base`` has the keys and groups of the same
    rows and is cheap to read: ranges and what precedes them come from it, so that steps before this one run once.
    """
    plan = plan or plan_ranges(df if base is None else base, order, rows_per_bucket, by)
    window_order = [k.order() for k in order]
    if plan.single:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*window_order)).cast("bigint"))
    bucketed = plan.assign(df)
    window = Window.partitionBy(*by, "_b1", "_b2").orderBy(*window_order)
    inside = bucketed.withColumn(out, F.row_number().over(window).cast("bigint"))
    totals = {out: F.count(F.lit(1))}
    before = _preceding(bucketed, by, totals) if base is None else store(_preceding(plan.assign(base), by, totals))
    return _join_preceding(inside, before, by, [out]).drop("_b1", "_b2")


def running_totals(
    df: DataFrame,
    order: Sequence[Key],
    measures: dict[str, Column | str],
    by: Sequence[str] = (),
    plan: RangePlan | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` in row order, per group of ``by``."""
    plan = plan or plan_ranges(df, order, rows_per_bucket, by)
    sources = {n: (F.col(m) if isinstance(m, str) else m) for n, m in measures.items()}
    window_order = [k.order() for k in order]
    if plan.single:
        window = Window.partitionBy(*by).orderBy(*window_order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(window).alias(n) for n, c in sources.items()])
    bucketed = plan.assign(df)
    window = Window.partitionBy(*by, "_b1", "_b2").orderBy(*window_order).rowsBetween(Window.unboundedPreceding, 0)
    inside = bucketed.select("*", *[F.sum(c).over(window).alias(n) for n, c in sources.items()])
    before = _preceding(bucketed, by, {n: F.sum(c) for n, c in sources.items()})
    return _join_preceding(inside, before, by, list(sources)).drop("_b1", "_b2")


def value_counts_running(
    df: DataFrame,
    value: Key,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Collapse to distinct values per group, then running sums over them.

    ``measures`` are aggregates. For each one ``m`` the output holds ``m`` (this
    value) and ``cum_m`` (this value and all before it). Ties vanish in the
    collapse, which combines on the map side.
    """
    collapsed = df.groupBy(*by, value.name).agg(*[c.alias(n) for n, c in measures.items()])
    return running_totals(
        collapsed,
        [value],
        {f"cum_{n}": n for n in measures},
        by,
        rows_per_bucket=rows_per_bucket,
    )


DENSE = 5_000  # rows of an average group from which its values are counted by cell first
CELLS = 256  # cells between a number and its double


def _cell(value: Column) -> Column:
    """A whole number that never falls as the value rises; a cell's width is in proportion to its values."""
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(TOP))) * CELLS) + 2000 * CELLS  # positive for the smallest number too
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, size).otherwise(-size)  # NaN is above all numbers


def _places(p: float) -> list[Column]:
    position = (F.col("_n") - 1) * F.lit(float(p))
    return [F.floor(position), F.ceil(position)]


def _near_quantiles(source: DataFrame, value: str, counts: Column, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, _cell, value, n, _n, _before): the values of the cells that hold a quantile, and what lies in earlier cells."""
    celled = source.withColumn("_cell", _cell(F.col(value)))
    cells = celled.groupBy(*by, "_cell").agg(counts.alias("_in"))
    before = F.sum("_in").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("*", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(*by)).alias("_n"))
    wanted = [(F.col("_before") <= place) & (F.col("_before") + F.col("_in") > place) for p in probabilities for place in _places(p)]
    asked = store(cells.where(reduce(lambda a, b: a | b, wanted)).select(*by, "_cell", "_before", "_n"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_cell"]])
    near = celled.alias("l").join(asked.alias("r"), same, "left_semi")
    found = settle(near.groupBy(*by, "_cell", value).agg(counts.alias("n")))
    return _attach(found, asked, [*by, "_cell"])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    weight: Column | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group with ``_n`` rows counted.

    Same result as ``percentile``, but no task holds the values of a whole group. Values of large groups are first
    counted by cell, so that only those near the quantiles are exchanged.
    """
    by = list(by)
    source = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value), *([] if weight is None else [weight.alias("_w")]))
    counts = F.count(F.lit(1)) if weight is None else F.sum("_w")
    # Groups of few rows: their values are one range anyway.
    sizes = group_size(source, by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    if (sizes["rows"] or 0) > max(1, sizes["groups"]) * min(DENSE, rows_per_bucket or DENSE):
        joined, inside = _near_quantiles(source, value, counts, list(probabilities.values()), by), [*by, "_cell"]
    else:
        totals = source.groupBy(*by).agg(counts.alias("_n"))
        joined, inside = _attach(source.groupBy(*by, value).agg(counts.alias("n")), totals, by).withColumn("_before", F.lit(0)), by
    joined = running_totals(joined, [Key(value)], {"cum_n": "n"}, inside, rows_per_bucket=rows_per_bucket)
    joined = joined.withColumn("cum_n", F.col("cum_n") + F.col("_before"))
    aggregates = []
    for name, p in probabilities.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        for suffix, place in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("cum_n") > place) & (F.col("cum_n") - F.col("n") <= place)
            aggregates.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{suffix}"))
    picked = joined.groupBy(*by).agg(F.max("_n").alias("_n"), *aggregates)
    outputs = []
    for name, p in probabilities.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        fraction = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (high - low) * fraction).alias(name))
    return picked.select(*by, "_n", *outputs)


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group values to rows; null groups match each other."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
    extra = [F.col(f"r.{c}") for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), condition, "left").select("l.*", *extra)


attach = _attach


def group_size(df: DataFrame, by: Sequence[str] = (), out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def top_count(n: Column, fraction: Column | float, floor_one: bool = True) -> Column:
    """``min(n, max(1, ceil(n * fraction)))`` computed in decimals, so no rounding can add a row."""
    f = F.lit(str(fraction)).cast("decimal(18,9)") if isinstance(fraction, float) else fraction.cast("decimal(18,9)")
    k = F.ceil(n.cast("decimal(18,0)") * f).cast("bigint")
    return F.least(n, F.greatest(F.lit(1).cast("bigint"), k) if floor_one else k)


def flag_top_fraction(
    df: DataFrame,
    order: Sequence[Key],
    fraction: float,
    by: Sequence[str] = (),
    out: str = "selected",
    floor_one: bool = True,
) -> DataFrame:
    """Flag the first ``ceil(n * fraction)`` rows of the ordering in each group."""
    numbered = ranked(df, order, by, out="_r")
    sized = _attach(numbered, group_size(df, by, "_n"), by)
    return sized.withColumn(out, F.col("_r") <= top_count(F.col("_n"), fraction, floor_one)).drop("_r", "_n")


def quantile_groups(
    df: DataFrame, order: Sequence[Key], count: int, by: Sequence[str] = (), out: str = "quantile", base: DataFrame | None = None
) -> DataFrame:
    """Equal-count groups 1..count: ranks without ties, cut at their own linear quantiles. ``base`` is that of ``ranked``."""
    numbered = ranked(df, order, by, out="_r", base=base)
    sized = _attach(numbered, group_size(df, by, "_n") if base is None else store(group_size(base, by, "_n")), by)
    spread = F.ceil((F.col("_r") - 1) * F.lit(count) / F.nullif(F.col("_n") - 1, F.lit(0)))
    return sized.withColumn(
        out, F.greatest(F.lit(1), F.coalesce(spread, F.lit(1))).cast("int")
    ).drop("_r", "_n")


def equal_frequency_bins(
    df: DataFrame, order: Sequence[Key], bins: int, by: Sequence[str] = (), out: str = "bin"
) -> DataFrame:
    """Bins 1..bins of near-equal size, the first ``n % bins`` one row larger."""
    numbered = ranked(df, order, by, out="_r")
    sized = _attach(numbered, group_size(df, by, "_n"), by)
    small = F.floor(F.col("_n") / F.lit(bins))
    larger = F.col("_n") % F.lit(bins)
    boundary = larger * (small + 1)
    bin_id = F.when(F.col("_r") <= boundary, F.floor((F.col("_r") - 1) / (small + 1)) + 1).otherwise(
        larger + F.floor((F.col("_r") - 1 - boundary) / F.nullif(small, F.lit(0))) + 1
    )
    return sized.withColumn(out, bin_id.cast("int")).drop("_r", "_n")


def value_quantile_groups(
    df: DataFrame, value: str, count: int, by: Sequence[str] = (), out: str = "quantile"
) -> DataFrame:
    """Groups 1..count cut at the values' own quantiles; right edges closed, lowest included."""
    edges = exact_quantiles(df, value, {f"_e{i}": i / count for i in range(1, count)}, by).drop("_n")
    joined = _attach(df, edges, by)
    label = F.when(F.col(value).isNull(), F.lit(None))
    for i in range(1, count):
        label = label.when(F.col(value) <= F.col(f"_e{i}"), F.lit(i))
    return joined.withColumn(out, label.otherwise(F.lit(count)).cast("int")).drop(
        *[f"_e{i}" for i in range(1, count)]
    )


def best_prefix(
    df: DataFrame, order: Sequence[Key], value: str, by: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Prefix of the ordering with the largest running total; no row where that total is not positive.

    Gives ``prefix_rows``, ``prefix_total`` and the ``keep`` columns of its last row.
    """
    totals = running_totals(df, order, {"prefix_rows": F.lit(1).cast("bigint"), "prefix_total": value}, by)
    best = totals.groupBy(*by).agg(
        F.max_by(F.struct("prefix_rows", "prefix_total", *keep), F.struct("prefix_total", -F.col("prefix_rows"))).alias(
            "_best"
        )
    )
    return best.select(*by, "_best.*").where(F.col("prefix_total") > 0)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Rank with ties averaged, ascending."""
    counted = value_counts_running(df.where(F.col(value).isNotNull()), Key(value), {"n": F.count(F.lit(1))}, by)
    per_value = counted.select(
        *by, value, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).cast("double").alias(out)
    )
    return _attach(df, per_value, [*by, value])


def spearman(df: DataFrame, first: str, second: str, by: Sequence[str] = (), out: str = "spearman") -> DataFrame:
    """Pearson correlation of average ranks, per group."""
    both = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    with_first = average_ranks(both, first, by, "_ra")
    with_both = average_ranks(with_first, second, by, "_rb")
    return with_both.groupBy(*by).agg(F.corr("_ra", "_rb").alias(out))


def sequence_ids(df: DataFrame, order: Sequence[Key], base: int, out: str = "event_id") -> DataFrame:
    """Consecutive ids from ``base`` in the given order."""
    numbered = ranked(df, order, out="_r")
    return numbered.withColumn(out, F.col("_r") + F.lit(base - 1)).drop("_r")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Key], limit: int) -> DataFrame:
    """First ``limit`` rows of each group.

    The physical plan keeps at most ``limit`` rows of a group per task before the
    shuffle (window group limit), so a hot group stays small.
    """
    window = Window.partitionBy(*by).orderBy(*[k.order() for k in order])
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit)
