"""Joins on time: latest and first records, snapshots, event-time attributes, checked joins."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import active_on, count_if, earliest, latest
from stayline.operators.rank import Key, plan_ranges

Calendar = Sequence[tuple[int, str, str, str | None]]


def _day(value: str | None) -> Column:
    return F.lit(value).cast("date")


def latest_on_or_before(
    facts: DataFrame,
    entity: str,
    date: str,
    cutoff: str,
    order: Sequence[str],
    values: Sequence[str],
    inclusive: bool = True,
) -> DataFrame:
    """One row per entity: ``values`` of its greatest (date, order) record up to the cutoff."""
    reached = (F.col(date) <= _day(cutoff)) if inclusive else (F.col(date) < _day(cutoff))
    return (
        facts.where(reached).groupBy(entity).agg(latest([date, *values], [date, *order]).alias("_r")).select(entity, "_r.*")
    )


def first_on_or_before(
    facts: DataFrame, entity: str, date: str, cutoff: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One row per entity: ``values`` of its smallest (date, order) record up to the cutoff."""
    return (
        facts.where(F.col(date) <= _day(cutoff))
        .groupBy(entity)
        .agg(earliest([date, *values], [date, *order]).alias("_r"))
        .select(entity, "_r.*")
    )


def lagged_value(
    facts: DataFrame, entity: str, date: str, cutoff: str, order: Sequence[str], value: str, months: int = 12
) -> DataFrame:
    """Current value, value ``months`` earlier, and the first value as its fallback, in one pass."""
    early = F.col(date) <= F.add_months(_day(cutoff), -months)
    key = F.struct(date, *order)
    return (
        facts.where(F.col(date) <= _day(cutoff))
        .groupBy(entity)
        .agg(
            F.max_by(value, key).alias("current_value"),
            F.coalesce(F.max_by(F.col(value), F.when(early, key)), F.min_by(value, key)).alias("lagged_value"),
            (F.count(F.when(early, 1)) == 0).alias("used_first_value"),
        )
    )


def calendar_frame(facts: DataFrame, calendar: Calendar, keep: Column, out: str = "_s") -> DataFrame:
    """Repeat each row for the calendar entries that satisfy ``keep`` (written over ``x.<field>``).

    The calendar is an array literal of a few configured dates, so the expansion is
    row-local: no join and no exchange.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(seq).cast("int").alias("snapshot_sequence"),
                F.lit(kind).alias("dataset_type"),
                _day(day).alias("snapshot_date"),
                _day(end).alias("prediction_end_date"),
            )
            for seq, kind, day, end in calendar
        ]
    )
    return facts.withColumn(out, F.explode(entries)).where(keep)


def expand_snapshots(entities: DataFrame, start: str, end: str, calendar: Calendar) -> DataFrame:
    """One row per entity and snapshot on which the entity is active."""
    return calendar_frame(entities, calendar, active_on(start, end, F.col("_s.snapshot_date"))).select(
        *entities.columns, "_s.*"
    )


def facts_at_snapshots(facts: DataFrame, date: str, calendar: Calendar, trailing_months: int | None = None) -> DataFrame:
    """Records visible at each snapshot: dated on or before it, optionally in the trailing window only."""
    seen = F.col(date) <= F.col("_s.snapshot_date")
    if trailing_months is not None:
        seen = seen & (F.col(date) > F.add_months(F.col("_s.snapshot_date"), -trailing_months))
    return calendar_frame(facts, calendar, seen).withColumn("snapshot_date", F.col("_s.snapshot_date")).drop("_s")


def months_before(day: str, months: int) -> str:
    """Same day ``months`` earlier, clamped to the end of a shorter month."""
    year, month, dom = (int(part) for part in day.split("-"))
    index = year * 12 + month - 1 - months
    year, month = divmod(index, 12)
    return f"{year:04d}-{month + 1:02d}-{min(dom, monthrange(year, month + 1)[1]):02d}"


def collapse_between(
    facts: DataFrame, entity: str, date: str, calendar: Calendar, aggregates: Sequence[Column], lags: Sequence[int] = (12,)
) -> DataFrame:
    """Aggregate the records between neighbouring cutoffs, one row per entity and interval.

    The cutoffs are the snapshots and the dates ``lags`` months before them. ``_bound``
    is the first cutoff on or after a record, so for any cutoff ``c`` the record is
    dated on or before ``c`` exactly if ``_bound <= c``. Lifetime figures of all
    snapshots then merge from these rows, and no raw record is repeated per snapshot.
    """
    cutoffs = sorted({c for _, _, day, _ in calendar for c in (day, *[months_before(day, m) for m in lags])})
    bound = F.lit(None).cast("date")
    for cutoff in reversed(cutoffs):
        bound = F.when(F.col(date) <= _day(cutoff), _day(cutoff)).otherwise(bound)
    within = facts.where(F.col(date) <= _day(cutoffs[-1]))
    return within.groupBy(entity, bound.alias("_bound")).agg(*aggregates)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_time: str,
    right_time: str,
    right_order: Sequence[str],
    values: Sequence[str],
    inclusive: bool = True,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its entity at that time.

    Both sides are laid on one time line that is cut into ranges, so the records of
    one hot entity are spread over tasks. Only the last record of each
    (entity, range) is carried into the later ranges.
    """
    left_cols = left.columns
    events = right.select(
        F.col(entity).alias("_e"),
        F.col(right_time).cast("timestamp").alias("_t"),
        F.lit(0 if inclusive else 1).alias("_side"),
        F.struct(*[F.col(c) for c in right_order]).alias("_o"),
        F.struct(*[F.col(c) for c in values]).alias("_v"),
    )
    probes = left.select(
        F.col(entity).alias("_e"),
        F.col(left_time).cast("timestamp").alias("_t"),
        F.lit(1 if inclusive else 0).alias("_side"),
        F.struct(*left_cols).alias("_l"),
    )
    line = events.unionByName(probes, allowMissingColumns=True)
    plan = plan_ranges(line.select("_e", "_t"), [Key("_t")], rows_per_bucket, ["_e"])
    line = plan.assign(line)
    inner = (
        Window.partitionBy("_e", "_b1", "_b2").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = line.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)).where(F.col("_l").isNotNull())
    if plan.single:
        return found.select("_l.*", *[F.col(f"_in.{v}").alias(v) for v in values])
    carried = (
        line.where(F.col("_v").isNotNull())
        .groupBy("_e", "_b1", "_b2")
        .agg(F.max_by("_v", F.struct("_t", "_o")).alias("_c"))
    )
    touched = found.select("_e", "_b1", "_b2").distinct()
    across = Window.partitionBy("_e").orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (entity, range), null entities included, without a join
    before = (
        carried.unionByName(touched, allowMissingColumns=True)
        .groupBy("_e", "_b1", "_b2")
        .agg(F.first("_c", ignorenulls=True).alias("_c"))
        .select(
            F.col("_e").alias("_be"),
            F.col("_b1").alias("_bb1"),
            F.col("_b2").alias("_bb2"),
            F.last("_c", ignorenulls=True).over(across).alias("_before"),
        )
    )
    same = F.col("_e").eqNullSafe(F.col("_be")) & (F.col("_b1") == F.col("_bb1")) & (F.col("_b2") == F.col("_bb2"))
    return (
        found.join(before, same, "left")
        .withColumn("_in", F.coalesce("_in", "_before"))
        .select("_l.*", *[F.col(f"_in.{v}").alias(v) for v in values])
    )


def attribute_at(
    population: DataFrame,
    events: DataFrame,
    entity: str,
    cutoff: str,
    current: str,
    change_type: str,
    out: str,
    initial_pattern: str | None = None,
    initial_type: str = "Hire",
    inclusive: bool = True,
    first_old_value: bool = False,
) -> DataFrame:
    """Value of an attribute at each row's ``cutoff``, from the change log.

    The latest change up to the cutoff gives its new value. Without one: the value
    written in the first ``initial_type`` note (``initial_pattern``), or with
    ``first_old_value`` the old value of the earliest later change, and finally the
    current value.
    """
    points = population.select(entity, cutoff).distinct()
    changes = events.where((F.col("event_type") == change_type) & F.col(entity).isNotNull()).select(
        entity, "event_date", "event_id", "old_value", "new_value"
    )
    order = F.struct("event_date", "event_id")
    # on one time line, so that an entity's changes do not meet each of its cutoffs
    at_cutoff = asof_join(points, changes, entity, cutoff, "event_date", ["event_id"], ["new_value"], inclusive)
    out_df = population.join(at_cutoff.withColumnRenamed("new_value", "_new"), [entity, cutoff], "left")
    options = [F.col("_new").try_cast("int")]
    if first_old_value:
        earliest = changes.groupBy(entity).agg(F.min_by("old_value", order).alias("_old"))
        out_df = out_df.join(earliest, entity, "left")
        options.append(F.col("_old").try_cast("int"))
    if initial_pattern:
        initial = (
            events.where(F.col("event_type") == initial_type)
            .groupBy(entity)
            .agg(F.min_by("notes", order).alias("_note"))
            .select(entity, F.nullif(F.regexp_extract("_note", initial_pattern, 1), F.lit("")).alias("_first"))
        )
        out_df = out_df.join(initial, entity, "left")
        options.append(F.col("_first").try_cast("int"))
    options.append(F.col(current).try_cast("int"))
    return out_df.withColumn(out, F.coalesce(*options)).drop("_new", "_old", "_first")


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str | None = "many_to_one"
) -> DataFrame:
    """Join that raises when a side that must be unique on ``on`` is not."""
    unique_sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,), None: ()}[validate]
    for side in unique_sides:
        repeated = side.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count()
        if repeated:
            raise ValueError(f"join keys {list(on)} repeat on a side that must be unique ({validate})")
    return left.join(right, list(on), how)


def reconcile_ids(scored: DataFrame, active: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """Counts of the four disagreements between scored, active and eligible ids, from one full join."""

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    joined = (
        flag(scored, "s").join(flag(active, "a"), key, "full").join(flag(eligible, "e"), key, "full")
    )
    s, a, e = (F.coalesce(F.col(c), F.lit(False)) for c in "sae")
    return joined.agg(
        count_if(s & ~a).alias("scored_not_active"),
        count_if(e & ~s).alias("eligible_not_scored"),
        count_if(s & ~e).alias("scored_not_eligible"),
        count_if(s & ~a & ~e).alias("scored_unknown"),
        count_if(s & a & e).alias("agreed"),
    )


def anti_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def outer_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of two grouped tables with ``presence``: both, left_only or right_only."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(on), "full")
    presence = (
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
        .when(F.col("_l").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return joined.withColumn("presence", presence).drop("_l", "_r")


def with_parent(df: DataFrame, key: str, parent: str, values: Sequence[str], prefix: str = "manager_") -> DataFrame:
    """Self join along ``parent`` that adds the parent's ``values``."""
    parents = df.select(F.col(key).alias(parent), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    return df.join(parents, parent, "left")


def assemble(population: DataFrame, on: Sequence[str], blocks: Sequence[tuple[DataFrame, dict[str, object]]]) -> DataFrame:
    """Left join feature blocks that share a grouping key and fill the gaps of each block.

    All blocks are grouped on the same key, so their exchanges are reused by the joins.
    """
    def add(left: DataFrame, block: tuple[DataFrame, dict[str, object]]) -> DataFrame:
        frame, fills = block
        joined = left.join(frame, list(on), "left")
        return joined.fillna({c: v for c, v in fills.items() if v is not None}) if fills else joined

    return reduce(add, blocks, population)


