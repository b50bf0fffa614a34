"""Data-quality rules.

Every rule gives rows of (check, status, observed, requirement). ``observed`` is the
number of violations, or the measured value of a bound. Rules over the same table
share one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayline.functions.expr import count_if
from stayline.operators.rank import Key, plan_ranges, ranked


def with_previous(
    df: DataFrame,
    entity: str | Sequence[str],
    order: Sequence[Key],
    value: str,
    out: str,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Previous value of the entity in the given order.

    The ordering is cut into ranges, so the records of a hot entity spread over tasks;
    the first record of a range takes the last value of the entity's earlier ranges.
    """
    by = [entity] if isinstance(entity, str) else list(entity)
    plan = plan_ranges(df, order, rows_per_bucket, by)
    columns = [k.order() for k in order]
    if plan.single:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*by).orderBy(*columns)))
    bucketed = plan.assign(df)
    inner = Window.partitionBy(*by, "_b1", "_b2").orderBy(*columns)
    numbered = bucketed.select(
        "*",
        F.lag(value).over(inner).alias(out),
        (F.row_number().over(inner) == 1).alias("_first"),
        F.lead(F.lit(True), 1, False).over(inner).alias("_followed"),
    )
    across = Window.partitionBy(*by).orderBy("_b1", "_b2")
    places = [*by, "_b1", "_b2"]
    ends = numbered.where(~F.col("_followed")).select(
        *[F.col(c).alias(f"_at{i}") for i, c in enumerate(places)],
        F.lag(F.struct(F.col(value).alias("v"))).over(across).alias("_before"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(places)])
    return (
        numbered.join(ends, same, "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_before.v")).otherwise(F.col(out)))
        .select(*df.columns, out)
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, rows beyond the first of their key, and keys that repeat."""
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
            F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"),
        )
    )


# ---- report ---------------------------------------------------------------------------------------

CHECK_COLUMNS = ["check", "status", "observed", "requirement"]


def _outcome(check: Column, passed: Column, observed: Column, requirement: Column) -> list[Column]:
    return [
        check.alias("check"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        observed.cast("double").alias("observed"),
        requirement.alias("requirement"),
    ]


def no_violations(counts: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Turn a one-row frame of violation counts into check rows; ``checks`` maps column to requirement."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n"), F.lit(r).alias("r")) for c, r in checks.items()]
    )
    rows = counts.select(F.explode(entries).alias("_e"))
    return rows.select(*_outcome(F.col("_e.c"), F.col("_e.n") == 0, F.col("_e.n"), F.col("_e.r")))


def bounded(values: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Check rows for a one-row frame of measured values with lower and upper bounds."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("c"),
                F.col(c).cast("double").alias("v"),
                F.lit(f"between {low:g} and {high:g}").alias("r"),
                F.coalesce(F.col(c).between(low, high), F.lit(False)).alias("ok"),
            )
            for c, (low, high) in bounds.items()
        ]
    )
    rows = values.select(F.explode(entries).alias("_e"))
    return rows.select(*_outcome(F.col("_e.c"), F.col("_e.ok"), F.col("_e.v"), F.col("_e.r")))


def constant_check(spark: SparkSession, check: str, violations: int, requirement: str) -> DataFrame:
    row = (check, "PASS" if violations == 0 else "FAIL", float(violations), requirement)
    return spark.createDataFrame([row], "check string, status string, observed double, requirement string")


def report(checks: Iterable[DataFrame], raise_on_failure: bool = False) -> DataFrame:
    """All check rows in one frame; the only collect is of failed checks, and only on request."""
    table = reduce(lambda a, b: a.unionByName(b), checks)
    if raise_on_failure:
        failed = table.where(F.col("status") == "FAIL").select("check").collect()  # one row per rule
        if failed:
            raise ValueError("failed checks: " + ", ".join(r["check"] for r in failed))
    return table


# ---- rules on one table -----------------------------------------------------------------------------


def row_rules(df: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Rules about single rows: check name to (violation, requirement). One pass for all of them."""
    counts = df.agg(*[count_if(violation).alias(name) for name, (violation, _) in rules.items()])
    return no_violations(counts, {name: text for name, (_, text) in rules.items()})


def key_rules(df: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """Key without nulls or duplicates, running first..first+n-1 when ``first`` is given."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sums = per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias(f"{key} null"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0)).alias(f"{key} repeated"),
        F.sum("n").alias("_n"),
        F.min(key).alias("_low"),
        F.max(key).alias("_high"),
    )
    checks = {f"{key} null": "no null key", f"{key} repeated": "each key once"}
    if first is not None:
        gap = F.abs(F.col("_low") - first) + F.abs(F.col("_high") - (F.lit(first) + F.col("_n") - 1))
        sums = sums.withColumn(f"{key} sequence", gap)
        checks[f"{key} sequence"] = f"ids run from {first} without gaps"
    return no_violations(sums, checks)


def domain_rules(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside the list (rows) and listed values that never occur."""
    value = F.col(column)
    counts = df.agg(
        count_if(value.isNotNull() & ~value.isin(*allowed)).alias(f"{column} outside domain"),
        (F.lit(len(allowed)) - F.count_distinct(F.when(value.isin(*allowed), value))).alias(f"{column} unused values"),
    )
    return no_violations(
        counts, {f"{column} outside domain": "only listed values", f"{column} unused values": "every listed value occurs"}
    )


def composite_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    name = "+".join(columns) + " repeated"
    counts = duplicate_keys(df, columns).select(F.col("surplus_rows").alias(name))
    return no_violations(counts, {name: "each combination once"})


def monotone(df: DataFrame, entity: str, order: Sequence[Key], value: str) -> DataFrame:
    """The value of an entity never decreases in the given order."""
    earlier = with_previous(df, entity, order, value, "_previous")
    name = f"{value} decreases"
    return no_violations(earlier.agg(count_if(F.col(value) < F.col("_previous")).alias(name)), {name: "no decrease over time"})


def first_row_rules(
    df: DataFrame, entity: str, order: Sequence[str], kind: str, expected: str, parents: DataFrame, date: str, parent_date: str
) -> DataFrame:
    """The earliest row of an entity is of the expected kind and date, and the kind occurs once."""
    first = df.groupBy(entity).agg(
        F.min_by(F.struct(kind, date), F.struct(*order)).alias("_f"), count_if(F.col(kind) == expected).alias("_n")
    )
    joined = parents.select(entity, parent_date).join(first, entity, "left")
    counts = joined.agg(
        count_if(~F.coalesce(F.col(f"_f.{kind}") == expected, F.lit(False))).alias("first row kind"),
        count_if(~F.coalesce(F.col(f"_f.{date}") == F.col(parent_date), F.lit(False))).alias("first row date"),
        count_if(F.coalesce("_n", F.lit(0)) != 1).alias("first row count"),
    )
    return no_violations(
        counts,
        {"first row kind": f"earliest row is {expected}", "first row date": "on the start date", "first row count": "exactly one"},
    )


def pairing_rules(events: DataFrame, entity: str, date: str, kind: str, start: str, end: str) -> DataFrame:
    """As many ends as starts per entity, and each start has its own later or equal end.

    The k-th start is compared with the k-th end, by running numbers per entity and kind.
    """
    both = events.where(F.col(kind).isin(start, end)).select(entity, date, "event_id", F.col(kind).alias("_k"))
    numbered = ranked(both, [Key(date), Key("event_id")], [entity, "_k"], out="_i")
    pairs = numbered.groupBy(entity, "_i").agg(
        F.max(F.when(F.col("_k") == start, F.col(date))).alias("_s"),
        F.max(F.when(F.col("_k") == end, F.col(date))).alias("_e"),
    )
    counts = pairs.agg(
        count_if(F.col("_s").isNotNull() & F.col("_e").isNull()).alias("start without end"),
        count_if(F.col("_s").isNull() & F.col("_e").isNotNull()).alias("end without start"),
        count_if(F.col("_e") < F.col("_s")).alias("end before start"),
    )
    return no_violations(
        counts,
        {"start without end": "each start has an end", "end without start": "each end has a start", "end before start": "ends later"},
    )


# ---- rules across tables ------------------------------------------------------------------------------


def referential(child: DataFrame, foreign: str, parent: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Child rows whose foreign key has no parent; counted per distinct key."""
    name = name or f"{foreign} orphans"
    used = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = used.join(parent.select(F.col(key).alias("_k")), "_k", "left_anti")
    return no_violations(orphans.agg(F.sum("_n").alias(name)), {name: "every foreign key exists"})


def child_counts(parent: DataFrame, child: DataFrame, key: str, name: str, exactly_one: bool = True) -> DataFrame:
    """Parents without exactly one (or without any) child."""
    counted = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    bad = (n != 1) if exactly_one else (n == 0)
    joined = parent.select(key).join(counted, key, "left")
    return no_violations(joined.agg(count_if(bad).alias(name)), {name: "exactly one child" if exactly_one else "at least one child"})


def inside_interval(
    records: DataFrame, date: str, entities: DataFrame, key: str, start: str, end: str, as_of: str, name: str
) -> DataFrame:
    """Records dated outside start..end of their entity (an open end means the as-of date)."""
    last = F.coalesce(end, F.lit(as_of).cast("date"))
    joined = records.select(key, date).join(entities.select(key, start, end), key)
    return no_violations(
        joined.agg(count_if((F.col(date) < F.col(start)) | (F.col(date) > last)).alias(name)), {name: "start <= date <= end"}
    )


def within_band(
    records: DataFrame, value: str, bands: DataFrame, on: str, low: str, high: str, factor: float, name: str
) -> DataFrame:
    """Values outside low..factor·high of their band."""
    joined = records.select(on, value).join(bands.select(on, low, high), on)
    return no_violations(
        joined.agg(count_if(~F.col(value).between(F.col(low), F.col(high) * factor)).alias(name)), {name: f"low <= value <= {factor:g} high"}
    )


def same_rows(first: DataFrame, second: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Both tables hold the same multiset of rows.

    Rows are counted with opposite signs in one aggregate, which gives what two
    exceptAll runs would give.
    """
    signed = first.select(*columns, F.lit(1).alias("_d")).unionByName(second.select(*columns, F.lit(-1).alias("_d")))
    gaps = signed.groupBy(*columns).agg(F.sum("_d").alias("_d"))
    counts = gaps.agg(
        F.sum(F.greatest("_d", F.lit(0))).alias(f"{name} only first"),
        F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias(f"{name} only second"),
    )
    return no_violations(counts, {f"{name} only first": "no row on one side only", f"{name} only second": "no row on one side only"})


def latest_matches(
    events: DataFrame, change: str, master: DataFrame, key: str, current: str, name: str, maximum: int | None = None
) -> DataFrame:
    """The last change of an entity leads to its current value; optionally at most ``maximum`` changes."""
    last = events.where(F.col("event_type") == change).groupBy(key).agg(
        F.max_by("new_value", F.struct("event_date", "event_id")).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    joined = last.join(master.select(key, current), key)
    counts = [count_if(~F.col("_v").try_cast("bigint").eqNullSafe(F.col(current).cast("bigint"))).alias(name)]
    checks = {name: "last change equals current value"}
    if maximum is not None:
        counts.append(count_if(F.col("_n") > maximum).alias(f"{name} repeats"))
        checks[f"{name} repeats"] = f"at most {maximum}"
    return no_violations(joined.agg(*counts), checks)


def hierarchy_rules(
    people: DataFrame, allowed: Sequence[tuple[str, str]], heads: Sequence[str], key: str = "employee_id", parent: str = "manager_id"
) -> DataFrame:
    """No self-management; the manager exists, is active, of the same department and an allowed level; heads have none."""
    columns = ["employment_status", "department_id", "organizational_level"]
    managers = people.select(F.col(key).alias(parent), *[F.col(c).alias(f"m_{c}") for c in columns], F.lit(True).alias("_found"))
    joined = people.select(key, parent, *columns).join(managers, parent, "left")
    has = F.col(parent).isNotNull()
    found = F.col("_found").isNotNull()
    level_ok = reduce(
        lambda a, b: a | b, [(F.col("organizational_level") == a) & (F.col("m_organizational_level") == b) for a, b in allowed]
    )
    active = F.col("employment_status") == "Active"
    counts = joined.agg(
        count_if(has & (F.col(key) == F.col(parent))).alias("self managed"),
        count_if(has & ~found).alias("manager missing"),
        count_if(found & active & (F.col("m_employment_status") != "Active")).alias("manager inactive"),
        count_if(found & (F.col("department_id") != F.col("m_department_id"))).alias("manager of other department"),
        count_if(found & ~level_ok).alias("manager level"),
        count_if(F.col("organizational_level").isin(*heads) & has).alias("head with manager"),
        count_if(~F.col("organizational_level").isin(*heads) & ~has).alias("no manager"),
    )
    return no_violations(counts, {c: "none" for c in counts.columns})


def span_limits(people: DataFrame, limits: dict[str, int], key: str = "employee_id", parent: str = "manager_id") -> DataFrame:
    """Managers with more active reports than their level allows."""
    load = people.where((F.col("employment_status") == "Active") & F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    limit = F.lit(None).cast("int")
    for level, n in limits.items():
        limit = F.when(F.col("organizational_level") == level, n).otherwise(limit)
    joined = load.join(people.select(key, "organizational_level"), key)
    return no_violations(joined.agg(count_if(F.col("_n") > limit).alias("span of control")), {"span of control": "reports within the limit"})


def required_child(parents: DataFrame, condition: Column, child: DataFrame, child_condition: Column, key: str, name: str) -> DataFrame:
    """Parents that meet ``condition`` but have no child that meets ``child_condition``."""
    missing = parents.where(condition).select(key).join(child.where(child_condition).select(key), key, "left_anti")
    return no_violations(missing.agg(F.count(F.lit(1)).alias(name)), {name: "required record exists"})


def totals_agree(first: DataFrame, second: DataFrame, on: Sequence[str], value: str, name: str, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose totals differ between two tables, or that only one of them has."""
    a = first.groupBy(*on).agg(F.sum(value).alias("_a"))
    b = second.groupBy(*on).agg(F.sum(value).alias("_b"))
    joined = a.join(b, list(on), "full")
    off = F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance)
    return no_violations(joined.agg(count_if(off).alias(name)), {name: "group totals agree"})


def attributes_equal(first: DataFrame, second: DataFrame, on: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Paired rows that differ in an attribute."""
    right = second.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = first.select(*on, *columns).join(right, list(on))
    counts = joined.agg(*[count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(f"{name} {c}") for c in columns])
    return no_violations(counts, {c: "equal on both sides" for c in counts.columns})


# ---- rules for panels, splits, scores and plans ---------------------------------------------------------


def forbidden_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    present = sorted(set(df.columns) & set(names))
    return constant_check(df.sparkSession, "leaky columns", len(present), "none of: " + ", ".join(names))


def outcome_telling(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows without a value, the label's rate among them and among the others, and whether either side has one label only.

    A column that is written when the outcome happens shows it by its presence, whatever its name. One aggregate.
    """
    entries = []
    for c in columns:
        empty = F.col(c).isNull()
        a, b = (F.avg(F.when(side, F.col(label).cast("double"))) for side in (empty, ~empty))
        settled = (count_if(empty) > 0) & (a.isin(0.0, 1.0) | b.isin(0.0, 1.0))
        entries.append(
            F.struct(
                F.lit(c).alias("feature"), count_if(empty).alias("missing"), a.alias("rate_where_missing"), b.alias("rate_where_present"),
                F.coalesce(settled, F.lit(False)).alias("tells_the_outcome"),
            )
        )
    return df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def entity_windows(panel: DataFrame, entity: str, sequence: str, snapshot: str, horizon: str) -> DataFrame:
    """Rows, rows with a later one of their entity, and those whose label window reaches over its snapshot."""
    following = F.lead(snapshot).over(Window.partitionBy(entity).orderBy(sequence))  # a row per snapshot
    placed = panel.select(F.col(horizon).alias("_h"), following.alias("_n"))
    return placed.agg(
        F.count(F.lit(1)).alias("rows"), F.count("_n").alias("followed"), count_if(F.col("_n") < F.col("_h")).alias("overlapping")
    )


def no_future_dates(audit: DataFrame, snapshot: str, columns: Sequence[str]) -> DataFrame:
    """Source dates that lie after the row's snapshot."""
    return row_rules(audit, {f"{c} in the future": (F.col(c) > F.col(snapshot), "date <= snapshot") for c in columns})


def label_rebuild(panel: DataFrame, master: DataFrame, key: str, label: str, expected: Column) -> DataFrame:
    """Labels that differ from the ones recomputed from the master table."""
    joined = panel.join(master, key)
    return no_violations(
        joined.agg(count_if(~F.col(label).eqNullSafe(expected)).alias("label mismatches")), {"label mismatches": "labels can be rebuilt"}
    )


def windows_disjoint(panel: DataFrame, sequence: str, snapshot: str, horizon: str) -> DataFrame:
    """A snapshot of the panel never precedes the horizon end of the one before."""
    table = panel.select(sequence, snapshot, horizon).distinct()
    following = F.lead(snapshot).over(Window.partitionBy(F.lit(0)).orderBy(sequence))  # one row per snapshot
    gaps = table.withColumn("_gap", F.datediff(following, horizon))
    return no_violations(gaps.agg(count_if(F.col("_gap") < 0).alias("overlapping windows")), {"overlapping windows": "next snapshot >= horizon end"})


def same_population(first: DataFrame, second: DataFrame, key: str, name: str = "population") -> DataFrame:
    return same_rows(first.select(key).distinct(), second.select(key).distinct(), [key], name)


def volume_bounds(panel: DataFrame, group: str, label: str, rows: tuple[int, int], rate: tuple[float, float]) -> DataFrame:
    """Rows and positive rate of each snapshot inside their bounds."""
    grouped = panel.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("r"))
    name = F.col(group).cast("string")
    volume = grouped.select(
        *_outcome(F.concat(F.lit("rows "), name), F.col("n").between(*rows), F.col("n"), F.lit(f"between {rows[0]} and {rows[1]}"))
    )
    share = grouped.where(F.col("r").isNotNull()).select(
        *_outcome(F.concat(F.lit("rate "), name), F.col("r").between(*rate), F.round("r", 6), F.lit(f"between {rate[0]:g} and {rate[1]:g}"))
    )
    return volume.unionByName(share)


def split_safety(
    split: DataFrame, assignment: DataFrame, folds: DataFrame, entity: str, date: str, target: str, order: Sequence[str], spread: float
) -> DataFrame:
    """Splits in time order, disjoint folds, similar fold rates, no target in the output or the reserved split."""
    spans = split.agg(
        *[F.max(F.when(F.col("split") == s, F.col(date))).alias(f"hi_{s}") for s in order],
        *[F.min(F.when(F.col("split") == s, F.col(date))).alias(f"lo_{s}") for s in order],
        count_if((F.col("split") == order[-1]) & F.col(target).isNotNull()).alias("reserved target present"),
    )
    disorder = F.lit(0)
    for a, b in zip(order, order[1:], strict=False):
        disorder = disorder + F.when(F.col(f"hi_{a}") < F.col(f"lo_{b}"), 0).otherwise(1)
    first = no_violations(
        spans.withColumn("splits out of order", disorder),
        {"splits out of order": "chronological", "reserved target present": "reserved target is null"},
    )
    shared = folds.groupBy(entity).agg(F.count_distinct("fold").alias("f")).agg(count_if(F.col("f") > 1).alias("entity in several folds"))
    second = no_violations(shared, {"entity in several folds": "folds are disjoint"})
    rates = split.where(F.col("split") != order[-1]).join(folds, entity).groupBy("fold").agg(F.avg(target).alias("r"))
    third = bounded(rates.agg((F.max("r") - F.min("r")).alias("fold rate spread")), {"fold rate spread": (0.0, spread)})
    fourth = constant_check(split.sparkSession, "target in assignment", int(target in assignment.columns), "assignment carries no target")
    return report([first, second, third, fourth])


def policy_coverage(df: DataFrame, roles: dict[str, Sequence[str]], references: dict[str, str]) -> DataFrame:
    """Every column has exactly one role, and every reference category occurs."""
    listed = [c for columns in roles.values() for c in columns]
    spark = df.sparkSession
    structure = [
        constant_check(spark, "columns without role", len(set(df.columns) - set(listed)), "every column assigned"),
        constant_check(spark, "columns with several roles", len(listed) - len(set(listed)), "assigned once"),
        constant_check(spark, "unknown columns", len(set(listed) - set(df.columns)), "assigned columns exist"),
    ]
    counts = df.agg(*[(1 - F.max((F.col(c).cast("string") == v).cast("int"))).alias(f"reference {c}") for c, v in references.items()])
    structure.append(no_violations(counts, {c: "reference category occurs" for c in counts.columns}))
    return report(structure)


def score_rules(df: DataFrame, score: str, label: str) -> DataFrame:
    return row_rules(
        df,
        {
            "score missing": (F.col(score).isNull(), "no null"),
            "score outside [0,1]": (~F.col(score).between(0.0, 1.0), "in [0, 1]"),
            "label outside {0,1}": (~F.col(label).isin(0, 1), "0 or 1"),
        },
    )


def confusion_rules(table: DataFrame, rows: str = "rows") -> DataFrame:
    """The four confusion counts add up to the rows."""
    total = F.col("true_negative") + F.col("false_positive") + F.col("false_negative") + F.col("true_positive")
    return row_rules(table, {"confusion sum": (total != F.col(rows), "tn + fp + fn + tp = rows")})


def non_increasing(curve: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """A curve never rises. The curve has one row per distinct step."""
    stepped = with_previous(curve, by, [Key(order)], value, "_p")
    return no_violations(stepped.agg(count_if(F.col(value) > F.col("_p") + 1e-12).alias(name)), {name: "non-increasing"})


def plan_rules(
    plan: DataFrame, scored: DataFrame, group: str, flag: str, unit_cost: float, maximum: int, budget: float, active: DataFrame, key: str
) -> DataFrame:
    """Selection within its limits, group sums equal to totals, spend re-derived, nobody inactive selected."""
    chosen = scored.where(F.col(flag))
    size = chosen.agg(F.count(F.lit(1)).alias("selected"), (F.count(F.lit(1)) * unit_cost).alias("spend"))
    limits = bounded(size, {"selected": (0, maximum), "spend": (0, budget)})
    rebuilt = scored.groupBy(group).agg(
        count_if(F.col(flag)).alias("_n"), F.sum("attrition_probability").alias("_p")
    )
    joined = plan.join(rebuilt, group, "full")
    sums = joined.agg(
        count_if(~F.col("_n").eqNullSafe(F.col("selected_for_human_review"))).alias("group selection"),
        count_if(~F.coalesce(F.abs(F.col("_p") - F.col("expected_departures_12m")) <= 1e-6, F.lit(False))).alias("group departures"),
        count_if(
            ~F.coalesce(F.abs(F.col("_n") * unit_cost - F.col("planned_intervention_spend_usd")) <= 1e-6, F.lit(False))
        ).alias("group spend"),
    )
    gone = chosen.select(key).join(active.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("inactive selected"))
    return report(
        [
            limits,
            no_violations(sums, {c: "plan equals recomputation" for c in sums.columns}),
            no_violations(gone, {"inactive selected": "only active rows"}),
        ]
    )
