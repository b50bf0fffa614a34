"""Corrections of dated histories after outcomes are known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.asof import attribute_at
from stayline.operators.rank import Key, ranked
from stayline.session import store


def apply_outcomes(employees: DataFrame, outcomes: DataFrame, columns: Sequence[str], key: str = "employee_id") -> DataFrame:
    """Overwrite the outcome columns of every employee; one without an outcome gets nulls."""
    joined = employees.drop(*columns).join(outcomes.select(key, *columns), key, "left")
    return joined.select(*employees.columns)


def end_dates(employees: DataFrame, as_of: str, key: str = "employee_id") -> DataFrame:
    return employees.select(key, F.coalesce("termination_date", F.lit(as_of).cast("date")).alias("_end"))


def censor(records: DataFrame, date: str, ends: DataFrame, key: str = "employee_id") -> DataFrame:
    """Drop records after the end date of their entity."""
    return records.join(ends, key).where(F.col(date) <= F.col("_end")).select(*records.columns)


def censor_training(training: DataFrame, programs: DataFrame, ends: DataFrame, key: str = "employee_id") -> DataFrame:
    """Drop later starts; a completion after the end becomes incomplete, with hours below the requirement."""
    joined = training.join(ends, key).where(F.col("start_date") <= F.col("_end")).join(
        programs.select("program_id", "required_hours"), "program_id", "left"
    )
    late = F.coalesce(F.col("completion_date") > F.col("_end"), F.lit(False))
    limit = F.greatest(F.col("required_hours").cast("double") - 0.1, F.lit(0.0))
    changes = {
        "completion_status": F.when(late, "Incomplete").otherwise(F.col("completion_status")),
        "completion_date": F.when(~late, F.col("completion_date")),
        "score": F.when(~late, F.col("score")),
        "training_hours": F.when(late, F.least(F.col("training_hours").cast("double"), limit)).otherwise(F.col("training_hours")),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in training.columns])


def assignments_at_exit(employees: DataFrame, events: DataFrame, key: str = "employee_id") -> DataFrame:
    """Location and manager of terminated employees as of their exit; active employees keep theirs."""
    gone = employees.where(F.col("employment_status") == "Terminated").select(key, "termination_date", "location_id", "manager_id")
    at_exit = attribute_at(
        gone, events, key, "termination_date", "location_id", "Transfer", "_location", first_old_value=True
    )
    at_exit = attribute_at(
        at_exit, events, key, "termination_date", "manager_id", "Manager Change", "_manager", first_old_value=True
    )
    joined = employees.join(at_exit.select(key, "_location", "_manager", F.lit(True).alias("_gone")), key, "left")
    ended = F.col("_gone").isNotNull()
    changes = {
        "location_id": F.when(ended, F.col("_location")).otherwise(F.col("location_id").cast("int")),
        "manager_id": F.when(ended, F.col("_manager").cast("bigint")).otherwise(F.col("manager_id").cast("bigint")),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in employees.columns])


def valid_manager_changes(employees: DataFrame, events: DataFrame, key: str = "employee_id") -> DataFrame:
    """Manager changes with a flag: were the old and the new manager still there on that date?"""
    changes = events.where(F.col("event_type") == "Manager Change")
    ends = employees.select(F.col(key).alias("_m"), F.col("termination_date").alias("_e"))

    def known_end(df: DataFrame, value: str, out: str) -> DataFrame:
        lookup = ends.select(F.col("_m").alias(f"_id_{out}"), F.col("_e").alias(out))
        return df.join(lookup, F.col(value).try_cast("bigint") == F.col(f"_id_{out}"), "left").drop(f"_id_{out}")

    joined = known_end(known_end(changes, "old_value", "_old_end"), "new_value", "_new_end")

    def there(end: str) -> Column:
        return F.col(end).isNull() | (F.col(end) > F.col("event_date"))

    return joined.withColumn("valid", there("_old_end") & there("_new_end")).drop("_old_end", "_new_end")


def repair_manager_changes(employees: DataFrame, events: DataFrame, key: str = "employee_id") -> tuple[DataFrame, DataFrame]:
    """Drop impossible manager changes; the manager becomes the last valid change or the first old value."""
    judged = valid_manager_changes(employees, events, key)
    order = F.struct("event_date", "event_id")
    final = judged.groupBy(key).agg(
        F.coalesce(F.max_by("new_value", F.when(F.col("valid"), order)), F.min_by("old_value", order))
        .try_cast("bigint")
        .alias("_manager")
    )
    manager = F.coalesce("_manager", F.col("manager_id").cast("bigint"))
    people = employees.join(final, key, "left").withColumn("manager_id", manager).select(*employees.columns)
    kept = events.where(F.col("event_type") != "Manager Change").unionByName(
        judged.where("valid").select(*events.columns)
    )
    return people, kept


def rebuild_events(
    events: DataFrame, employees: DataFrame, as_of: str, leave_types: Sequence[str] = ("Leave",), key: str = "employee_id"
) -> DataFrame:
    """Event stream without old terminations, later events and broken leave pairs, plus one termination per exit."""
    kept = censor(events.where(F.col("event_type") != "Termination"), "event_date", end_dates(employees, as_of, key), key)
    leave = F.col("event_type").isin(*leave_types)
    pairs = kept.where(leave).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2).select(key)
    whole = kept.where(leave).join(pairs, key, "left_semi")
    exits = employees.where(F.col("employment_status") == "Terminated").select(
        key,
        F.col("termination_date").alias("event_date"),
        F.lit("Termination").alias("event_type"),
        F.lit("Active").alias("old_value"),
        F.lit("Terminated").alias("new_value"),
        F.concat("termination_type", F.lit(" termination.")).alias("notes"),
    )
    columns = [key, "event_date", "event_type", "old_value", "new_value", "notes"]
    return kept.where(~leave).select(*columns).unionByName(whole.select(*columns)).unionByName(exits)


def reassign_reports(
    employees: DataFrame,
    as_of: str,
    valid_levels: dict[str, Sequence[str]],
    capacity: dict[str, int],
    key: str = "employee_id",
) -> DataFrame:
    """New manager for every report whose manager left first: one row per report, null if no slot is free.

    Each active manager offers its free slots, ordered per department and level by
    level priority, load and id. Reports are numbered in the same department and
    level, and the n-th report takes the n-th slot. Levels that share managers are
    served one after the other, so a slot is used once. Limits hold as in a
    sequential assignment; the pairs may differ from it.
    """
    managers = employees.select(F.col(key).alias("manager_id"), F.col("employment_status").alias("_ms"), F.col("termination_date").alias("_me"))
    last = F.coalesce("termination_date", F.lit(as_of).cast("date"))
    orphans = (
        employees.join(managers, "manager_id")
        .where((F.col("_ms") != "Active") & (last > F.col("_me")))
        .select(key, "department_id", "organizational_level", F.col("manager_id").alias("old_manager_id"), F.col("_me").alias("event_date"))
    )
    load = employees.where((F.col("employment_status") == "Active") & F.col("manager_id").isNotNull()).groupBy(
        F.col("manager_id").alias("_id")
    ).agg(F.count(F.lit(1)).alias("_load"))
    size = F.lit(None).cast("int")
    for level, n in capacity.items():
        size = F.when(F.col("_level") == level, n).otherwise(size)
    offers = (
        employees.where(F.col("employment_status") == "Active")
        .select(F.col(key).alias("_id"), "department_id", F.col("organizational_level").alias("_level"))
        .where(F.col("_level").isin(*capacity))
        .join(load, "_id", "left")
        .withColumn("_load", F.coalesce("_load", F.lit(0)))
        .withColumn("_size", size)
        .where(F.col("_load") < F.col("_size"))
    )
    # a slot is one more report on top of the present load
    fill = F.explode(F.sequence(F.col("_load") + 1, F.col("_size").cast("bigint"))).alias("_fill")
    # each round reads files: a plan that grows by a round would run all rounds before it again for every ranking
    slots = store(offers.select("_id", "department_id", "_level", fill))
    asked = F.array(*[F.struct(F.lit(lv).alias("level"), F.array(*[F.lit(m) for m in ms]).alias("ms")) for lv, ms in valid_levels.items()])
    levels = orphans.select("*", F.filter(asked, lambda e: e.level == F.col("organizational_level"))[0].ms.alias("_ms"))
    # the slots of a department serve the reports of all its levels: number both sides per department and manager level
    first = store(levels.withColumn("_level", F.element_at("_ms", 1)))
    # ids order the sides; "_fill" spreads the reports over managers with equal load
    reports = ranked(first, [Key(key)], ["department_id", "_level"], out="_n")
    numbered = store(ranked(slots, [Key("_fill"), Key("_id")], ["department_id", "_level"], out="_n"))
    matched = store(reports.join(numbered.select("department_id", "_level", "_n", F.col("_id").alias("new_manager_id")), ["department_id", "_level", "_n"], "left"))
    out = matched.where(F.col("new_manager_id").isNotNull())
    waiting = matched.where(F.col("new_manager_id").isNull())
    rounds = max(len(m) for m in valid_levels.values())
    columns = [key, "department_id", "organizational_level", "old_manager_id", "event_date", "new_manager_id"]
    result = out.select(*columns)
    free = numbered.join(out.select(F.col("department_id"), "_level", "_n"), ["department_id", "_level", "_n"], "left_anti")
    for step in range(2, rounds + 1):
        has = F.size("_ms") >= step
        pending = waiting.where(has).drop("_n", "_level", "new_manager_id").withColumn("_level", F.element_at("_ms", step))
        pending = ranked(pending, [Key(key)], ["department_id", "_level"], out="_n")
        open_slots = store(ranked(store(free.drop("_n")), [Key("_fill"), Key("_id")], ["department_id", "_level"], out="_n"))
        again = store(
            pending.join(
                open_slots.select("department_id", "_level", "_n", F.col("_id").alias("new_manager_id")), ["department_id", "_level", "_n"], "left"
            )
        )
        taken = again.where(F.col("new_manager_id").isNotNull())
        result = result.unionByName(taken.select(*columns)).unionByName(
            waiting.where(~has).select(*columns)
        )
        free = open_slots.join(taken.select("department_id", "_level", "_n"), ["department_id", "_level", "_n"], "left_anti")
        waiting = again.where(F.col("new_manager_id").isNull())
    return result.unionByName(waiting.select(*columns))

