"""Column-by-column comparison of two tables with the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import count_if
from stayline.session import settle
from stayline.sources.tables import canonical, fingerprint

TYPE_CLASSES = ("exact_numeric", "tolerant_numeric", "date", "timestamp", "boolean", "exact_text")

# Accepted spellings of booleans.
TRUE_TEXT = ("true", "1", "1.0", "t")
FALSE_TEXT = ("false", "0", "0.0", "f")


def as_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE_TEXT), True).when(text.isin(*FALSE_TEXT), False)


def as_date(value: Column) -> Column:
    return F.trim(value.cast("string")).substr(1, 10).try_cast("date")


def as_number(value: Column) -> Column:
    return value.try_cast("double")


def as_exact(value: Column) -> Column:
    """Without the detour through a double, in which integers beyond 2**53 fall together."""
    return value.try_cast("decimal(38,10)")


NORMALISERS = {
    "exact_numeric": as_exact,
    "tolerant_numeric": as_number,
    "date": as_date,
    "timestamp": lambda v: v.try_cast("timestamp"),
    "boolean": as_boolean,
    "exact_text": lambda v: v.cast("string"),
}


def normalise(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Every column in the form of its type class; columns without a class are kept."""
    return df.select(*[NORMALISERS[classes[c]](F.col(c)).alias(c) if c in classes else F.col(c) for c in df.columns])


def invalid_values(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Per column: non-null inputs that their normaliser cannot read."""
    counts = df.agg(
        *[count_if(F.col(c).isNotNull() & NORMALISERS[k](F.col(c)).isNull()).alias(c) for c, k in classes.items()]
    )
    return counts.unpivot([], list(classes), "column_name", "invalid_values")


def require_valid(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """The normalised table; raises when a non-null value would turn into null."""
    bad = [r["column_name"] for r in invalid_values(df, classes).where("invalid_values > 0").collect()]
    if bad:
        raise ValueError(f"values that cannot be read in: {', '.join(sorted(bad))}")
    return normalise(df, classes)


def infer_classes(df: DataFrame, tolerant: Sequence[str] = ()) -> dict[str, str]:
    out = {}
    for field in df.schema:
        kind = field.dataType.typeName()
        if field.name in tolerant or kind in ("double", "float"):
            out[field.name] = "tolerant_numeric"
        elif kind in ("integer", "long", "short", "byte") or kind.startswith("decimal"):
            out[field.name] = "exact_numeric"
        elif kind == "date":
            out[field.name] = "date"
        elif kind in ("timestamp", "timestamp_ntz"):
            out[field.name] = "timestamp"
        elif kind == "boolean":
            out[field.name] = "boolean"
        else:
            out[field.name] = "exact_text"
    return out


def compare_tables(
    first: DataFrame,
    second: DataFrame,
    key: Sequence[str],
    classes: dict[str, str],
    absolute: float = 1e-9,
    relative: float = 1e-9,
) -> DataFrame:
    """Per column: null-pattern mismatches, value mismatches and the largest difference.

    One full join on the key and one aggregate for all columns. A key on one side
    only counts as a null mismatch in every column.
    """
    columns = [c for c in first.columns if c not in key]
    a = normalise(first, classes).select(*key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = normalise(second, classes).select(*key, *[F.col(c).alias(f"b_{c}") for c in columns])
    joined = a.join(b, list(key), "full")
    entries = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        null_gap = x.isNull() != y.isNull()
        kind = classes[c]
        both = x.isNotNull() & y.isNotNull()
        largest = F.lit(None).cast("double")
        if kind == "tolerant_numeric":
            close = F.abs(x - y) <= F.lit(absolute) + F.lit(relative) * F.abs(y)
            different = null_gap | (both & ~close)
        else:
            different = null_gap | (both & (x != y))
        if kind.endswith("numeric"):
            largest = F.max(F.abs(x - y)).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(kind).alias("comparison_type"),
                F.count(F.lit(1)).alias("rows_compared"),
                count_if(null_gap).alias("null_pattern_mismatches"),
                count_if(different).alias("value_mismatches"),
                largest.alias("maximum_absolute_difference"),
            )
        )
    return joined.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def unequal_buckets(first: DataFrame, second: DataFrame, key: Sequence[str], columns: Sequence[str], decimals: dict[str, int], buckets: int, fan: int) -> DataFrame:
    """Buckets of keys whose rows differ, found by a tree of digests.

    A bucket's digest is the exclusive or of two hashes of its rows, which differ since keys are unique, so a level
    follows from the one below it. Levels are compared from the
    root; only children of unequal nodes are looked at, so equal tables cost the pass that makes the digests.
    """
    text = F.concat_ws("\x1f", *[canonical(first, c, decimals.get(c)) for c in [*key, *columns]])

    def leaves(df: DataFrame) -> DataFrame:
        hashed = df.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("node"), F.xxhash64(text, F.lit(1)).alias("h"), F.xxhash64(text, F.lit(2)).alias("i"))
        return settle(hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("i").alias("i")))

    sides = [leaves(first), leaves(second)]
    names = ["n", "h", "i"]
    depth = 0
    while fan ** (depth + 1) < buckets:
        depth += 1
    unequal = None
    for level in range(depth, -1, -1):
        width = fan**level
        summed = []
        for side in sides:
            up = side.withColumn("node", F.floor(F.col("node") / width))
            if unequal is not None:  # children of unequal nodes only
                up = up.join(unequal.withColumnRenamed("node", "parent"), F.floor(F.col("node") / fan) == F.col("parent"), "left_semi")
            summed.append(up.groupBy("node").agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("i").alias("i")))
        both = summed[0].unionByName(summed[1]).groupBy("node").agg(
            F.count(F.lit(1)).alias("sides"), *[F.min(c).alias(f"a{c}") for c in names], *[F.max(c).alias(f"b{c}") for c in names]
        )
        differs = F.col("sides") < 2
        for c in names:
            differs = differs | (F.col(f"a{c}") != F.col(f"b{c}"))
        unequal = settle(both.where(differs).select("node"))
        if not unequal.limit(1).count():
            break
    return unequal


def located_differences(
    first: DataFrame, second: DataFrame, key: Sequence[str], classes: dict[str, str],
    decimals: int = 8, rows_per_bucket: int = 10_000, fan: int = 64,
) -> DataFrame:
    """(key, feature, first_value, second_value) of every cell that differs; a missing row differs in every column.

    Only rows in buckets of keys whose digests differ are joined. Numbers compared with a tolerance are equal if they
    agree to ``decimals`` places, in the digest and in the values alike. Keys are unique on each side.
    """
    columns = [c for c in first.columns if c not in key]
    places = {c: decimals for c, k in classes.items() if k == "tolerant_numeric"}
    a, b = normalise(first, classes), normalise(second, classes).select(*first.columns)
    buckets = max(1, -(-first.count() // rows_per_bucket))
    nodes = unequal_buckets(a, b, key, columns, places, buckets, fan)

    def opened(df: DataFrame, side: str) -> DataFrame:
        chosen = df.join(nodes, F.pmod(F.xxhash64(*key), F.lit(buckets)) == F.col("node"), "left_semi")
        shown = [F.when(F.col(c).isNotNull(), canonical(df, c, places.get(c))).alias(f"{side}{c}") for c in columns]
        return chosen.select(*key, F.lit(True).alias(f"{side}side"), *shown)

    joined = opened(a, "_a").join(opened(b, "_b"), list(key), "full")
    lone = F.col("_aside").isNull() | F.col("_bside").isNull()
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_a{c}").alias("first_value"), F.col(f"_b{c}").alias("second_value")) for c in columns]
    )
    long = joined.select(*key, lone.alias("_lone"), F.explode(cells).alias("_c")).select(*key, "_lone", "_c.*")
    return long.where(F.col("_lone") | ~F.col("first_value").eqNullSafe(F.col("second_value"))).drop("_lone")


def key_differences(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys, with multiplicity, that one side has more often."""
    signed = first.select(*key, F.lit(1).alias("_d")).unionByName(second.select(*key, F.lit(-1).alias("_d")))
    gaps = signed.groupBy(*key).agg(F.sum("_d").alias("_d"))
    return gaps.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_in_first"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_in_second"),
    ).withColumn("keys_match", (F.col("only_in_first") == 0) & (F.col("only_in_second") == 0))


def partition_counts(first: DataFrame, second: DataFrame, partition: str) -> DataFrame:
    a = first.groupBy(partition).agg(F.count(F.lit(1)).alias("first_rows"))
    b = second.groupBy(partition).agg(F.count(F.lit(1)).alias("second_rows"))
    joined = a.join(b, partition, "full").fillna(0, ["first_rows", "second_rows"])
    return joined.withColumn("row_count_match", F.col("first_rows") == F.col("second_rows"))


def comparison_summary(
    first: DataFrame, second: DataFrame, key: Sequence[str], classes: dict[str, str], decimals: int = 8
) -> DataFrame:
    """One row: columns, keys, total mismatches and whether the content digests agree."""
    totals = compare_tables(first, second, key, classes).agg(
        F.sum("null_pattern_mismatches").alias("total_null_pattern_mismatches"),
        F.sum("value_mismatches").alias("total_value_mismatches"),
    )
    places = {c: decimals for c, k in classes.items() if k == "tolerant_numeric"}

    def digest(df: DataFrame, out: str) -> DataFrame:
        parts = fingerprint(normalise(df, classes), sorted(df.columns), places)
        return parts.select(F.concat_ws("-", *[F.col(f"digest_{i}").cast("string") for i in range(1, 5)]).alias(out))

    joined = key_differences(first, second, key)
    for part in (totals, digest(first, "_a"), digest(second, "_b")):
        joined = joined.crossJoin(F.broadcast(part))  # one row each
    return joined.select(
        F.lit(first.columns == second.columns).alias("columns_match"),
        "keys_match",
        "total_null_pattern_mismatches",
        "total_value_mismatches",
        (F.col("_a") == F.col("_b")).alias("fingerprints_match"),
    )
