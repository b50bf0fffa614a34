"""Typed table scans, sinks, views, content fingerprints and two-source parity."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayline.sources.contracts import CONTRACTS, Contract


def read_csv(spark: SparkSession, path: str, contract: Contract, strict: bool = True) -> DataFrame:
    """CSV scan with the declared schema.

    ``strict`` fails on a header that differs in name or order and on a value of
    the wrong type. Otherwise a bad date or number becomes null.
    """
    reader = (
        spark.read.schema(contract.schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
    )
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    contract: Contract,
    schema: str = "public",
    relation: str | None = None,
    partitions: int | None = None,
    bounds: tuple[int, int] | None = None,
    **properties: str,
) -> DataFrame:
    """Relational scan of the contracted columns, split on the integer key when bounds are known."""
    options = {"url": url, "dbtable": f"{schema}.{relation or contract.name}", **properties}
    if partitions and bounds:
        options.update(
            partitionColumn=contract.key[0],
            numPartitions=str(partitions),
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
        )
    return conform(spark.read.format("jdbc").options(**options).load(), contract)


def conform(df: DataFrame, contract: Contract, public_only: bool = False) -> DataFrame:
    """Project the contracted columns and coerce them; values that do not parse become null."""
    wanted = contract.public_columns if public_only else contract.columns
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: columns missing from the source: {missing}")
    return df.select(*[F.col(c).try_cast(contract.schema[c].dataType).alias(c) for c in wanted])


def typed_scan(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Project and coerce to a schema given as a StructType or DDL text."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in target.fields])


def create_views(tables: dict[str, DataFrame], hidden: dict[str, Sequence[str]], prefix: str = "analytics_") -> list[str]:
    """Register one least-privilege view per table, without its hidden columns."""
    names = []
    for name, df in tables.items():
        view = f"{prefix}{name}"
        df.select(*[c for c in df.columns if c not in set(hidden.get(name, ()))]).createOrReplaceTempView(view)
        names.append(view)
    return names


def bulk_load(spark: SparkSession, source_dir: str, target_dir: str, contracts: Iterable[Contract] | None = None) -> DataFrame:
    """Full reload of CSV files into parquet. All headers are checked before the first write.

    Returns one row per table with the number of rows loaded and their digest, as ``fingerprint`` gives it. Both are
    observed while the rows are written, so a table is read once. Rows of a retried task count once.
    """
    chosen = list(contracts or CONTRACTS.values())
    frames = {}
    for contract in chosen:
        path = os.path.join(source_dir, f"{contract.name}.csv")
        frame = read_csv(spark, path, contract)
        header = [c.strip() for c in spark.read.text(path).first()[0].split(",")]
        if header != contract.columns:
            raise ValueError(f"{contract.name}: header {header} differs from {contract.columns}")
        frames[contract.name] = frame
    loaded = []
    for name, frame in frames.items():
        seen = Observation(f"load_{name}")
        hashed = _row_hash(frame, frame.columns, {})
        watched = frame.observe(seen, F.count(F.lit(1)).alias("row_count"), *_digest_sums(hashed))
        watched.write.mode("overwrite").parquet(os.path.join(target_dir, name))
        loaded.append((name, *[int(seen.get[c]) for c in ("row_count", *DIGESTS)]))
    return spark.createDataFrame(loaded, "table_name string, row_count long, " + ", ".join(f"{d} long" for d in DIGESTS))


def write_partitioned(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    return union_all(
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")).select("table_name", "row_count")
        for name, df in tables.items()
    )


def reconcile_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Counts of both sides per table, and whether they agree; a table on one side only never does."""
    left = row_counts(source).withColumnRenamed("row_count", "source_rows")
    right = row_counts(target).withColumnRenamed("row_count", "target_rows")
    return left.join(right, "table_name", "full").withColumn(
        "matches", F.coalesce(F.col("source_rows") == F.col("target_rows"), F.lit(False))
    )


def canonical(df: DataFrame, column: str, decimals: int | None = None) -> Column:
    """Text form of a value that does not depend on its storage type; different values have different texts.

    A timestamp at midnight reads like the date. Doubles are told apart up to 12 digits, decimals by all of theirs.
    """
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind in ("timestamp", "timestamp_ntz"):
        midnight = c == F.date_trunc("day", c)
        text = F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif kind == "boolean":
        text = F.initcap(c.cast("string"))
    elif decimals is not None and kind in ("double", "float", "decimal"):
        text = F.format_string(f"%.{decimals}f", c.cast("double"))
    elif kind == "decimal" and df.schema[column].dataType.precision > 12:
        text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif kind in ("double", "float", "decimal"):
        text = F.format_string("%.12g", c.cast("double"))
    else:
        # the separator and the mark of null stay apart from the same characters in a text
        text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\u"))
        text = F.when(text == "<NULL>", F.lit("\\<NULL>")).otherwise(text)
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("<NULL>"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, decimals: dict[str, int] | None = None) -> DataFrame:
    """Row count and an order-free digest of the content.

    Each row is hashed; the digest is the sum of four 32-bit slices of that hash,
    so rows may be read and combined in any order and duplicates still count.
    """
    hashed = df.select(_row_hash(df, list(columns or df.columns), decimals or {}).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("row_count"), *_digest_sums(F.col("h")))


DIGESTS = tuple(f"digest_{i}" for i in range(1, 5))


def _row_hash(df: DataFrame, columns: Sequence[str], decimals: dict[str, int]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[canonical(df, c, decimals.get(c)) for c in columns]))


def _digest_sums(hashed: Column) -> list[Column]:
    return [
        F.coalesce(F.sum(F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("bigint")), F.lit(0)).alias(d) for i, d in enumerate(DIGESTS)
    ]


def provenance(tables: dict[str, tuple[str, str, DataFrame]]) -> DataFrame:
    """backend, relation, key, rows, columns and digest per table; values are (backend, key, frame)."""
    rows = []
    for relation, (backend, key, df) in tables.items():
        rows.append(
            fingerprint(df).select(
                F.lit(backend).alias("backend"),
                F.lit(relation).alias("relation"),
                F.lit(key).alias("key_column"),
                "row_count",
                F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                *[f"digest_{i}" for i in range(1, 5)],
            )
        )
    return union_all(rows)


def parity_report(first: dict[str, DataFrame], second: dict[str, DataFrame], key_columns: dict[str, Sequence[str]]) -> DataFrame:
    """Per table: rows, column order, duplicate keys and content digest on both sides."""

    def side(df: DataFrame, key: Sequence[str], tag: str) -> DataFrame:
        duplicates = (
            df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d"))
        )
        digest = F.concat_ws("-", *[F.col(f"digest_{i}").cast("string") for i in range(1, 5)])
        return fingerprint(df, sorted(df.columns)).crossJoin(F.broadcast(duplicates)).select(
            F.col("row_count").alias(f"{tag}_rows"), F.col("d").alias(f"{tag}_duplicate_keys"), digest.alias(f"{tag}_digest")
        )

    rows = []
    for name in first:
        a, b = side(first[name], key_columns[name], "first"), side(second[name], key_columns[name], "second")
        rows.append(
            a.crossJoin(F.broadcast(b)).select(
                F.lit(name).alias("table_name"),
                "*",
                F.lit(first[name].columns == second[name].columns).alias("same_columns"),
                (F.col("first_rows") == F.col("second_rows")).alias("same_rows"),
                (F.col("first_digest") == F.col("second_digest")).alias("same_content"),
            )
        )
    return union_all(rows)
