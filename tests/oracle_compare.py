"""Run registered queries against DuckDB and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

from stayline.plans.binding import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _kind(t: pa.DataType) -> str:
    if pa.types.is_boolean(t):
        return "boolean"
    if pa.types.is_integer(t):
        return "integer"
    if pa.types.is_floating(t):
        return "double"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else repr(v) if not isinstance(v, float) else f"{v:.9g}") for v in row)


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    out = []
    left, right = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if left != right:
        return [f"columns {set(left) ^ set(right)}"]
    for name in left:
        a, b = spark_table.schema.field(name).type, duck_table.schema.field(name).type
        if _kind(a) != _kind(b):
            out.append(f"type of {name}: {a} / {b}")
    if spark_table.num_rows != duck_table.num_rows:
        out.append(f"rows {spark_table.num_rows} / {duck_table.num_rows}")
        return out
    rows_a = sorted(zip(*[spark_table[c].to_pylist() for c in left], strict=True), key=_key)
    rows_b = sorted(zip(*[duck_table[c].to_pylist() for c in left], strict=True), key=_key)
    bad = 0
    for a, b in zip(rows_a, rows_b, strict=True):
        for name, x, y in zip(left, a, b, strict=True):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            if not same:
                bad += 1
                if bad <= 4:
                    out.append(f"{name}: {x!r} / {y!r}")
    if bad:
        out.append(f"{bad} differing values")
    return out


def run(spark, sf_dir: str, names: list[str], queries: dict, oracles: dict) -> dict[str, list[str]]:
    connection = duck(sf_dir)
    report = {}
    for name in names:
        began = time.time()
        try:
            table = queries[name](spark, sf_dir).toArrow()
            spark_seconds = time.time() - began
            if name in oracles:
                began = time.time()
                problems = differences(table, connection.execute(oracles[name]).to_arrow_table())
                duck_seconds = time.time() - began
            else:
                problems, duck_seconds = [], 0.0
        except Exception as error:  # noqa: BLE001 - one report line per query
            problems, table, spark_seconds, duck_seconds = [str(error)[:900]], None, time.time() - began, 0.0
        report[name] = problems
        rows = table.num_rows if table is not None else "-"
        kind = "oracle" if name in oracles else "rows"
        state = "ok  " if not problems else "FAIL"
        print(f"{state} {name:44s} {kind:6s} rows={rows} spark={spark_seconds:.1f}s duck={duck_seconds:.1f}s", *problems, sep="\n      " if problems else " ")
        sys.stdout.flush()
    return report


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stayline.session import build_session

    session = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    all_queries, all_oracles = entry.queries(), entry.oracle_sql()
    patterns = sys.argv[2:]
    only = "--checked" in patterns
    patterns = [p for p in patterns if p != "--checked"]
    chosen = [n for n in all_queries if not patterns or any(n.startswith(p) for p in patterns)]
    chosen = [n for n in chosen if n in all_oracles or not only]
    results = run(session, sys.argv[1], chosen, all_queries, all_oracles)
    failed = [n for n, p in results.items() if p]
    print(f"{len(results) - len(failed)}/{len(results)} ok; failed: {failed}")
