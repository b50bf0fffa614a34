"""Named queries over the test tables and the statements they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayline.plans.binding import rel, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Relations of the data model for one scale directory, loaded on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._loaded: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = rel(self.spark, self.sf_dir, name)
        return self._loaded[name]

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def pick(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}


def query(name: str, needs: str = "", oracle: str | None = None):
    """Register ``fn(tables)``; ``oracle`` may use the relations listed in ``needs``."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            body = oracle.strip()
            if not needs:
                ORACLES[name] = body
            elif body.upper().startswith("WITH "):
                # join the statement's own common table expressions to the relations
                prefix = with_relations(*needs.split(), body="").rstrip()
                own = body[5:]
                if own.upper().startswith("RECURSIVE "):
                    prefix, own = prefix.replace("WITH ", "WITH RECURSIVE ", 1), own[10:]
                ORACLES[name] = f"{prefix}, {own}"
            else:
                ORACLES[name] = with_relations(*needs.split(), body=body)
        return fn

    return keep


def round_all(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round double columns, since sums of doubles depend on the order of the rows."""
    from pyspark.sql import functions as F

    return df.select(
        *[F.round(f.name, decimals).alias(f.name) if f.dataType.typeName() in ("double", "float") else f.name for f in df.schema]
    )
