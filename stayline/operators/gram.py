"""Sums of outer products over wide tables: one binary buffer per partition and fit, added up in a tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import settle

#: Partial sums that one task adds up, and triangular factors that one task stacks.
FAN_IN, STACK = 64, 16


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([np.asarray(c.cast(pa.float64())) for c in batch.columns[first:]])


def buffers(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["_g", "_sums"]
    )


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.float64) for b in table["_sums"].to_pylist()], axis=0)
    return pa.table({"_g": table["_g"][:1], "_sums": pa.array([total.tobytes()], pa.binary())})


def summed_by_fit(partial: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the ``_sums`` buffers of each fit ``_g``, added in groups of partitions first."""
    near = partial.withColumn("_part", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("_g", "_part").applyInArrow(_add, "_g int, _sums binary")
    far = near.groupBy("_g").applyInArrow(_add, "_g int, _sums binary")
    return {r["_g"]: np.frombuffer(bytes(r["_sums"]), np.float64) for r in far.collect()}


def logistic_sums(frame: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) of each fit at its coefficients, intercept first.

    ``frame`` has the fit ``_g``, the weight ``_w``, the label ``_y`` and the features. A partition yields one buffer per
    fit that it holds rows of; curvature is a product of matrices over a batch, whatever the number of features.
    """
    d = len(features) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            group = np.asarray(batch.column(0))
            order = np.argsort(group, kind="stable")
            w, y = (np.asarray(batch.column(k))[order] for k in (1, 2))
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch, 3)])[order] if d > 1 else np.ones((batch.num_rows, 1))
            names, heads = np.unique(group[order], return_index=True)
            for g, a, b in zip(names.tolist(), heads, [*heads[1:], batch.num_rows]):
                if g not in betas:
                    continue
                z = x[a:b] @ betas[g]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
                # log(1 + e^z) - y z, written so that a large |z| does not overflow
                loss = np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - y[a:b] * z
                curve = (w[a:b] * p * (1.0 - p))[:, None] * x[a:b]
                parts = [[float(w[a:b] @ loss)], (w[a:b] * (y[a:b] - p)) @ x[a:b], (curve.T @ x[a:b]).ravel()]
                sums[g] = sums.get(g, 0.0) + np.concatenate(parts)
        yield buffers(sums)

    columns = frame.select("_g", "_w", "_y", *features)
    totals = summed_by_fit(columns.mapInArrow(partial, "_g int, _sums binary"))
    return {g: (float(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)) for g, v in totals.items()}


#: Rows whose weights in all resamples are one matrix.
LOT = 2048


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Lots of rows with their counts as a matrix; ``counts`` is the first column."""
    for batch in batches:
        for start in range(0, batch.num_rows, LOT):
            lot = batch.slice(start, LOT)
            yield np.asarray(lot.column(0).flatten()).reshape(lot.num_rows, -1).astype(np.float64), lot


def fit_counts(rows: DataFrame, number: int) -> DataFrame:
    """``counts`` in place of the list ``_train`` of fits: how often it names each of the fits 1 to ``number``."""
    rest = [c for c in rows.columns if c != "_train"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LOT):
                lot = batch.slice(start, LOT)
                n = lot.num_rows
                lists = lot.column(0)
                at = np.repeat(np.arange(n) * number, lists.value_lengths().to_numpy())
                counts = np.bincount(at + lists.flatten().to_numpy() - 1, minlength=n * number).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(number)), pa.array(counts))
                yield pa.RecordBatch.from_arrays([listed, *lot.columns[1:]], names=["counts", *rest])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema)
    return rows.select("_train", *rest).mapInArrow(count, f"counts array<int>, {kinds}")


def resampled_sizes(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positives of every resample; ``frame`` has ``counts`` and the label ``_y``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for counts, lot in _counted(batches):
            positive = lot.column(1).fill_null(0.0).to_numpy() == 1.0
            total = total + np.concatenate([counts.sum(axis=0), counts[positive].sum(axis=0)])
        yield buffers({0: total} if np.ndim(total) else {})

    found = summed_by_fit(frame.select("counts", "_y").mapInArrow(partial, "_g int, _sums binary"))
    return tuple(np.split(found[0], 2)) if found else (np.zeros(0), np.zeros(0))


def resampled_logistic_sums(
    frame: DataFrame, features: Sequence[str], betas: dict[int, np.ndarray], weight: dict[int, np.ndarray]
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """``logistic_sums`` of resamples numbered from 1: a row's weight is its count times the ``weight`` of its class there.

    ``frame`` has ``counts``, the label ``_y`` and the features, a row once for all resamples.
    """
    d = len(features) + 1
    fits = sorted(betas)
    if not fits:
        return {}
    columns = np.array(fits) - 1
    coefficients = np.column_stack([betas[g] for g in fits])
    of_class = {k: v[columns] for k, v in weight.items()}
    rows, others = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for counts, lot in _counted(batches):
            y = lot.column(1).to_numpy()[:, None]
            x = np.column_stack([np.ones(lot.num_rows), _matrix(lot, 2)]) if d > 1 else np.ones((lot.num_rows, 1))
            w = counts[:, columns] * np.where(y == 1.0, of_class[1], of_class[0])
            z = x @ coefficients
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            loss = (w * (np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - y * z)).sum(axis=0)
            curve = (w * p * (1.0 - p)).T @ (x[:, rows] * x[:, others])
            total = total + np.column_stack([loss, (w * (y - p)).T @ x, curve])
        yield buffers({0: total.ravel()} if np.ndim(total) else {})

    found = summed_by_fit(frame.select("counts", "_y", *features).mapInArrow(partial, "_g int, _sums binary"))
    out = {}
    for g, v in zip(fits, found[0].reshape(len(fits), -1)):
        curve = np.zeros((d, d))
        curve[rows, others] = curve[others, rows] = v[d + 1 :]
        out[g] = (float(v[0]), v[1 : d + 1], curve)
    return out


def triangular_factor(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """R of the QR decomposition of the rows of ``columns``: each partition keeps d x d numbers, which are stacked in a tree.

    Unlike the product of the matrix with itself, R keeps small singular values apart from rounding errors.
    """
    d = len(columns)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _matrix(batch, 0)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def stack(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.float64).reshape(-1, d) for b in table["r"].to_pylist()]
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return pa.table({"node": table["node"][:1], "r": pa.array([r.tobytes()], pa.binary())})

    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    factors = cast.mapInArrow(local, "r binary").select(F.spark_partition_id().cast("long").alias("node"), "r")
    factors = settle(factors)
    while (factors.agg(F.max("node")).first()[0] or 0) > 0:
        grouped = factors.withColumn("node", F.floor(F.col("node") / STACK)).groupBy("node")
        factors = settle(grouped.applyInArrow(stack, "node long, r binary"))
    row = factors.first()
    return np.frombuffer(bytes(row["r"]), np.float64).reshape(-1, d) if row else np.zeros((0, d))
