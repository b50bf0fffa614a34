"""Steps of calibrated models fitted anew in every fold of every repeat, with a row per input row throughout.

Fits are numbered over outer folds and inner parts: ``(outer - 1) * inner + part``. A row carries how often it is trained
in each fit (``counts``) and the outer folds that hold it (``_held``); what a fit makes of it is found as a matrix over
rows and fits inside a task, so neither rows nor scores are stored per fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.gram import buffers, summed_by_fit
from stayline.operators.isotonic import pool_adjacent, pool_points
from stayline.session import store

#: Rows of a block (at most 65536), rows of a matrix, and draws of one class and outer fold that one group orders.
BLOCK_BITS, LOT, ORDERED = 15, 8192, 1_000_000
#: Cells of a column's values, cells of a fit's scores, and rows from which the latter's edges are taken.
VALUE_CELLS, SCORE_CELLS, EDGE_ROWS = 4096, 8192, 32_768


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, LOT):
            yield batch.slice(start, LOT)


def _times(lists: pa.Array, number: int) -> np.ndarray:
    """How often each list names each of 1 to ``number``."""
    at = np.repeat(np.arange(len(lists)) * number, lists.value_lengths().to_numpy())
    return np.bincount(at + lists.flatten().to_numpy() - 1, minlength=len(lists) * number).reshape(len(lists), number)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def deal_parts(rows: DataFrame, row_id: str, label: str, folds: int, repeats: int, inner: int, seed: int) -> DataFrame:
    """``rows`` with ``counts``: the training rows of each outer fold are dealt to ``inner`` parts, stratified by class.

    A row takes the part that its rank by hash among the outer fold's rows of its class says, and is trained in the
    fits of the other parts. Hashes are ordered in ranges; a range's first rank is known once all ranges are counted,
    and only the rank's remainder goes back, three bytes a row and outer fold.
    """
    total = folds * repeats
    columns, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # numbers that are written once stay the same in every read
    numbered = store(rows.withColumn("_at", F.monotonically_increasing_id()))
    width = 2**60 // max(1, numbered.count() // ORDERED + 1) + 1
    heads = [f"{seed}|inner|{o + 1}|".encode() for o in range(total)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            at, kind = lot.column(0).to_numpy(), lot.column(1).to_numpy()
            held = _times(lot.column(3), total)
            entries = held.reshape(-1, repeats, folds).sum(axis=2).repeat(folds, axis=1) - held
            texts = [t.encode() for t in lot.column(2).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for o, head in enumerate(heads):
                mine = np.flatnonzero(entries[:, o])
                # the draw of ``expr.draw``: 60 bits of the md5
                digests = b"".join([hashlib.md5(head + texts[i]).digest()[:8] for i in mine.tolist()])
                mine = np.repeat(np.arange(len(mine)), entries[mine, o]), np.repeat(mine, entries[mine, o])
                h = (np.frombuffer(digests, ">u8") >> 4).astype(np.int64)[mine[0]]
                k, a, part = kind[mine[1]], at[mine[1]], h // width
                order = np.lexsort((part, k))
                h, a, k, part = h[order], a[order], k[order], part[order]
                starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (part[1:] != part[:-1])]) if len(k) else []
                for s, e in zip(starts, [*starts[1:], len(k)]):
                    for column, value in zip(out, (o + 1, k[s], part[s], h[s:e].tobytes(), a[s:e].tobytes())):
                        column.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["_outer", "_kind", "_range", "_h", "_a"])

    def order(table: pa.Table) -> pa.Table:
        h, at = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("_h", "_a"))
        rank = np.empty(len(h), np.uint8)
        rank[np.lexsort((at, h))] = np.arange(len(h)) % inner
        turn = np.argsort(at, kind="stable")
        at, rank = at[turn], rank[turn]
        block = at >> BLOCK_BITS
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = [*starts[1:].tolist(), len(at)]
        place = (at & (2**BLOCK_BITS - 1)).astype(np.uint16)
        n = len(starts)
        return pa.table(
            {
                "_block": block[starts], **{c: pa.repeat(table[c][0], n) for c in ("_outer", "_kind", "_range")}, "_size": pa.array(np.full(n, len(h))),
                "_places": pa.array([place[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                "_ranks": pa.array([rank[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
            }
        )

    asked = numbered.select("_at", F.xxhash64(label).alias("_kind"), F.col(row_id).cast("string").alias("_text"), "_held")
    drawn = asked.mapInArrow(spread, "_outer int, _kind long, _range long, _h binary, _a binary")
    ranks = store(
        drawn.groupBy("_outer", "_kind", "_range").applyInArrow(order, "_block long, _outer int, _kind long, _range long, _size long, _places binary, _ranks binary")
    )
    first: dict[tuple[int, int, int], int] = {}
    so_far: dict[tuple[int, int], int] = {}
    for o, k, r, n in sorted(map(tuple, ranks.select("_outer", "_kind", "_range", "_size").distinct().collect())):  # a row per range
        first[o, k, r] = so_far.get((o, k), 0) % inner
        so_far[o, k] = so_far.get((o, k), 0) + n

    def count(table: pa.Table, parts: pa.Table) -> pa.Table:
        where = np.zeros(2**BLOCK_BITS, np.int64)
        where[table["_at"].to_numpy() & (2**BLOCK_BITS - 1)] = np.arange(table.num_rows)
        keys = [np.zeros(0, np.int64)]
        for o, k, r, places, ranks in zip(*(parts[c].to_pylist() for c in ("_outer", "_kind", "_range", "_places", "_ranks"))):
            part = (np.frombuffer(ranks, np.uint8) + first[o, k, r]) % inner
            keys.append((where[np.frombuffer(places, np.uint16)] * total + o - 1) * inner + part)
        known = np.bincount(np.concatenate(keys), minlength=table.num_rows * total * inner).reshape(-1, inner)
        counts = (known.sum(axis=1, keepdims=True) - known).astype(np.int32).ravel()
        bounds = np.arange(table.num_rows + 1, dtype=np.int32) * np.int32(total * inner)
        return table.select(columns).append_column("counts", pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts)))

    blocks = numbered.withColumn("_block", F.shiftright("_at", BLOCK_BITS))
    return store(blocks.groupBy("_block").cogroup(ranks.groupBy("_block")).applyInArrow(count, f"{kinds}, counts array<int>"))


def _summed_rows(partial: DataFrame, by: str) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(b, np.int64) for b in table["_sums"].to_pylist()], axis=0)
        return pa.table({c: table[c][:1] for c in ("_i", "_v")} | {"_sums": pa.array([sums.tobytes()], pa.binary())})

    return partial.groupBy("_i", "_v").applyInArrow(add, f"_i int, _v {by}, _sums binary")


def _sum_by(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their rows of counts."""
    turn = np.argsort(values, kind="stable")
    values = values[turn]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.add.reduceat(counts[turn], starts, axis=0) if len(starts) else counts[:0]


def encoders_of_counts(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], number: int) -> dict[int, dict[str, object]]:
    """``model.encoders_per_fit`` as a dict by fit, from rows with ``counts`` of fits 1 to ``number``.

    Medians are exact: values are counted by cell for all fits, then those of the cells that hold a median one by one.
    """
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(numeric)]
    table = rows.select("counts", *values)
    start = table.agg(*[F.avg(f"_v{i}").alias(f"_v{i}") for i in range(len(numeric))]).first()
    base = [start[f"_v{i}"] or 0.0 for i in range(len(numeric))]
    cuts = [sorted(set(q)) for q in table.stat.approxQuantile([f"_v{i}" for i in range(len(numeric))], [k / VALUE_CELLS for k in range(1, VALUE_CELLS)], 1e-4)]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((len(c) + 1 + 3, number)) for i, c in enumerate(cuts)}
        for lot in _lots(batches):
            counts = _matrix(lot.column(0)).astype(np.float64)
            for i, cut in enumerate(cuts):
                known = np.asarray(lot.column(i + 1).is_valid())
                v = lot.column(i + 1).drop_null().to_numpy()
                cells, found = _sum_by(np.searchsorted(cut, v), counts[known])
                sums[i][cells] += found
                sums[i][-3] += counts[~known].sum(axis=0)
                sums[i][-2:] += np.vstack([v - base[i], (v - base[i]) ** 2]) @ counts[known]
        yield buffers({i: s.ravel() for i, s in sums.items()})

    found = {i: s.reshape(-1, number) for i, s in summed_by_fit(table.mapInArrow(totals, "_g int, _sums binary")).items()}
    cells, places, wanted = {}, {}, {}
    for i in found:
        cells[i] = np.vstack([np.zeros(number), np.cumsum(found[i][:-3], axis=0)])  # rows before each cell, and all
        n = cells[i][-1]
        places[i] = [np.floor((n - 1) * 0.5), np.ceil((n - 1) * 0.5)]
        inside = [np.where(n > 0, (cells[i][1:] <= p).sum(axis=0), -1) for p in places[i]]
        wanted[i] = np.unique(np.concatenate(inside)[np.concatenate(inside) >= 0])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            for i, cut in enumerate(cuts):
                known = np.asarray(lot.column(i + 1).is_valid())
                v = lot.column(i + 1).drop_null().to_numpy()
                take = np.isin(np.searchsorted(cut, v), wanted.get(i, []))
                names, sums = _sum_by(v[take], _matrix(lot.column(0))[known][take].astype(np.int64))
                parts = [pa.array(np.full(len(names), i), pa.int32()), pa.array(names), pa.array([s.tobytes() for s in sums], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["_i", "_v", "_sums"])

    single = _summed_rows(table.mapInArrow(near, "_i int, _v double, _sums binary"), "double").collect()  # values near a median
    texts = [F.col(c).cast("string").alias(f"_v{j}") for j, c in enumerate(categorical)]

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            for j in range(len(categorical)):
                coded = lot.column(j + 1).fill_null("Missing").dictionary_encode()
                at, sums = _sum_by(coded.indices.to_numpy(), _matrix(lot.column(0)).astype(np.int64))
                names = [coded.dictionary[int(k)].as_py() for k in at]
                parts = [pa.array(np.full(len(at), j), pa.int32()), pa.array(names, pa.string()), pa.array([s.tobytes() for s in sums], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["_i", "_v", "_sums"])

    levels = _summed_rows(rows.select("counts", *texts).mapInArrow(kinds, "_i int, _v string, _sums binary"), "string").collect()  # a row per category
    out: dict[int, dict[str, object]] = {}
    drawn = next(iter(found.values()))[:-2].sum(axis=0) if found else np.zeros(number)
    for g in np.flatnonzero(drawn).tolist():
        out[g + 1] = {}
    for i, base_ in enumerate(base):
        ordered = sorted(((r["_v"], np.frombuffer(bytes(r["_sums"]), np.int64)) for r in single if r["_i"] == i), key=lambda x: (x[0] != x[0], x[0]))
        v, n = np.array([x[0] for x in ordered]), np.array([x[1] for x in ordered]).reshape(-1, number)
        cell = np.searchsorted(cuts[i], v)
        for g in out:
            size = cells[i][-1, g - 1]
            if not size:
                out[g] |= {f"_m_{i}": None, f"_a_{i}": None, f"_s_{i}": None}
                continue
            ends = []
            for p in places[i]:
                k = int((cells[i][1:, g - 1] <= p[g - 1]).sum())
                mine = np.flatnonzero(cell == k)
                reach = cells[i][k, g - 1] + np.cumsum(n[mine, g - 1])
                ends.append(v[mine[np.searchsorted(reach, p[g - 1], side="right")]])
            median = float(ends[0] + (ends[1] - ends[0]) * ((size - 1) * 0.5 - places[i][0][g - 1]))
            missing, one, two = found[i][-3:, g - 1]
            mean = (one + missing * (median - base_)) / (size + missing)
            spread = (two + missing * (median - base_) ** 2) / (size + missing) - mean**2
            out[g] |= {f"_m_{i}": median, f"_a_{i}": base_ + mean, f"_s_{i}": float(np.sqrt(max(spread, 0.0))) if spread == spread else spread}
    for j in range(len(categorical)):
        mine = sorted((r["_v"], np.frombuffer(bytes(r["_sums"]), np.int64)) for r in levels if r["_i"] == j and r["_v"] != "Missing")
        for g in out:
            seen = [(-int(n[g - 1]), name) for name, n in mine if n[g - 1]]
            out[g][f"_o_{j}"] = min(seen)[1] if seen else None
    return out


@dataclass
class FoldScorer:
    """Probabilities of rows under many fits with encoders of their own, a column per fit of ``fits``.

    The sums are formed in the order of ``model.encode_with`` and ``model.score_by_fit``, so that equal rows tie.
    """

    fits: np.ndarray
    numeric: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # median, mean, deviation, coefficient per fit
    categorical: list[tuple[list[str], np.ndarray]]  # levels; what each adds per fit, then any other, then a missing one
    intercept: np.ndarray

    @staticmethod
    def of(groups: dict[int, np.ndarray], found: dict[int, dict], numeric: Sequence[str], categorical: dict[str, Sequence[str]]) -> FoldScorer:
        fits = sorted(groups)
        width = 1 + len(numeric) + sum(len(levels) - 1 for levels in categorical.values())
        beta = np.array([groups[g] for g in fits]).reshape(len(fits), width)
        numbers = []
        for i in range(len(numeric)):
            m, a, s = (np.array([found[g][f"_{x}_{i}"] for g in fits], float) for x in "mas")
            numbers.append((m, a, np.where(s > 0, s, 1.0), beta[:, i + 1]))
        kinds, at = [], len(numeric) + 1
        for j, levels in enumerate(categorical.values()):
            adds = np.zeros((len(levels) + 2, len(fits)))
            adds[1 : len(levels)] = beta[:, at : at + len(levels) - 1].T
            for c, g in enumerate(fits):
                mode = found[g][f"_o_{j}"]
                mode = levels[0] if mode is None else mode
                adds[-1, c] = adds[list(levels).index(mode), c] if mode in levels else 0.0
            kinds.append((list(levels), adds))
            at += len(levels) - 1
        return FoldScorer(np.array(fits, np.int64), numbers, kinds, beta[:, 0])

    def scores(self, columns: Sequence[pa.Array]) -> np.ndarray:
        linear = np.tile(self.intercept, (len(columns[0]), 1))
        for column, (median, mean, unit, beta) in zip(columns, self.numeric):
            missing = np.asarray(column.is_null())[:, None]
            value = np.where(missing, median, column.fill_null(0.0).to_numpy()[:, None])
            linear = linear + beta * ((value - mean) / unit)
        for column, (levels, adds) in zip(columns[len(self.numeric) :], self.categorical):
            coded = column.dictionary_encode()
            codes = [levels.index(v) if v in levels else len(levels) for v in coded.dictionary.to_pylist()]
            codes = np.array([*codes, len(levels) + 1])
            linear = linear + adds[codes[coded.indices.fill_null(len(codes) - 1).to_numpy()]]
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-linear))


def feature_columns(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    return [*[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"_k{j}") for j, c in enumerate(categorical)]]


def _known(counts: np.ndarray, inner: int, fits: np.ndarray) -> np.ndarray:
    """How often a row is in the part that a fit leaves out, from how often it is trained in the fits."""
    parts = counts.reshape(len(counts), -1, inner)
    return (parts.sum(axis=2, keepdims=True) // max(1, inner - 1) - parts).reshape(len(counts), -1)[:, fits - 1]


def known_scores(rows: DataFrame, label: str, scorer: FoldScorer, features: list, inner: int, out: str = "raw") -> DataFrame:
    """(fit, out, label): a row for each time that a fit leaves a training row out."""
    kind = rows.schema[label].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            times = _known(_matrix(lot.column(0)), inner, scorer.fits)
            row, col = np.nonzero(times)
            again = np.repeat(np.arange(len(row)), times[row, col])
            row, col = row[again], col[again]
            p = scorer.scores(lot.columns[2:])[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(scorer.fits[col], pa.int32()), pa.array(p), lot.column(1).take(pa.array(row))], names=["fit", out, label])

    return rows.select("counts", label, *features).mapInArrow(score, f"fit int, `{out}` double, `{label}` {kind}")


def held_scores(rows: DataFrame, row_id: str, scorer: FoldScorer, features: list, folds: int, inner: int, out: str = "raw") -> DataFrame:
    """(row, repeat, fit, out): a row for each outer fold that holds the row and each of its parts."""
    kind = rows.schema[row_id].dataType.simpleString()
    at = {int(g): c for c, g in enumerate(scorer.fits)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            row, fit, col = _asked(lot.column(1), inner, at)
            p = scorer.scores(lot.columns[2:])[row, col]
            repeat = (fit - 1) // (inner * folds) + 1
            yield pa.RecordBatch.from_arrays([lot.column(0).take(pa.array(row)), pa.array(repeat, pa.int32()), pa.array(fit, pa.int32()), pa.array(p)], names=[row_id, "repeat", "fit", out])

    return rows.select(row_id, "_held", *features).mapInArrow(score, f"`{row_id}` {kind}, repeat int, fit int, `{out}` double")


def _asked(held: pa.Array, inner: int, at: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, fit and the fit's column for each part of each outer fold that holds a row; fits that do not exist are left out."""
    row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
    fit = ((held.flatten().to_numpy().astype(np.int64) - 1) * inner)[:, None] + np.arange(1, inner + 1)
    row, fit = np.repeat(row, inner), fit.ravel()
    place = np.full(max([0, *at, *fit.tolist()[:1], int(fit.max(initial=0))]) + 1, -1)
    place[list(at)] = list(at.values())
    there = place[fit] >= 0
    return row[there], fit[there], place[fit[there]]


def _open_cells(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Cells whose rows decide where pools end, and (last cell, rows, positives) of each run of the others.

    Pools end where the lower hull of positives over rows turns. Within a cell the sums never lie below the path that
    takes all negatives first, whose corner is its lowest point: a cell with its corner above the hull of the cells'
    borders holds no turn.
    """
    cells = np.flatnonzero(n)
    n, p = n[cells], p[cells]
    x, y = np.r_[0.0, np.cumsum(n)], np.r_[0.0, np.cumsum(p)]
    number = np.arange(len(cells), dtype=float)
    pools = pool_adjacent(number, number, n, p)
    turns = np.array([0, *[int(high) + 1 for _, high, _, _ in pools]])
    corner = x[:-1] + (n - p)
    open_ = y[:-1] <= np.interp(corner, x[turns], y[turns]) + 1e-6 * (1.0 + y[-1] / max(x[-1], 1.0))
    open_[turns[1:] - 1] = True
    open_[turns[:-1]] = True
    closed, runs = np.flatnonzero(~open_), []
    if len(closed):
        breaks = np.flatnonzero(np.diff(closed) > 1)
        for s, e in zip(np.r_[0, breaks + 1], np.r_[breaks, len(closed) - 1]):
            a, b = closed[s], closed[e]
            runs.append((int(cells[b]), float(n[a : b + 1].sum()), float(p[a : b + 1].sum())))
    return cells[open_], runs


def pools_of_known(rows: DataFrame, row_id: str, label: str, scorer: FoldScorer, features: list, inner: int) -> DataFrame:
    """``isotonic_pools`` of ``known_scores`` by fit, from counts by cell of the score and the rows of cells with ends of pools.

    Cells are cut at quantiles of the scores of some rows. Where they are cut decides how many rows go on, not the result.
    """
    spark = rows.sparkSession
    every = max(1, rows.count() // EDGE_ROWS)
    some = rows.where(F.pmod(F.xxhash64(row_id), F.lit(every)) == 0).select(*features).toArrow().combine_chunks()  # about EDGE_ROWS rows
    cuts = [np.zeros(0)] * len(scorer.fits)
    if some.num_rows:
        p = scorer.scores([c.combine_chunks() for c in some.columns])
        cuts = [np.unique(q[np.isfinite(q)]) for q in np.quantile(p, np.arange(1, SCORE_CELLS) / SCORE_CELLS, axis=0, method="nearest").T]
    chosen = rows.where(F.col(label).isNotNull()).select("counts", F.col(label).cast("double").alias("_y"), *features)

    def cells_of(lot: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Column of the fit, cell, score, times and label of what is known in a lot, by fit."""
        times = _known(_matrix(lot.column(0)), inner, scorer.fits)
        p, y = scorer.scores(lot.columns[2:]), lot.column(1).to_numpy()
        col, row = np.nonzero(times.T)
        p, times, y = p[row, col], times[row, col], y[row]
        ends = np.searchsorted(col, np.arange(len(cuts) + 1))
        cell = np.concatenate([np.zeros(0, np.int64), *[np.searchsorted(cut, p[s:e]) for cut, s, e in zip(cuts, ends, ends[1:])]])
        return col, cell, p, times, y

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(cuts) * SCORE_CELLS))
        for lot in _lots(batches):
            col, cell, _, times, y = cells_of(lot)
            at = col * SCORE_CELLS + cell
            sums[0] += np.bincount(at, times, sums.shape[1])
            sums[1] += np.bincount(at, times * y, sums.shape[1])
        yield buffers({k: sums[:, k * SCORE_CELLS : (k + 1) * SCORE_CELLS].ravel() for k in range(len(cuts)) if sums[0, k * SCORE_CELLS : (k + 1) * SCORE_CELLS].any()})

    found = summed_by_fit(chosen.mapInArrow(count, "_g int, _sums binary"))
    open_, closed = np.zeros((len(cuts), SCORE_CELLS), bool), []
    for k, s in found.items():
        cells, runs = _open_cells(*s.reshape(2, -1))
        open_[k, cells] = True
        closed += [(int(scorer.fits[k]), float(cuts[k][cell]), float(cuts[k][cell]), n, y) for cell, n, y in runs]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            col, cell, p, times, y = cells_of(lot)
            take = open_[col, cell]
            columns = [scorer.fits[col[take]].astype(np.int32), p[take], times[take].astype(float), times[take] * y[take]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fit", "low", "weight", "total"])

    single = chosen.mapInArrow(pick, "fit int, low double, weight double, total double")
    points = single.groupBy("fit", "low").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    points = points.select("fit", "low", F.col("low").alias("high"), "weight", "total")
    runs = spark.createDataFrame(closed, "fit int, low double, high double, weight double, total double")  # some of a fit's cells
    return pool_points(points.unionByName(runs), ["fit"])


def mean_calibrated(
    rows: DataFrame, row_id: str, scorer: FoldScorer, features: list, pools: Sequence, folds: int, repeats: int, inner: int
) -> DataFrame:
    """(row, repeat, score): the mean over the parts of the fitted values at a held row's scores, linear between pools."""
    kind = rows.schema[row_id].dataType.simpleString()
    ends: dict[int, list[tuple[float, float]]] = {}
    for fit, low, high, value in sorted(map(tuple, pools)):
        ends.setdefault(fit, []).extend([(low, value)] if low == high else [(low, value), (high, value)])
    lines = {g: tuple(np.array(e).T) for g, e in ends.items()}
    at = {int(g): c for c, g in enumerate(scorer.fits)}

    def value(x: np.ndarray, g: int) -> np.ndarray:
        if g not in lines:
            return np.full(len(x), np.nan)
        low, v = lines[g]
        i = np.searchsorted(low, x, side="right") - 1
        a, b = np.maximum(i, 0), np.minimum(i + 1, len(low) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            between = v[a] + (x - low[a]) / (low[b] - low[a]) * (v[b] - v[a])
        return np.where((i < 0) | (a == b) | (x == low[a]), v[a], between)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            row, fit, col = _asked(lot.column(1), inner, at)
            p = scorer.scores(lot.columns[2:])[row, col]
            turn = np.argsort(fit, kind="stable")
            names, starts = np.unique(fit[turn], return_index=True)
            fitted = np.empty(len(p))
            for g, s, e in zip(names.tolist(), starts, [*starts[1:], len(p)]):
                fitted[turn[s:e]] = value(p[turn[s:e]], g)
            key, known = row * repeats + (fit - 1) // (inner * folds), ~np.isnan(fitted)
            size = lot.num_rows * repeats
            sums = np.bincount(key[known], fitted[known], size).astype(float)  # without keys it counts in integers
            columns = [np.bincount(key[known], minlength=size), np.bincount(key, minlength=size)]
            parts = [pa.array(c.reshape(-1, repeats)[:, r]) for r in range(repeats) for c in (sums, *columns)]
            yield pa.RecordBatch.from_arrays([lot.column(0), *parts], names=[row_id, *[f"_{x}{r}" for r in range(repeats) for x in "sne"]])

    shape = ", ".join(f"_s{r} double, _n{r} long, _e{r} long" for r in range(repeats))
    each = rows.select(row_id, "_held", *features).mapInArrow(score, f"`{row_id}` {kind}, {shape}")
    summed = each.groupBy(row_id).agg(*[F.sum(f"_{x}{r}").alias(f"_{x}{r}") for r in range(repeats) for x in "sne"])
    turns = F.array(
        *[F.when(F.col(f"_e{r}") > 0, F.struct(F.lit(r + 1).alias("repeat"), F.try_divide(f"_s{r}", f"_n{r}").alias("score"))) for r in range(repeats)]
    )
    return summed.select(row_id, F.explode(F.array_compact(turns)).alias("_t")).select(row_id, "_t.*")
