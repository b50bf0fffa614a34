"""Substring deduplication by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.blocks import BASES, hash_words, mix, split_words, text_blocks, window_hashes
from stayline.session import store

WINDOW = 50
LAST = (1 << 63) - 1  # stands for a null id: later than all others


def sliding(values: np.ndarray, length: int, pick=np.minimum) -> np.ndarray:
    """Smallest (or largest) of ``length`` neighbours from each position, by doubling; ``length`` - 1 fewer values."""
    out, reach = values, 1
    while 2 * reach <= length:
        out, reach = pick(out[:-reach], out[reach:]), 2 * reach
    if reach < length:
        rest = length - reach
        out = pick(out[:-rest], out[rest:])
    return out


def anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The half windows that stand for whole ones: their hashes, each whole window's smallest, and which are chosen.

    A window of ``window`` words stands behind the smallest hash of the half windows inside it. Equal windows choose
    equal halves, so a window can only be repeated if a half that it chose is. ``smallest`` is 0 where no whole
    window of one text starts; ``chosen`` marks every half that some window chose, ties included.
    """
    half = window // 2
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    short = mix(window_hashes(words, half).copy()) | np.uint64(1)
    smallest = sliding(short, window - half + 1)
    at = np.arange(len(smallest))
    ends = np.repeat(first[1:], np.diff(first))[: len(smallest)]
    smallest[at + window > ends] = 0
    reach = window - half
    padded = np.concatenate([np.zeros(reach, np.uint64), smallest, np.zeros(len(short) - len(smallest), np.uint64)])
    return short, smallest, sliding(padded, reach + 1, np.maximum) == short


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _level_one(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column(0), batch.column(1)
        for low, high, data, offsets in text_blocks(batch.column(2)):
            starts, ends, first = split_words(data, offsets)
            one, two = (hash_words(data, starts, ends, b) for b in BASES)
            raw = data.tobytes()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())) for a, b in zip(offsets[:-1], offsets[1:])]
            short, _, chosen = anchors(one, first, window)
            at = np.flatnonzero(chosen)
            bounds = np.searchsorted(at, first)
            out = [
                ids.slice(low, high - low), marks.slice(low, high - low), pa.array(np.diff(first)),
                pa.array([h.hexdigest() for h in whole]),
                pa.LargeListArray.from_arrays(pa.array(bounds), _signed(short[at])).cast(pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["id", "mark", "n_words", "sha256", "halves"])


def _level_two(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    half = window // 2
    for batch in batches:
        candidates = batch.column(3)
        for low, high, data, offsets in text_blocks(batch.column(2)):
            starts, ends, first = split_words(data, offsets)
            one, two = (hash_words(data, starts, ends, b) for b in BASES)
            _, smallest, _ = anchors(one, first, window)
            part = candidates.slice(low, high - low)
            values = np.asarray(part.flatten()).view(np.uint64)
            sizes = np.asarray(pa.compute.list_value_length(part))
            row = np.repeat(np.arange(high - low), np.diff(first))[: len(smallest)]
            # a window survives where its smallest half is one of its own text's repeated halves
            keep = np.zeros(len(smallest), bool)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for r in np.flatnonzero(sizes).tolist():
                a, b = first[r], min(first[r + 1], len(smallest))
                keep[a:b] = np.isin(smallest[a:b], values[bounds[r] : bounds[r + 1]])
            keep &= smallest != 0
            at = np.flatnonzero(keep)
            left, right = (window_hashes(x, half) for x in (one, two))
            b = np.uint64(pow(BASES[1], half, 1 << 64))
            h1, h2 = (mix(x[at] * b + x[at + half]) for x in (left, right))
            r = pa.array(row[at] + low)
            place = (at - first[row[at]]).astype(np.int32)
            out = [batch.column(0).take(r), batch.column(1).take(r), _signed(h1), _signed(h2), pa.array(place)]
            yield pa.RecordBatch.from_arrays(out, names=["id", "mark", "h1", "h2", "place"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests, texts = [], [], []
        for r in range(batch.num_rows):
            words = (batch.column(2)[r].as_py() or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            starts = np.asarray(batch.column(3)[r].values) if batch.column(3)[r].is_valid else np.zeros(0, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            text = b" ".join([words[i] for i in kept.tolist()])
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(texts, pa.string())],
            names=["id", "mark", "n_removed", "kept_sha256", "kept_text"],
        )


def keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, mark, text) with a hash of the text beside the id, so that repeated ids with other texts stay apart."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(words).alias("mark"), words.alias("text")
    )


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For (id, mark, text) rows: one row per row with its words and digest, and the windows that repeat earlier ids'.

    Level one: half windows of ``window`` / 2 words, of which each window chooses the smallest hash inside it. Only
    halves found under two ids survive. Level two: only windows that chose a surviving half are extended to the whole
    length; of those the ones that start under a smaller id too survive. 128-bit hashes stand for whole windows.

    Rows of one id never count against each other. Texts that are the same words as a smaller id's are left out after
    level one: each of their windows repeats it. All groups are sums and minima, whatever a window's number of copies.
    """
    base = store(
        documents.mapInArrow(
            lambda batches: _level_one(batches, window),
            "id long, mark long, n_words long, sha256 string, halves array<long>",
        )
    )
    rows = base.filter(F.col("n_words") >= window)
    first = rows.groupBy("sha256").agg(F.min("id").alias("first_id"))
    unique = rows.join(first, "sha256").filter(F.col("id") == F.col("first_id"))
    halves = store(unique.select("id", "mark", F.explode(F.array_distinct("halves")).alias("half")))
    spread = halves.groupBy("half").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("half")
    repeated = halves.join(store(spread), "half", "left_semi")  # stored: a hot half's rows can then be split
    candidates = repeated.groupBy("id", "mark").agg(F.collect_set("half").alias("halves"))
    texts = documents.dropDuplicates(["id", "mark"]).join(candidates, ["id", "mark"]).select("id", "mark", "text", "halves")
    windows = store(
        texts.mapInArrow(
            lambda batches: _level_two(batches, window), "id long, mark long, h1 long, h2 long, place int"
        )
    )
    earliest = windows.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").drop("b")
    later = windows.join(store(earliest), ["h1", "h2"]).filter("id > a").select("id", "mark", "place")
    return base, later


def remove_repeated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text, without every word that a repeated window covers.

    A window is ``window`` consecutive words of one text; it is repeated if its words also start under a smaller
    doc_id. Windows are judged on the input. Null or empty texts have no words. Rows with a null doc_id count as later
    than all others and not against each other; rows with the same doc_id do not count against each other. Repeated
    rows stay repeated; other columns are not read. ``kept_text`` is null where it is just the words of the input.
    """
    named = keyed(documents, doc_id, text)
    base, later = repeated_windows(named, window)
    places = later.groupBy("id", "mark").agg(F.collect_list("place").alias("places"))
    touched = named.dropDuplicates(["id", "mark"]).join(places, ["id", "mark"]).select("id", "mark", "text", "places")
    cut = touched.mapInArrow(
        lambda batches: _cut(batches, window),
        "id long, mark long, n_removed long, kept_sha256 string, kept_text string",
    )
    long = base.filter(F.col("n_words") >= window)
    first = long.groupBy("sha256").agg(F.min("id").alias("first_id"))
    copies = long.join(first, "sha256").filter(F.col("id") > F.col("first_id")).select("id", "mark").distinct()
    nothing = F.sha2(F.lit(""), 256)
    gone = cut.unionByName(
        copies.select(
            "id", "mark", F.lit(-1).cast("long").alias("n_removed"), nothing.alias("kept_sha256"), F.lit("").alias("kept_text")
        )
    )
    out = base.drop("halves").join(gone, ["id", "mark"], "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_words",
        removed.cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        "kept_text",
    )
