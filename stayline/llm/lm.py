"""Cross-entropy difference of a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.blocks import BASES, hash_words, mix, split_words, text_blocks
from stayline.llm.substrings import keyed

#: Pseudo-count of every word after every word.
SMOOTHING = 0.01
#: Bytes of text in a block on average, and keys of the model in a slice.
BLOCK_TEXT, SLICE_KEYS = 12_000_000, 1_000_000
START = np.uint64(0x243F6A8885A308D3)


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word's pair with the word before it, and the key of that word before it as a context."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    firsts = first[:-1]
    before[firsts[firsts < len(words)]] = START
    context = mix(before + np.uint64(1))
    return mix(words * np.uint64(BASES[1]) + context), context


def _documents(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for low, high, data, offsets in text_blocks(table.column("text")):
        starts, ends, first = split_words(data, offsets)
        pairs, contexts = grams(hash_words(data, starts, ends), first)
        yield low, high, first, pairs, contexts


def squeeze(values: np.ndarray) -> bytes:
    """Numbers compressed byte plane by byte plane: small ones and ascending keys' differences take little room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def widen(packed: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` numbers that ``squeeze`` was given."""
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(packed, n * width, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _keys(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per row; then for all words: the row, and the keys of its pair (even) and of its context (odd)."""
    sizes, rows, pairs, contexts = ([np.zeros(0, t)] for t in (np.int64, np.int32, np.uint64, np.uint64))
    for low, high, first, two, one in _documents(docs):
        sizes.append(np.diff(first))
        rows.append(np.repeat(np.arange(low, high, dtype=np.int32), np.diff(first)))
        pairs.append(two & ~np.uint64(1))
        contexts.append(one | np.uint64(1))
    pairs = np.concatenate(pairs)
    keys, at = np.unique(np.concatenate([pairs, *contexts]), return_inverse=True)
    return np.concatenate(sizes), np.concatenate(rows), keys, at[: len(pairs)].astype(np.int32), at[len(pairs) :].astype(np.int32)


def _counts(block: int, docs: pa.Table, target: pa.Table, slices: int) -> pa.Table:
    """A block's distinct keys with their counts in the target and in all texts, packed by slice of the key space."""
    _, row, keys, pair, context = _keys(docs)
    wanted = np.isin(docs.column("id").to_numpy(), target.column("held").to_numpy()) if docs.num_rows else np.zeros(0, bool)
    inside = wanted[row]
    total = np.bincount(pair, minlength=len(keys)) + np.bincount(context, minlength=len(keys))
    part = np.bincount(pair[inside], minlength=len(keys)) + np.bincount(context[inside], minlength=len(keys))
    cuts = np.append(np.searchsorted(keys, slice_starts(slices)), len(keys))
    rows = [
        (block, s, int(b - a), squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(part[a:b].astype("<u4")), squeeze(total[a:b].astype("<u4")))
        for s, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if b > a
    ]
    columns = zip(*rows) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["block", "slice", "n", "keys", "part", "total"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def slice_starts(slices: int) -> np.ndarray:
    """First key of each slice of the key space."""
    return np.array([(i << 64) // slices for i in range(slices)], np.uint64)


def _answer(table: pa.Table) -> pa.Table:
    """For every block's keys of one slice, in their order: the counts in the target and in all texts of all blocks."""
    sizes = table.column("n").to_pylist()
    keys = [np.cumsum(widen(x.as_py(), n, "<u8"), dtype=np.uint64) for x, n in zip(table.column("keys"), sizes)]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = []
    ends = np.cumsum(sizes)
    for name in ("part", "total"):
        counts = np.concatenate([widen(x.as_py(), n, "<u4") for x, n in zip(table.column(name), sizes)])
        summed = np.bincount(at, counts, len(every)).astype("<u8")
        out.append([squeeze(summed[at[e - n : e]]) for e, n in zip(ends, sizes)])
    return pa.Table.from_arrays(
        [table.column("block"), table.column("slice"), table.column("n"), *(pa.array(x, pa.binary()) for x in out)],
        names=["block", "slice", "n", "part", "total"],
    )


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_blocks(batch.column(0)):
            starts, ends, _ = split_words(data, offsets)
            words = np.unique(hash_words(data, starts, ends))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64))], names=["word"])


def _score(docs: pa.Table, answers: pa.Table, smoothing: float, vocabulary: int) -> pa.Table:
    """Per row: number of words and mean loss under both models, from the block's answers."""
    size, row, keys, pair, context = _keys(docs)
    answers = answers.sort_by("slice")
    n = answers.column("n").to_pylist()
    mean = []
    for name in ("part", "total"):
        counts = np.concatenate([widen(x.as_py(), k, "<u8") for x, k in zip(answers.column(name), n)] or [np.zeros(0)])
        logs = np.log(counts + np.where(keys & np.uint64(1), smoothing * vocabulary, smoothing))
        loss = np.bincount(row, logs[context] - logs[pair], docs.num_rows)
        mean.append(loss / np.maximum(size, 1))
    return pa.Table.from_arrays(
        [docs.column("id"), docs.column("mark"), pa.array(size), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])],
        names=["id", "mark", "n_words", "target_loss", "background_loss", "score"],
    )


def score_difference(
    documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_id: str = "doc_id",
    smoothing: float = SMOOTHING, block_text: int = BLOCK_TEXT, slice_keys: int = SLICE_KEYS,
) -> DataFrame:
    """Per row: doc_id, n_words, target_loss, background_loss and score, their difference, in nats per word.

    Both models are bigram models over words (runs of other than ASCII white space) with one vocabulary, all words of
    ``documents`` (their number is a sketch's, within about one percent, and the same for both); every text begins after a start mark. P(w | v) = (n(v, w) + a) / (n(v) + a * vocabulary), with a =
    ``smoothing``. The background model counts all documents, the target model those whose id is in ``target``. A low
    score is a text that looks more like the target than like everything.

    Counts cover all texts. The texts are dealt into blocks; each block sends one row of its distinct keys for every
    slice of the key space, a slice adds up all blocks' counts and answers each block, and the block scores its texts.
    So a key has one entry per block however often it occurs, and neither blocks nor slices grow with the input.
    Equal rows share a block's place. A null or empty text has no words and losses of 0; a null id is in no target;
    repeated rows stay repeated; other columns are not read; an empty table gives no rows.
    """
    named = keyed(documents, doc_id, text)
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    words = named.select("text").mapInArrow(_distinct_words, "word long")
    vocabulary = words.agg(F.approx_count_distinct("word", 0.01)).first()[0]
    blocks = max(1, -(-int(chars) // block_text))
    slices = max(1, -(-int(chars) // (12 * slice_keys)))
    place = F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).alias("block")
    dealt = named.select(place, "id", "mark", "text").repartition(blocks, "block")
    ids = target.select(F.col(target_id).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    # a target id cannot know its row's text: it goes to every block that holds the id
    held = named.select(F.col("id").alias("held"), place).join(ids, F.col("held") == F.col("id"), "left_semi").distinct()
    held = held.select(F.col("block").alias("at"), F.col("held"))
    counts = (
        dealt.groupBy("block").cogroup(held.repartition(blocks, "at").groupBy("at"))
        .applyInArrow(
            lambda key, left, right: _counts(key[0].as_py(), left, right, slices),
            "block long, slice long, n long, keys binary, part binary, total binary",
        )
    )
    answers = counts.groupBy("slice").applyInArrow(
        _answer, "block long, slice long, n long, part binary, total binary"
    )
    scored = (
        dealt.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block"))
        .applyInArrow(
            lambda left, right: _score(left, right, smoothing, vocabulary),
            "id long, mark long, n_words long, target_loss double, background_loss double, score double",
        )
    )
    return scored.select(F.nullif("id", F.lit((1 << 63) - 1)).alias("doc_id"), "n_words", "target_loss", "background_loss", "score")
