"""Periodic runs of words: suffix classes united by falling common prefix, neighbours at a small distance seed runs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.blocks import hash_words, mix, split_words, text_blocks, window_hashes

#: A run has at least MIN_WORDS words and at least MIN_PERIODS periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of texts whose suffixes are sorted together; a longer text is sorted by itself.
SORTED_WORDS = 400_000

RUN = "struct<start:long,length:long,period:long>"


def shared_prefixes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, next position, words in common) of neighbours in the sorted suffixes of each text.

    ``words`` numbers the words so that equal numbers are equal words of one text. Prefixes are doubled; only
    suffixes that still tie are sorted again. The ranks of all rounds then give the common prefixes bit by bit.
    """
    n = len(words)
    end = np.repeat(first[1:], np.diff(first))
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    levels, reach = [rank], 1
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        at = tied + reach
        second = np.where(at < end[tied], rank[np.minimum(at, n - 1)], 0)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        old = rank[tied]
        head = np.ones(len(tied), bool)
        head[1:] = old[1:] != old[:-1]
        new = head.copy()
        new[1:] |= second[1:] != second[:-1]
        place = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - group
        levels.append(rank)
        tied = tied[~(new & np.append(new[1:], True))]
        reach *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank - 1] = np.arange(n)
    one, two = suffixes[:-1], suffixes[1:]
    same = end[one] == end[two]
    one, two = one[same], two[same]
    common, last = np.zeros(len(one), np.int64), end[one]
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + common, two + common
        inside = np.maximum(a, b) < last
        alike = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common[alike] += 1 << k
    return one, two, common


def united_runs(words: list, one: np.ndarray, two: np.ndarray, common: np.ndarray, starts: set) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the texts behind neighbouring suffixes.

    Edges between neighbours are taken by falling common prefix and unite the classes of their ends, each an ordered
    list of positions; the shorter list goes into the longer. Positions i < j that come next to each other at common
    prefix l have exactly l words in common. If j - i is small against l, words i to j + l repeat with period j - i,
    and no smaller period can hold, for then a position between them would be in the class already. Every run of
    smallest period q and length m meets as its start s and s + q, at l = m - q; others are no left ends.
    """
    least = MIN_WORDS - 1
    wanted = np.flatnonzero(common >= least)
    wanted = wanted[np.argsort(-common[wanted], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []
    for i, j, shared in zip(one[wanted].tolist(), two[wanted].tolist(), common[wanted].tolist()):
        roots = []
        for x in (i, j):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                x, parent[x] = parent[x], root
            roots.append(root)
        big, small = (members.pop(r, None) or [r] for r in roots)
        a, b = roots
        if len(big) < len(small):
            big, small, a, b = small, big, b, a
        parent[b] = a
        members[a] = big
        before, farthest = -1, shared // (MIN_PERIODS - 1)
        for k, x in enumerate(small):
            at = bisect_left(big, x)
            if at and big[at - 1] != before and x - big[at - 1] <= farthest:
                found.append((big[at - 1], x, shared))
            if at < len(big) and big[at] - x <= farthest and (k + 1 == len(small) or small[k + 1] > big[at]):
                found.append((x, big[at], shared))
            big.insert(at, x)
            before = x
    return [
        (i, shared + j - i, j - i)
        for i, j, shared in found
        if shared + j - i >= MIN_WORDS and (i in starts or words[i - 1] != words[j - 1])
    ]


def repeated_texts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows that may hold a run: some MIN_WORDS - 1 words of theirs occur twice in them."""
    size = MIN_WORDS - 1
    if len(words) < size:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(words) - size + 1]
    whole = np.arange(len(row)) + size <= first[row + 1]
    keys = mix(window_hashes(words, size)[whole] + mix(row[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    twice = keys[order[1:]] == keys[order[:-1]]
    return np.unique(row[whole][order[1:][twice]])


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words, by start and then period."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    flat: list[int] = []
    for t in texts:
        numbers: dict[bytes, int] = {}
        base = len(flat)
        flat.extend([base + numbers.setdefault(w, len(numbers)) for w in t])
    found = united_runs(flat, *shared_prefixes(np.array(flat, np.int64), first), set(first.tolist())) if flat else []
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.array([r[0] for r in found], np.int64)
    for row, run in zip((np.searchsorted(first, starts, "right") - 1).tolist(), found):
        out[row].append((run[0] - int(first[row]), run[1], run[2]))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _find(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for low, high, data, offsets in text_blocks(batch.column(n_keys)):
            starts, ends, first = split_words(data, offsets)
            raw = data.tobytes()
            texts = {}
            waiting: list[int] = []
            held = 0

            def settle() -> None:
                words = [raw[offsets[r] : offsets[r + 1]].split() for r in waiting]
                for r, w, runs in zip(waiting, words, runs_of_texts(words)):
                    if runs:
                        texts[r] = (runs, b" ".join(collapse(w, runs)))
                waiting.clear()

            for r in repeated_texts(hash_words(data, starts, ends), first).tolist():
                waiting.append(r)
                held += int(first[r + 1] - first[r])
                if held >= SORTED_WORDS:
                    settle()
                    held = 0
            settle()
            runs = [[dict(zip(("start", "length", "period"), x)) for x in texts[r][0]] if r in texts else [] for r in range(high - low)]
            plain = (texts[r][1] if r in texts else b" ".join(raw[offsets[r] : offsets[r + 1]].split()) for r in range(high - low))
            out = [c.slice(low, high - low) for c in batch.columns[:n_keys]]
            out += [pa.array(np.diff(first)), pa.array(runs, kind), pa.array([p.decode() for p in plain], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:n_keys], "n_words", "runs", "collapsed"])


def find_runs(documents: DataFrame, keys: list[str], text: str | Column = "text") -> DataFrame:
    """Per row: the key columns, n_words, runs (start, length, period) and collapsed, the text without its repetitions.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch with smallest
    period q of at least six words and four periods that no neighbouring word extends; ``runs`` is ordered by start,
    then period. ``collapsed`` joins the words that no run holds after its first q words by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one: keys may be
    null, repeated rows stay repeated, an empty table gives no rows, and columns other than the keys are not read.
    A task holds one text at a time, or SORTED_WORDS words of shorter ones.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    whole = F.col(text) if isinstance(text, str) else text
    named = documents.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], whole.cast("string").alias("text"))
    kinds = ", ".join(f"{n} {named.schema[n].dataType.simpleString()}" for n in names)
    found = named.mapInArrow(lambda batches: _find(batches, len(names)), f"{kinds}, n_words long, runs array<{RUN}>, collapsed string")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_words", "runs", "collapsed")


def repeat_tails(text: Column, doc_id: Column) -> Column:
    """The text, for one id in ten with its tail replaced by repetitions of the tail's start; a null id changes nothing.

    With h the crc32 of the decimal id and g = h / 10: if h % 10 = 0, each word from a = g % n on becomes word
    a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p)))), " ")

    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    # the words are bound once, by a transform over a list of one
    once = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(F.lit(""))), 0)
    return F.when(h % 10 == 0, once).otherwise(text)
