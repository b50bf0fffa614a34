"""Byte-exact removal of repeated substrings over sorted suffixes that are compared by prefix hashes.

Not every suffix is sorted. Each window of ``window`` bytes stands behind an anchor, the leftmost smallest hash of the
grams inside it, so equal windows stand behind equal grams at equal places. Anchors of one text alone are dropped first.
Of the others the bytes around them go to the task of their gram. There the suffixes from the anchor on, and the
reversed bytes before it, are sorted by a mergesort that compares two of them by a binary search over prefix hashes for
their common extension. Windows are equal if both sides have enough bytes in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.blocks import BASES, mix, text_blocks, window_hashes
from stayline.session import store

WINDOW = 50
#: Bytes of a gram; windows whose gram is found in one text only are never sorted.
GRAM = 25
#: Bytes hashed at once, bytes of text in a block, and bytes of text for each slice of the grams.
CHUNK, BLOCK, SLICE = 1 << 17, 16_000_000, 8_000_000
#: A gram with more occurrences than this is split: each of its windows goes to a task by the window's own hash.
HOT = 20_000
#: The order of rows without an id: after all others.
LAST = (1 << 63) - 1

BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


def leftmost(values: np.ndarray, length: int) -> np.ndarray:
    """Position of the smallest of ``length`` neighbours from each place, the first of equal ones."""
    low, at, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < length:
        step = min(reach, length - reach)
        right = low[step:] < low[:-step]
        low = np.where(right, low[step:], low[:-step])
        at = np.where(right, at[step:], at[:-step])
        reach += step
    return at


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window start, last window start, anchor, gram hash) of the windows of all rows, in order.

    Neighbouring windows with one anchor are one entry. No window reaches from one row into the next.
    """
    found = []
    for begin in range(0, len(data) - window + 1, CHUNK):
        piece = data[begin : begin + CHUNK + window - 1]
        grams = mix(window_hashes(BYTE_CODES[piece], gram).copy())
        at = leftmost(grams, window - gram + 1)
        n = len(at)
        crossing = np.zeros(n + 1, np.int32)
        ends = offsets[(offsets > begin) & (offsets < begin + n + window)] - begin
        np.add.at(crossing, np.clip(ends - window + 1, 0, n), 1)
        np.add.at(crossing, np.minimum(ends, n), -1)
        whole = np.cumsum(crossing[:-1]) == 0
        new = whole.copy()
        new[1:] &= ~(whole[:-1] & (at[1:] == at[:-1]))
        last = whole.copy()
        last[:-1] &= ~(whole[1:] & (at[1:] == at[:-1]))
        low = np.flatnonzero(new)
        found.append((low + begin, np.flatnonzero(last) + begin, at[low].astype(np.int64) + begin, grams[at[low]]))
    if not found:
        return tuple(np.zeros(0, np.uint64 if k == 4 else np.int64) for k in range(5))
    low, high, at, grams = (np.concatenate(x) for x in zip(*found))
    return np.searchsorted(offsets, low, "right") - 1, low, high, at, grams


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(values))


ASKED = "slice long, marks array<long>, grams array<long>, known array<long>, told_marks array<long>, told array<long>"
ANSWERED = "bucket long, marks array<long>, grams array<long>"
REPEATED = "mark long, grams array<long>"


def _ask(batches: Iterator[pa.RecordBatch], window: int, gram: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The distinct grams of a block of texts by slice. Grams of two texts of the block are known to repeat: they go
    out once, and their texts are told by way of a slice of the text."""
    n_slices = np.uint64(slices)
    for batch in batches:
        every_mark = np.asarray(batch.column(0)).view(np.uint64)
        for low, high, data, offsets in text_blocks(batch.column(1), BLOCK):
            row, _, _, _, grams = anchors(data, offsets, window, gram)
            marks = every_mark[low:high][row]
            order = np.lexsort((marks, grams))
            marks, grams = marks[order], grams[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (marks[1:] != marks[:-1])
            marks, grams = marks[new], grams[new]
            twin = np.zeros(len(grams), bool)
            twin[1:] = grams[1:] == grams[:-1]
            known = np.unique(grams[twin])
            twin[:-1] |= twin[1:]
            parts = []
            for values, others, by in (
                (grams[~twin], marks[~twin], grams[~twin]), (known, known, known), (grams[twin], marks[twin], mix(marks[twin].copy()))
            ):
                part = by % n_slices
                order = np.lexsort((values, others, part))
                parts.append((values[order], others[order], np.searchsorted(part[order], np.arange(slices + 1, dtype=np.uint64))))
            out = [
                pa.array(np.arange(slices)), _lists(parts[0][1], parts[0][2]), _lists(parts[0][0], parts[0][2]),
                _lists(parts[1][0], parts[1][2]), _lists(parts[2][1], parts[2][2]), _lists(parts[2][0], parts[2][2]),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["slice", "marks", "grams", "known", "told_marks", "told"])


def _flat(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks().flatten() if table.num_rows else pa.array([], pa.int64())
    return np.asarray(values).view(np.uint64)


def _answer(table: pa.Table, buckets: int) -> pa.Table:
    """The grams of one slice that are found under two marks, and what other blocks told already, by bucket of the mark."""
    marks, grams, known = _flat(table, "marks"), _flat(table, "grams"), _flat(table, "known")
    order = np.argsort(grams, kind="stable")
    marks, grams = marks[order], grams[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    several = np.zeros(len(heads), bool)
    several[group[marks != marks[heads][group]]] = True
    several |= np.isin(grams[heads], known)
    kept = several[group]
    marks = np.concatenate([marks[kept], _flat(table, "told_marks")])
    grams = np.concatenate([grams[kept], _flat(table, "told")])
    bucket = mix(marks.copy()) % np.uint64(buckets)
    order = np.lexsort((marks, bucket))
    heads, bounds = _runs(bucket[order])
    return pa.table({"bucket": _signed(bucket[order][heads]), "marks": _lists(marks[order], bounds), "grams": _lists(grams[order], bounds)})


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equal values, and the same with the end."""
    heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return heads, np.append(heads, len(values))


def _by_mark(table: pa.Table) -> pa.Table:
    """One row per mark of a bucket with its repeated grams."""
    marks, grams = _flat(table, "marks"), _flat(table, "grams")
    order = np.argsort(marks, kind="stable")
    heads, bounds = _runs(marks[order])
    return pa.table({"mark": _signed(marks[order][heads]), "grams": _lists(grams[order], bounds)})


CONTEXTS = "id long, mark long, gram long, place long, context binary, start long, end long"


def _binary(data: np.ndarray, low: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> pa.Array:
    """For each entry one byte ``lead`` and then the bytes from ``low`` on."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.repeat(low - 1 - bounds[:-1], sizes + 1) + np.arange(bounds[-1])
    values = data[np.maximum(at, 0)]
    values[bounds[:-1]] = lead
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(low), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]
    ).cast(pa.binary())


def least_by(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest id among the entries of its code."""
    if not len(codes):
        return ids
    least = np.full(int(codes.max()) + 1, LAST)
    np.minimum.at(least, codes, ids)
    return least[codes]


def _settle(ids: np.ndarray, marks: np.ndarray, grams: np.ndarray, place: np.ndarray, contexts: pa.Array, reach: np.ndarray) -> pa.RecordBatch:
    """Rows for the task of the gram; an entry whose whole context a smaller id of the batch has is removed at once."""
    codes = np.asarray(contexts.dictionary_encode().indices)
    gone = ids > least_by(codes, ids)
    asked, told = np.flatnonzero(~gone), np.flatnonzero(gone)
    nothing = pa.nulls(len(told), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[asked], ids[told]])), pa.array(np.concatenate([marks[asked], marks[told]])),
            pa.concat_arrays([_signed(grams[asked]), nothing]), pa.concat_arrays([pa.array(place[asked]), nothing]),
            pa.concat_arrays([contexts.take(pa.array(asked)), pa.nulls(len(told), pa.binary())]),
            pa.concat_arrays([pa.nulls(len(asked), pa.int64()), pa.array(place[told])]),
            pa.concat_arrays([pa.nulls(len(asked), pa.int64()), pa.array((place + reach)[told])]),
        ],
        names=["id", "mark", "gram", "place", "context", "start", "end"],
    )


def _contexts(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every_id, every_mark = (np.asarray(batch.column(k)) for k in range(2))
        for low, high, data, offsets in text_blocks(batch.column(2), BLOCK):
            row, first, last, at, grams = anchors(data, offsets, window, gram)
            wanted = batch.column(3).slice(low, high - low)
            values = np.asarray(wanted.flatten()).view(np.uint64)
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(wanted)))])
            bounds = np.searchsorted(row, np.arange(high - low + 1))
            keep = np.zeros(len(row), bool)
            for r in range(high - low):
                a, b = bounds[r : r + 2]
                keep[a:b] = np.isin(grams[a:b], values[sizes[r] : sizes[r + 1]])
            row, first, last, at, grams = (x[keep] for x in (row, first, last, at, grams))
            reach = last - first + window
            contexts = _binary(data, first, reach, (at - first).astype(np.uint8))
            yield _settle(every_id[low:high][row], every_mark[low:high][row], grams, first - offsets[row], contexts, reach)


def _split(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Contexts of a hot gram as one row per window, under the window's own hash."""
    for batch in batches:
        contexts = batch.column(4).cast(pa.large_binary())
        for low, high, data, offsets in text_blocks(contexts.cast(pa.large_binary()).view(pa.large_string()), 1_000_000):
            ids, marks, place = (np.asarray(batch.column(k))[low:high] for k in (0, 1, 3))
            n = np.diff(offsets) - window
            row = np.repeat(np.arange(high - low), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[row] + 1 + nth
            hashes = mix(window_hashes(BYTE_CODES[data], window).copy())[start]
            size = np.full(len(row), window)
            windows = _binary(data, start, size, np.zeros(len(row), np.uint8))
            yield _settle(ids[row], marks[row], hashes, place[row] + nth, windows, size)


class Strings:
    """Byte strings that are compared by prefix hashes: two common prefixes in a binary search over their lengths."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, base: int):
        self.data, self.start, self.size = data, start, size
        inverse = pow(base, -1, 1 << 64)
        self.down = np.full(len(data) + 1, inverse, np.uint64)
        up = np.full(len(data) + 1, base, np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_CODES[data] * up[:-1], dtype=np.uint64)])
        self.steps = [1 << k for k in range(int(size.max(initial=0)).bit_length() - 1, -1, -1)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the strings numbered a and b."""
        i, j = self.start[a], self.start[b]
        most = np.minimum(self.size[a], self.size[b])
        one, two = self.sums[i], self.sums[j]
        shared = np.zeros(len(a), np.int64)
        for step in self.steps:
            longer = shared + step
            fits = longer <= most
            longer = np.where(fits, longer, 0)
            alike = (self.sums[i + longer] - one) * self.down[i] == (self.sums[j + longer] - two) * self.down[j]
            shared = np.where(fits & alike, longer, shared)
        return shared

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = self.common(a, b)
        one, two = (
            np.where(shared < self.size[x], self.data[np.minimum(self.start[x] + shared, len(self.data) - 1)].astype(np.int16), -1) for x in (a, b)
        )
        return one < two

    def truly_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same from the bytes themselves."""
        shared = np.zeros(len(a), np.int64)
        open_ = np.arange(len(a))
        most = np.minimum(self.size[a], self.size[b])
        while len(open_):
            x, s = open_, shared[open_]
            inside = s < most[x]
            x, s = x[inside], s[inside]
            x = x[self.data[self.start[a[x]] + s] == self.data[self.start[b[x]] + s]]
            shared[x] += 1
            open_ = x
        return shared


def merge_sort(strings: Strings, group: np.ndarray) -> np.ndarray:
    """The strings' numbers, by group and then by bytes; ``group`` is ascending. All runs of one width merge at once:
    a string's new place is its place in its run plus the number of smaller ones in the neighbouring run."""
    n = len(group)
    order = np.arange(n)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:n])
    sizes = np.diff(np.append(head, n))
    begin, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
    inner = np.arange(n) - begin
    width = 1
    active = np.flatnonzero(size > 1)
    while len(active):
        run = inner[active] // width
        other = begin[active] + (run ^ 1) * width
        stop = begin[active] + size[active]
        low = np.minimum(other, stop)
        high = np.minimum(other + width, stop)
        left, floor = run % 2 == 0, low.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            own, met = order[active[open_]], order[middle]
            lefts = left[open_]
            a, b = np.where(lefts, met, own), np.where(lefts, own, met)
            smaller = strings.less(a, b)
            further = np.where(lefts, smaller, ~smaller)  # equal ones of the left run come first
            low[open_[further]] = middle[further] + 1
            high[open_[~further]] = middle[~further]
            open_ = open_[low[open_] < high[open_]]
        to = begin[active] + (run & ~1) * width + inner[active] % width + (low - floor)
        moved = order[active]
        order[to] = moved
        width *= 2
        active = active[size[active] > width]
    return order


def common_classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups and each one's common prefix with the one before it (-1 at a group's
    start). Prefixes are compared byte by byte once sorted; if a hash misled, another base is taken."""
    for base in (*BASES, 0xDA942042E4DD58B5, 0x2545F4914F6CDD1D):
        strings = Strings(data, start, size, base)
        order = merge_sort(strings, group)
        shared = np.full(len(order), -1)
        inside = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        shared[inside] = strings.common(order[inside - 1], order[inside])
        if (shared[inside] == strings.truly_common(order[inside - 1], order[inside])).all():
            return order, shared
    raise RuntimeError("prefix hashes of four bases collided")


def repeated_in_contexts(grams: np.ndarray, ids: np.ndarray, contexts: pa.Array, window: int) -> np.ndarray:
    """A row of booleans per context: does its window with n bytes before the anchor also occur under a smaller id?

    A context is a byte with the place of the anchor and then the bytes of the windows behind that anchor.
    """
    order = np.argsort(grams, kind="stable")
    flat = contexts.take(pa.array(order)).cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[: offsets[-1]]
    ids, grams = ids[order], grams[order]
    begin, length = offsets[:-1] + 1, np.diff(offsets) - 1
    lead = data[offsets[:-1]].astype(np.int64)
    group = np.cumsum(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    right, right_shared = common_classes(data, begin + lead, length - lead, group)
    backwards = np.ascontiguousarray(data[::-1])
    left, left_shared = common_classes(backwards, len(data) - begin - lead, lead, group)
    out = np.zeros((len(grams), int(lead.max(initial=0)) + 1), bool)
    for before in range(out.shape[1]):
        has = np.flatnonzero((lead - (length - window) <= before) & (before <= lead))
        classes = []
        for order_, shared, least in ((right, right_shared, window - before), (left, left_shared, before)):
            number = np.empty(len(grams), np.int64)
            number[order_] = np.cumsum(shared < least)
            classes.append(number[has])
        _, codes = np.unique(classes[0] * (len(grams) + 1) + classes[1], return_inverse=True)
        out[has, before] = ids[has] > least_by(codes, ids[has])
    back = np.empty_like(out)
    back[order] = out
    return back


SPANS = "mark long, start long, end long"


def _match(table: pa.Table, window: int) -> pa.Table:
    """Spans of one slice of the grams. Equal contexts are one string; only those of the smallest id are looked up."""
    ids, marks, grams, place = (np.asarray(table.column(n).combine_chunks()) for n in ("id", "mark", "gram", "place"))
    contexts = table.column("context").combine_chunks()
    if isinstance(contexts, pa.ChunkedArray):
        contexts = contexts.chunk(0)
    codes = np.asarray(contexts.dictionary_encode().indices)
    gone = ids > least_by(codes, ids)
    sizes = np.asarray(pa.compute.binary_length(contexts)).astype(np.int64) - 1
    spans = [(marks[gone], place[gone], (place + sizes)[gone])]
    first = np.flatnonzero(~gone)
    _, one, back = np.unique(codes[first], return_index=True, return_inverse=True)
    chosen = first[one]
    repeated = repeated_in_contexts(grams[chosen].view(np.uint64), ids[chosen], contexts.take(pa.array(chosen)), window)[back]
    raw = contexts.take(pa.array(first)).cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    lead = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[:-1]].astype(np.int64)
    # runs of windows: fewer bytes before the anchor is a later start
    padded = np.zeros((len(first), repeated.shape[1] + 2), np.int8)
    padded[:, 1:-1] = repeated
    steps = np.diff(padded, axis=1)
    row, least = np.nonzero(steps == 1)
    _, above = np.nonzero(steps == -1)
    base = place[first][row] + lead[row]
    spans.append((marks[first][row], base - (above - 1), base - least + window))
    mark, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*spans))
    return pa.table({"mark": pa.array(mark), "start": pa.array(start), "end": pa.array(end)})


CUT = "mark long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            raw = np.frombuffer(batch.column(1)[r].as_py().encode(), np.uint8)
            steps = np.zeros(len(raw) + 1, np.int32)
            for name, sign in (("start", 1), ("end", -1)):
                np.add.at(steps, np.asarray(batch.column(2)[r].values.field(name)), sign)
            gone = np.cumsum(steps[:-1]) > 0
            kept = raw[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["mark", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_spans(named: DataFrame, texts: DataFrame, n_bytes: int, window: int, gram: int) -> DataFrame:
    """(mark, spans) of texts with bytes that a repeated window covers. ``named`` has (id, mark, text), ``texts`` the
    (id, mark) of one row per different text."""
    slices = max(1, -(-n_bytes // SLICE))
    asked = named.select("mark", "text").mapInArrow(lambda batches: _ask(batches, window, gram, slices), ASKED)
    answered = asked.groupBy("slice").applyInArrow(lambda table: _answer(table, slices), ANSWERED)
    wanted = answered.groupBy("bucket").applyInArrow(_by_mark, REPEATED).join(texts, "mark")
    held = named.join(wanted, ["id", "mark"]).select("id", "mark", "text", "grams")
    contexts = store(held.mapInArrow(lambda batches: _contexts(batches, window, gram), CONTEXTS))
    open_ = contexts.filter("gram IS NOT NULL")
    hot = store(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("gram"))
    cold = open_.join(hot, "gram", "left_anti").select(*contexts.columns)
    single = open_.join(hot, "gram", "left_semi").select(*contexts.columns)
    windows = store(single.mapInArrow(lambda batches: _split(batches, window), CONTEXTS))
    rows = cold.unionByName(windows.filter("gram IS NOT NULL")).drop("start", "end")
    by_slice = rows.withColumn("slice", F.pmod("gram", F.lit(slices))).groupBy("slice")
    matched = by_slice.applyInArrow(lambda table: _match(table, window), SPANS)
    told = contexts.unionByName(windows).filter("gram IS NULL").select("mark", "start", "end")
    return matched.unionByName(told).groupBy("mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeated_bytes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, without the bytes of repeated windows.

    A window is ``window`` consecutive bytes of one text in UTF-8; it is repeated if its bytes also start in a row with
    a smaller doc_id. Windows are judged on the input. ``n_spans`` counts maximal removed runs; ``kept`` are the
    remaining bytes, null where nothing is removed.

    Null texts are empty. Rows with a null doc_id (and with the largest long) come after all others; rows of one doc_id
    do not count against each other. Rows with the text of a smaller doc_id lose all of it if it holds a window, so
    only one row per text is looked at. Repeated rows stay repeated, other columns are not read, an empty table gives no
    rows. Grams sent to a slice are distinct per block of texts, and grams with over HOT occurrences are split by window,
    so that no group grows with the number of texts that share a passage. Very long texts are hashed in chunks.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ordered = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id")
    named = documents.select(ordered, F.xxhash64(whole).alias("mark"), whole.alias("text"))
    base = store(
        documents.select(
            F.col(doc_id).alias("doc_id"), ordered, F.xxhash64(whole).alias("mark"),
            F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha256"),
        )
    )
    long = base.filter(F.col("n_bytes") >= window)
    firsts = store(long.groupBy("sha256", "mark").agg(F.min("id").alias("first_id"), F.min("n_bytes").alias("n_bytes")))
    n_bytes = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    spans = repeated_spans(named, firsts.select("mark", F.col("first_id").alias("id")), n_bytes, window, gram)
    touched = named.join(spans.join(firsts.select("mark", F.col("first_id").alias("id")), "mark"), ["id", "mark"])
    cut = touched.dropDuplicates(["id", "mark"]).select("mark", "text", "spans").mapInArrow(_cut, CUT)
    known = firsts.select("sha256", "first_id", "mark").join(cut, "mark", "left").drop("mark")
    copy = F.col("id") > F.col("first_id")
    nothing = F.lit("").cast("binary")
    return base.join(known, "sha256", "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(nothing, 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, nothing).otherwise(F.col("kept")).alias("kept"),
    )
