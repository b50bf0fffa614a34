"""Benchmark decontamination: exact hits of pieces, verified by bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.session import store

#: Edits allowed per character of an item, and the shortest piece; an item has as many edits as both allow.
ERROR_RATE = 0.1
MIN_PIECE = 12
#: Items with fewer characters are too common to tell anything and are not searched.
MIN_ITEM = 24
#: Characters of items that are searched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 1_000_000

TOKEN = re.compile(r"\S+")


def normalise(text: str) -> str:
    """Lower case, with white space as single spaces."""
    return " ".join(text.lower().split())


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where a span of ``normalise(text)`` stands in ``text``: from the word it starts in to the word it ends in."""
    at, low, high = 0, None, None
    for m in TOKEN.finditer(text):
        size = len(" ".join(m.group().lower().split()))
        if low is None and start < at + size:
            same = size == m.end() - m.start()
            low = m.start() + (max(0, start - at) if same else 0)
        if at < end:
            high = m.start() + end - at if end - at < size and size == m.end() - m.start() else m.end()
        elif low is not None:
            break
        at += size + 1
    return low or 0, high or 0


def budget(length: int, rate: float = ERROR_RATE, piece: int = MIN_PIECE) -> int:
    """Edits allowed for an item of so many characters."""
    return max(0, min(int(length * rate), length // piece - 1))


def split_item(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their places: one of them survives that many edits."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, equal: dict[str, int], text: str) -> tuple[int, int]:
    """(distance, end) of the best match of ``pattern`` anywhere in ``text``, the first of equally good ends.

    Myers' bit-parallel column update: one addition and a few bit operations for each character of the text.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text):
        eq = equal.get(c, 0)
        vertical = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


class Searcher:
    """A bounded block of items, ready to be searched."""

    def __init__(self, items: list[tuple[int, str]], rate: float, piece: int) -> None:
        self.items = [(i, text, budget(len(text), rate, piece)) for i, text in items]
        self.tables: dict[int, tuple[dict, dict]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors) in enumerate(self.items):
            for at, part in split_item(text, errors):
                pieces.setdefault(part, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for part, places in pieces.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def table(self, k: int) -> tuple[dict, dict]:
        if k not in self.tables:
            self.tables[k] = masks(self.items[k][1]), masks(self.items[k][1][::-1])
        return self.tables[k]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best match in the normalised text, within its budget.

        Hits of one item whose windows overlap are one window; windows are verified in order of their start.
        """
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, at in places:
                _, item, errors = self.items[k]
                start = last + 1 - size - at
                low, high = max(0, start - errors), start + len(item) + errors
                held = windows.setdefault(k, [])
                if held and low <= held[-1][1] and high - held[-1][0] < 4 * len(item):
                    held[-1][0], held[-1][1] = min(held[-1][0], low), max(held[-1][1], high)
                else:
                    held.append([low, high])
        out = []
        for k, held in windows.items():
            name, item, errors = self.items[k]
            best = None
            for low, high in sorted(held):
                part = text[low:high]
                exact = part.find(item)
                if exact >= 0:
                    best = (0, low + exact, low + exact + len(item))
                    break
                ahead, back = self.table(k)
                distance, end = myers(item, ahead, part)
                if distance <= errors and (best is None or distance < best[0]):
                    _, size = myers(item[::-1], back, part[:end][::-1])
                    best = (distance, low + end - size, low + end)
            if best:
                out.append((name, *best))
        return sorted(out)


@lru_cache(maxsize=2)
def _searcher(items: tuple[tuple[int, str], ...], rate: float, piece: int) -> Searcher:
    return Searcher(list(items), rate, piece)


def _find(batches: Iterator[pa.RecordBatch], items: tuple, rate: float, piece: int) -> Iterator[pa.RecordBatch]:
    searcher = _searcher(items, rate, piece)
    for batch in batches:
        rows, found = [], []
        for r, text in enumerate(batch.column(batch.num_columns - 1)):
            text = text.as_py()
            if text:
                for item, distance, start, end in searcher.search(normalise(text)):
                    rows.append(r)
                    found.append((item, distance, *original_span(text, start, end)))
        columns = zip(*found) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]), *(pa.array(c, pa.int64()) for c in columns)],
            names=[*batch.schema.names[:-1], "item_id", "distance", "span_start", "span_end"],
        )


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple]:
    """The distinct normalised items in blocks of about ``limit`` characters, read one after the other."""
    chosen = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    held, size = [], 0
    for row in chosen.filter("i IS NOT NULL AND t IS NOT NULL").distinct().sort("i", "t").toLocalIterator():
        item = normalise(row.t)
        if len(item) < MIN_ITEM:
            continue
        held.append((row.i, item))
        size += len(item)
        if size >= limit:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def find_items(
    documents: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id",
    item_text: str = "text", rate: float = ERROR_RATE, piece: int = MIN_PIECE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``keys``, item_id, distance and span of every benchmark item found in a document, its best match once.

    Texts are compared in lower case with white space as single spaces. An item of n characters may differ by
    ``budget(n)`` edits. It is cut into one piece more than that, so at least one piece stands unchanged in any such
    copy; where a piece is found, the place around it is verified. Spans are code points of the document's text.

    The benchmark goes to the tasks in blocks of bounded size, one narrow pass over the documents for each: no shuffle
    and no pairs. Null texts and ids, and items of less than MIN_ITEM characters, are not searched for; repeated rows
    give repeated results; an empty table gives no rows. Two items of one id are both searched for.
    """
    chosen = documents.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text")
    )
    names = ("item_id", "distance", "span_start", "span_end")
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])
    out = None
    for items in item_blocks(benchmark, item_id, item_text, block_chars):
        held = documents.sparkSession.sparkContext.broadcast(items)
        part = chosen.mapInArrow(lambda batches, held=held: _find(batches, held.value, rate, piece), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(keys)})


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows in whose text no benchmark item is found, with all their columns."""
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    named = documents.select(F.col(doc_id).alias("id"), mark.alias("mark"), F.col(text).alias("text"))
    found = store(find_items(named, benchmark, ["id", "mark"]).select("id", "mark").distinct())
    joined = documents.withColumn("_mark", mark).alias("d").join(
        found.alias("f"), F.col(f"d.{doc_id}").eqNullSafe(F.col("f.id")) & (F.col("d._mark") == F.col("f.mark")), "left_anti"
    )
    return joined.drop("_mark")
