"""Toxicity by a learned, weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the weights of its score are learned from, at most.
SAMPLE_ROWS = 12_000
#: Entries: toxic texts with it at least, share of toxic texts among those with it, and letters of a stem.
SUPPORT, PURITY, STEM = 4, 0.9, (4, 7)
#: Entries of the lexicon at most, the ones in most toxic texts first.
ENTRIES = 5_000
THRESHOLD = 0.7

# Characters that look like, or are typed for, a Latin letter.
HOMOGLYPHS = str.maketrans(
    {
        **dict(zip("абвгеёіїјкмнорсстухѕԁһӏԛԝүА", "abbreeiijkmhopcctyxsdhlqwya")),
        **dict(zip("αβγεικνορτυχωϲ", "abyeiKvoptuxwc".lower())),
        **dict(zip("0134578@$!|€", "oieastbasile")),
        **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
        "​": None, "‌": None, "‍": None, "⁠": None, "­": None, "﻿": None,
    }
)
APART = re.compile(r"[\W_]+")
#: Phrases in which an entry is harmless, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "white trash bag", "pond scum")


def fold(text: str) -> str:
    """Words in lower case between single spaces, look-alike characters and digits as the letters they stand for.

    A closing exclamation mark is punctuation, one inside a word an i.
    """
    text = re.sub(r"!+(?=\s|$|[\"')])", " ", text.lower())
    return f" {APART.sub(' ', text.translate(HOMOGLYPHS)).strip()} "


def entries(folded: str) -> set[str]:
    """The text's words, as ' word ', and the stems of its longer words, as ' stem'."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
            out.add(f" {word[:n]}")
    return out


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1)):
            seen[toxic.as_py()].update(entries(fold(text.as_py() or "")))
        names = list(seen[0].keys() | seen[1].keys())
        counts = [pa.array([s[n] for n in names], pa.int64()) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["entry", "clean", "toxic"])


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Entries and weights from (text, toxic) rows: the log odds of a toxic text among the texts with the entry.

    An entry stands in SUPPORT toxic texts or more, and PURITY of the texts that it stands in are toxic. A stem
    replaces the longer entries that begin with it.
    """
    totals = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic:
        return {}
    counted = labelled.mapInArrow(_count_entries, "entry string, clean long, toxic long")
    summed = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    pure = summed.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
    rows = pure.orderBy(F.desc("toxic"), "entry").limit(ENTRIES).collect()
    stems = {r["entry"] for r in rows if not r["entry"].endswith(" ")}
    out = {}
    for r in rows:
        entry = r["entry"]
        word = entry.rstrip(" ")
        if any(word[:n] in stems for n in range(STEM[0] + 1, len(word) + (entry != word))):
            continue
        out[entry] = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))
    return {k: v for k, v in out.items() if v > 0}


@lru_cache(maxsize=4)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    out = ahocorasick.Automaton()
    for entry, weight in lexicon:
        out.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        if len(folded := fold(phrase)) > 2:
            out.add_word(folded, (len(folded), None))
    if len(out):
        out.make_automaton()
    return out


def hits(folded: str, lexicon: tuple, exceptions: tuple) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries found outside exception phrases, at most one for each word."""
    automaton = _automaton(lexicon, exceptions)
    if not len(automaton):
        return []
    found: dict[int, tuple[int, float]] = {}
    harmless: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(folded):
        start = last + 1 - size
        if weight is None:
            harmless.append((start, last + 1))
        elif start not in found or weight > found[start][1]:
            found[start] = (last + 1, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s < b - 1 for a, b in harmless)]


def features(text: str, lexicon: tuple, exceptions: tuple) -> tuple[float, float]:
    """Matched weight, and matched weight for each hundred words, both on a log scale."""
    folded = fold(text)
    total = sum(w for _, _, w in hits(folded, lexicon, exceptions))
    words = folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


def _around(batches: Iterator[pa.RecordBatch], lexicon: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0), batch.column(1)):
            folded = fold(text.as_py() or "")
            phrases = set()
            for start, end, _ in hits(folded, lexicon, ()):
                stop = folded.find(" ", start + 1)
                after = folded.find(" ", stop + 1)
                before = folded.rfind(" ", 0, start) if start else -1
                if after > 0:
                    phrases.add(folded[start:after].strip())
                if before >= 0:
                    phrases.add(folded[before:stop].strip())
            seen[toxic.as_py()].update(phrases)
        names = list(seen[0].keys())  # phrases of toxic texts alone are no exceptions
        counts = [pa.array([s[n] for n in names], pa.int64()) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["entry", "clean", "toxic"])


def learn_exceptions(labelled: DataFrame, lexicon: tuple) -> tuple[str, ...]:
    """Two-word phrases around an entry that stand in two clean texts or more, and in more clean texts than toxic."""
    counted = labelled.mapInArrow(lambda batches: _around(batches, lexicon), "entry string, clean long, toxic long")
    summed = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = summed.filter("clean >= 2 AND clean > toxic").orderBy(F.desc("clean"), "entry").limit(ENTRIES).collect()
    return tuple(r["entry"] for r in rows)


def _features(batches: Iterator[pa.RecordBatch], lexicon: tuple, exceptions: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py() or "", lexicon, exceptions) for t in batch.column(0)]
        a, b = zip(*rows) if rows else ([], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column(1)], names=["a", "b", "toxic"]
        )


def fit(a: np.ndarray, b: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic weights of the two features, by Newton steps until they stand still; both weights are 0 or more."""
    x, y = np.column_stack([np.ones(len(a)), a, b]), toxic.astype(float)
    w = np.zeros(3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.diag([1e-3, ridge, ridge])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


class Model:
    """A learned lexicon, its exception phrases and the weights of the score."""

    def __init__(self, lexicon: tuple, exceptions: tuple, weights: tuple[float, float, float]) -> None:
        self.lexicon, self.exceptions, self.weights = lexicon, exceptions, weights

    def score(self, text: str | None) -> float:
        a, b = features(text or "", self.lexicon, self.exceptions)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    At most ``rows`` labelled documents are used, those with the smallest hash of doc_id; of several labels of one
    document the largest counts. Without toxic texts among them every score is low.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").persist()
    try:
        lexicon = tuple(sorted(learn_lexicon(labelled).items()))
        exceptions = (*EXCEPTIONS, *learn_exceptions(labelled, lexicon))
        found = labelled.mapInArrow(lambda x: _features(x, lexicon, exceptions), "a double, b double, toxic int").collect()
    finally:
        labelled.unpersist()
    a, b, y = (np.array([r[i] for r in found], float) for i in range(3))
    return Model(lexicon, exceptions, fit(a, b, y) if len(found) else (-4.0, 1.0, 1.0))


def score_documents(documents: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and score of every row from its whole text alone; null texts count as empty. Narrow: no shuffle."""
    chosen = documents.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(rate, f"{kinds}score double").withColumnsRenamed({f"key_{i}": k for i, k in enumerate(keys)})
