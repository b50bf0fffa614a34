"""Tokens of whole texts, and best-fit packing of the pieces under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.blocks import released, text_blocks
from stayline.session import store

MAX_TOKENS = 4096
END_ID = 1
#: Tokens that one packing task takes on average: about 2,000 sequences, of which the last few are not full.
GROUP_TOKENS = 8_000_000
#: Weights of the three capacities in the residual norm.
WEIGHTS = (1.0, 0.01, 0.01)
BLOCK = 4_000_000
#: Parts of words whose ids a worker keeps, and a character that parts words where many are encoded at once.
KNOWN_WORDS = 500_000
MARK = "\x01"
#: Words given to the tokenizer at once; what it returns for a word takes far more memory than the ids.
ENCODED_WORDS = 20_000
#: Kinds of bytes; LATIN leads the two bytes of the letters from U+00C0 to U+00FF.
LETTER, DIGIT, SYMBOL, LATIN = 1, 2, 3, 0xC3
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = [DIGIT if chr(c).isdigit() else LETTER if chr(c).isalpha() else SYMBOL for c in range(0x21, 0x7F)]
KINDS[LATIN] = LETTER
LOWERED = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _kinds(data: np.ndarray) -> np.ndarray:
    """LETTER, DIGIT or SYMBOL for every byte of an ASCII or Latin-1 letter, a digit or a printable ASCII symbol; else 0."""
    kinds = KINDS[data]
    after = np.flatnonzero(data == LATIN) + 1
    kinds[after] = np.where((data[after] == 0x97) | (data[after] == 0xB7), 0, LETTER)  # two signs among the letters
    return kinds


def split_tails(words: pa.LargeStringArray, whole: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(parts, single, places): each word without the symbols at its end, lowered, and these symbols.

    ``places`` has the two parts of every word; the second is -1 in a word without a tail. Symbols are cut off behind an
    ASCII or Latin-1 letter or a digit only. ASCII letters are lowered in words of printable ASCII and Latin-1 letters:
    composing characters changes nothing there. Words marked in ``whole`` stay as they are. ``single`` tells the parts
    that are letters or symbols throughout.
    """
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    held = words.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    kinds, sizes, at = _kinds(data), ends - begins, np.arange(len(data))

    def share(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        return total[ends] - total[begins]

    data = np.where(np.repeat((share(0) == 0) & ~whole, sizes), LOWERED[data], data)
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(kinds != SYMBOL, at, -1))])[ends]
    cut = (last >= begins) & (last + 1 < ends) & ~whole
    cut[cut] = (kinds[last[cut]] == LETTER) | (kinds[last[cut]] == DIGIT)
    middle = np.where(cut, last + 1, ends)
    tail = at >= np.repeat(middle, sizes)
    single = ((share(LETTER) == middle - begins) | (share(SYMBOL) == sizes)) & (sizes > 0) & ~whole
    sizes = np.concatenate([middle - begins, (ends - middle)[cut]])
    parts = pa.LargeStringArray.from_buffers(
        len(sizes),
        pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)),
        pa.py_buffer(np.concatenate([data[~tail], data[tail]])),
    )
    places = np.full((n, 2), -1)
    places[:, 0] = np.arange(n)
    places[cut, 1] = n + np.arange(len(sizes) - n)
    return parts, np.concatenate([single, np.ones(len(sizes) - n, bool)]), places


class WordIds:
    """Ids of the parts of words met so far in this worker, at most KNOWN_WORDS of them.

    A cache only: every part's ids come from the tokenizer, and a full cache starts anew with the parts at hand.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.index: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        t = tokenizer(path)
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.splits = self._splits()
        suffix = getattr(t.model, "end_of_word_suffix", None)
        self.final = np.zeros(t.get_vocab_size() + 1, bool)
        if suffix:
            self.final[[i for s, i in t.get_vocab(False).items() if s.endswith(suffix)]] = True

    def _splits(self) -> bool:
        """Whether this vocabulary lowers letters and parts every letter and digit from a symbol after it."""
        t = tokenizer(self.path)
        letters = [chr(c) for c in [*range(128), *range(0xC0, 0x100)] if chr(c).isalpha()]
        symbols = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
        pairs = [x + y for x in [*letters, *"0123456789"] for y in symbols]
        if t.normalizer is None or t.pre_tokenizer is None:
            return False
        if any(t.normalizer.normalize_str(x) != x.lower() for x in [*letters, *pairs]):
            return False
        return all(len(t.pre_tokenizer.pre_tokenize_str(x.lower())) == 2 for x in pairs)

    def encode_single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` for words that are letters or symbols throughout: the id that ends each of them is known."""
        found, ends = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, len(words), ENCODED_WORDS):
            part = words[low : low + ENCODED_WORDS]
            texts = [" ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids = [np.array(e.ids, np.uint32) for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate(ids)
            last = np.flatnonzero(self.final[ids])
            if len(last) != len(part) or last[-1] != len(ids) - 1:  # words are not parted by their last ids
                return self.encode(words)
            ends.append(last + sum(map(len, found)))
            found.append(ids)
        return np.concatenate(found), np.diff(np.concatenate(ends), prepend=-1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and the number of each word's."""
        t = tokenizer(self.path)
        mark = t.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1 or any(MARK in w for w in words):
            found = [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        found = [np.zeros(0, np.uint32)]
        for low in range(0, len(words), ENCODED_WORDS):
            part = words[low : low + ENCODED_WORDS]
            texts = [f" {MARK} ".join([*part[i : i + 500], ""]) for i in range(0, len(part), 500)]
            found += [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == mark[0])
        return ids[ids != mark[0]], np.diff(ends, prepend=-1) - 1

    def look_up(self, words: list[str], single: np.ndarray) -> np.ndarray:
        """Where the words stand in this cache; those not in it are encoded first."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.index) + len(missing) > KNOWN_WORDS:
                used = np.unique(at[at >= 0])
                sizes = self.lengths[used]
                self.flat, self.lengths = _taken(self.flat, (np.cumsum(self.lengths) - self.lengths)[used], sizes), sizes
                self.index = {words[i]: k for k, i in enumerate(np.flatnonzero(at >= 0)[np.argsort(at[at >= 0])].tolist())}
                at[at >= 0] = np.searchsorted(used, at[at >= 0])
            for lot, encode in ((missing[single[missing]], self.encode_single), (missing[~single[missing]], self.encode)):
                new = [words[i] for i in lot.tolist()]
                flat, lengths = encode(new)
                at[lot] = len(self.index) + np.arange(len(new))
                self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
                self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        return at

    def find(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, lengths): the ids of the i-th word stand at begins[i]."""
        whole = np.full(len(words), not self.splits)
        for content in self.added:  # its lowered form too, lest lowering makes one
            whole |= np.asarray(pc.match_substring(words, content, ignore_case=True))
        parts, single, places = split_tails(words, whole)
        coded = parts.dictionary_encode()
        codes = np.asarray(coded.indices)
        alone = np.zeros(len(coded.dictionary), bool)
        alone[codes] = single
        at = self.look_up(coded.dictionary.to_pylist(), alone)
        places = np.append(at[codes], len(self.lengths))[places]  # a tail that is not there has no ids
        lengths = np.append(self.lengths, 0)
        sizes = lengths[places]
        flat = _taken(self.flat, (np.cumsum(lengths) - lengths)[places.ravel()], sizes.ravel())
        sizes = sizes.sum(axis=1)
        return flat, np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_block(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, and each row's first id (one more at the end), with END_ID after every row.

    The vocabulary's pre-tokenisation never reaches over ASCII white space, so a word's ids do not depend on the words
    around it. Strings of special tokens inside a text get those tokens' ids, as the tokenizer gives them by itself.
    """
    texts = pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))
    )
    words = pc.ascii_split_whitespace(texts)
    first = np.asarray(words.offsets) - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    codes = np.asarray(coded.indices)
    flat, begins, lengths = word_ids(path).find(coded.dictionary)
    sizes = lengths[codes]
    starts = np.concatenate([[0], np.cumsum(sizes)])[first] + np.arange(len(offsets))
    ids = np.full(int(starts[-1]), END_ID, np.uint32)
    inside = np.ones(len(ids), bool)
    inside[starts[1:] - 1] = False
    ids[inside] = _taken(flat, begins[codes], sizes)
    return ids, starts


def _taken(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begins``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size-1 for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, limit: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.columns[:-1]
        for low, high, data, offsets in text_blocks(batch.column(batch.num_columns - 1), BLOCK):
            ids, starts = encode_block(path, data, offsets)
            lengths = np.diff(starts)
            counts = (lengths + limit - 1) // limit
            row = np.repeat(np.arange(high - low), counts)
            piece = _ramp(counts)
            begin = piece * limit
            size = np.minimum(lengths[row] - begin, limit)
            at = starts[row] + begin
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
            out = [k.take(pa.array(row + low)) for k in keys]
            out += [pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(size), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array([ids[a : a + n].tolist() for a, n in zip(at, size)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                out, names=[*batch.schema.names[:-1], "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            )


def tokenise(
    documents: DataFrame, keys: list[str], path: str, text: str = "text", limit: int = MAX_TOKENS, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document's ids: piece, start, length, the ids' CRC and, if asked for, the ids.

    The document's ids are those of the vocabulary file at ``path`` without special tokens, then END_ID. Only a
    document of more than ``limit`` ids is cut. A null or empty text has END_ID alone. ``keys`` are carried along and
    may be null or repeat; other columns are not read. Narrow: no shuffle.
    """
    chosen = documents.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text")
    )
    schema = T.StructType(
        [*chosen.schema.fields[:-1], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )
    out = chosen.mapInArrow(lambda batches: released(_pieces(batches, path, limit, with_ids)), schema)
    return out.withColumnsRenamed({f"key_{i}": k for i, k in enumerate(keys)})


def best_fit(
    lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length: each goes, longest first, to the open bin that it leaves the least room in.

    A bin has room for tokens, for pieces and for attention cost (the sum of squared lengths). Of the bins with room
    in all three, the one with the smallest weighted norm of what is left wins, each residual as a share of its
    capacity; ties go to the bin opened first. Without such a bin a new one is opened. A piece that alone exceeds a
    capacity gets a bin of its own.
    """
    caps, w = np.asarray(capacities, float), np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, 1024))
    ids = np.empty(1024, np.int64)
    n_open = n_bins = 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) * size])
        left = room[:, :n_open] - need[:, None]
        fits = (left >= 0).all(axis=0)
        if fits.any():
            norm = (w[:, None] * (left / caps[:, None]) ** 2).sum(axis=0)
            norm[~fits] = np.inf
            at = int(norm.argmin())
        else:
            if n_open == len(ids):
                room, ids = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([ids, np.empty_like(ids)])
            room[:, n_open], ids[n_open] = caps, n_bins
            at, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        bins[i], offsets[i] = ids[at], int(caps[0] - room[0, at])
        room[:, at] -= need
        if room[0, at] < smallest or room[1, at] < 1 or room[2, at] < smallest * smallest:
            n_open -= 1  # no piece fits any more; the last open bin takes its place
            room[:, at], ids[at] = room[:, n_open], ids[n_open]
    return bins, offsets


def _pack(batches: Iterator[pa.RecordBatch], capacities: tuple, weights: tuple) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    bins, offsets = best_fit(table.column("length").to_numpy(), capacities, weights)
    task = TaskContext.get().partitionId()
    table = table.append_column("sequence_id", pa.array(bins + (task << 33)))
    yield from table.append_column("offset", pa.array(offsets)).combine_chunks().to_batches()


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int = MAX_TOKENS,
    max_cost: float = float(MAX_TOKENS) ** 2,
    weights: tuple[float, float, float] = WEIGHTS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Add sequence_id and offset to every piece, in as few sequences as vector best-fit finds.

    Every sequence keeps to ``max_tokens``, ``max_documents`` pieces and ``max_cost``. Pieces of the full length are
    sequences by themselves and are packed as such. The pieces are dealt evenly, whatever their keys, to tasks of about
    ``group_tokens``; a task's last few sequences are all that packing in groups costs. The dealt pieces are stored
    first, so that a task run again finds the same rows. An empty table gives no rows. Input columns are kept;
    sequence_id and offset must be free names.
    """
    pieces = store(pieces)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    capacities = (float(max_tokens), float(max_documents), float(max_cost))
    return pieces.repartition(groups).mapInArrow(lambda batches: released(_pack(batches, capacities, weights)), schema)
