"""Near-duplicates by BagMinHash signatures of shingle multisets, banding and exact verification."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.blocks import BASES, hash_words, mix, released, split_words, text_blocks, window_hashes
from stayline.llm.substrings import LAST, keyed
from stayline.session import store

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and registers per band: a pair at similarity 0.8 shares a band with probability 0.9994, one at 0.4 with 0.03.
BANDS, ROWS = 40, 8
#: Rounds with one centre in each bucket, then with the likeliest partner of each member, members of a lot, and how far
#: below the similarity registers may agree.
STARS, CHOICES, LOT, MARGIN = 2, 1, 128, 0.075
#: Lots of bags that are compared: so many lots' members, and bytes of text, at most on average.
COMPARED, COMPARED_BYTES = 4, 2_000_000
#: Texts whose bags a task keeps while it verifies pairs.
HELD_BAGS = 4_000
#: Bits of a sieve per key, and the most that are sent (one million words of 64): more keys only let more rows through.
SIEVE_BITS, MOST_BITS = 16, 2**26


def shingles(words: np.ndarray, first: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, multiplicity) of all rows' shingles; a text of fewer words is one shingle of all its words."""
    n_rows = len(first) - 1
    sizes = np.diff(first)
    row = np.repeat(np.arange(n_rows), sizes)
    hashes = window_hashes(words, length) if len(words) >= length else np.zeros(0, np.uint64)
    at = np.arange(len(hashes))
    whole = at + length <= first[row[: len(hashes)] + 1] if len(hashes) else np.zeros(0, bool)
    rows, values = row[: len(hashes)][whole], mix(hashes[whole])
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short.tolist()):
            total[k] = window_hashes(words[first[r] : first[r + 1]], int(sizes[r]))[0] + np.uint64(sizes[r])
        rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(total)])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], np.diff(np.append(at, len(rows)))


def signatures(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """BagMinHash registers of each row's weighted elements; infinite for a row without any.

    Every element owns independent Poisson processes on the dyadic stretches [0,1), [1,2), [2,4), ... of the weight
    axis, of ``size`` points per unit of weight and time. A point has a time, a place on its stretch and a register;
    it counts in rows whose weight reaches beyond its place, and a register keeps its earliest point. Two rows agree
    on a register with the probability of their weighted Jaccard similarity. Points are drawn in time order and only
    up to the time by which all registers of the row are filled.
    """
    out = np.full(n_rows * size, np.inf)
    if not len(rows):
        return out.reshape(n_rows, size)
    seeds, owner, low, width, reach = [mix(values ^ np.uint64(0x632BE59BD9B4E019))], [rows], [0], [1], [weights]
    step = 1
    while (over := weights > step).any():
        seeds.append(mix(values[over] + np.uint64(step * 0x8CB92BA72F3D8DD7 % 2**64)))
        owner.append(rows[over])
        low.append(step)
        width.append(step)
        reach.append(weights[over])
        step *= 2
    sizes = [len(o) for o in owner]
    seed, owner, reach = np.concatenate(seeds), np.concatenate(owner), np.concatenate(reach)
    low, width = np.repeat(np.array(low), sizes), np.repeat(np.array(width), sizes)
    total = np.bincount(rows, weights, n_rows)
    until = (math.log(size) + 3) / np.maximum(total, 1)
    time, count = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)

    def draw(at: np.ndarray) -> None:
        """The next point's time for these processes."""
        count[at] += np.uint64(1)
        random = mix(seed[at] + count[at] * np.uint64(0x9E3779B97F4A7C15))
        uniform = ((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[at] -= np.log(uniform) / (size * width[at])

    draw(np.arange(len(seed)))
    waiting = np.arange(len(seed))
    while len(waiting):
        active = waiting[time[waiting] < until[owner[waiting]]]
        while len(active):
            random = mix((seed[active] ^ np.uint64(0xA0761D6478BD642F)) + count[active] * np.uint64(0xE7037ED1A0B428DB))
            place = low[active] + (random >> np.uint64(32)).astype(np.int64) % width[active]
            register = (random & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            valid = place < reach[active]
            np.minimum.at(out, (owner[active] * size + register)[valid], time[active][valid])
            draw(active)
            active = active[time[active] < until[owner[active]]]
        late = out.reshape(n_rows, size).max(axis=1) > until
        late &= total > 0
        until[late] *= 2
        waiting = np.flatnonzero(late[owner])
    return out.reshape(n_rows, size)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in text_blocks(batch.column(2)):
            starts, ends, first = split_words(data, offsets)
            words = hash_words(data, starts, ends)
            found = signatures(*shingles(words, first), high - low, bands * per_band)
            bits = found.view(np.uint64).reshape(high - low, bands, per_band)
            keys = np.zeros((high - low, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for k in range(per_band):
                keys = mix(keys * np.uint64(BASES[0]) + bits[:, :, k])
            short = (bits.reshape(high - low, -1) & np.uint64(255)).astype(np.uint8)
            raw = data.tobytes()
            node = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest()[:32] for a, b in zip(offsets[:-1], offsets[1:])]
            out = [
                batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(np.diff(first)),
                pa.array(node), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                pa.array([r.tobytes() for r in short], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["id", "mark", "n_words", "node", "bands", "registers"])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of one text and their multiplicities."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = split_words(data, np.array([0, len(data)]))
    _, values, weights = shingles(hash_words(data, starts, ends), first)
    return values, weights


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: multiset overlap over multiset union."""
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][a], two[1][b]).sum())
    union = int(one[1].sum() + two[1].sum()) - both
    return both / union if union else 0.0


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    bags: dict[str, tuple] = {}

    def held(node: pa.Scalar, text: pa.Scalar) -> tuple:
        name = node.as_py()
        if name not in bags:
            if len(bags) >= HELD_BAGS:
                bags.clear()
            bags[name] = bag(text.as_py())
        return bags[name]

    for batch in batches:
        a, b, one, two = batch.columns
        kept = [similarity(held(a[r], one[r]), held(b[r], two[r])) >= least for r in range(batch.num_rows)]
        mask = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the (a, b) edges: the smallest node of its connected part.

    Each step takes the smallest neighbouring label and then the label's own label, so that long chains shrink fast.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("label").alias("up"))
        step = store(
            closer.join(parents, closer.label == parents.parent, "left").select(
                "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")
            )
        )
        changed = step.filter("old <> label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _sides(batch: pa.RecordBatch, r: int) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
    """Outside and other members of a pair of lots, the registers of both, and which pairs are of two classes."""
    left, right = (batch.column(i)[r].as_py() for i in range(2))
    one, two = (np.frombuffer(b"".join(x["registers"] for x in lot), np.uint8).reshape(len(lot), -1) for lot in (left, right))
    classes = [np.array([x["label"] for x in lot]) for lot in (left, right)]
    return left, right, one, two, classes[0][:, None] != classes[1]


def _likeliest(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each outside member and class of a pair of lots, the member that most registers agree with, not tried yet."""
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            left, right, one, two, apart = _sides(batch, r)
            names = np.array([x["node"] for x in right])
            for i, x in enumerate(left):
                agree = (one[i] == two).mean(axis=1)
                best: dict[str, int] = {}
                for j in np.flatnonzero((agree >= least) & apart[i] & ~np.isin(names, x["tried"] or [])).tolist():
                    held = best.setdefault(right[j]["label"], j)
                    if (agree[j], names[held]) > (agree[held], names[j]):
                        best[right[j]["label"]] = j
                rows += [(x["node"], label, float(agree[j]), right[j]["node"]) for label, j in best.items()]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "class", "agree", "b"])


def lot_of(node: str, lots: int) -> int:
    """The lot of a node among all nodes, from its hexadecimal name."""
    return zlib.crc32(node.encode()) % lots


def _candidates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per outside member the nodes of other classes whose registers agree: a row a task, so no more rows than members.

    A pair is an entry of one list of a task, however many of its buckets share it. Two outside members of a bucket
    ask for each other, so only the smaller one's list has the pair.
    """
    for batch in batches:
        asked: dict[str, set[str]] = {}
        for r in range(batch.num_rows):
            left, right, one, two, apart = _sides(batch, r)
            names, outside = np.array([y["node"] for y in right]), np.array([y["outside"] for y in right])
            for i, x in enumerate(left):
                open_pairs = ((one[i] == two).mean(axis=1) >= least) & apart[i] & (~outside | (names > x["node"]))
                if open_pairs.any():
                    asked.setdefault(x["node"], set()).update(names[open_pairs].tolist())
        others = pa.array([sorted(o) for o in asked.values()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.string()), others], names=["node", "others"])


def _dealt(batches: Iterator[pa.RecordBatch], lots: int) -> Iterator[pa.RecordBatch]:
    """Each list cut by the lots of its entries; and the entries, once for each lot of nodes that asks for them."""
    held: set[tuple[int, str]] = set()
    for batch in batches:
        rows = []
        for x_lot, x, others in zip(*(c.to_pylist() for c in batch.columns)):
            parts: dict[int, list[str]] = {}
            for y in others:
                parts.setdefault(lot_of(y, lots), []).append(y)
            rows += [(x_lot, y_lot, x, part) for y_lot, part in parts.items()]
            new = [(x_lot, y_lot, y, None) for y_lot, part in parts.items() for y in part if (x_lot, y) not in held]
            held.update((row[0], row[2]) for row in new)
            rows += new
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["x_lot", "y_lot", "node", "others"])


def _compare(asked: pa.Table, held: pa.Table, least: float) -> pa.Table:
    """Links between the members of two lots; classes that a link joins count as one from then on."""

    def bags(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        columns = (table[c].combine_chunks() for c in ("values", "weights"))
        values, weights = ([np.asarray(v.values) for v in c] for c in columns)
        return {n: (v.view(np.uint64), w.astype(np.int64)) for n, v, w in zip(table["node"].to_pylist(), values, weights)}

    ours, theirs = bags(asked), bags(held)
    label = dict(zip(held["node"].to_pylist(), held["label"].to_pylist())) | dict(zip(asked["node"].to_pylist(), asked["label"].to_pylist()))
    joined: dict[str, str] = {}

    def root(name: str) -> str:
        while name in joined:
            name = joined[name]
        return name

    links = []
    for x, others in zip(asked["node"].to_pylist(), asked["others"].to_pylist()):
        for y in others:
            a, b = root(label[x]), root(label[y])
            if a != b and similarity(ours[x], theirs[y]) >= least:
                links.append((min(x, y), max(x, y)))
                joined[a] = b
    columns = list(zip(*links)) or [[], []]
    return pa.table({n: pa.array(c, pa.string()) for n, c in zip(("a", "b"), columns)})


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [bag(t) for t in batch.column(1).to_pylist()]
        values = pa.array([v.view(np.int64) for v, _ in bags], pa.list_(pa.int64()))
        weights = pa.array([w.astype(np.int32) for _, w in bags], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values, weights], names=["node", "values", "weights"])


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with a boolean: true for all rows whose keys are in ``wanted``, and for few of the others.

    Each key sets one bit by its hash, and the bits go out as words of 64. ``wanted`` is read twice; its keys have the
    types of those of ``rows``.
    """
    bits = min(MOST_BITS, max(64, SIEVE_BITS * wanted.count()))
    bit = F.pmod(F.xxhash64(*keys, F.lit("sieve")), F.lit(bits))
    word, mask = F.shiftright(bit, 6).alias("_word"), F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")
    words = wanted.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or(mask).alias("_mask"))
    found = rows.select("*", word, bit.alias("_bit")).join(F.broadcast(words), "_word", "left")
    return found.withColumn(out, F.coalesce(F.col("_mask").bitwiseAND(mask) != 0, F.lit(False))).drop("_word", "_bit", "_mask")


def sifted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys are in ``wanted``, and few of the others: the join that follows shuffles no more than these."""
    return sieve(rows, wanted, keys, "_may").filter("_may").select(*rows.columns)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs whose texts are similar enough."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.select("a", "b", "text_a", "text_b")
    return store(both.mapInArrow(lambda batches: _verify(batches, least), "a string, b string"))


def classified(members: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, label, draw) of all members and (bucket, main, size, first) of the buckets with several classes."""
    named = store(
        members.join(labels, "node", "left").select(
            "bucket", "node", F.coalesce("label", "node").alias("label"), F.xxhash64("bucket", "node", F.lit(turn)).alias("draw")
        )
    )
    parts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("draw", "node")).alias("first"))
    state = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("size"),
        F.min(F.struct(F.col("first.draw").alias("draw"), F.col("first.node").alias("node"), "label")).alias("first"),
        F.count(F.lit(1)).alias("classes"),
    )
    return named, store(state.filter("classes > 1").select("bucket", "main", "size", "first"))


def lots(named: DataFrame, state: DataFrame, extra: DataFrame, fields: list[str]) -> DataFrame:
    """(centres, members): lots of a bucket's members outside its largest class beside each of its lots of all members."""
    outside = F.col("size") - F.col("main.n")
    sizes = state.select("bucket", F.col("main.label").alias("main"), F.ceil(F.col("size") / LOT).alias("lots"), F.ceil(outside / LOT).alias("out_lots"))
    placed = named.join(sizes, "bucket").join(extra, "node").select(
        "bucket", F.pmod("draw", "lots").alias("lot"), F.when(F.col("label") != F.col("main"), F.pmod("draw", "out_lots")).alias("out_lot"),
        F.struct("node", "label", (F.col("label") != F.col("main")).alias("outside"), *fields).alias("item"),
    )
    placed = store(placed)
    every = placed.groupBy("bucket", "lot").agg(F.collect_list("item").alias("members")).drop("lot")
    outer = placed.filter("out_lot IS NOT NULL").groupBy("bucket", "out_lot").agg(F.collect_list("item").alias("centres")).drop("out_lot")
    return every.join(outer, "bucket").select("centres", "members")


def linked(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, label) for the nodes that link to another: classes of the graph of all similar pairs that share a bucket.

    ``members`` has (bucket, node), ``texts`` (node, text, registers). Each round adds some verified links and
    contracts the classes that they join to stars, so edges never outnumber nodes. In STARS rounds each bucket has one
    centre, which is compared with its members of other classes. In CHOICES rounds each member outside its bucket's
    largest class is compared with the one member of each other class whose registers agree most, among those that it
    was not compared with. Rows of both are linear in the members. What is left then is compared whole: each member lists
    its open candidates, those of another class whose registers agree to within MARGIN of ``least``, a pair once however
    many buckets share it. Bags go to pairs of lots of these nodes, are compared inside the task, and only links come
    out. So no link in a bucket is missed, but for registers off by over three standard deviations, as rare as a pair
    without a common band.
    """
    spark = members.sparkSession
    labels = spark.createDataFrame([], "node string, label string")
    tried = spark.createDataFrame([], "node string, tried array<string>")

    def contracted(found: DataFrame) -> DataFrame:
        stars = labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
        return components(found.unionByName(stars))

    for turn in range(STARS + CHOICES):
        named, state = classified(members, labels, turn)
        if not state.limit(1).count():
            return labels
        if turn < STARS:
            centres = state.select("bucket", F.col("first.node").alias("a"), F.col("first.label").alias("label_a"))
            pairs = named.join(centres, "bucket").filter("label <> label_a")
            pairs = store(pairs.select(F.greatest("node", "a").alias("b"), F.least("node", "a").alias("a")).distinct())
        else:
            known = texts.select("node", "registers").join(tried, "node", "left")
            met = lots(named, state, known, ["registers", "tried"])
            best = met.mapInArrow(lambda batches: _likeliest(batches, least - MARGIN), "a string, class string, agree double, b string")
            chosen = store(best.groupBy("a", "class").agg(F.max(F.struct("agree", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
            if not chosen.limit(1).count():
                return labels
            both = tried.select("node", F.explode("tried").alias("b")).unionByName(chosen.select(F.col("a").alias("node"), "b"))
            tried = store(both.groupBy("node").agg(F.collect_set("b").alias("tried")))
            pairs = store(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = contracted(verified(pairs, texts, least))
    named, state = classified(members, labels, STARS + CHOICES)
    placed = named.join(state.select("bucket", F.col("main.label").alias("main")), "bucket")
    open_nodes = placed.groupBy("node").agg(F.max(F.col("label") != F.col("main")).alias("out"))
    sizes = open_nodes.join(texts.select("node", F.octet_length("text").cast("long").alias("size")), "node")
    total = sizes.agg(F.count_if("out"), F.sum(F.when(F.col("out"), F.col("size"))), F.count(F.lit(1)), F.sum("size")).first()
    out_count, count = (max(1, -(-n // (COMPARED * LOT)), -(-(size or 0) // COMPARED_BYTES)) for n, size in (total[:2], total[2:]))
    met = lots(named, state, texts.select("node", "registers"), ["registers"])
    found = store(met.mapInArrow(lambda batches: _candidates(batches, least - MARGIN), "node string, others array<string>"))
    if not found.limit(1).count():
        return labels
    # a lot's lists meet in one task, which then knows the nodes that its lot has asked for
    placed = found.withColumn("x_lot", F.pmod(F.xxhash64("node"), F.lit(out_count))).repartition("x_lot")
    merged = placed.groupBy("x_lot", "node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    shape = "x_lot long, y_lot long, node string, others array<string>"
    dealt = store(merged.mapInArrow(lambda batches: _dealt(batches, count), shape))
    asked = texts.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "text")
    bags = asked.mapInArrow(_bagged, "node string, values array<long>, weights array<int>").join(labels, "node", "left")
    bags = store(bags.select("node", F.coalesce("label", "node").alias("label"), "values", "weights"))
    lists = dealt.filter("others IS NOT NULL")
    held = dealt.filter("others IS NULL").drop("others")
    # new names of columns on each side: both come from the same stored tables
    sides = [d.join(bags, "node").select(*[F.col(c).alias(c) for c in (*d.columns, "label", "values", "weights")]) for d in (lists, held)]
    grouped = [side.groupBy("x_lot", "y_lot") for side in sides]
    links = grouped[0].cogroup(grouped[1]).applyInArrow(lambda x, y: _compare(x, y, least), "a string, b string")
    return contracted(store(links))


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY,
    bands: int = BANDS, per_band: int = ROWS,
) -> DataFrame:
    """Per row: doc_id, mark (a hash of its text), n_words, class_id, class_mark and class_size.

    Two texts are linked if the weighted Jaccard similarity of their multisets of five-word shingles is ``least`` or
    more; classes are the connected parts. ``class_id`` is the class's smallest doc_id (``class_mark`` the text's
    under it), ``class_size`` its rows. Equal word sequences are one node from the start, so copies cost nothing.
    Texts of fewer than five words are one shingle; texts without words are classes by themselves. A null doc_id comes
    after all others. Repeated rows stay repeated; other columns are not read.
    """
    named = keyed(documents, doc_id, text)
    signed = store(
        named.mapInArrow(
            lambda batches: released(_sign(batches, bands, per_band)),
            "id long, mark long, n_words long, node string, bands array<long>, registers binary",
        )
    )
    worded = signed.filter("n_words > 0")
    nodes = store(worded.groupBy("node").agg(F.min(F.struct("id", "mark", "bands", "registers")).alias("first"), F.count(F.lit(1)).alias("rows")))
    # a short name in the two wide shuffles; two texts of one short name would only be compared in vain
    buckets = nodes.select(F.xxhash64("node").alias("short"), F.explode("first.bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("short").alias("one"), F.max("short").alias("other")).filter("one <> other")
    shared = store(shared.select("bucket"))
    found = sifted(buckets, shared, ["bucket"]).join(shared, "bucket", "left_semi")
    members = store(found.join(nodes.select(F.xxhash64("node").alias("short"), "node"), "short").drop("short"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first.id", "first.mark", "first.registers")
    wanted = store(wanted)
    asked = sifted(named, wanted, ["id", "mark"]).dropDuplicates(["id", "mark"])
    texts = store(asked.join(wanted, ["id", "mark"]).select("node", "text", "registers"))
    labels = linked(members, texts, least)
    placed = nodes.select("node", "rows", F.struct("first.id", "first.mark").alias("first")).join(labels, "node", "left")
    placed = store(placed.select("node", "rows", "first", F.coalesce("label", "node").alias("label")))
    classes = placed.groupBy("label").agg(F.min("first").alias("class"), F.sum("rows").alias("class_size"))
    where = placed.select("node", "label").join(classes, "label").select("node", "class", "class_size")
    out = signed.drop("bands", "registers").join(where, "node", "left")
    alone = F.struct("id", "mark")
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "mark",
        "n_words",
        F.when(F.coalesce("class", alone)["id"] != LAST, F.coalesce("class", alone)["id"]).alias("class_id"),
        F.coalesce("class", alone)["mark"].alias("class_mark"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )
