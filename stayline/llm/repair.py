"""Repair of conversations: the cheapest edits to a legal order of roles, over a grammar shared by all conversations.

A conversation is a sequence of symbols, one per turn: the role's initial and whether the turn is sound, must go, or
breaks off. Re-Pair replaces frequent pairs of symbols by rules. Each symbol and rule has one matrix: for each state
before and after it the least cost and the edits that give it. Matrices multiply by minimum and sum; a rule's matrix is
the product of its two parts', and a sequence costs as many products as it has symbols left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import store

# Fixed values of the repair.
RENAME, DELETE, INSERT, BROKEN = 1, 2, 5, 5
ROLES = ("user", "assistant")
BLANKS = " \t\n\x0b\f\r"

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
SOUND, DOOMED, CUT_OFF = range(3)
FIRST_SYMBOL, FIRST_RULE = ord("a"), 256

#: Turns in one sequence; longer conversations are several, whose matrices are multiplied.
SEGMENT = 4_096
#: Rounds of Re-Pair, pairs replaced in a round, and occurrences that a pair needs. They change the work, not results.
ROUNDS, PAIRS, LEAST_USES = 8, 16, 2

MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A8C6E4


class Rope:
    """An immutable string as a tree; joining costs O(1), comparing skips equal parts by their hash."""

    __slots__ = ("left", "right", "text", "size", "value", "power")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, self.value = len(text), 0
            for c in text:
                self.value = (self.value * BASE + ord(c)) % MODULUS
            self.power = pow(BASE, self.size, MODULUS)
        else:
            self.size = left.size + right.size
            self.value = (left.value * right.power + right.value) % MODULUS
            self.power = left.power * right.power % MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        return Rope(left=self, right=other)

    def __str__(self) -> str:
        parts, open_ = [], [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                parts.append(node.text)
            else:
                open_ += (node.right, node.left)
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        one, two = [self], [other]
        while one and two:
            a, b = one.pop(), two.pop()
            if a.size == b.size and a.value == b.value:
                continue
            if a.left is None and b.left is None:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                one += [Rope(a.text[n:])] if a.size > n else []
                two += [Rope(b.text[n:])] if b.size > n else []
                continue
            # open the longer tree, so that both sides come to parts of one size
            if a.left is not None and (b.left is None or a.size >= b.size):
                one += (a.right, a.left)
                two.append(b)
            else:
                two += (b.right, b.left)
                one.append(a)
        return not one and bool(two)


Entry = tuple[int, Rope]
Matrix = tuple[tuple[Entry | None, ...], ...]


def _better(one: Entry | None, two: Entry | None) -> Entry | None:
    if one is None or two is None:
        return two if one is None else one
    if one[0] != two[0]:
        return one if one[0] < two[0] else two
    return two if two[1] < one[1] else one


def product(one: Matrix, two: Matrix) -> Matrix:
    """Least sums over the state between. Equally cheap edits between two states are never prefixes of each other
    (the same edits lead to the same state), so that the smaller stays smaller whatever follows."""
    rows = []
    for left in one:
        row: list[Entry | None] = [None] * 4
        for k, a in enumerate(left):
            if a is not None:
                for j, b in enumerate(two[k]):
                    if b is not None and (row[j] is None or a[0] + b[0] <= row[j][0]):
                        row[j] = _better(row[j], (a[0] + b[0], a[1] + b[1]))
        rows.append(tuple(row))
    return tuple(rows)


def after_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _inserts() -> Matrix:
    rows = []
    for state in range(4):
        row: list[Entry | None] = [None] * 4
        at = state
        for n in range(3):
            row[at] = _better(row[at], (n * INSERT, Rope("I" * n)))
            at = after_insert(at)
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> Matrix:
    """Any inserted turns, then the edit of one turn."""
    initial, fault = divmod(symbol, 3)
    edit: list[list[Entry | None]] = [[None] * 4 for _ in range(4)]
    extra = BROKEN if fault == CUT_OFF else 0
    for state in range(4):
        edit[state][state] = (DELETE, Rope("D"))
        if fault == DOOMED:
            continue
        renamed = after_insert(state)  # user after anything but a user, else assistant
        edit[state][renamed] = _better(edit[state][renamed], (RENAME + extra, Rope("R")))
        kept = {0: SYSTEM if state == START else None, 1: None if state == USER else USER, 2: ASSISTANT if state == USER else None}
        to = kept.get(initial)
        if to is not None:
            edit[state][to] = _better(edit[state][to], (extra, Rope("K")))
    return product(INSERTS, tuple(tuple(r) for r in edit))


@lru_cache(maxsize=4)
def matrices(rules: tuple[str, ...]) -> dict[str, Matrix]:
    """The matrix of each symbol and, bottom-up, of each rule; a rule is the pair of symbols that it stands for."""
    out = {chr(FIRST_SYMBOL + k): symbol_matrix(k) for k in range(12)}
    for k, (a, b) in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[a], out[b])
    return out


def sequence_matrix(sequence: str, rules: tuple[str, ...]) -> Matrix:
    known = matrices(rules)
    out = known[sequence[0]]
    for symbol in sequence[1:]:
        out = product(out, known[symbol])
    return out


def cheapest(start: tuple[Entry | None, ...]) -> tuple[int, str]:
    """Cost and edits from the costs of all states: after nothing or after an assistant turn, with turns inserted."""
    best = None
    for state, entry in enumerate(start):
        for end in (START, ASSISTANT):
            close = INSERTS[state][end]
            if entry is not None and close is not None:
                best = _better(best, (entry[0] + close[0], entry[1] + close[1]))
    return best[0], str(best[1])


def re_pair(sequences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, tuple[str, ...]]:
    """(sequence, packed) of distinct sequences and the rules: frequent pairs become symbols, some in each round.

    Pairs of one round share no symbol, so the order in which they are replaced does not matter. The driver sees counts
    of pairs of symbols, at most (12 + ROUNDS x PAIRS) squared.
    """
    rules: list[str] = []
    packed = store(sequences.select("sequence", F.col("sequence").alias("packed")))
    for _ in range(rounds):
        pairs = packed.filter(F.char_length("packed") > 1).select(
            F.explode(F.transform(F.sequence(F.lit(1), F.char_length("packed") - 1), lambda i: F.substr("packed", i, F.lit(2)))).alias("pair")
        )
        counted = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_USES).collect()
        chosen: list[str] = []
        for row in sorted(counted, key=lambda r: (-r.n, r.pair)):
            if len(chosen) < PAIRS and not set(row.pair) & set("".join(chosen)):
                chosen.append(row.pair)
        if not chosen:
            break
        shorter: Column = F.col("packed")
        for pair in chosen:
            shorter = F.replace(shorter, F.lit(pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(pair)
        packed = store(packed.select("sequence", shorter.alias("packed")))
    return packed, tuple(rules)


def judged_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows with place, fault, symbol and the marks that the report adds up.

    One exchange by conversation; all orderings follow within it and may spill.
    """
    held = rows.repartition(F.col("conv_id"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    inner = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(inner == "", "blank").when(F.col("_seen") > 1, "duplicate")
        .when(~F.substr(inner, F.char_length(inner), F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_seen")
    initial = F.substring("role", 1, 1)
    out = held.withColumn("_seen", seen).withColumn("fault", fault).withColumn("_initial", initial)
    out = out.withColumns(
        {
            "place": (F.row_number().over(order) - 1).cast("long"),
            "_before": F.lag("_initial").over(order),
            "_last_turn": F.lag("turn").over(order),
        }
    )
    group = F.when(F.col("_initial") == "", 0).otherwise(F.instr(F.lit(INITIALS), F.col("_initial")))
    kind = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT_OFF).otherwise(DOOMED)
    code = FIRST_SYMBOL + F.pmod(group - 1, F.lit(4)) * 3 + kind
    steps = F.concat("_before", "_initial")
    return out.select(
        "conv_id", "turn", "role", "text", "place", "fault", F.chr(code.cast("long")).alias("symbol"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_last_turn"))).alias("new_turn"),
        F.coalesce(F.col("_before").isNotNull() & ~steps.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def _evaluate(batches: Iterator[pa.RecordBatch], rules: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string())]))
    for batch in batches:
        found = []
        for packed in batch.column(1).to_pylist():
            matrix = sequence_matrix(packed, rules)
            found.append([None if e is None else {"cost": e[0], "edits": str(e[1])} for row in matrix for e in row])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["sequence", "matrix"])


def _conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits = [], []
        for parts in batch.column(1).to_pylist():
            row: tuple = ((0, Rope()), None, None, None)
            for part in parts:
                cells = [None if e is None else (e["cost"], Rope(e["edits"])) for e in part["matrix"]]
                row = product((row,), tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4)))[0]
            cost, audit = cheapest(row)
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["conv_id", "cost", "audit"]
        )


def cheapest_edits(turns: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of every conversation in ``judged_turns``.

    Conversations are cut into sequences of SEGMENT turns; equal sequences of all conversations are one row, so each is
    evaluated once. A task then holds one conversation's sequences, a few bytes a turn, as the audit itself does.
    """
    part = turns.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("symbols")
    )
    sequence = F.array_join(F.transform("symbols", lambda s: s["symbol"]), "").alias("sequence")
    parts = store(part.select("conv_id", "part", sequence))
    packed, rules = re_pair(parts.select("sequence").distinct())
    cells = "sequence string, matrix array<struct<cost:long,edits:string>>"
    valued = store(packed.mapInArrow(lambda batches: _evaluate(batches, rules), cells))
    whole = parts.join(valued, "sequence").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("parts"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(_conclude, f"conv_id {kind}, cost long, audit string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from rows ordered by conversation, the audit first; the state is carried between batches."""
    conv, audit, at, state, place = None, "", 0, START, 0

    def insert(out: list) -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = after_insert(state)
            out.append((conv, place, ROLES[state == ASSISTANT], ""))
            at, place = at + 1, place + 1

    names = ["conv_id", "place", "role", "text"]
    kinds = None
    for batch in batches:
        kinds = kinds or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
        out: list[tuple] = []
        for conv_id, row, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
            if row < 0:
                insert(out)
                conv, audit, at, state, place = conv_id, edits, 0, START, 0
                continue
            insert(out)
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = after_insert(state)
                role = ROLES[state == ASSISTANT]
            else:
                state = 1 + INITIALS.index(role[0])
            out.append((conv, place, role, text))
            place += 1
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    if kinds:
        out = []
        insert(out)
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def repair_conversations(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired turns
    (conv_id, place, role, text).

    A turn is blank without a character other than ASCII white space, else a duplicate if an earlier turn has its role
    and text, else truncated if its last such character is none of ``.!?``. Edits: keep, rename to user or assistant,
    delete (blank and duplicate turns always), insert an empty user or assistant turn. The result's roles are nothing,
    or an optional system turn and then user and assistant in turns, by their initials; ``audit`` are the edits' initials
    in order, of the cheapest ones the least. ``gaps`` counts the turn numbers missing between the first and the last.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are duplicates of the first. A null
    role or text counts as one space; null ``conv_id`` form one conversation; other columns are not read; an empty table
    gives no rows. Repaired turns come out in order, each conversation whole in one partition, and are passed on as they
    are read, so a very long conversation is not held in memory.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    turns = store(judged_turns(rows))
    edits = store(cheapest_edits(turns))

    def counted(fault: str) -> Column:
        return F.count_if(F.col("fault").eqNullSafe(F.lit(fault))).alias(fault)

    missing = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    report = turns.groupBy("conv_id").agg(
        F.coalesce(missing, F.lit(0)).alias("gaps"), counted("blank"), counted("duplicate"), counted("truncated"),
        F.count_if("illegal").alias("illegal"),
    )
    same = report["conv_id"].eqNullSafe(edits["conv_id"])
    report = report.join(edits, same).select(report["*"], "cost", "audit")
    nothing = F.lit(None).cast("string")
    lines = turns.select("conv_id", "place", "role", "text", nothing.alias("audit")).unionByName(
        edits.select("conv_id", F.lit(-1).cast("long").alias("place"), nothing.alias("role"), nothing.alias("text"), "audit")
    )
    ordered = lines.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return report, ordered.mapInArrow(_apply, f"conv_id {kind}, place long, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running = None, None
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        done: list[tuple] = []
        for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if place == 0:
                if running:
                    done.append((conv, running.hexdigest()))
                conv, running = conv_id, hashlib.sha256()
            running.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        columns = list(zip(*done)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], names=["conv_id", "sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([running.hexdigest()])], names=["conv_id", "sha256"])


def repaired_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the newline-joined ``role:text`` of repaired turns as they come out of the repair."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_digest, f"conv_id {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties the text,
    2 removes its ``.!?``, 3 repeats the row, 4 makes it the user's. Nulls count as one space in the key, role and text."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1)))
    kept = conversations.filter(draw != 0)
    return kept.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
