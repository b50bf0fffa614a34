"""Periodic runs, conversation repair and repeated bytes: brute force, and nulls, empty tables, repeats and odd texts."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stayline.llm import repair, runs, suffixes

WORDS = re.compile("[^\x20\x09-\x0D]+")


def naive_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if rng.random() < 0.5 and n > 4:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        assert runs.runs_of_texts(texts) == [naive_runs(w) for w in texts]


def test_runs_of_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "SORTED_WORDS", 50)
    rows = [
        (1, "a b " * 10 + "c"), (1, "a b " * 10 + "c"), (None, "x " * 3000), (2, None), (3, ""), (4, " \n\t "), (5, "one two three"),
        (6, "é ö  " * 8), (7, "p q r s t u v w\n" * 4 + "p"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("key_0", F.lit(1))
    got = runs.find_runs(frame, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((i or 0, len(WORDS.findall(t or ""))) for i, t in rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        words = WORDS.findall(text)
        want = naive_runs(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == want and r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert runs.find_runs(frame.limit(0), ["doc_id"]).count() == 0
    tails = frame.select("doc_id", runs.repeat_tails(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert len(tails) == len(rows) and all(r.t is None for r in tails if r.doc_id == 2)


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def naive_repair(rows):
    """Least (cost, edits) over all sequences of edits of up to two turns inserted in each gap."""
    open_ = {("", 0, "")}
    for initial, fault in rows:
        after = set()
        for roles, cost, edits in open_:
            for n in range(3):
                for new in itertools.product("ua", repeat=n):
                    r, c, e = roles + "".join(new), cost + 5 * n, edits + "I" * n
                    after.add((r, c + 2, e + "D"))
                    if fault != 1:
                        more = 5 if fault == 2 else 0
                        after.add((r + initial, c + more, e + "K"))
                        after |= {(r + x, c + 1 + more, e + "R") for x in "ua"}
        open_ = {x for x in after if re.match(r"(s?(ua)*u?)?\Z", x[0]) and x[1] <= 2 * len(rows)}
    ends = [(c + 5 * n, e + "I" * n) for r, c, e in open_ for n in range(3) for new in itertools.product("ua", repeat=n) if LEGAL.match(r + "".join(new))]
    return min(ends)


def test_matrices_against_enumeration():
    rng = random.Random(2)
    for _ in range(250):
        rows = [(rng.choice("suux" "aa"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 6))]
        sequence = "".join(chr(97 + 3 * "suax".index(i) + f) for i, f in rows)
        want = naive_repair(rows)
        assert repair.cheapest(repair.sequence_matrix(sequence, ())[0]) == want
        rules = (sequence[:2], chr(256) * 2) if len(rows) > 1 else ()
        packed = sequence.replace(sequence[:2], chr(256)).replace(chr(256) * 2, chr(257)) if rules else sequence
        assert repair.cheapest(repair.sequence_matrix(packed, rules)[0]) == want


def test_ropes_compare_like_strings():
    rng = random.Random(3)
    for _ in range(400):
        texts = ["".join(rng.choice("DK") for _ in range(rng.randint(0, 12))) for _ in range(2)]
        if rng.random() < 0.5:
            texts[1] = texts[0][: rng.randint(0, 12)] + texts[1]
        ropes = []
        for t in texts:
            rope = repair.Rope()
            while t:
                n = rng.randint(1, 4)
                rope, t = rope + repair.Rope(t[:n]), t[n:]
            ropes.append(rope)
        assert [str(r) for r in ropes] == texts and (ropes[0] < ropes[1]) == (texts[0] < texts[1])


def naive_conversation(rows):
    """Counts, cost, audit and repaired turns of (turn, role, text) rows."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        inner = text.strip(" \t\n\x0b\f\r")
        fault = 0
        if not inner:
            counts["blank"] += 1
            fault = 1
        elif (role, text) in seen:
            counts["duplicate"] += 1
            fault = 1
        elif inner[-1] not in ".!?":
            counts["truncated"] += 1
            fault = 2
        seen.add((role, text))
        symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
    turns = [t for known, t, _, _ in rows if known]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = naive_repair(symbols)
    out, at = [], 0
    for edit in audit:
        last = out[-1][0][:1] if out else ""
        new = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((new, ""))
            continue
        _, _, role, text = rows[at]
        at += 1
        if edit != "D":
            out.append((role if edit == "K" else new, text))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, out


def test_repair_of_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), role, rng.choice(["Hi.", "Hi.", "broken", "", None, " \n", "Yes! ", "a\nb?"])))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("place", F.lit("clash")).withColumn("symbol", F.lit(None).cast("int")).repartition(4)
    report, turns = repair.repair_conversations(frame)
    texts = {}
    for r in turns.collect():
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    digests = {r.conv_id: r.sha256 for r in repair.repaired_digests(turns).collect()}
    reported = report.collect()
    assert len(reported) == 41
    for r in reported:
        gaps, blank, duplicate, truncated, illegal, cost, audit, out = naive_conversation([x[1:] for x in rows if x[0] == r.conv_id])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, blank, duplicate, truncated, illegal, cost, audit)
        assert [x[1:] for x in sorted(texts.get(r.conv_id, []))] == out
        whole = "\n".join(f"{a}:{b}" for a, b in out)
        assert digests.get(r.conv_id, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(whole.encode()).hexdigest()
    report, turns = repair.repair_conversations(frame.limit(0))
    assert report.count() == turns.count() == repair.repaired_digests(turns).count() == 0
    assert set(repair.damage(frame).columns) == {"conv_id", "turn", "role", "text"}


def naive_bytes(rows, window):
    first = {}
    last = (1 << 63) - 1
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < (last if i is None else i):
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram", "hot"), [(8, 4, 20_000), (8, 4, 1), (50, 25, 3), (9, 9, 20_000), (7, 1, 20_000)])
def test_bytes_against_brute_force(spark, monkeypatch, window, gram, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SLICE", 700)
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    rng = random.Random(window + hot)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randint(3, 3 * window))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passages), "".join(rng.choice("abcdef") for _ in range(rng.randint(0, window)))]) for _ in range(rng.randint(0, 7))]
        rows.append((rng.choice([None, *range(40)]), "".join(parts)))
    rows += [*rows[:4], (3, None), (4, ""), (5, "a" * 300), (6, "a" * 301), (50, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("gram", F.lit(1)).repartition(5)
    found = suffixes.remove_repeated_bytes(frame, window=window, gram=gram).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == naive_bytes(rows, window)
    assert all(r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)
    assert suffixes.remove_repeated_bytes(frame.limit(0)).count() == 0


def test_colliding_hashes_are_noticed(monkeypatch):
    """With a base that makes every hash equal the sort goes wrong; the bytes tell, and another base is taken."""
    import numpy as np

    data = np.frombuffer(b"abcabdabcaaa", np.uint8)
    start, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 3])
    codes = suffixes.BYTE_CODES.copy()
    codes[:] = codes[0]
    good = suffixes.common_classes(data, start, size, np.ones(4, int))
    assert good[0].tolist() == [3, 0, 2, 1] and good[1].tolist() == [-1, 1, 3, 2]
    monkeypatch.setattr(suffixes, "BYTE_CODES", codes)
    with pytest.raises(RuntimeError):
        suffixes.common_classes(data, start, size, np.ones(4, int))
