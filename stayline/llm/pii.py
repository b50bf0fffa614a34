"""Personal data: fixed patterns, and weakly supervised labelers whose votes train a span classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.session import store

# Fixed values of the base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = ("email", "ip", "card", "phone", "secret", "account", "local_phone", "spoken_email")

# Fixed values of the labelers.
TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
SPOKEN = re.compile(r"(?<![\w.])[\w.+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[\w-]{1,64} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}\b", re.I)
STRIP = "\"'`()[]{}<>,;:!?.=*#$%&|"
HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
RANDOM = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")
PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "glpat-", "Bearer")
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
ENDINGS = frozenset("com net org edu gov info io co de fr es uk eu ch it nl".split())
CONTEXT = re.compile(
    r"token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|iban|account|konto|ssn|social security|"
    r"phone|tel\b|call|mobile|fax|contact|mail|reach|kontakt|contacto|t[ée]l[ée]phone",
    re.I,
)
PLAIN = re.compile(r"[0-9.,:/-]+%?|v?[0-9]+(?:\.[0-9]+)+")
N_LABELERS = 5
ACCEPT = 0.5
PRIOR = 0.1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of e-mail addresses, IP addresses, card and telephone numbers, leftmost and apart per kind.

    A match that fails its check is dropped and not tried again. E-mails are found from their @ sign: the match starts
    where the run of local characters before it does, so that long texts take linear time.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _checked(kind: str, token: str) -> int:
    """A check sum's vote: 1 passed, -1 failed, 0 for tokens without one."""
    if kind == "account" and token[:2].isalpha():
        moved = token[4:] + token[:4]
        number = "".join(str(int(c, 36)) for c in moved)
        return 1 if int(number) % 97 == 1 else -1
    if kind == "account":
        return -1 if token.startswith(("000", "666", "9")) else 0
    return 0


def votes(kind: str, token: str, before: str) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 personal, -1 not, 0 no opinion.

    In order: pattern, gazetteer, context, randomness of the characters, check sum.
    """
    if kind == "secret":
        pattern = 1 if HEX.fullmatch(token) or len(token) >= 20 else 0
        gazetteer = 1 if token.startswith(PREFIXES) else 0
        h = entropy(token)
        chance = 1 if h >= 3.2 else -1 if h < 2.5 else 0
    elif kind == "account":
        pattern, chance = 1, 0
        gazetteer = (1 if token[:2] in COUNTRIES else -1) if token[:2].isalpha() else 0
    elif kind == "local_phone":
        digits = re.sub("[^0-9]", "", token)
        pattern = 1 if len(digits) == 10 and digits[0] not in "01" else -1
        gazetteer = 0
        chance = -1 if len(set(digits)) <= 2 else 0
    else:
        pattern = 1
        gazetteer = 1 if re.split(r"\W+", token)[-1].lower() in ENDINGS else -1
        chance = 0
    context = 1 if CONTEXT.search(before) else 0
    return pattern, gazetteer, context, chance, _checked(kind, token)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of the spans outside ``taken`` that a labeler may call personal."""
    found = []
    for m in TOKEN.finditer(text):
        raw = m.group()
        token = raw.strip(STRIP)
        start = m.start() + (raw.index(token) if token else 0)
        if "=" in token.rstrip("=")[:-1]:
            start += token.index("=") + 1
            token = token[token.index("=") + 1 :].strip(STRIP)
            start = text.index(token, start) if token else start
        if not token or PLAIN.fullmatch(token) and not ACCOUNT.fullmatch(token) and not NATIONAL.fullmatch(token):
            continue
        if ACCOUNT.fullmatch(token):
            kind = "account"
        elif NATIONAL.fullmatch(token):
            kind = "local_phone"
        elif HEX.fullmatch(token) or RANDOM.fullmatch(token):
            kind = "secret"
        else:
            continue
        found.append((kind, start, start + len(token)))
    for m in re.finditer(r"(?<![\w+.(-])\(?[0-9]{3}\)? ?[.-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])", text):
        found.append(("local_phone", m.start(), m.end()))
    lowered = text.lower()
    if any(w in lowered for w in (" at ", "(at)", "[at]")) and any(w in lowered for w in (" dot ", "(dot)", "[dot]")):
        found += [("spoken_email", m.start(), m.end()) for m in SPOKEN.finditer(text)]
    out, free = [], sorted((s, e) for _, s, e in taken)
    for kind, start, end in sorted(set(found), key=lambda x: (x[1], -x[2])):
        if any(s < end and start < e for s, e in free):
            continue
        free.append((start, end))
        out.append((KINDS.index(kind), start, end, votes(kind, text[start:end], text[max(0, start - 40) : start])))
    return out


def code(kind: int, cast: tuple[int, ...]) -> int:
    """Kind and votes as one number below len(KINDS) * 3 ** N_LABELERS."""
    out = kind
    for v in cast:
        out = 3 * out + v + 1
    return out


def decode(number: int) -> tuple[int, tuple[int, ...]]:
    cast = []
    for _ in range(N_LABELERS):
        number, v = divmod(number, 3)
        cast.append(v - 1)
    return number, tuple(reversed(cast))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))
    for batch in batches:
        base, more = [], []
        for text in batch.column(batch.num_columns - 1):
            text = text.as_py() or ""
            sure = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e, "code": -1} for k, s, e in sorted(sure)])
            more.append([{"kind": k, "start": s, "end": e, "code": code(k, v)} for k, s, e, v in candidates(text, sure)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(base, spans), pa.array(more, spans)],
            names=[*batch.schema.names[:-1], "base", "more"],
        )


def estimate(patterns: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Probability that a candidate with these votes is personal, for each pattern of votes.

    Expectation-maximisation over two hidden classes: each labeler votes independently given the class, with
    probabilities estimated from all candidates. Labelers start as right four times in five when they vote; that start
    also counts as PRIOR of the candidates' number, so that a class keeps its meaning where few candidates disagree.
    """
    if not patterns:
        return {}
    codes = sorted(patterns)
    cast = np.array([decode(c)[1] for c in codes]) + 1
    counts = np.array([patterns[c] for c in codes], float)
    start = np.array([[0.4, 0.4, 0.2], [0.1, 0.4, 0.5]])  # chance of the votes -1, 0, 1 outside and inside the class
    tables = np.repeat(start[:, None, :], N_LABELERS, axis=1)
    share, belief = 0.5, np.zeros(len(codes))
    prior = 1 + PRIOR * counts.sum()
    for _ in range(rounds):
        logs = np.log(tables[:, np.arange(N_LABELERS)[None, :], cast]).sum(axis=2)
        odds = logs[1] - logs[0] + math.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - belief).max() < 1e-9
        belief = new
        if done:
            break
        share = float(np.clip((counts @ belief + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        for y, weight in ((0, counts * (1 - belief)), (1, counts * belief)):
            for v in range(3):
                tables[y, :, v] = ((cast == v) * weight[:, None]).sum(axis=0) + prior * start[y, v]
            tables[y] /= tables[y].sum(axis=1, keepdims=True)
    return dict(zip(codes, belief.tolist()))


def train(patterns: dict[int, int], beliefs: dict[int, float], ridge: float = 1.0) -> dict[int, float]:
    """The span classifier's probability for each pattern: logistic regression on kind and votes.

    It is fitted to the beliefs, each pattern weighing as much as it has candidates, by Newton steps until they stand
    still.
    """
    codes = sorted(patterns)
    if not codes:
        return {}
    x = np.array([[1.0, *(np.arange(4, len(KINDS)) == k), *np.array(v)] for k, v in map(decode, codes)])
    n, y = np.array([patterns[c] for c in codes], float), np.array([beliefs[c] for c in codes])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))).tolist()))


def label(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``base`` spans and ``more``, the candidates with their votes; narrow, stored once."""
    chosen = documents.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(text).cast("string").alias("text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    span = "array<struct<kind:int,start:int,end:int,code:int>>"
    return store(chosen.mapInArrow(_label, f"{kinds}base {span}, more {span}"))


def accepted(labelled: DataFrame, least: float = ACCEPT) -> list[int]:
    """The vote patterns that the trained classifier calls personal; there are at most len(KINDS) * 3 ** N_LABELERS."""
    counted = labelled.select(F.explode("more.code").alias("code")).groupBy("code").count().collect()
    patterns = {r["code"]: r["count"] for r in counted}
    return [c for c, p in train(patterns, estimate(patterns)).items() if p >= least]


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the number of base spans per kind, their digest, and all spans as kind:start:end.

    Spans are code points of the whole text, end exclusive, ordered by kind and start. Base spans always stay; the
    classifier adds candidates that it calls personal: secrets, account numbers, national telephone numbers and
    spelled-out e-mail addresses, none of them over a base span. Null texts count as empty, repeated rows stay
    repeated, other columns are not read. Its counts of votes cover all candidates of all texts.
    """
    labelled = label(documents, keys, text)
    yes = F.array(*[F.lit(c) for c in accepted(labelled)]).cast("array<int>")
    every = F.sort_array(F.concat("base", F.filter("more", lambda s: F.array_contains(yes, s["code"]))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = {f"n_{k}": F.size(F.array_remove(kinds, -1)) - F.size(F.array_remove(kinds, i)) for i, k in enumerate(KINDS[:4])}
    return labelled.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
        *[c.cast("long").alias(n) for n, c in counts.items()],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        (F.size(every) - F.size("base")).cast("long").alias("n_added"),
    )


def mask(text: str, allowed: frozenset[int]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    sure = base_spans(text)
    spans = sorted([(s, -e, k) for k, s, e in sure] + [(s, -e, k) for k, s, e, v in candidates(text, sure) if code(k, v) in allowed])
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def mask_personal(documents: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked in ``text`` and ``n_chars`` counted anew; nulls stay null."""
    allowed = frozenset(accepted(label(documents, [], text)))
    names = documents.columns
    at, size = names.index(text), names.index(n_chars)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else mask(x.as_py(), allowed) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            columns[size] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(rewrite, T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema]))
