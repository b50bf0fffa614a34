"""The operators on small tables: brute force, round trips, and nulls, empty tables, repeats and extra columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from oracle_compare import differences, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

import corpus_pipeline
from stayline.llm import bagminhash, blocks, chat, decontaminate, html, lm, packing, pii, queries, rules, substrings, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{i % 97}x{i}" for i in range(120))
ROWS = [
    (1, WORDS, "en", "a", None), (2, WORDS, "en", "a", 1), (3, "fresh " + WORDS, None, None, 2), (4, None, None, None, None),
    (5, "", "en", "b", 0), (None, WORDS, "en", "b", 3), (6, "one two", "en", "b", 7), (6, "one two", "en", "b", 7),
    (7, "x " * 30_000, "en", "a", 60_000), (8, " \n\t ", "en", "a", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    extra = {n: F.lit("clash") for n in ("text_a", "mark", "id", "host", "node", "bucket", "kept", "piece", "key_0")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, name):
    assert differences(queries.QUERIES[name](spark, SF).toArrow(), duck(SF).execute(queries.ORACLES[name]).to_arrow_table()) == []


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a</turn>\\###"), (1, 0, "us:er", None), (1, 2, "user", "tail"), (None, None, None, None), (2, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.prefix_examples(frame)
    found = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert found[1].n_turns == 3 and found[1].n_examples == 2 and found[1].loss_chars == len("a</turn>\\###")
    turns = "us:er\n\nassistant\na</turn>\\###\nuser\ntail\n"
    assert found[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert found[2].loss_chars == 0 and found[None].n_turns == 1
    assert chat.prefix_examples(frame.limit(0)).count() == 0
    for text in ("\\", "####", "</turn></turn>\\", "\\### Assistant: </turn> ok", ""):
        assert chat.parse_turns(chat.format_turn("r:#<\\", text)[0] * 2) == [("r:#<\\", text)] * 2


def test_lm_against_counts(spark, docs, nothing):
    target = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    got = sorted((r.doc_id or 0, r.n_words, round(r.score, 4)) for r in lm.score_difference(docs, target, block_text=5_000, slice_keys=50).collect())
    texts = [(r[0], (r[1] or "").encode().split()) for r in ROWS]
    vocabulary = len({w for _, t in texts for w in t})
    every, part = Counter(), Counter()
    for i, t in texts:
        for v, w in zip([None, *t], t):
            for c in (every, part) if i == 1 else (every,):
                c[v, w] += 1
                c[v] += 1
    a, want = lm.SMOOTHING, []
    for i, t in texts:
        loss = [sum(math.log(c[v] + a * vocabulary) - math.log(c[v, w] + a) for v, w in zip([None, *t], t)) for c in (part, every)]
        want.append((i or 0, len(t), round((loss[0] - loss[1]) / max(1, len(t)), 4)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert all(abs(x[2] - y[2]) < 0.1 for x, y in zip(got, sorted(want)))  # the vocabulary's size is a sketch's
    assert lm.score_difference(nothing, target).count() == 0


def test_html():
    page = (
        "<html><body><header>Top</header><nav><a href=/>Menu</a></nav><div class='cookie-notice'>Agree</div><article>"
        "<h1>T &amp; U</h1><p>One  two<br>three<p>Short<p>" + "long text " * 30 + "<ul><li>i1<li>i2</ul><aside>x</aside>"
        "<form>f</form></article><div id=comments><p>" + "nice post " * 60 + "</p></div><footer>&copy;</footer><script>var a='<p>';</script>"
    )
    assert html.main_text(page) == "T & U\nOne two three\nShort\n" + ("long text " * 30).strip() + "\ni1\ni2"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a</nav>") == ""
    assert html.main_text("plain &lt; text") == "plain < text"
    plain = "<body><div class=sidebar><p>s</p></div><div><h2>H</h2><p>a b</p><p>c</p></div></body>"
    assert html.main_text(plain) == "H\na b\nc"


WRAPPERS = [
    "<div class='content has-sidebar'>", "<div class='layout-with-sidebar'>", "<div class='post no-comments'>", "<div id='notice-board'>",
    "<section class='social-science'>", "<div class='related-work'>", "<form action=/ method=post>", "<section role=dialog>",
    "<form><div class='content has-sidebar'><div id=notice-board>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_wrappers(wrapper):
    """A class, role or form around the article does not remove it; beside or in the article they still mark what is none."""
    body = "<h1>Head</h1><p>" + "long text " * 30 + "</p><p>Last one</p>"
    want = "Head\n" + ("long text " * 30).strip() + "\nLast one"
    inner = "<div class=sidebar><p>Other pages of interest</p></div><form>Mail me</form>"
    ends = "".join(f"</{t}>" for t in reversed(html.re.findall(r"<(\w+)", wrapper)))
    assert html.main_text(f"<body><div>Name of the site</div>{wrapper}{body}{inner}{ends}<footer>f</footer></body>") == want
    comments = "<div id=comments><p>" + "nice post " * 60 + "</p></div>"
    for page in (f"{wrapper}<article>{body}{inner}</article>{comments}{ends}", f"{wrapper}<article>{body}</article>{ends}{comments}"):
        assert html.main_text(f"<body>{page}</body>") == want


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract_articles(pages, ["page_id", "url"]).collect()) == ["", "x", "x"]


def test_decontamination(spark, docs, nothing):
    item = "the quick brown fox jumps over the lazy dog while nobody else is looking at all today"
    changed = item.replace("quick", "quik").replace("lazy", "lazzy")
    rows = [(1, f"before {item.upper()}\n after"), (2, f"x {changed} y"), (3, item[:40]), (4, None), (5, ""), (1, f"{item} {item}")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    benchmark = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "short")], "item_id long, text string")
    found = sorted(decontaminate.find_items(texts, benchmark, ["doc_id"]).collect())
    assert [(r.doc_id, r.item_id, r.distance) for r in found] == [(1, 7, 0), (1, 7, 0), (2, 7, 2)]
    assert rows[1][1][found[2].span_start : found[2].span_end] == changed
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(texts, benchmark).collect()) == [3, 4, 5]
    assert decontaminate.find_items(docs, benchmark.limit(0), ["doc_id"]).count() == 0
    assert decontaminate.drop_contaminated(nothing, benchmark).count() == 0


def test_myers_against_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 70), rng.integers(0, 90)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.myers(p, decontaminate.masks(p), t)[0] == min(row)


def test_substrings(spark, docs, nothing):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.remove_repeated(docs).collect()}
    assert got[1, 120] == 0 and got[2, 120] == 120 and got[3, 121] == 120 and got[None, 120] == 120 and got[7, 30_000] == 0
    assert got[4, 0] == got[5, 0] == got[8, 0] == got[6, 2] == 0
    assert substrings.remove_repeated(nothing).count() == 0


def test_personal_data(spark, docs):
    text = (
        "mail a.b@c.de, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, call +49 (30) 1234-5678 now; "
        'token = "0123456789abcdef0123456789abcdef01234567" end'
    )
    frame = spark.createDataFrame([(1, text), (2, None), (3, "é" * 9 + " x@y.z"), (1, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_personal(frame, ["doc_id"]).collect()}
    assert (found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone, found[1].n_added) == (1, 1, 1, 1, 1)
    assert found[2].spans == "" and found[3].spans == "email:10:15"
    assert ",secret:" in found[1].spans and found[1].spans.startswith("email:5:13,ip:18:26,")
    masked = pii.mask_personal(frame.withColumn("n_chars", F.lit(0))).collect()
    assert [r.n_chars for r in masked if r.doc_id == 2] == [None] and all("@" not in (r.text or "") for r in masked)
    assert pii.find_personal(docs, ["doc_id"]).count() == len(ROWS)
    assert pii.find_personal(docs.limit(0), ["doc_id"]).count() == 0


def test_candidates_after_words_with_digits():
    """Each word is judged by itself, whatever stands before it; spoken e-mails are found in any case."""
    hex_ = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    for text in (f"key1 {hex_}", f"2024-05-01 {hex_[:24]}", f"id 7 {hex_} 8 9 {hex_}", f"a1 4{hex_}"):
        words = [w for w in text.split() if len(w) > 20]
        assert [text[s:e] for _, s, e, _ in pii.candidates(text, [])] == words
    for text in ("write to john AT example DOT com now", "john (At) example (Dot) com"):
        assert [pii.KINDS[k] for k, *_ in pii.candidates(text, [])] == ["spoken_email"]
    assert [text for text in ("call 1 555 234 5678 9", "212 555 1234") if not pii.candidates(text, [])] == []


def test_toxicity(spark, docs):
    rows = [(i, f"calm words number {i} here, stupid question {i % 3}" if i % 3 else f"you st0pid1sh 1dіоt {i} go") for i in range(90)]
    frame = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(frame, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(frame, model, ["doc_id"]).collect()}
    assert all((scores[i] >= toxicity.THRESHOLD) == (i % 3 == 0) for i in range(60, 90))
    assert scores[100] == scores[101] < 0.5
    empty = toxicity.learn(frame, labels.limit(0))
    assert max(r.score for r in toxicity.score_documents(docs, empty, ["doc_id"]).collect()) < 0.5


def test_near_duplicates(spark, docs, nothing):
    found = [(r.doc_id, r.class_id, r.class_size) for r in bagminhash.near_duplicates(docs).collect()]
    assert {x[:2] for x in found if x[2] == 4} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert found.count((6, 6, 2)) == 2 and (4, 4, 1) in found and (5, 5, 1) in found
    assert bagminhash.near_duplicates(nothing).count() == 0


def classes(texts: dict) -> dict:
    """Brute force: the smallest id of each connected part of the similar pairs."""
    bags = {i: bagminhash.bag(t or "") for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [(i, j) for i in ids for j in ids if i < j and len(bags[i][0]) and bagminhash.similarity(bags[i], bags[j]) >= 0.8]
    for _ in ids:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_duplicates_against_all_pairs(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = classes({r.doc_id: r.text for r in frame.collect()})
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == want


def test_links_whose_registers_agree_by_chance(spark):
    """Two near copies meet in one bucket among strangers; an earlier band agrees in its registers' bytes alone."""
    alike = {"a": WORDS, "b": WORDS + " more"}
    texts = alike | {f"n{i}": " ".join(f"other{i}x{k}" for k in range(20)) for i in range(40)}
    rng = np.random.default_rng(1)
    registers = {n: bytes(320) if n in alike else rng.integers(1, 256, 320).astype(np.uint8).tobytes() for n in texts}
    members = spark.createDataFrame([(3, 77, n) for n in texts], "band int, bucket long, node string")
    frame = spark.createDataFrame([(n, t, registers[n]) for n, t in texts.items()], "node string, text string, registers binary")
    assert {r.node: r.label for r in bagminhash.linked(members, frame, 0.8).collect()} == {"a": "a", "b": "a"}


def near_family(size: int) -> dict:
    """Texts of one bucket around the threshold: each differs from one base text in its own places."""
    rng = np.random.default_rng(11)
    base = [f"base{i}" for i in range(300)]
    texts = {}
    for n in range(size):
        words = list(base)
        for k in rng.choice(300, int(rng.integers(2, 11)), replace=False).tolist():
            words[k] = f"own{n}x{k}"
        texts[f"n{n:03}"] = " ".join(words)
    return texts


@pytest.mark.parametrize(("stars", "choices"), [(2, 3), (1, 1), (1, 0)])
def test_one_bucket_of_texts_around_the_threshold(spark, monkeypatch, stars, choices):
    """All links of a hot bucket are found in each mix of rounds, and classes equal those of all pairs."""
    for name, value in (("STARS", stars), ("CHOICES", choices), ("LOT", 16), ("MARGIN", 0.8)):
        monkeypatch.setattr(bagminhash, name, value)
    texts = near_family(70)
    bags = {n: bagminhash.bag(t) for n, t in texts.items()}
    label = {n: n for n in texts}
    links = [(a, b) for a in texts for b in texts if a < b and bagminhash.similarity(bags[a], bags[b]) >= 0.8]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    members = spark.createDataFrame([(b, n) for n in texts for b in (77, 78)], "bucket long, node string")
    frame = spark.createDataFrame([(n, t, bytes(320)) for n, t in texts.items()], "node string, text string, registers binary")
    got = {r.node: r.label for r in bagminhash.linked(members, frame, 0.8).collect()}
    assert links and {n: got.get(n, n) for n in texts} == label


def test_rows_of_open_candidates_do_not_grow_with_lots(spark, monkeypatch):
    """Texts of one hot bucket that agree but do not link: no step gives a row for each text and lot of texts."""
    monkeypatch.setattr(bagminhash, "LOT", 4)
    made, keep = [], bagminhash.store

    def counted(frame):
        out = keep(frame)
        if "others" in frame.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(bagminhash, "store", counted)
    texts = {f"{i:03}": " ".join(f"own{i}x{k}" for k in range(30)) for i in range(96)} | {"100": WORDS, "101": WORDS + " more"}
    members = spark.createDataFrame([(b, n) for n in texts for b in range(70, 75)], "bucket long, node string")
    frame = spark.createDataFrame([(n, t, bytes(320)) for n, t in texts.items()], "node string, text string, registers binary")
    got = {r.node: r.label for r in bagminhash.linked(members, frame, 0.8).collect()}
    assert got["100"] == got["101"] == "100"
    assert made and max(made) <= 2 * len(texts) * -(-len(texts) // (bagminhash.COMPARED * bagminhash.LOT))


def test_sieve_keeps_all_wanted_rows(spark, monkeypatch):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("name"))
    wanted = rows.filter("id % 40 = 3").union(rows.filter("id % 40 = 3"))
    kept = {r.id for r in bagminhash.sifted(rows, wanted, ["id", "name"]).collect()}
    assert {i for i in range(20_000) if i % 40 == 3} <= kept and len(kept) < 3_000
    assert bagminhash.sifted(rows, wanted.limit(0), ["id", "name"]).count() == 0
    monkeypatch.setattr(bagminhash, "MOST_BITS", 64)  # too few bits let rows through and lose none
    assert {i for i in range(20_000) if i % 40 == 3} <= {r.id for r in bagminhash.sifted(rows, wanted, ["id", "name"]).collect()}


def test_workers_give_memory_back():
    """What a task has freed between blocks that it keeps does not stay with the worker."""
    import os
    import pathlib

    def held() -> float:
        return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    kept = []

    def work():
        blocks = [bytearray(60_000) for _ in range(4_000)]
        kept.append(blocks[-1])
        yield None

    before = held()
    assert list(blocks.released(work())) == [None]
    assert held() - before < 60


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    values = rng.integers(1, 2**63, 300).astype(np.uint64)
    one, two = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    signs = [bagminhash.signatures(np.zeros(300, int), values, w, 1, 8000) for w in (one, two)]
    assert abs((signs[0] == signs[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.02


def check_packing(rows, texts: dict):
    path = Tokenizer.from_file(queries.public_tokenizers.path("word_bpe_49k.json"))  # unaltered
    ids = {i: [*path.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    bins, seen = {}, Counter()
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(part) and r.start == 4096 * r.piece and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()]
    return len(bins), -(-sum(map(len, ids.values())) // 4096)


def test_packing(spark, docs, nothing):
    rows = queries.op9_best_fit(spark, SF).collect()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check_packing(rows, {r.doc_id: r.text for r in frame.collect()})
    assert used <= least * 1.02 + 1
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(packing.tokenise(nothing, ["doc_id"], path)).count() == 0
    tight = packing.pack(packing.tokenise(docs.filter("n_chars < 10"), ["doc_id"], path, with_ids=True), max_documents=2).collect()
    assert max(Counter(r.sequence_id for r in tight).values()) <= 2 and all(len(r.ids) == r.length for r in tight)


def test_ids_of_special_strings(spark, monkeypatch):
    """Special tokens' strings inside texts, and a cache that starts anew, against the unaltered tokenizer."""
    monkeypatch.setattr(packing, "KNOWN_WORDS", 12)
    rng = np.random.default_rng(8)
    parts = ["<|startoftext|>", "<|endoftext|>", "word", "é", "x<|endoftext|>y", "\x01", " ", "\n", "<|", "The", "end.", *(f"w{i}" for i in range(30))]
    texts = ["".join(rng.choice(parts, 12)) + " " + " ".join(rng.choice(parts, 9)) for _ in range(60)]
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    rows = packing.tokenise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"], path, with_ids=True).collect()
    plain = Tokenizer.from_file(path)
    assert {r.doc_id: r.ids for r in rows} == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    for _ in range(2):  # the second time the words are known
        for r in range(len(texts)):
            ids, _ = packing.encode_block(path, np.frombuffer(data[r], np.uint8), offsets[r : r + 2] - offsets[r])
            assert ids.tolist() == [*plain.encode(texts[r], add_special_tokens=False).ids, 1]


@pytest.fixture
def given(monkeypatch):
    """Lengths of all that is given to the tokenizer at once, and a worker without known words."""
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    lots, plain = [], Tokenizer.from_file(path)

    class Counting:
        def encode_batch_fast(self, texts, **options):
            lots.append(sum(len(re.sub("\x01", "", x).split()) for x in texts))
            return plain.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(plain, name)

    monkeypatch.setattr(packing, "tokenizer", lambda path: Counting())
    monkeypatch.setattr(packing, "word_ids", lru_cache(packing.WordIds))
    return path, plain, lots


def encoded(path, texts):
    data = [t.encode() for t in texts]
    ids, starts = packing.encode_block(path, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(starts)]


def test_word_is_encoded_once_in_all_its_spellings(given):
    path, plain, lots = given
    words = ["some", "straße", "naïve", "x"]
    texts = [f"{x}{tail} {x}" for w in words for x in (w, w.title(), w.replace("s", "S")) for tail in ("", ",", ".", "...", ");")]
    for _ in range(2):
        assert encoded(path, texts) == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sum(lots) == len(words) + 4


def test_ids_of_parted_words(given):
    """Words of every kind with tails of every kind, against the unaltered tokenizer."""
    path, plain, lots = given
    rng = np.random.default_rng(9)
    heads = ["Word", "É", "été", "e\u0301", "E\u0301", "ÀÇ×", "÷", "Straße", "ΟΔΟΣ", "İI", "\u212b", "Привет", "日本", "3", "3.14", "x²", "don't", "I'LL",
             "'s", "''t", "<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|", "…", "\x1c", "\x01", "\x7f", "a\x00b", "\u00a0", "\u2028a", "</w>", "_", "ﬁ"]
    tails = ["", "", ",", ".", "...", "'", "'s", "!?", "</w>", "|>", "<|endoftext|>", "\u0338", "<\u0338", "\u0301", "_", "\x1f", "é", "É.", "9,", "«"]
    texts = ["", " ", *(" ".join("".join(rng.choice([*heads, *tails], rng.integers(1, 4))) for _ in range(30)) for _ in range(150))]
    texts += [f"{h}{t}" for h in heads for t in tails]
    assert encoded(path, texts) == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [encoded(path, [t])[0] for t in texts] == encoded(path, texts)


def test_vocabulary_that_keeps_capitals_or_tails(given, monkeypatch):
    """Without lowering, or with words that keep their symbols, words are encoded whole."""
    path, plain, lots = given
    assert packing.WordIds(path).splits
    texts = ["Word word word, WORD. don't 7,"]
    for part, other in (("normalizer", normalizers.NFC()), ("pre_tokenizer", pre_tokenizers.WhitespaceSplit())):
        kept = getattr(plain, part)
        setattr(plain, part, other)
        assert not packing.WordIds(path).splits
        packing.word_ids.cache_clear()
        assert encoded(path, texts) == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        setattr(plain, part, kept)


def test_numbers_of_any_length():
    assert pii.base_spans("0" * 5000 + ".1.1.1 and " + "9" * 6000 + ".1.1.1") == [(1, 0, 5006)]


def test_rules(spark, docs, nothing):
    rows = {r.doc_id: r for r in rules.judge(docs, ["doc_id"]).collect()}
    assert rows[4].n_words == rows[5].n_words == rows[8].n_words == 0 and rows[4].base_failed
    assert rows[7].n_repeat_words == 30_000 and rows[7].base_failed and rows[1].word_chars == sum(map(len, WORDS.split()))
    assert rules.judge(docs, ["doc_id"]).count() == len(ROWS) and rules.judge(nothing, ["doc_id"]).count() == 0


def test_pipeline_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op10_host_rules(spark, SF).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id in kept}
    texts = {i: texts[i] for i, c in classes(texts).items() if i == c}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text: str) -> bool:
        plain = decontaminate.normalise(text)
        return any(decontaminate.myers(i, decontaminate.masks(i), plain)[0] <= decontaminate.budget(len(i)) for i in items)

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    frame = documents.filter(F.col("doc_id").isin(list(texts)))
    check_packing(rows, {r.doc_id: r.text for r in pii.mask_personal(frame).collect()})


def test_stages_keep_columns(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, DOCS)
    for name in ("documents", "benchmark"):
        source = frame if name == "documents" else spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string")
        source.write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (frame, frame.limit(0)):
            assert stage(spark, rows, str(tmp_path)).columns == frame.columns
    near = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in near) == [1, 4, 5, 6, 7, 8]
