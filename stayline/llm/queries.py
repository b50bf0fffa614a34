"""Named queries of the ten operators and the pipeline over the whole test tables, with statements where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import bagminhash, chat, decontaminate, html, lm, packing, pii, repair, rules, runs, substrings, suffixes, toxicity

QUERIES = {}
ORACLES = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


@query(
    "op1_prefix_targets",
    """
    WITH rows_ AS (
      SELECT conv_id, turn, role, COALESCE(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
    ), escaped AS (
      SELECT *, 4 + length(role) + 2 + length(regexp_replace(text, '\\\\|###|</turn>', '\\\\\\0', 'g')) + 8 AS n,
        COUNT(*) OVER (PARTITION BY conv_id) AS size, ROW_NUMBER() OVER w AS k, role = 'assistant' AS target
      FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
    ), prefixes AS (
      SELECT *, SUM(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM escaped
    )
    SELECT conv_id, COUNT(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
      COALESCE(SUM(length(text)) FILTER (target), 0)::BIGINT AS loss_chars,
      sha256(COALESCE(string_agg(text, '' ORDER BY k) FILTER (target), '')) AS loss_sha256,
      SUM(CASE WHEN target OR k = size THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
      SUM(CASE WHEN target OR k = size THEN 1 ELSE 0 END)::BIGINT AS n_examples
    FROM prefixes GROUP BY conv_id
    """,
)
def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.prefix_examples(rows.unionByName(odd)))


@query("op3_article_text")
def op3_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_articles(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query(
    "op5_repeated_windows",
    """
    WITH words AS (
      SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), windows AS (
      SELECT doc_id, UNNEST(range(1, GREATEST(len(w) - 48, 1))) AS i, w FROM words
    ), hashed AS (
      SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM windows
    ), later AS (
      SELECT doc_id, i FROM hashed
      JOIN (SELECT h, MIN(doc_id) AS a FROM hashed GROUP BY h HAVING MIN(doc_id) < MAX(doc_id)) USING (h) WHERE doc_id > a
    ), gone AS (
      SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM later GROUP BY doc_id
    ), marked AS (
      SELECT words.doc_id, w, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT COALESCE(list_contains(g, i), false))) AS k
      FROM words LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed,
      sha256(COALESCE(array_to_string(list_transform(k, lambda i: w[i]), ' '), '')) AS kept_sha256
    FROM marked
    """,
)
def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op9_best_fit")
def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), ["doc_id"], path))


@query(
    "op10_host_rules",
    """
    WITH words AS (
      SELECT doc_id, source AS host, COALESCE(text, '') AS text,
        regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents
    ), windows AS (
      SELECT doc_id, UNNEST(range(1, GREATEST(len(w) - 1, 1))) AS i, w FROM words
    ), grouped AS (
      SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, w[i], w[i + 1], w[i + 2] HAVING COUNT(*) > 1
    ), covered AS (
      SELECT doc_id, COUNT(DISTINCT p + d) AS n FROM (SELECT doc_id, UNNEST(places) AS p FROM grouped), range(0, 3) t(d) GROUP BY doc_id
    ), measured AS (
      SELECT words.doc_id, host, len(w)::BIGINT AS n_words, COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, COALESCE(n, 0)::BIGINT AS n_repeat_words
      FROM words LEFT JOIN covered USING (doc_id)
    ), failed AS (
      SELECT *, n_words < 50 AS fails_length, 100 * n_repeat_words > 50 * n_words AS fails_repetition,
        2 * n_symbols > n_words AS fails_symbols, 2 * n_dup_lines > n_lines AS fails_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
      FROM measured
    ), long AS (
      SELECT host, rule, COUNT(*) AS n, SUM(hit::INT) AS k FROM (
        SELECT host, UNNEST(['a', 'b', 'c', 'd']) AS rule,
          UNNEST([fails_length, fails_repetition, fails_symbols, fails_lines]) AS hit FROM failed
      ) GROUP BY host, rule
    ), means AS (SELECT rule, SUM(k) / SUM(n) AS m FROM long GROUP BY rule),
    spread AS (
      SELECT rule, MAX(m) AS m, SUM(n * (k / n - m) ** 2) / SUM(n) AS v FROM long JOIN means USING (rule) GROUP BY rule
    ), verdicts AS (
      SELECT host, MAX((k + m * s) / (n + s)) AS host_rate FROM (
        SELECT long.*, m, LEAST(GREATEST(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000 END, 1), 10000) AS s
        FROM long JOIN spread USING (rule)
      ) GROUP BY host
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND host_rate <= 0.5 AS kept
    FROM failed JOIN verdicts ON failed.host IS NOT DISTINCT FROM verdicts.host
    """,
)
def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id of every document: the smallest doc_id that it is linked to, over any number of links."""
    found = bagminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "class_id", "class_size")


@query("op2_cross_entropy_difference")
def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good; background: all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.score_difference(table(spark, sf_dir, "documents"), good)


@query("op4_edit_matches")
def op4_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, with its distance and place."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_items(documents, benchmark, ["doc_id"])


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.learn(documents, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score_documents(documents, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def crc32_sql(text: str) -> str:
    """The crc32 of an ASCII string bit by bit, for DuckDB has no function for it."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce({steps}, {step}, 4294967295::BIGINT), 4294967295)"


@query(
    "op11_periodic_runs",
    f"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
    ), draws AS (
      SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM words
    ), changed AS (
      SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
        w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM draws
    ), places AS (
      SELECT doc_id, n, UNNEST(w) AS word, UNNEST(range(n)) AS i FROM changed
    ), alike AS (
      SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y
      ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
    ), islands AS (
      SELECT doc_id, q, i, i - ROW_NUMBER() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike
    ), stretches AS (
      SELECT doc_id, MIN(i) AS start, COUNT(*) + q AS length, q FROM islands GROUP BY doc_id, q, island
    ), runs AS (
      SELECT doc_id, start, length, MIN(q) AS period FROM stretches WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length
    ), longest AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM runs
    ), listed AS (
      SELECT doc_id, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        MAX(start) FILTER (place = 1) AS start, MAX(length) FILTER (place = 1) AS length, MAX(period) FILTER (place = 1) AS period
      FROM longest GROUP BY doc_id
    ), gone AS (
      SELECT DISTINCT doc_id, UNNEST(range(start + period, start + length)) AS i FROM runs
    ), kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
      sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(kept.text, '')) AS collapsed_sha256
    FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(documents, ["doc_id"], runs.repeat_tails(F.col("text"), F.col("doc_id")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # exact order of length / period: cross products
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", 0),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    exponent = F.floor(1000 * best["length"] / best["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), exponent.alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _cheapest_sql(*candidates: tuple[str, int, str, str]) -> str:
    """The least of (state, added cost, edits, lines), as a struct."""
    parts = (f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edits}', 'r': {s}.r || {lines}}}" for s, cost, edits, lines in candidates)
    return f"list_min([{', '.join(parts)}])"


def _repair_sql() -> str:
    far = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
    user, assistant, nothing = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "''"
    kept = "chr(10) || role || ':' || text"
    both = f"{user} || {assistant}"
    to_user, to_assistant = f"{user} || text", f"{assistant} || text"
    allowed = "CASE WHEN doomed THEN 1000000000 ELSE 0 END + CASE WHEN cut THEN 5 ELSE 0 END"

    def keep(initial: str) -> str:
        return f"{allowed} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END"

    return f"""
    WITH RECURSIVE given AS (
      SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
        {crc32_sql("COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        UNNEST(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM given WHERE draw <> 0
    ), ordered AS (
      SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inner_text, substr(role, 1, 1) AS initial,
        ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
    ), numbered AS (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM ordered
    ), judged AS (
      SELECT *, inner_text = '' AS blank, inner_text <> '' AND seen > 1 AS duplicate,
        inner_text <> '' AND seen = 1 AND right(inner_text, 1) NOT IN ('.', '!', '?') AS cut,
        inner_text = '' OR seen > 1 AS doomed, LAG(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
      FROM numbered
    ), steps AS (
      SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {far} AS ss, {far} AS su, {far} AS sa
      FROM (SELECT DISTINCT conv_id FROM judged)
      UNION ALL
      SELECT conv_id, k, {_cheapest_sql(("e0", 2, "D", nothing))}, {_cheapest_sql(("es", 2, "D", nothing), ("e0", keep("s"), "K", kept))},
        {_cheapest_sql(("eu", 2, "D", nothing), *((e, keep("u"), "K", kept) for e in ("e0", "es", "ea")), *((e, f"1 + {allowed}", "R", to_user) for e in ("e0", "es", "ea")))},
        {_cheapest_sql(("ea", 2, "D", nothing), ("eu", keep("a"), "K", kept), ("eu", f"1 + {allowed}", "R", to_assistant))}
      FROM (
        SELECT judged.conv_id, judged.k, role, text, initial, cut, doomed, s0 AS e0, ss AS es,
          {_cheapest_sql(("su", 0, "", nothing), *((s, 5, "I", user) for s in ("s0", "ss", "sa")))} AS eu,
          {_cheapest_sql(("sa", 0, "", nothing), ("su", 5, "I", assistant), *((s, 10, "II", both) for s in ("s0", "ss")))} AS ea
        FROM steps JOIN judged ON judged.conv_id IS NOT DISTINCT FROM steps.conv_id AND judged.k = steps.k + 1
      )
    ), report AS (
      SELECT conv_id, COUNT(*) AS k, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank,
        COUNT(*) FILTER (duplicate) AS duplicate, COUNT(*) FILTER (cut) AS truncated,
        COUNT(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
    ), ended AS (
      SELECT conv_id, k, {_cheapest_sql(("s0", 0, "", nothing), ("sa", 0, "", nothing), ("su", 5, "I", assistant), ("ss", 10, "II", both))} AS best
      FROM steps
    ), done AS (
      SELECT report.*, best FROM report JOIN ended ON report.conv_id IS NOT DISTINCT FROM ended.conv_id AND report.k = ended.k
    )
    SELECT o.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
      COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(best.c, 0) AS cost, COALESCE(best.a, '') AS audit,
      sha256(substr(COALESCE(best.r, ''), 2)) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
    """


@query("op12_repaired_conversations", _repair_sql())
def op12_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, turns = repair.repair_conversations(repair.damage(rows))
    digests = repair.repaired_digests(turns)
    asked = rows.select("conv_id").distinct()
    out = asked.join(report, asked.conv_id.eqNullSafe(report.conv_id), "left").drop(report.conv_id)
    out = out.join(digests, out.conv_id.eqNullSafe(digests.conv_id), "left").drop(digests.conv_id)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query(
    "op13_repeated_bytes",
    """
    WITH given AS (
      SELECT doc_id, lower(hex(encode(COALESCE(text, '')))) AS x, strlen(COALESCE(text, '')) AS n FROM documents
    ), pieces AS (
      SELECT doc_id, n, c, substr(x, 200 * c + 1, 298) AS x FROM (SELECT doc_id, x, n, UNNEST(range((n + 99) // 100)) AS c FROM given)
    ), windows AS (
      SELECT doc_id, 100 * c + j + 1 AS i, md5(substr(x, 2 * j + 1, 100)) AS h FROM pieces, range(100) t(j) WHERE 100 * c + j + 50 <= n
    ), later AS (
      SELECT doc_id, i FROM windows
      JOIN (SELECT h, MIN(doc_id) AS a FROM windows GROUP BY h HAVING MIN(doc_id) < MAX(doc_id)) USING (h) WHERE doc_id > a
    ), stretches AS (
      SELECT doc_id, MIN(i) AS a, MAX(i) + 50 AS b FROM (
        SELECT doc_id, i, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (
          SELECT doc_id, i, COALESCE(i - LAG(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS fresh FROM later))
      GROUP BY doc_id, part
    ), gaps AS (
      SELECT doc_id, a, b, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM stretches
    ), cut AS (
      SELECT doc_id, COUNT(*) AS n_spans, SUM(b - a)::BIGINT AS n_removed,
        string_agg(substr(x, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) || substr(ANY_VALUE(x), 2 * MAX(b) - 1) AS kept
      FROM gaps JOIN given USING (doc_id) GROUP BY doc_id
    )
    SELECT doc_id, n AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
      sha256(unhex(COALESCE(kept, x))) AS kept_sha256
    FROM given LEFT JOIN cut USING (doc_id)
    """,
)
def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
