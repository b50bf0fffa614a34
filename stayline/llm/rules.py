"""Quality rules per document and per host, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import store

# Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\f\r"

# Defaults of the host verdict.
MAX_HOST_RATE = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0

RULES = ("fails_length", "fails_repetition", "fails_symbols", "fails_lines")


def _repeated_words(words: Column, n_words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the same list.

    The windows' hashes are sorted with their positions, so equal ones are neighbours: n log n for any text.
    """
    windows = F.transform(
        F.slice(words, 1, n_words - 2),
        lambda word, i: F.struct(F.xxhash64(word, words[i + 1], words[i + 2]).alias("h"), i.alias("p")),
    )
    return F.sort_array(windows)


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to every row.

    A null or empty text has zeros throughout. Words are runs of characters other than ASCII white space, read from
    the whole text.
    """
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, " " * len(BLANKS))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    out = documents.withColumns({"_flat": F.btrim(flat), "_lines": lines})
    out = out.withColumns(
        {
            "_words": F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", " +")),
            "word_chars": F.char_length(F.translate("_flat", " ", "")).cast("long"),
            "n_symbols": (F.char_length("_flat") - F.char_length(F.translate("_flat", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    size = F.col("n_words").cast("int")
    out = out.withColumn("_windows", F.when(size >= 3, _repeated_words(F.col("_words"), size)))
    sorted_windows = F.col("_windows")
    covered = F.transform(
        sorted_windows,
        lambda x, i: F.when(
            (x["h"] == F.get(sorted_windows, i - 1)["h"]) | (x["h"] == F.get(sorted_windows, i + 1)["h"]), x["p"]
        ),
    )
    out = out.withColumn("_repeated", F.filter(covered, lambda p: p.isNotNull()))
    out = out.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.size(F.array_distinct(F.flatten(F.transform("_repeated", lambda p: F.array(p, p + 1, p + 2))))), F.lit(0)
        ).cast("long"),
    )
    return out.drop("_flat", "_lines", "_words", "_windows", "_repeated")


def rule_failures(statistics: DataFrame) -> DataFrame:
    """Add one boolean per rule, and base_failed (too short, or mostly repeated windows).

    Besides the two base rules, a text fails with more than one symbol for two words, or with more than half of its
    lines equal to an earlier one.
    """
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    out = statistics.withColumns(
        {
            "fails_length": words < MIN_WORDS,
            "fails_repetition": 100 * repeated > MAX_REPEATED_PERCENT * words,
            "fails_symbols": 2 * F.col("n_symbols") > words,
            "fails_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        }
    )
    return out.withColumn("base_failed", F.col("fails_length") | F.col("fails_repetition"))


def shrunken_rates(failures: DataFrame, host: str, rules: tuple[str, ...] = RULES) -> DataFrame:
    """One row per host: documents, and for each rule its failure rate shrunk towards all hosts' rate.

    The beta prior of a rule is fitted to the hosts by moments: mean of all documents, strength from the spread of the
    hosts' rates weighted by their documents. With one host, or without spread, the strength is its upper bound; where
    every document agrees, the shrunken rate is that common rate. Null is a host of its own.
    """
    hosts = failures.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_documents"), *[F.sum(F.col(r).cast("long")).alias(f"n_{r}") for r in rules]
    )
    total = F.sum("n_documents")
    means = hosts.agg(*[(F.sum(f"n_{r}") / F.greatest(total, F.lit(1))).alias(f"mean_{r}") for r in rules])
    spread = hosts.crossJoin(F.broadcast(means)).agg(
        *[F.max(f"mean_{r}").alias(f"mean_{r}") for r in rules],
        *[
            (
                F.sum(F.col("n_documents") * F.pow(F.col(f"n_{r}") / F.col("n_documents") - F.col(f"mean_{r}"), 2))
                / F.greatest(total, F.lit(1))
            ).alias(f"variance_{r}")
            for r in rules
        ],
    )  # means and spread have one row each
    out = hosts.crossJoin(F.broadcast(spread))
    for r in rules:
        mean, variance = F.col(f"mean_{r}"), F.col(f"variance_{r}")
        fitted = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(MAX_STRENGTH)
        strength = F.least(F.greatest(fitted, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))
        out = out.withColumn(
            f"rate_{r}", (F.col(f"n_{r}") + mean * strength) / (F.col("n_documents") + strength)
        )
    return out.select("host", "n_documents", *[f"rate_{r}" for r in rules])


def host_verdicts(
    failures: DataFrame, host: str, max_rate: float = MAX_HOST_RATE, rules: tuple[str, ...] = RULES
) -> DataFrame:
    """One row per host with its shrunken rates and host_kept: no rule fails on more than ``max_rate`` of it."""
    rates = shrunken_rates(failures, host, rules)
    return rates.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in rules]) <= max_rate)


def judge(
    documents: DataFrame,
    keys: list[str],
    text: str = "text",
    host: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """``keys`` of every row with its statistics, failed rules, its host's verdict and ``kept``.

    Repeated rows stay repeated. An empty table gives an empty result. Other columns of ``documents`` are not read, so
    their names cannot clash. The statistics are stored once, since the hosts' sums and the join back both read them;
    the join carries no text, and a hot host is split by adaptive execution.
    """
    chosen = documents.select(
        *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(host).alias("host"), F.col(text).alias("text")
    )
    measured = store(rule_failures(text_statistics(chosen)).drop("text"))
    verdicts = host_verdicts(measured, "host", max_rate).select(
        F.col("host").alias("verdict_host"), "host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]).alias("host_rate")
    )
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left").drop("verdict_host")
    joined = joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    return joined.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)],
        *[c for c in joined.columns if not c.startswith("key_")],
    )
