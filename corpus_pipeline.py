"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import bagminhash, decontaminate, packing, pii, rules
from stayline.session import store


def _marked(docs: DataFrame) -> DataFrame:
    """With a hash of the text, so that repeated ids with other texts stay apart."""
    return docs.withColumn("_mark", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and whose host passes."""
    judged = rules.judge(_marked(docs), ["doc_id", "_mark"])
    bad = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("_mark").alias("bad_mark"), F.col("host").alias("bad_host"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("_mark") == F.col("bad_mark")) & F.col("source").eqNullSafe(F.col("bad_host"))
    return _marked(docs).join(bad, same, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id."""
    found = bagminhash.near_duplicates(docs)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    others = store(found.filter(~first).select(F.col("doc_id").alias("other_id"), F.col("mark").alias("other_mark")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("_mark") == F.col("other_mark"))
    named = _marked(docs).withColumn("_id", F.col("doc_id").cast("long"))
    # only texts that may be such another one are shuffled
    keys = others.select(F.col("other_id").alias("_id"), F.col("other_mark").alias("_mark"))
    named = bagminhash.sieve(named, keys, ["_id", "_mark"], "_may")
    kept = named.filter("NOT _may").unionByName(named.filter("_may").join(others, same, "left_anti"))
    repeated = found.filter(first & (F.col("n_words") > 0)).groupBy("doc_id", "mark").count().filter("count > 1").limit(1)
    if repeated.count():  # rows repeated with their id
        kept = kept.dropDuplicates(["doc_id", "_mark"])
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return pii.mask_personal(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenise(docs, ["doc_id"], path))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit),
]

#: The signatures, edit distances, learned spans and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after each other over the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs)
    return docs
