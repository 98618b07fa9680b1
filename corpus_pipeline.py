"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all but the last return the columns of
documents. Null and empty texts go through every stage as its operator defines. Near-dedup and decontamination decide by
rows, known by doc_id and text, so rows that repeat a doc_id or have none are judged by their own texts; mixing keeps one
copy of rows of null doc_id. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pqledger.llm import decontaminate, mixing, neardup, tokens, toxicity
from pqledger.llm.common import read, text_key
from pqledger.scratch import Scratch
from pqledger.session import ship

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = toxicity.fit(docs, toxicity.train_labels(read(spark, sf_dir, "labels")))
    return toxicity.flag(docs, net, reject=True)


def row_name(doc_id: str, *key: Column) -> Column:
    """Names a row by its doc_id and text; never null."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), *[k.cast("string") for k in key])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one of the least doc_id, null last; of rows of that id, the one of the least hash."""
    stay = neardup.near_rows(docs).where("is_representative").select(row_name("doc_id", F.col("t1"), F.col("t2")).alias("_row")).distinct()
    rows = docs.withColumn("_row", row_name("doc_id", *text_key("text")))
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    leaks = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaks, "_row", "left_anti").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies by rate, with the target weights reached by repeating documents, never by dropping one. The output has at
    most 1 / (the least target) times the input's tokens; documents of a rare domain with a high target are repeated often."""
    labelled = mixing.labelled_by_lang(docs, read(spark, sf_dir, "labels"))
    rates = mixing.mixed(docs, labelled, mixing.TARGETS, floor=1.0, budget=0).groupBy("doc_id").agg(F.max("rate").alias("_rate"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / (1 << 20)
    copies = F.coalesce(F.floor("_rate") + (part < F.col("_rate") - F.floor("_rate")).cast("long"), F.lit(1))
    both = docs.join(rates, "doc_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1)))))
    return both.select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; the rows are read back from them."""
    return tokens.token_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_domains),
    ("token_binary", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written is deleted once its successor is written."""
    docs, scratch = read(ship(spark), sf_dir, "documents"), Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
