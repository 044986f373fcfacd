"""The corpus pipeline: its stages one after another, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents: the quality classifier drops the rows it
rejects, near-dedup all but one document of each group, substring dedup the words of repeated passages (a text without any stays as
it is; in the others the words that stay are one space apart), decontamination the contaminated rows. The last packs what is left.

Odd rows, in every stage: extra columns go, whatever their names; an empty table gives an empty table. A null text is the empty text:
nothing near, repeated or contaminated is found in it, and it goes on as it is unless the classifier rejects it (substring dedup
keeps it null). Rows with a null doc_id have no labels and no near copies, count as the last documents in substring dedup, and are
judged by their text in decontamination. Rows of one doc_id are one document to near-dedup, which keeps all of them or none, and to
substring dedup, which removes nothing from one for the other's sake; the other stages judge each row. Of equal documents the
one with the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.llm import decontaminate, minhash, packing, quality, substring
from streetflow.llm.shared import on_path, table, tidy_driver

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: more ids to drop than these are joined by shuffle
BROADCAST_IDS = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_driver(spark)
    on_path(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels, keep=COLUMNS[1:])
    return judged.where("accepted").select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_driver(spark)
    on_path(spark)
    gone = table(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    few = decontaminate.sized(gone, BROADCAST_IDS)
    return docs.join(few, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_driver(spark)
    on_path(spark)
    out = substring.dedup(docs, texts=True, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_driver(spark)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = table(found.where("contaminated").select("doc_id", "text_key").distinct())
    few, keyed = decontaminate.sized(gone, BROADCAST_IDS), docs.withColumn("text_key", F.xxhash64("text"))
    return keyed.join(few, keyed["doc_id"].eqNullSafe(few["doc_id"]) & (keyed["text_key"] == few["text_key"]), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy_driver(spark)
    on_path(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]
#: a trained classifier and a tokenizer can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
