"""The corpus pipeline: documents through five stages, each written and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, near_dedup, quality, secret_scan, sieve
from millrace.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Links of near duplicates, in percent of their union; the mix's shards.
NEAR_PERCENT, SHARDS = 80, 32


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is one half at least; learned from graded ones that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.graded(docs.select(*COLUMNS), quality.fit(docs, labels)).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id. Rows that repeat an id become one, the least by text and then the other columns; null ids stay.

    Most rows aren't shuffled: a sieve of the ids that go or repeat tells them apart, and an exact join follows for the rest.
    """
    scratch = Scratch(spark, "near-dedup-stage")
    docs = docs.select(*COLUMNS)
    judged = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("stays"))
    doubtful = scratch.keep(judged.where("rows > 1 or not stays").select(F.col("doc_id").alias("id"), "stays"), "doubtful")
    told = sieve.marked(docs, "doc_id", sieve.sieve(doubtful, "id"), "may")
    met = told.where("may").join(doubtful.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    single = met.where("id is null").select(*COLUMNS)
    repeated = met.where("stays").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return told.where("not may").select(*COLUMNS).union(single).union(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each reported secret masked by as many asterisks."""
    return secret_scan.masked(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and copy, with its shard and its place in it."""
    scratch = Scratch(spark, "mixing-stage")
    keyed = scratch.keep(docs.select(F.monotonically_increasing_id().alias("key"), *COLUMNS), "keyed")
    decided = mixing.mix(keyed, shards=SHARDS, scratch=scratch, key="key")
    return decided.shards(keyed.withColumnRenamed("key", "own"), "own").drop("own")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Trained weights and hashed permutations have no SQL form; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents, each result written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.discard(STAGES[i - 1][0])
    return docs
