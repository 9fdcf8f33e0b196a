"""The corpus pipeline: documents in, token ids out. Each stage is written as Parquet and read again."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lines, minhash, quality
from tidemark.llm.common import shared_dir, without, written
from tidemark.llm.queries import pattern, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good. The model comes from all of them."""
    # the counts are written with their rows, once: taken into the filter, their expressions would run for each rule again
    featured = written(quality.features(docs.select(F.struct("*").alias("_doc"), "text")).select("_doc", "_q"), "quality")
    return quality.judge(featured, quality.learn(featured)).where("kept").select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without lines that came earlier in the corpus."""
    return lines.dedup(docs, short=True).select(*docs.columns)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, row): whole rows, each with a key, as ids may repeat or be null; a written table."""
    return written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id (nulls last), of equal ids one by its text and place."""
    rows = _rows(docs)
    found = minhash.near_duplicates(rows.select("row", "doc.text"), percent=80, id_col="row").select("row", "component_id")
    order = F.struct(F.col("doc.doc_id").isNull().alias("null"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("hash"), "row")
    placed = written(found.join(rows.select("row", order.alias("place")), "row"), "placed")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = placed.join(first, "component_id").where(F.col("row") != F.col("first.row"))
    return without(rows, written(gone.select("row"), "gone"), "row").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows = _rows(docs)
    found = decontaminate.contaminated(rows.select("row", "doc.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return without(rows, written(found.select("row").distinct(), "contaminated"), "row").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), pattern(), with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: The model of the quality stage and the token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
