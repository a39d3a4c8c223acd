"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that `run` writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents. A stage judges every row it is given:

1. quality: rows whose calibrated score is below 0.3 go.
2. line_dedup: lines of 10 or more characters stay in the smallest document that holds them only; n_chars follows.
3. near_dup: of each group at Jaccard 0.8 or more on five-word shingles one row stays, of the smallest doc_id.
4. decontaminate: documents that hold a benchmark item go.
5. pack: token pieces of the rest, with their ids, in sequences of 2048.

Null and empty texts pass every filter but quality, where they get the score of empty texts; rows of one doc_id count as
one document when lines are compared, in stage 2, and are compared row by row in stage 3; empty tables give empty
results; further columns are carried up to the last stage. Stages run jobs when they are called, to fit or count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import decontaminate, line_dedup, near_dup, packing, quality_model
from lexitide.llm.common import shared_dir

MIN_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_model.score_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("__score") >= MIN_SCORE).drop("__score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("__kept_text"))
    fresh = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", drop_lines), ("near_dup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack)]

#: Random features and a tokenizer's ids can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
