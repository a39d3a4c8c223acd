"""Filters and first-wins deduplication of segments and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.text import is_hallucination, strip


def drop_empty(segments: DataFrame) -> DataFrame:
    """Without segments of white space only; a null text counts as empty."""
    return segments.filter(F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) > 0)


def drop_no_duration(segments: DataFrame) -> DataFrame:
    return segments.filter(F.coalesce("end_ms", F.lit(0)) > F.coalesce("start_ms", F.lit(0)))


def clean_words(words: Column) -> Column:
    """Without words that are empty, lack a time or end before they begin."""
    return F.filter(words, lambda w: (F.length(strip(w["word"])) > 0) & w["start_ms"].isNotNull() & (w["end_ms"] > w["start_ms"]))


def dedup_segments(segments: DataFrame) -> DataFrame:
    """The first of segments with one stripped text and start in a medium, after the two filters."""
    rows = drop_no_duration(drop_empty(segments))
    nth = F.row_number().over(Window.partitionBy("media_id", strip(F.col("text")), "start_ms").orderBy("seg_idx"))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def drop_hallucinations(segments: DataFrame) -> DataFrame:
    return segments.filter(~is_hallucination(F.col("text")))


def normalize_segments(segments: DataFrame) -> DataFrame:
    """Times that are missing become 0, a missing text "", missing words none; the text is stripped."""
    rows = segments.withColumn("start_ms", F.coalesce("start_ms", F.lit(0).cast("long"))).withColumn("end_ms", F.coalesce("end_ms", F.lit(0).cast("long")))
    rows = rows.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    return rows.withColumn("words", F.coalesce("words", F.expr("cast(array() as array<struct<word:string,start_ms:bigint,end_ms:bigint>>)"))) if "words" in segments.columns else rows
