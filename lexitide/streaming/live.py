"""Cleaning of segments that arrive as a stream. The batch operators remain the reference for whole media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions.text import strip
from lexitide.operators.clean import drop_empty, drop_hallucinations, drop_no_duration


def clean_stream(segments: DataFrame, *, event_time: str = "arrived", watermark: str = "10 minutes") -> DataFrame:
    """Segments (media_id, seg_idx, start_ms, end_ms, text, event_time) without noise, and one for each stripped text
    and start of a medium; the state of a key is dropped once the watermark has passed it. Of repeats the first to
    arrive stays, which is the first in order where a medium arrives in order."""
    rows = drop_hallucinations(drop_no_duration(drop_empty(segments))).withColumn("__key", strip(F.col("text")))
    return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["media_id", "__key", "start_ms"]).drop("__key")
