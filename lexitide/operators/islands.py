"""Gap-and-island merges over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.text import strip


def with_islands(rows: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """Numbers islands by `island`; `opens` marks a row that does not go on with the row before."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("island", F.sum("__opens").over(ordered)).drop("__opens")


def merge_regions(regions: DataFrame, *, gap_ms: int = 1000, min_ms: int = 1000) -> DataFrame:
    """Speech regions (media_id, idx, start_ms, end_ms): neighbours closer than gap_ms become one, whose end is the
    last row's; regions shorter than min_ms go."""
    last = F.lag("end_ms").over(Window.partitionBy("media_id").orderBy("start_ms", "idx"))
    rows = with_islands(regions.withColumn("__last", last), ["media_id"], ["start_ms", "idx"], F.col("start_ms") - F.col("__last") >= gap_ms)
    merged = rows.groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "idx")).alias("end_ms"))
    return merged.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).select("media_id", F.col("island").alias("region"), "start_ms", "end_ms")


def regions_or_whole(media: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions of each medium (media_id, duration_ms); of one that has none, the whole medium."""
    whole = media.join(regions.select("media_id").distinct(), "media_id", "left_anti")
    return regions.unionByName(whole.select("media_id", F.lit(1).cast("long").alias("region"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("end_ms")))


def shift_to_absolute(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments of regions (media_id, region, seg_idx, times from the region's start, words) on the medium's clock, words too."""
    by = regions.select("media_id", "region", F.col("start_ms").alias("__from"))
    rows = segments.join(by, ["media_id", "region"])
    moved = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] + F.col("__from")).alias("start_ms"), (w["end_ms"] + F.col("__from")).alias("end_ms")))
    rows = rows.withColumn("start_ms", F.col("start_ms") + F.col("__from")).withColumn("end_ms", F.col("end_ms") + F.col("__from"))
    return rows.withColumn("words", moved).drop("__from") if "words" in segments.columns else rows.drop("__from")


def merge_adjacent_duplicates(segments: DataFrame) -> DataFrame:
    """Neighbours with one text, but for case and ends, become the first of them with the end of the last."""
    key = F.lower(strip(F.col("text")))
    before = F.lag("__key").over(Window.partitionBy("media_id").orderBy("seg_idx"))
    rows = segments.withColumn("__key", key).withColumn("__before", before)
    rows = with_islands(rows, ["media_id"], ["seg_idx"], F.col("__key") != F.col("__before"))
    out = rows.groupBy("media_id", "island").agg(
        F.min("seg_idx").alias("seg_idx"), F.min_by("start_ms", "seg_idx").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms"), F.min_by("text", "seg_idx").alias("text")
    )
    return out.select("media_id", "seg_idx", "start_ms", "end_ms", "text")
