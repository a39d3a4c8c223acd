"""JSON of speech services and of media probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.text import strip

RESPONSE = "struct<segments:array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>>"
PROBE = "struct<streams:array<struct<duration:string>>>"


def to_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def response_segments(responses: DataFrame) -> DataFrame:
    """Segments of rows (media_id, body): 0, 0 and "" for what is missing, text stripped, by start and position."""
    rows = responses.select("media_id", F.posexplode(F.from_json("body", RESPONSE)["segments"]).alias("pos", "s"))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("__start", "pos")).cast("long") - 1
    rows = rows.withColumn("__start", F.coalesce("s.start", F.lit(0.0)))
    words = F.transform("s.words", lambda w: F.struct(w["word"].alias("word"), to_ms(w["start"]).alias("start_ms"), to_ms(w["end"]).alias("end_ms")))
    return rows.select("media_id", number.alias("seg_idx"), to_ms(F.col("__start")).alias("start_ms"), to_ms(F.coalesce("s.end", F.lit(0.0))).alias("end_ms"), strip(F.coalesce("s.text", F.lit(""))).alias("text"), words.alias("words"))


def probe_duration(body: Column) -> Column:
    """Seconds of the first stream with a duration; 0 if there is none or the JSON is broken."""
    streams = F.filter(F.from_json(body, PROBE)["streams"], lambda s: F.length(s["duration"]) > 0)
    return F.coalesce(F.get(streams, F.lit(0))["duration"].try_cast("double"), F.lit(0.0))
