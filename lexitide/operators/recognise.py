"""The boundary to recognisers and voice detectors: external code runs over chunks, and a chunk that fails is a row.

A recogniser is a function from bytes or text of a chunk to segments, a detector one from those of a medium to regions.
Neither is part of this package; both run in Arrow batches, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.text import strip
from lexitide.operators.islands import regions_or_whole, shift_to_absolute
from lexitide.operators.segment import WORDS

#: (start_ms, end_ms, text, [(word, start_ms, end_ms)]) by chunk, times from the chunk's start.
Segments = list[tuple[int, int, str, list[tuple[str, int, int]]]]

_ARROW_WORDS = pa.list_(pa.struct([("word", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_ARROW_SEGMENTS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("words", _ARROW_WORDS)]))
SEGMENTS = f"array<struct<start_ms:bigint,end_ms:bigint,text:string,words:{WORDS}>>"


def recognise_chunks(chunks: DataFrame, recogniser: Callable[[object], Segments], content: str = "content") -> DataFrame:
    """(media_id, region, segments, error) of chunks (media_id, region, content). What a chunk raises is its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start_ms", "end_ms", "text", "words")
        for batch in batches:
            found, errors = [], []
            for value in batch.column(2).to_pylist():
                try:
                    rows = [dict(zip(names, s, strict=True)) for s in recogniser(value)]
                    for row in rows:
                        row["words"] = [{"word": w, "start_ms": a, "end_ms": b} for w, a, b in row["words"]]
                    found.append(rows)
                    errors.append(None)
                except Exception as e:  # external code may raise anything
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _ARROW_SEGMENTS), pa.array(errors, pa.string())], names=["media_id", "region", "segments", "error"])

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("media_id", "region"))
    return chunks.select("media_id", "region", content).mapInArrow(run, f"{kinds}, segments {SEGMENTS}, error string")


def chunk_segments(results: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments (media_id, seg_idx, times, text, words) of the chunks that gave some, on the medium's clock, by time.
    results are read more than once: keep them as a table."""
    rows = results.filter("error is null").select("media_id", "region", F.posexplode("segments").alias("__pos", "s"))
    rows = shift_to_absolute(rows.select("media_id", "region", "__pos", "s.start_ms", "s.end_ms", strip(F.col("s.text")).alias("text"), "s.words"), regions)
    order = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "region", "__pos")).cast("long") - 1
    return rows.select("media_id", order.alias("seg_idx"), "start_ms", "end_ms", "text", "words")


def media_without_result(media: DataFrame, results: DataFrame) -> DataFrame:
    """Media of which no chunk gave a segment: these are recognised whole."""
    some = results.filter("error is null and size(segments) > 0").select("media_id").distinct()
    return media.join(some, "media_id", "left_anti")


def detect_regions(media: DataFrame, detector: Callable[[object], list[tuple[int, int]]], content: str = "content") -> DataFrame:
    """Regions (media_id, region, start_ms, end_ms) of media (media_id, duration_ms, content); the whole medium where the
    detector finds none or fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for medium, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = detector(value)
                except Exception:  # external code may raise anything; the medium is then taken whole
                    found = []
                for n, (a, b) in enumerate(found, 1):
                    ids.append(medium)
                    numbers.append(n)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(x, pa.int64()) for x in (numbers, starts, ends))], names=["media_id", "region", "start_ms", "end_ms"])

    kind = media.schema["media_id"].dataType.simpleString()
    return regions_or_whole(media, media.select("media_id", content).mapInArrow(run, f"media_id {kind}, region long, start_ms long, end_ms long"))
