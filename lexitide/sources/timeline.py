"""Timed words for tables that have text but no times: a deterministic clock in integer milliseconds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.functions.flat import flat, numbers, strings
from lexitide.functions.text import strip

WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())]))

#: Characters between words: U+0020 and U+0009 to U+000D.
BREAKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

#: Bytes of text that are timed at once.
AT_ONCE = 1 << 21


def _clock(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of all texts; of their words, where they begin and end, their number in the text, their time, 60 ms a character, and
    the pause after, by the last character or that number; the first word of each text, and the end."""
    offsets, data = flat(texts)
    gap = BREAKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    first = np.searchsorted(begins, offsets)
    nth = np.arange(len(begins)) - np.repeat(first[:-1], np.diff(first))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    last = data[ends - 1] if len(ends) else data[:0]
    pause = np.where(np.isin(last, np.frombuffer(b".!?", np.uint8)), 550, np.where(last == ord(","), 260, 40 * (nth % 4)))
    return data, begins, ends, nth, 60 * (chars[ends] - chars[begins]), pause, first


def _some(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """Batches (text, ...) in parts of some AT_ONCE bytes, a text at least; a null text is empty."""
    for texts, *rest in batches:
        texts = pc.fill_null(texts, "")
        part = flat(texts)[0][:-1] // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield texts.slice(a, b - a), *(x.slice(a, b - a) for x in rest)


@F.arrow_udf(T.StructType([T.StructField("total", T.LongType()), T.StructField("spoken", T.LongType())]))
def _lasts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Milliseconds of a text, with and without the pause after its last word."""
    for (texts,) in _some((b,) for b in batches):
        _, _, _, _, ms, pause, first = _clock(texts)
        upto = np.concatenate([[0], np.cumsum(ms + pause)])
        total = upto[first[1:]] - upto[first[:-1]]
        after = np.append(pause, 0)[np.maximum(first[1:] - 1, 0)]
        yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(np.where(np.diff(first) > 0, total - after, 0), pa.int64())], ["total", "spoken"])


@F.arrow_udf(WORDS)
def _timed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A text's words with times from its base; each but the first has a space before it."""
    for texts, base in _some(batches):
        data, begins, ends, nth, ms, pause, first = _clock(texts)
        upto = np.concatenate([[0], np.cumsum(ms + pause)])
        start = upto[:-1] + np.repeat(numbers(base) - upto[first[:-1]], np.diff(first))
        space = begins[nth > 0] - 1
        keep = ~BREAKS[data]
        keep[space] = True
        data = data.copy()
        data[space] = 0x20
        words = strings(np.concatenate([[0], np.cumsum(ends - begins + (nth > 0))]), data[keep])
        kinds = [pa.field("word", pa.string()), pa.field("start_ms", pa.int64()), pa.field("end_ms", pa.int64())]
        yield pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([words, pa.array(start, pa.int64()), pa.array(start + ms, pa.int64())], fields=kinds))


# Not evaluated again for a filter on their results.
_lasts, _timed = _lasts.asNondeterministic(), _timed.asNondeterministic()


def segments_of(rows: DataFrame) -> DataFrame:
    """Segments with words of rows (media_id, seg_idx, text); each starts where the medium's last one ended, pause included.

    Times of segments are sums, so words are timed only where they are asked for. Rows come medium by medium and by seg_idx."""
    rows = rows.select("media_id", "seg_idx", "text", _lasts(F.col("text")).alias("__ms"))
    before = F.sum("__ms.total").over(Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("base", F.coalesce(before, F.lit(0)))
    end = F.col("base") + F.col("__ms.spoken")
    return rows.select("media_id", "seg_idx", F.col("base").alias("start_ms"), end.alias("end_ms"), strip(F.col("text")).alias("text"), _timed(F.col("text"), F.col("base")).alias("words"))


def from_documents(documents: DataFrame) -> DataFrame:
    """A medium per document, a segment per line."""
    rows = documents.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seg_idx", "text"))
    return segments_of(rows.withColumn("seg_idx", F.col("seg_idx").cast("long")))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A medium per conversation, a segment per turn."""
    return segments_of(conversations.select(F.col("conv_id").alias("media_id"), F.col("turn").cast("long").alias("seg_idx"), "text"))
