"""WAV files as samples by channel."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions.media import mono

_KIND = {1: (np.uint8, 128.0, 128.0), 2: (np.dtype("<i2"), 0.0, 2.0**15), 4: (np.dtype("<i4"), 0.0, 2.0**31)}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rates, samples, errors = [], [], []
        for content in batch.column(1).to_pylist():
            try:
                with wave.open(io.BytesIO(content)) as f:
                    kind, zero, scale = _KIND[f.getsampwidth()]
                    frames = np.frombuffer(f.readframes(f.getnframes()), dtype=kind).reshape(-1, f.getnchannels())
                    rates.append(f.getframerate())
                    samples.append(((frames - zero) / scale).astype(np.float64).tolist())
                    errors.append(None)
            except (wave.Error, EOFError, KeyError, ValueError) as e:
                rates.append(None)
                samples.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.list_(pa.float64()))), pa.array(errors, pa.string())], names=["media_id", "rate", "samples", "error"])


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, rate, audio, error) of PCM files: samples from -1 to 1, channels averaged. A file that is none is an error row."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("media_id"), "content")
    rows = files.mapInArrow(_decode, "media_id string, rate int, samples array<array<double>>, error string")
    return rows.select("media_id", "rate", mono(F.col("samples")).alias("audio"), "error")
