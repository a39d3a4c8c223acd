"""Planning of uploads and of speech detection, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 25 * 1024 * 1024
AUTO_VAD_SECONDS = 600
RATE_STEP, RATE_LOW, RATE_HIGH = 8000, 16_000, 128_000


def bitrate(duration_s: Column) -> Column:
    """Bits a second that fit the upload limit with a tenth to spare, in steps, within bounds."""
    fits = F.floor(F.floor(F.lit(MAX_UPLOAD_BYTES * 8 * 0.9) / duration_s) / RATE_STEP) * RATE_STEP
    return F.least(F.lit(RATE_HIGH), F.greatest(F.lit(RATE_LOW), fits)).cast("int")


def upload_plan(size_bytes: Column, wav_bytes: Column) -> Column:
    """as_is, wav (16 kHz mono) or mp3, the first that fits."""
    return F.when(size_bytes <= MAX_UPLOAD_BYTES, "as_is").when(wav_bytes <= MAX_UPLOAD_BYTES, "wav").otherwise("mp3")


def wav_bytes(duration_s: Column) -> Column:
    """Size of 16-bit mono at 16 kHz with its header."""
    return F.floor(duration_s * 32_000).cast("long") + 44


def use_vad(duration_s: Column, vad: Column, no_vad: Column) -> Column:
    """Asked for, else refused, else by duration."""
    return F.when(vad, True).when(no_vad, False).otherwise(duration_s > AUTO_VAD_SECONDS)


def chinese_prompt(language: Column) -> Column:
    return F.coalesce(language.startswith("zh"), F.lit(False))


def engine(requested: str, system: str, machine: str) -> str:
    """auto picks by platform."""
    return requested if requested != "auto" else "mlx" if (system, machine) == ("Darwin", "arm64") else "faster-whisper"


def engine_of(requested: Column, system: Column, machine: Column) -> Column:
    """engine() as a column."""
    return F.when(requested != "auto", requested).when((system == "Darwin") & (machine == "arm64"), "mlx").otherwise("faster-whisper")


def sample_slice(audio: Column, start_ms: Column, end_ms: Column, rate: int = 16_000) -> Column:
    """Samples of a region."""
    first = F.floor(start_ms * rate / 1000).cast("int")
    return F.slice(audio, first + 1, F.greatest(F.floor(end_ms * rate / 1000).cast("int") - first, F.lit(0)))


def long_enough(samples: Column, rate: int = 16_000) -> Column:
    return F.size(samples) >= int(rate * 0.3)


def mono(channels: Column) -> Column:
    """Mean over channels of an array of samples by channel."""
    return F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))
