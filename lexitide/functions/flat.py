"""Arrow arrays of strings taken as flat buffers, and batches cut into whole media."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexitide.functions.text import WHITE_SPACE


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0 on and one more than strings, and bytes of an array without nulls."""
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], held[at[0] : at[-1]]


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    made = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(pa.string())


def joined(parts: pa.Array, begins: np.ndarray) -> pa.Array:
    """Each run of strings that begins there, up to the next, as one string. The first begins at 0."""
    offsets, data = flat(parts)
    return strings(offsets[np.append(begins, len(parts))], data)


def stripped(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(texts, characters=WHITE_SPACE)


def numbers(values: pa.Array) -> np.ndarray:
    """64-bit numbers, 0 for null."""
    return pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def flags(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False)


def spans(counts: np.ndarray) -> np.ndarray:
    """Where each of so many items begins, and the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def changes(values: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before; null is a value like others. The first does."""
    known = flags(values.is_valid())
    other = flags(pc.not_equal(values.slice(1), values.slice(0, max(len(values) - 1, 0))))
    return np.concatenate([np.ones(min(len(values), 1), bool), other | (known[1:] != known[:-1])])


def whole_media(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole media from rows that come medium by medium. Holds one medium and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in filter(lambda b: b.num_rows, batches):
        media = batch.column("media_id")
        new = changes(media)
        if held:
            new[0] = changes(pa.concat_arrays([held[-1].column("media_id").slice(held[-1].num_rows - 1), media.slice(0, 1)]))[1]
        firsts = np.flatnonzero(new)
        if not len(firsts):
            held.append(batch)
            continue
        if done := [b for b in (*held, batch.slice(0, firsts[-1])) if b.num_rows]:
            yield pa.concat_batches(done)
        held = [batch.slice(firsts[-1])]
    if held:
        yield pa.concat_batches(held)
