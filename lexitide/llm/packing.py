"""Operator 6: token packing by shortest-pack-first over the length histogram.

Texts are tokenised once; a document's ids, with an end id, are cut at multiples of the sequence length, so only
its last piece is shorter. Pieces are counted by length, and lengths are placed longest first, each into the
emptiest packs that still take it, as counts of packing patterns. Only the histogram, one row a length, reaches
the driver. The patterns, at most a few a length, are joined back to pieces by their rank among pieces of that
length; ranks are local ranks plus a running count by task, so a length that a third of all pieces share is
never gathered anywhere.

Edge cases: a null or empty text has only the end id; very long texts are read whole; repeated rows and null ids
are packed like any other; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import written
from lexitide.llm.textvec import chunks

#: Texts up to this character, but for U+0085, and of less than a million characters are encoded by tiktoken over the same
#: vocabulary, which gives the same ids (tests compare every character, runs of each, and long runs) in a fifth of the
#: time; others by tokenizers.
LAST_FAST = "ɏ"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids as `tokenizers` gives them for the vocabulary at json_path, no special tokens added."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    load = lru_cache(lambda: Tokenizer.from_file(json_path))  # only where a text needs it: it takes 40 MB

    def encode_slow(text: str) -> np.ndarray:
        return np.array(load().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks_path is None:
        return encode_slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if len(text) < 1_000_000 and (text.isascii() or (max(text) <= LAST_FAST and "\x85" not in text)):
            return fast.encode_to_numpy(text, allowed_special="all")
        return encode_slow(text)

    return encode


def _pieces(json_path: str, ranks_path: str | None, max_len: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, dtype=np.int64)  # pieces of this task so far, by length
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = [np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4") for t in part.column(1).to_pylist()]
                tokens = np.array([len(x) for x in ids], dtype=np.int64)
                n = -(-tokens // max_len)
                row = np.repeat(np.arange(len(ids)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * max_len
                length = np.minimum(max_len, tokens[row] - start)
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = np.arange(len(row)) - np.searchsorted(sorted_lengths, sorted_lengths)
                rank += seen[length]
                seen += np.bincount(length, minlength=max_len + 1)
                data = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                raw = memoryview(data.tobytes())
                sums = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                columns = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(tokens[row]), pa.array(np.full(len(row), task, dtype=np.int32)), pa.array(rank), sums]
                names = ["doc_id", "start", "length", "doc_tokens", "task", "task_rank", "ids_crc32"]
                if with_ids:
                    columns.append(pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, end_id: int = 1, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Pieces of each row's ids, written when called: doc_id, start, length, doc_tokens, ids_crc32 (of little-endian uint32
    ids), the piece's task and its rank there among pieces of its length, and with with_ids the ids."""
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    if ranks_path is None and json_path == vocabulary_path("byte_bpe_50k.json"):
        ranks_path = vocabulary_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, task int, task_rank long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return written(rows.mapInArrow(_pieces(json_path, ranks_path, max_len, end_id, with_ids), schema), "pieces")


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns: (packs, [(length, copies), ...]). Lengths go longest first into the packs with most room."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []  # with open patterns, sorted

    def put(gap: int, packs: int, pattern: list[tuple[int, int]]) -> None:
        if gap not in room:
            room[gap] = []
            bisect.insort(gaps, gap)
        room[gap].append((packs, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and gaps and gaps[-1] >= length:
            gap = gaps[-1]
            packs, pattern = room[gap].pop()
            if not room[gap]:
                del room[gap]
                gaps.pop()
            if left < packs:
                put(gap, packs - left, pattern)
                packs = left
            copies = min(gap // length, left // packs)
            put(gap - copies * length, packs, [*pattern, (length, copies)])
            left -= packs * copies
        fit = max_len // length
        for packs, copies in ((left // fit, fit), (1, left % fit)):
            if packs and copies:
                put(max_len - copies * length, packs, [(length, copies)])
    return [x for gap in reversed(gaps) for x in room[gap]][::-1]


def pattern_runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies a sequence, offset) of each part of each pattern."""
    runs, used, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            low = used.get(length, 0)
            used[length] = low + packs * copies
            runs.append((length, low, used[length], sequence, copies, offset))
            offset += length * copies
        sequence += packs
    return runs


def pack(pieces: DataFrame, *, max_len: int = 2048) -> DataFrame:
    """pieces (with length, task, task_rank; lengths from 1 to max_len) with sequence_id and offset in place of the ranks."""
    spark = pieces.sparkSession
    slim = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    slim = written(slim, "piece-counts")
    histogram = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    runs = pattern_runs(pack_histogram(histogram, max_len))  # bounded by max_len, however many pieces there are
    table = spark.createDataFrame(runs, "length long, low long, high long, first_sequence long, copies long, first_offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = slim.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(table["length"])
    nth = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - low) div copies"))
    placed = placed.withColumn("offset", F.col("first_offset") + (nth % F.col("copies")) * F.col("length"))
    return placed.drop("before", "rank", "task", "task_rank", "low", "high", "first_sequence", "copies", "first_offset")


def pack_documents(docs: DataFrame, *, max_len: int = 2048, **options) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids_crc32, ids, sequence_id, offset."""
    return pack(token_pieces(docs, max_len=max_len, **options), max_len=max_len)
