"""Operator 8: quality classifier on random Fourier features of document statistics.

Each text becomes a fixed vector of statistics (lengths, letter case, symbols, digits, repetition, lines). Random
Fourier features approximate a Gaussian kernel over the standardised vectors; normal equations are summed by
partition and solved for ridge scores; isotonic regression over out-of-fold scores turns them into probabilities.
The fit takes at most `max_fit_rows` labelled rows, chosen by a hash of the id (documented bound); scoring covers
every row.

Edge cases: a null text counts as empty and gets the score of its (zero) statistics; very long texts are read
whole; a null id is scored and never used for the fit; labels that are null are not used; repeated labels of an
id must agree to be used; with no usable label of either class every score is the base rate (0.5 with none);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.llm.common import written
from lexitide.llm.textvec import chunks, words_of

_CLASS = np.zeros((8, 256), dtype=np.int32)
_CLASS[0, 65:91] = 1  # upper
_CLASS[1, 97:123] = 1  # lower
_CLASS[2, 48:58] = 1  # digit
_CLASS[3, [ord(c) for c in "#*$%&|<>"]] = 1  # symbol
_CLASS[4, [ord(c) for c in ".,;:?"]] = 1  # sentence marks
_CLASS[5, [ord(c) for c in "!\"'()[]{}=/\\@_+~^`-"]] = 1  # other marks
_CLASS[6, 10] = 1  # line break
_CLASS[7, 128:192] = 1  # continuation byte
N_STATS = 16


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values, all of which lie in some text, by text."""
    out = np.zeros(len(bounds) - 1)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, bounds[:-1][some])
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text, how many values equal an earlier one of it."""
    out = np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a > 1:
            x = np.sort(h[a:b])
            out[i] = np.count_nonzero(x[1:] == x[:-1])
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """texts x N_STATS."""
    words = words_of(column)
    data, first, n = words.data, words.first, words.counts
    kinds = np.stack([_sums(table[data], words.bounds) for table in _CLASS], axis=1)
    chars = np.diff(words.bounds) - kinds[:, 7]
    h = words.hashes()
    word_bytes = _sums(words.ends - words.starts, first)
    short = _sums(((words.ends - words.starts) <= 3).astype(np.int32), first)
    upper_words = np.zeros(len(h)) if not len(h) else (_CLASS[0][data[words.starts]] & _CLASS[0][data[np.minimum(words.starts + 1, words.ends - 1)]] & (words.ends - words.starts > 1))
    pairs_same = np.zeros(len(h))
    if len(h) > 1:
        pairs_same[1:] = h[1:] == h[:-1]
        starts = first[:-1][n > 0]
        pairs_same[starts] = 0
    two = np.zeros(len(h), dtype=np.uint64)
    if len(h) > 2:
        two[:-2] = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
        two[-2:] = np.arange(2)
    return np.column_stack([
        np.log1p(n),
        np.log1p(_ratio(n, kinds[:, 6] + 1)),
        _ratio(word_bytes, n),
        _ratio(short, n),
        _ratio(kinds[:, 0], chars),
        _ratio(kinds[:, 1], chars),
        _ratio(kinds[:, 2], chars),
        np.sqrt(_ratio(kinds[:, 3], chars)),
        np.sqrt(_ratio(kinds[:, 4], n)),
        np.sqrt(_ratio(kinds[:, 5], chars)),
        np.sqrt(_ratio(_sums(upper_words, first), n)),
        np.sqrt(_ratio(_sums(pairs_same, first), n)),
        _ratio(_repeats(two, first), n),
        _ratio(_repeats(h, first), n) / np.log1p(np.maximum(n, 1)),
        _ratio(kinds[:, 7], chars),
        (n == 0).astype(float),
    ])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_STATS)


def batch_statistics(column: pa.Array) -> np.ndarray:
    """statistics, chunk by chunk."""
    return np.concatenate([np.zeros((0, N_STATS)), *(statistics(column.slice(a, b - a)) for a, b in chunks(column))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            part = batch.slice(a, b - a)
            stats = statistics(part.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(stats.reshape(-1)), N_STATS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], names=["id", "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # N_STATS x features
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated

    def features(self, x: np.ndarray) -> np.ndarray:
        near = np.einsum("ij,jk->ik", np.clip((x - self.mean) / self.scale, -6, 6), self.w)  # no BLAS threads: a task has one core
        return np.concatenate([np.cos(near + self.phase) * np.sqrt(2 / self.w.shape[1]), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.features(x), self.beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the blocks' mean scores, levels rise strictly for distinct blocks."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, label sum, score sum
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([1.0, y, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([b[2] / b[0] for b in blocks])
    levels = np.array([b[1] / b[0] for b in blocks])
    return knots, levels


def _solve(parts: list[tuple[np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
    penalty = np.full(len(a), ridge)
    penalty[-1] = 0
    return np.linalg.solve(a + np.diag(penalty) + 1e-9 * np.eye(len(a)), b)


def fit(rows: DataFrame, *, features: int = 192, width: float = 3.0, ridge: float = 0.3, folds: int = 4, seed: int = 5, fit_partitions: int = 8) -> Model:
    """rows: (rk, x, y), a bounded sample. Each partition sends one sum of its normal equations per fold."""
    summary = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    mean = np.array([r["m"] for r in summary]) if summary else np.zeros(N_STATS)
    scale = np.array([r["s"] or 0.0 for r in summary]) if summary else np.ones(N_STATS)
    scale = np.where(scale > 1e-6, scale, 1.0)
    random = np.random.default_rng(seed)
    w, phase = random.normal(size=(N_STATS, features)) / width, random.uniform(0, 2 * np.pi, features)
    model = Model(mean, scale, w, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((folds, size, size)), np.zeros((folds, size))
        for batch in batches:
            x, y, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = model.features(x)
            for f in range(folds):
                own = fold == f
                a[f] += z[own].T @ z[own]
                b[f] += z[own].T @ y[own]
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array([x.tobytes() for x in a]), pa.array([x.tobytes() for x in b])], names=["fold", "a", "b"])

    fold = F.pmod(F.xxhash64("rk", F.lit(9)), F.lit(folds)).cast("int")
    data = rows.select("x", F.col("y").cast("double").alias("y"), fold.alias("fold")).repartition(fit_partitions)
    data = written(data, "fit-rows")
    got = data.coalesce(fit_partitions).mapInArrow(sums, "fold int, a binary, b binary").collect()
    parts = {f: [(np.frombuffer(r["a"]).reshape(size, size), np.frombuffer(r["b"])) for r in got if r["fold"] == f] for f in range(folds)}
    if not summary:
        return model
    betas = np.stack([_solve([p for g in range(folds) if g != f for p in parts[g]], ridge) for f in range(folds)])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((model.features(x) * betas[fold]).sum(axis=1)), pa.array(y)], names=["s", "y"])

    scored = data.mapInArrow(out_of_fold, "s double, y double").toArrow()  # at most max_fit_rows
    model.beta = _solve([p for g in parts.values() for p in g], ridge)
    model.knots, model.levels = isotonic(scored.column("s").to_numpy(), scored.column("y").to_numpy())
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, label_col: str = "quality", max_fit_rows: int = 50_000
) -> Model:
    """learn: over the column `id`, which labelled rows may be learnt from (all if None). Only the sample's texts are read."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(learn if learn is not None else F.lit(True)).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = known.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_fit_rows)
    sample = written(sample, "fit-ids")  # at most max_fit_rows, so it can be broadcast
    stats = rows.join(F.broadcast(sample.select("id")), "id", "left_semi").mapInArrow(_measure, "id long, x array<double>")
    # Rows that share an id may be more than ids, so the bound holds once more.
    chosen = stats.join(F.broadcast(sample), "id").withColumn("rk", F.xxhash64("id", "x")).orderBy("rk", "id").limit(max_fit_rows)
    return fit(written(chosen, "fit-sample"))


def score_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of docs with `__score` added: 0 to 1, higher where label 1 is likelier. Fits when called; scoring reads
    each text once."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch_statistics(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(own))], names=[*batch.schema.names, "__score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


def score_ids(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, score) of every row."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch_statistics(batch.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
