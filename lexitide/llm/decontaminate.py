"""Operator 5: benchmark decontamination by template windows.

Words lose punctuation at their ends and letter case; numbers, names (capitalised words inside a sentence) and
units become typed placeholders. Windows of k such tokens are hashed, and beside them those of the plain lowered
words, as capitals and sentence marks, which tell names, may differ in a copy. Those of a document that may occur in the
benchmark, by a bitmap of fixed size that never misses one, are joined to benchmark windows by hash. Matches of
one item on one offset are an alignment, whose slots must be consistent: a filler of the item always answers to
the same filler of the document; of an inconsistent one only windows with equal fillers count. A window with fewer than
`literals` plain words has no template and counts by its words only. A document is contaminated by an item if
consistent alignments cover `coverage` of the item's windows, or of those that have a template, or hold `run_words`
words in a row of it. `exact` tells copies from re-parameterised ones. An item of fewer than k tokens is found where a
line, or a whole text, holds its words and no others.

A phrase that many documents and many items share would pair all of them. So only probes of an item look for documents:
the windows rarest in the corpus, as many as a contaminated document can't all miss - of each run of `run_words` words
the rarest, and the rarest share beyond `coverage`. All windows are compared for the pairs that probes find only.

Edge cases: null or empty texts match nothing; items without tokens are not used; very long texts are read whole; repeated
rows are judged alike; null ids of documents are kept, items with null ids ignored; empty tables on either side give no
matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import bitmap_of, row_key, spread_join, without_rows, written
from lexitide.llm.textvec import Words, chunks, mix, words_of

#: Words that count as units.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces oz "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (101, 103, 107))
BITMAP_BITS = 24

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template codes, word hashes, each text's first token (one more at the end), and each token's line, of all texts."""
    raw, low = words_of(column), words_of(pc.utf8_lower(column))  # the same words, maybe of other byte lengths
    data, starts, ends = low.data, low.starts.copy(), low.ends.copy()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), dtype=bool)  # a sentence, or a line
    opens[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    opens[low.first[:-1][low.counts > 0]] = True
    for at, step in ((starts, 1), (ends, -1)):
        rows = np.arange(len(starts))
        while len(rows := rows[(starts[rows] < ends[rows]) & _PUNCT[data[np.minimum(at[rows] - (step < 0), len(data) - 1)]]]):
            at[rows] += step
    kept = starts < ends
    head = (raw.starts + starts - low.starts)[kept]  # marks that were cut are one byte in either
    doc = np.repeat(np.arange(len(low)), low.counts)[kept]
    starts, ends, opens = starts[kept], ends[kept], opens[kept]
    line = lines[starts] + doc
    first = np.searchsorted(doc, np.arange(len(low) + 1))
    plain = Words(data, starts, ends, first, low.bounds).hashes()
    codes = plain.copy()
    second = raw.data[np.minimum(head + 1, len(raw.data) - 1)]
    codes[_UPPER[raw.data[head]] & _LOWER[second] & (ends - starts > 1) & ~opens] = NAME
    codes[np.isin(plain, unit_hashes())] = UNIT
    codes[_DIGIT[data[starts]]] = NUMBER
    return codes, plain, first, line


def unit_hashes() -> np.ndarray:
    return words_of(pa.array([" ".join(UNITS)])).hashes()


def windows_of(column: pa.Array, k: int, literals: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, token position, hash, fillers, and whether it has a template, of each window: by template and, where slots are, by words.

    With bits, of documents, those that the bitmap knows. All their words are fillers, as capitals may make other
    slots than in the item, which decides. Fillers of items are 0 for plain words."""
    codes, plain, first, line = tokens_of(column)
    n = max(0, len(codes) - k + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    slot = codes < 200
    h, exact, words = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i] + np.uint64(i + 1))
        exact = mix(exact * np.uint64(0x9E3779B97F4A7C15) + plain[i : n + i] + np.uint64(i + 1))
        words += ~slot[i : n + i]
    whole = doc[:n] == doc[k - 1 : n + k - 1] if n else np.zeros(0, dtype=bool)
    usable = whole & (words >= literals)
    at, slotted = np.flatnonzero(usable), np.flatnonzero(whole & ((words < k) | ~usable))
    short, short_h = _short_units(plain, doc, line, k, bits is None)
    at, h = np.concatenate([at, slotted, short]), np.concatenate([h[at], exact[slotted], short_h])
    usable = np.append(usable, np.zeros(len(codes) - n, dtype=bool))
    if bits is not None:
        hit = bits[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
        at, h, slot = at[hit], h[hit], np.ones_like(slot)
    fillers = np.zeros((len(at), k), np.uint64)
    for i in range(k):  # a unit of fewer tokens may be the last one, and has no fillers that matter
        own = np.minimum(at + i, len(plain) - 1)
        fillers[:, i] = np.where(slot[own], plain[own] | np.uint64(1), np.uint64(0))
    if bits is None:
        fillers[np.isin(h, short_h)] = 0
    return doc[at], at - first[doc[at]], h, fillers, usable[at]


def _short_units(plain: np.ndarray, doc: np.ndarray, line: np.ndarray, k: int, items: bool) -> tuple[np.ndarray, np.ndarray]:
    """First token and word hash of whole texts of fewer than k tokens, and of documents' lines of fewer."""
    starts, hashes = [], []
    for unit in (doc,) if items else (doc, line):
        if not len(unit):
            continue
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        count = np.diff(np.append(first, len(unit)))
        first, count = first[count < k], count[count < k]
        h = mix(count.astype(np.uint64) + np.uint64(0xA5A5))
        for i in range(k - 1):
            more = i < count
            h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + plain[first[more] + i])
        starts.append(first)
        hashes.append(h)
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _windows(k: int, literals: int, bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.unpackbits(bitmap.value, bitorder="little").view(bool)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                doc, pos, h, fillers, usable = windows_of(part.column(1), k, literals, bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * k), pa.array(fillers.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(pos), pa.array(h.view(np.int64)), lists, pa.array(usable)], names=["id", "pos", "h", "slots", "usable"])

    return run


def _probes(known: DataFrame, hits: DataFrame, coverage: float, run: int) -> DataFrame:
    """(item, h) of the windows that look for documents: a document that misses them all is not contaminated."""
    seen = hits.groupBy("h").agg(F.count("*").alias("seen"))
    places = known.join(seen, "h", "left").groupBy("id", "pos").agg(F.sum(F.coalesce("seen", F.lit(0))).alias("seen"), F.max("usable").alias("usable"), F.collect_set("h").alias("hs"))
    nth = lambda by: F.row_number().over(Window.partitionBy("id", *by).orderBy("seen", "pos"))
    of = lambda by: F.count("*").over(Window.partitionBy("id", *by))
    for name, by in (("all", []), ("usable", ["usable"])):
        # To reach the share without them, more windows would have to be matched than are left.
        places = places.withColumn(f"in_{name}", nth(by) <= F.floor(of(by) * (1 - coverage) + 1e-9) + 1)
    ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(0, run - 1)
    places = places.withColumn("least", F.min(F.struct("seen", "pos")).over(ahead)).withColumn("full", F.count("*").over(ahead) == run)
    runs = places.filter("full").select("id", F.col("least.pos").alias("pos")).distinct().withColumn("in_run", F.lit(True))
    chosen = places.join(runs, ["id", "pos"], "left").filter(F.coalesce("in_run", F.lit(False)) | F.col("in_all") | (F.col("usable") & F.col("in_usable")))
    return chosen.select(F.col("id").alias("item"), F.explode("hs").alias("h")).distinct()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 5, literals: int = 3, coverage: float = 0.8, run_words: int = 13
) -> DataFrame:
    """(rk, item_id, covered, exact) of each row key and item that contaminates it; rk is row_key(id, text).

    Reads the benchmark and docs once when called and writes their windows; the rest runs with the frame."""
    spark = docs.sparkSession
    columns = "pos long, h long, slots array<long>, usable boolean"
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = written(items.mapInArrow(_windows(k, literals, None), f"id long, {columns}"), "item-windows").dropDuplicates(["id", "pos", "h"])
    held = spark.sparkContext.broadcast(bitmap_of(known.select("h"), BITMAP_BITS))  # 2 MB
    text = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = written(text.mapInArrow(_windows(k, literals, held), f"id struct<a:long,b:long>, {columns}"), "window-hits").drop("usable")

    probes = written(_probes(known, hits, coverage, run_words - k + 1), "probes")
    pairs = written(spread_join(hits.select("id", "h"), probes, ["h"], ["id"]).select("id", "item").distinct(), "candidates")
    own = known.select(F.col("id").alias("item"), "h", F.col("pos").alias("at"), F.col("slots").alias("item_slots"), "usable")
    hits = hits.dropDuplicates(["id", "pos", "h"])
    # Windows of the candidates' items, at most an item's length each, then those that the document holds.
    pairs = spread_join(pairs, own, ["item"], ["id"]).join(hits, ["id", "h"]).withColumn("shift", F.col("pos") - F.col("at"))
    zipped = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"] != 0)
    # An alignment has at most two matches for each window of its item: by template and by words.
    pairs = pairs.withColumn("filled", zipped).withColumn("same", F.forall("filled", lambda x: x["a"] == x["b"]))
    lines = pairs.groupBy("id", "item", "shift").agg(
        F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("same"), F.col("at"))).alias("same_at"), F.collect_set(F.when(F.col("usable"), F.col("at"))).alias("usable_at"), F.array_distinct(F.flatten(F.collect_list("filled"))).alias("slots"), F.min("same").alias("exact")
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    lines = lines.withColumn("at", F.sort_array(F.when(consistent, F.col("at")).otherwise(F.col("same_at")))).filter(F.size("at") > 0)
    fold = F.aggregate(
        "at",
        F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, p: F.struct(p.alias("last"), F.when(p == s["last"] + 1, s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["best"], F.when(p == s["last"] + 1, s["run"] + 1).otherwise(1)).alias("best")),
        lambda s: s["best"],
    )
    lines = lines.withColumn("run", fold + (k - 1))
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    lines = lines.withColumn("usable_at", F.array_intersect("at", "usable_at"))
    found = lines.groupBy("id", "item").agg(places("at").alias("n"), places("usable_at").alias("n_usable"), F.max("run").alias("run"), F.min("exact").alias("exact"))
    total = known.groupBy(F.col("id").alias("item")).agg(F.countDistinct("pos").alias("of"), F.countDistinct(F.when(F.col("usable"), F.col("pos"))).alias("of_usable"))
    share = F.greatest(F.col("n") / F.col("of"), F.when(F.col("of_usable") > 0, F.col("n_usable") / F.col("of_usable")))  # null is skipped
    found = spread_join(found, total, ["item"], ["id"], counted=probes.select("item")).withColumn("covered", share)
    found = found.filter((F.col("covered") >= coverage) | (F.col("run") >= run_words))
    return found.select(F.col("id").alias("rk"), F.col("item").alias("item_id"), "covered", "exact")


def judge_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids (sorted), covered (of the best item), exact."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    by_row = leaks.groupBy("rk").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"), F.max("exact").alias("exact"))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"))
    out = rows.join(by_row, "rk", "left")
    none = F.expr("cast(array() as array<long>)")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("exact", F.lit(False)).alias("exact"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that no item contaminates, all columns kept."""
    leaks = written(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("rk").distinct(), "leaks")
    return without_rows(docs, row_key(F.col(id_col), F.col(text_col)), leaks)
