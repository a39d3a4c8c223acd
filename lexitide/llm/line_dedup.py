"""Operator 9: corpus-wide line deduplication.

Line hashes are range-partitioned with a secondary sort by document and position, and first occurrences are
streamed in that order. A line's key is the line stripped of U+0020 and U+0009-000D, with A-Z lower-cased. A key
that may hold a third of all lines is dealt over runs by document, as many as its share of all lines asks for; the
heads of such runs, one document each, then settle the first one. The result is one run-length compressed keep bitmap
per document that loses lines, not text: `runs` holds lengths of alternating runs, kept lines first, without the last
run of kept lines. Bitmaps, not lines, are what is joined; documents that keep all lines are passed by a filter of
fixed size where they lie.

Edge cases: a null or empty text is one empty line; keys shorter than `min_chars` code points are never dropped;
repeats inside the first document stay; a null id counts as the largest id; rows with the same id are one
document when keys are compared, and each gets its own bitmap; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import SPACES, ascii_lower, hot_buckets, row_key, salted, split_by_key, written

LAST_ID = 2**63 - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(a, b, pos) of each line whose key an earlier document holds; a and b are the row key."""
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("d"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.select("d", "rk.a", "rk.b", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    rows = written(rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "d", "a", "b", "pos"), "line-keys")
    hot = hot_buckets(rows.select("h1"))
    rows = salted(rows, F.col("h1"), hot, F.xxhash64("d")).repartitionByRange("h1", "h2", "__salt")
    run = Window.partitionBy("h1", "h2", "__salt").orderBy("d", "pos")
    streamed = rows.withColumn("first_d", F.first("d").over(run)).filter(F.col("__hot") | (F.col("d") > F.col("first_d")))
    streamed = written(streamed.drop("__salt"), "later-lines")
    # Keys in one run are done. The first document of each run of a hot key is held against the other runs' firsts.
    heads = streamed.filter("d = first_d").withColumn("first_d", F.min("d").over(Window.partitionBy("h1", "h2")))
    return streamed.unionByName(heads).filter("d > first_d").select("a", "b", "pos")


def keep_runs(dropped: Column) -> Column:
    """Run lengths, kept lines first, from the sorted dropped positions; what follows the last run is kept."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) < p - 1))
    ends = F.filter(dropped, lambda p, i: F.coalesce(F.get(dropped, i + 1) > p + 1, F.lit(True)))
    before = F.concat(F.array(F.lit(-1)), ends)
    return F.flatten(F.zip_with(F.zip_with(starts, F.slice(before, F.lit(1), F.size(starts)), lambda s, e: F.struct(s.alias("s"), e.alias("e"))), ends, lambda x, e: F.array(x["s"] - x["e"] - 1, e - x["s"] + 1)))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(a, b, runs) of each row key that loses lines: its keep bitmap. Other documents keep all lines."""
    gone = dropped_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    by_row = gone.groupBy("a", "b").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return written(by_row.select("a", "b", keep_runs(F.col("dropped")).alias("runs")), "keep-bitmaps")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """All columns of docs with `__n_lines`, `__n_dropped`, `__keep_runs` (the bitmap, with its last run) and `__kept_text` added.

    Builds line keys and bitmaps (a pass over docs) when called; the rest runs with the frame."""
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    own = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    some, rest = split_by_key(own, F.col("__rk.a"), maps.select("a"))
    maps = maps.select(F.struct("a", "b").alias("__rk"), F.col("runs").alias("__runs"))
    none = F.expr("cast(array() as array<int>)")
    both = some.join(maps, "__rk", "left").unionByName(rest.withColumn("__runs", F.lit(None).cast("array<int>")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.col("__lines")
    # Dropped and kept stretches as slices of the lines; what the bitmap leaves open is kept.
    at = F.expr("aggregate(__runs, cast(array(0) as array<int>), (s, n) -> array_append(s, element_at(s, -1) + n))")
    both = both.withColumn("__lines", F.when(F.col("__runs").isNotNull(), lines_of(F.col(text_col)))).withColumn("__at", at)
    kept = F.flatten(F.transform(F.filter("__at", lambda _, i: i % 2 == 0), lambda s, j: F.slice(lines, s + 1, F.coalesce(F.get("__runs", 2 * j), F.size(lines) - s))))
    both = both.withColumn("__n_lines", F.size(lines_of(F.col(text_col))))
    both = both.withColumn("__n_dropped", F.aggregate(F.filter(F.coalesce("__runs", none), lambda _, i: i % 2 == 1), F.lit(0), lambda s, n: s + n))
    both = both.withColumn("__kept_text", F.when(F.col("__runs").isNotNull(), F.array_join(kept, "\n")).otherwise(text))
    total = F.aggregate(F.coalesce("__runs", none), F.lit(0), lambda s, n: s + n)
    return both.withColumn("__keep_runs", F.concat(F.coalesce("__runs", none), F.array(F.col("__n_lines") - total))).drop("__rk", "__lines", "__at", "__runs")
