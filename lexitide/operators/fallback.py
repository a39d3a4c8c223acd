"""Splitting of segments that have no word times, by length, punctuation and word borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import lexicon as lex
from lexitide.functions.fold import emitted, fold
from lexitide.functions.text import pinned, strip, unspaced_length


def _at(text: Column, i: Column) -> Column:
    """Character at a 0-based position, empty beyond the end."""
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, i + 1, F.lit(1))).otherwise("")


def _down(high: Column, low: Column) -> Column:
    return F.when(high >= low, F.sequence(high, F.least(low, high), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))


def _up(low: Column, end: Column) -> Column:
    """low to end, end exclusive."""
    return F.when(low < end, F.sequence(low, F.greatest(end - 1, low))).otherwise(F.expr("cast(array() as array<int>)"))


def split_position(text: Column, begin: Column, target: Column) -> Column:
    """Where a piece from `begin` of about `target` characters ends: after punctuation or at a space close by, past
    an English word, past a bad line start up to punctuation, or right there."""
    n = F.length(text)
    end = F.least(begin + target, n)
    letter = lambda i: _at(text, i).rlike("^[A-Za-z]$")
    mark = lambda i: _at(text, i).isin(*lex.SPLIT_PUNCT)
    back_mark = F.get(F.filter(_down(end, F.greatest(begin, end - 6) + 1), mark), F.lit(0)) + 1
    back_space = F.get(F.filter(_down(end, F.greatest(begin, end - 15) + 1), lambda c: _at(text, c - 1) == " "), F.lit(0))
    next_space = F.get(F.filter(_up(end, F.least(n, end + 10)), lambda c: _at(text, c) == " "), F.lit(0)) + 1
    word_end = F.when((end > begin) & (end < n) & letter(end - 1) & letter(end), F.get(F.filter(_up(end, F.least(n, end + 10)), lambda c: ~letter(c)), F.lit(0)))
    piece = strip(F.substring(text, begin + 1, end - begin))
    bad = piece.rlike("^(?:" + "|".join(lex.BAD_LINE_START) + ")(?![A-Za-z])")
    past_bad = F.when(bad, F.get(F.filter(_up(end, F.least(end + 6, n)), mark), F.lit(0)) + 1)
    return F.coalesce(back_mark, back_space, next_space, word_end, past_bad, end).cast("int")


def split_untimed(segments: DataFrame, *, max_chars: int = lex.MAX_CHARS, max_ms: int = lex.MAX_LINE_MS) -> DataFrame:
    """Rows (media_id, seg_idx, start_ms, end_ms, text) with `line`: each within limits, or cut into pieces whose
    share of the time follows their characters; times are rounded to milliseconds."""
    rows = segments.select("media_id", "seg_idx", "start_ms", "end_ms", "text", strip(F.col("text")).alias("t"))
    rows = rows.filter(F.length("t") > 0).withColumn("chars", unspaced_length(F.col("t"))).withColumn("ms", F.col("end_ms") - F.col("start_ms")).withColumn("n", F.length("t"))
    pieces = F.greatest(F.ceil(F.col("chars") / max_chars), F.floor(F.col("ms") / max_ms) + 1, F.lit(1)).cast("int")
    rows = rows.withColumn("pieces", F.when((F.col("chars") <= max_chars) & (F.col("ms") <= max_ms), 1).otherwise(pieces))
    rows = rows.withColumn("target", F.floor(F.col("chars") / F.col("pieces")).cast("int"))
    rows = pinned(rows.filter("pieces = 1").withColumn("out", F.array("text")), "out").unionByName(_pieces(rows.filter("pieces > 1")))

    def add(a: Column, x: Column) -> Column:
        chars = a["s"] + unspaced_length(x)
        return F.struct(chars.alias("s"), F.array_append(a["out"], chars).alias("out"))

    # Characters before each piece, and after the last.
    rows = pinned(rows.withColumn("cum", F.concat(F.array(F.lit(0)), emitted(fold(F.col("out"), F.lit(0), "int", "int", add)))), "cum")
    rows = rows.select("media_id", "seg_idx", "start_ms", "end_ms", "chars", "ms", "pieces", F.posexplode(F.arrays_zip("out", F.col("cum").alias("from"), F.slice("cum", F.lit(2), F.size("out")).alias("to"))).alias("line", "x")).filter("x.out is not null")
    edge = lambda c: F.col("start_ms") + F.round(F.col("ms") * F.col(c) / F.greatest("chars", F.lit(1))).cast("long")
    one = F.col("pieces") == 1
    return rows.select("media_id", "seg_idx", F.when(one, F.col("start_ms")).otherwise(edge("x.from")).alias("start_ms"), F.when(one, F.col("end_ms")).otherwise(edge("x.to")).alias("end_ms"), F.col("x.out").alias("text"), "line")


def _pieces(rows: DataFrame) -> DataFrame:
    """Adds `out`, the pieces of `t`. Characters are an array, so a piece far into a text costs no more than the first."""
    rows = pinned(rows.withColumn("__chars", F.split("t", "")), "__chars")
    rows = pinned(rows.withColumn("__nth", F.sequence(F.lit(1), F.col("pieces"))), "__nth")
    between = lambda a, n: F.array_join(F.slice("__chars", a + 1, n), "")

    def step(a: Column, i: Column) -> Column:
        # No rule looks further than ten characters past the target, so each reads a short window only.
        at = a["s"]
        cut = F.get(F.transform(F.array(between(at, F.col("target") + 12)), lambda w: split_position(w, F.lit(0), F.col("target"))), F.lit(0))
        end = F.when(i == F.col("pieces"), F.col("n")).otherwise(at + cut)
        made = F.array(F.struct(F.greatest(end, at).cast("int").alias("end"), strip(between(at, F.greatest(end - at, F.lit(0)))).alias("piece")))
        done = F.transform(made, lambda m: F.struct(m["end"].alias("s"), F.when(F.length(m["piece"]) > 0, F.array_append(a["out"], m["piece"])).otherwise(a["out"]).alias("out")))
        return F.get(done, F.lit(0))

    rows = rows.withColumn("out", emitted(fold(F.col("__nth"), F.lit(0), "int", "string", step)))
    return pinned(rows.drop("__chars", "__nth"), "out")
