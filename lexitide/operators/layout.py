"""Layout of translated cues, and checks of them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions.text import remove_punctuation, space_cjk_latin

MODES = ("translation", "translation_above", "translation_below", "original")


def layout_cues(cues: DataFrame, translations: DataFrame, mode: str) -> DataFrame:
    """cues and translations (media_id, cue_idx, text), one to one; the cue's times are kept."""
    if mode not in MODES:
        raise ValueError(f"mode: one of {', '.join(MODES)}")
    other = translations.select("media_id", "cue_idx", F.col("text").alias("__other"))
    both = cues.join(other, ["media_id", "cue_idx"], "left")
    text = {"translation": F.col("__other"), "translation_above": F.concat_ws("\n", "__other", "text"), "translation_below": F.concat_ws("\n", "text", "__other"), "original": F.col("text")}[mode]
    return both.withColumn("text", text).drop("__other")


def mismatched_cues(cues: DataFrame, others: DataFrame) -> DataFrame:
    """Cues that have no counterpart, or one with other times; empty if the two agree one to one."""
    a = cues.select("media_id", "cue_idx", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    b = others.select("media_id", "cue_idx", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    both = a.join(b, ["media_id", "cue_idx"], "full")
    return both.filter(~(F.col("s1").eqNullSafe(F.col("s2")) & F.col("e1").eqNullSafe(F.col("e2"))) | F.col("s1").isNull())


def wrap(text: Column, width: int = 18) -> Column:
    """Lines of at most so many characters, by count; semantic breaks are left to the translator."""
    n = F.greatest(F.ceil(F.length(text) / width), F.lit(1)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width))), "\n")


def tidy(text: Column) -> Column:
    """No punctuation; a space between Han and Latin."""
    return space_cjk_latin(remove_punctuation(text))


def needs_translation(language: Column) -> Column:
    return ~language.startswith("zh")


def baseline_text(polished: Column, raw: Column) -> Column:
    return F.coalesce(polished, raw)


def batch_of(cue_idx: Column, size: int = 5) -> Column:
    """Number of the translation batch of a cue, from 0."""
    return F.floor((cue_idx - 1) / size).cast("long")


def replace_terms(cues: DataFrame, terms: DataFrame, *, max_terms: int = 10_000) -> DataFrame:
    """cues (media_id, cue_idx, text, ...) with whole words between spaces that are a `term` of terms (term, wording)
    written as its wording; of several wordings the least. Up to max_terms terms are part of the plan; more are joined."""
    one = terms.filter("term is not null and wording is not null").groupBy("term").agg(F.min("wording").alias("wording"))
    known = one.limit(max_terms + 1).collect()
    if not known:
        return cues
    words = F.split("text", " ")
    if len(known) <= max_terms:
        wording = F.create_map(*chain.from_iterable((F.lit(r["term"]), F.lit(r["wording"])) for r in known))
        return cues.withColumn("text", F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(wording, w), w)), " "))
    rows = cues.select("media_id", "cue_idx", F.posexplode(words).alias("__pos", "term")).join(one, "term", "left")
    rows = rows.groupBy("media_id", "cue_idx").agg(F.sort_array(F.collect_list(F.struct("__pos", F.coalesce("wording", "term").alias("w")))).alias("__w"))
    rows = rows.select("media_id", "cue_idx", F.array_join(F.transform("__w", lambda x: x["w"]), " ").alias("__text"))
    return cues.join(rows, ["media_id", "cue_idx"], "left").withColumn("text", F.col("__text")).drop("__text")
