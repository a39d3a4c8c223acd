"""Operator 1: quality rules as a threshold table compiled into one projection.

Rules bound length, symbol, stop-word and line ratios of a document. A ratio with a zero denominator is 0.

Edge cases: a null text has no words; empty texts fail the length rule; repeated rows are judged alike; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import SPACES, WORD_BREAK

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for was with on at by it from are as be this have an or "
    "der die das und in den von zu mit ist auf für des dem ein eine im nicht "
    "le la les de des et un une en du que pour dans est sur par au avec pas qui "
    "el los las del y que en por con para una un se no es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds where low <= metric <= high; metric is SQL over the measures of `measures()`."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")


#: Ratios are of the whole document. Spans are wide: a clean document of any of the four languages is well inside.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 25),
    Rule("symbol_ratio", "n_symbols / word_chars", high=0.08),
    Rule("stop_word_ratio", "n_stop_words / n_words", low=0.02),
    Rule("duplicate_line_ratio", "n_dup_lines / n_text_lines", high=0.5),
    Rule("words_a_line", "n_words / n_text_lines", low=1.5),
)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = tuple(dict.fromkeys(STOP_WORDS))) -> DataFrame:
    """Per row: id and the counts that rules use, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_text_lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.trim("t", F.lit(SPACES)).alias("trimmed"))
    rows = rows.select(
        "doc_id",
        F.when(F.length("trimmed") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split("trimmed", WORD_BREAK)).alias("words"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("lines"),
    )
    words = F.col("words")
    rows = rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Windows as 64-bit hashes of their words' hashes, which sort and compare faster than text.
    hashes = F.col("hashes")
    window = lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))
    rows = rows.withColumn("windows", F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), window)).drop("hashes")
    # Windows of a document that repeats some, sorted: equal ones are neighbours.
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered).drop("windows")
    same = lambda x, i, step: F.coalesce(x["w"] == F.get(F.col("ordered"), i + step)["w"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("ordered", lambda x, i: (i > 0) & same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
    rows = rows.withColumn("starts", starts).drop("ordered")
    covered = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("starts"), i + 1) - p, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("starts")


def verdict(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A boolean column per rule, then `passes`: the table as one projection."""
    columns = []
    for r in rules:
        top, bottom = (F.expr(x.strip()).cast("double") for x in r.metric.split("/"))
        ratio = F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)
        columns.append(((ratio >= F.lit(r.low)) & (ratio <= F.lit(r.high))).alias(f"ok_{r.name}"))
    passes = F.lit(True)
    for c in columns:
        passes = passes & c
    return [*columns, passes.alias("passes")]


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, the measures, a boolean per rule and `passes`."""
    return measures(docs, id_col=id_col, text_col=text_col).select("*", *verdict(rules))
