"""Column functions over cue text: stripping, lengths, predicates, language, timestamps, spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import lexicon as lex

ZERO_WIDTH = "​"
CJK = "[一-鿿㐀-䶿]"


#: All white space, U+200B not among it.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; U+200B is kept."""
    return F.trim(c, F.lit(WHITE_SPACE))


def visible(c: Column) -> Column:
    return F.translate(c, " " + ZERO_WIDTH, "")


def visible_length(c: Column) -> Column:
    """Code points but spaces and zero-width spaces."""
    return F.length(visible(c))


def unspaced_length(c: Column) -> Column:
    return F.length(F.translate(c, " ", ""))


def ends_with_letter(c: Column) -> Column:
    return F.right(c, F.lit(1)).rlike("^[A-Za-z]$")


def starts_with_letter(c: Column) -> Column:
    return F.left(c, F.lit(1)).rlike("^[A-Za-z]$")


def is_repeat_loop(c: Column) -> Column:
    """A long text over very few different characters."""
    seen = visible(c)
    n, unique = F.length(seen), F.size(F.array_distinct(F.split(seen, "")))
    return (n >= lex.LOOP_MIN_CHARS) & ((unique / n < lex.LOOP_MIN_RATIO) | (unique <= 2))


def is_hallucination(c: Column) -> Column:
    return is_repeat_loop(c) | strip(c).isin(*lex.KNOWN_HALLUCINATIONS)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def language_of_words(words: Column) -> Column:
    """zh if any word has a Han character, else en."""
    return F.when(F.exists(words, lambda w: has_cjk(w["word"])), "zh").otherwise("en")


def pause_ms(language: Column, given: int | None = None) -> Column:
    """The pause that breaks a line: as given, or by language."""
    if given is not None:
        return F.lit(given)
    short = language.startswith("zh") | language.startswith("ja") | language.startswith("ko")
    return F.when(short, lex.PAUSE_CJK_MS).otherwise(lex.PAUSE_OTHER_MS)


def in_lexicon(c: Column, words: tuple[str, ...]) -> Column:
    return c.isin(*words)


def format_ms(ms: Column) -> Column:
    """HH:MM:SS,mmm of integer milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def format_seconds(s: Column) -> Column:
    """HH:MM:SS,mmm of seconds as a double; milliseconds are cut, not rounded."""
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor((s % 3600) / 60), F.floor(s % 60), F.floor((s - whole) * 1000))


STAMP = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"


def stamp_ms(c: Column, first: int) -> Column:
    """Milliseconds of the timestamp whose groups of STAMP start there."""
    h, m, s, ms = (F.regexp_extract(c, STAMP, first + i).cast("long") for i in range(4))
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def space_cjk_latin(c: Column) -> Column:
    """A space between Han and Latin letters or digits."""
    out = F.regexp_replace(c, f"({CJK})([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(out, f"([A-Za-z0-9])({CJK})", "$1 $2")


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"[{lex.STRONG_PUNCT}{lex.WEAK_PUNCT}]", "")


def pinned(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows; columns that are computed once here and not put together again inside later lambdas."""
    for name in names:
        rows = rows.withColumn(name, F.explode(F.array(name)))
    return rows
