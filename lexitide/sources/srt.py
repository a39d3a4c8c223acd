"""SRT files: one row per medium as text, one row per cue as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions.fold import emitted, fold
from lexitide.functions.text import STAMP, format_ms, pinned, stamp_ms, strip
from lexitide.operators.pipeline import renumber

SKIPPED, INDEX, STAMP_LINE, TEXT, BLANK = range(5)


def line_roles(lines: Column) -> Column:
    """What each line of an SRT text (pinned, stripped) is: after a line of digits the next one is read as the timestamp,
    whatever it is, then text lines up to a blank one. Digit lines inside a block are text; index values are not used."""

    def step(a: Column, line: Column) -> Column:
        before = a["s"]
        outside = before.isin(SKIPPED, BLANK)
        role = (
            F.when(outside, F.when(line.rlike(r"^\d+$"), INDEX).otherwise(SKIPPED)).when(before == INDEX, STAMP_LINE).when(F.length(line) == 0, BLANK).otherwise(TEXT)
        )
        return F.struct(role.alias("s"), F.array_append(a["out"], role).alias("out"))

    return emitted(fold(lines, F.lit(SKIPPED), "int", "int", step))


def parse_srt(files: DataFrame) -> DataFrame:
    """Segments (media_id, seg_idx, start_ms, end_ms, text) of rows (media_id, content)."""
    rows = pinned(files.select("media_id", F.transform(F.split("content", "\r\n|\r|\n"), strip).alias("lines")), "lines")
    rows = pinned(rows.withColumn("roles", line_roles(F.col("lines"))), "roles")
    places = lambda role: F.filter(F.transform("roles", lambda r, i: F.when(r == role, i)), lambda i: i.isNotNull())
    rows = pinned(pinned(rows.withColumn("stamps", places(STAMP_LINE)), "stamps").withColumn("blanks", places(BLANK)), "blanks")
    # Each block has one timestamp line, and one blank line unless the text ends first.
    end = lambda j: F.coalesce(F.get("blanks", j), F.size("lines"))
    block = lambda i, j: F.struct(F.get("lines", i).alias("stamp"), F.slice("lines", i + 2, end(j) - i - 1).alias("lines"))
    blocks = F.filter(F.transform("stamps", block), lambda b: b["stamp"].rlike(STAMP))
    rows = rows.select("media_id", F.posexplode(blocks).alias("seg_idx", "b"))
    return rows.select("media_id", F.col("seg_idx").cast("long").alias("seg_idx"), stamp_ms(F.col("b.stamp"), 1).alias("start_ms"), stamp_ms(F.col("b.stamp"), 5).alias("end_ms"), F.array_join("b.lines", " ").alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Segments of SRT files, media_id being the file's path."""
    return parse_srt(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content")))


def render_srt(segments: DataFrame) -> DataFrame:
    """(media_id, content): cues numbered from 1 by seg_idx."""
    rows = renumber(segments)
    block = F.concat(F.col("cue_idx").cast("string"), F.lit("\n"), format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    packed = rows.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("cue_idx", block.alias("block")))).alias("b"))
    return packed.select("media_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("content"))


def write_srt(segments: DataFrame, path: str) -> None:
    """A folder media_id=... with one SRT text for each medium. The path must not be one that segments are read from."""
    rows = render_srt(segments).withColumn("content", F.regexp_replace("content", "\n$", ""))  # the writer ends each row with a line break
    rows.write.partitionBy("media_id").text(path)


def default_output(path: str, language: str | None = None, polished: bool = False) -> str:
    """<stem>[_<language>][_Enhance].srt beside the input."""
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return stem + (f"_{language}" if language else "") + ("_Enhance" if polished else "") + ".srt"


def output_path(path: Column, language: Column, polished: Column) -> Column:
    """default_output() as a column; a null language adds nothing."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.concat(stem, F.coalesce(F.concat(F.lit("_"), language), F.lit("")), F.when(polished, "_Enhance").otherwise(""), F.lit(".srt"))


def cue_count(files: DataFrame) -> DataFrame:
    """(media_id, cues): lines of digits only in rows (media_id, content)."""
    return files.select("media_id", F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^[0-9]+$"))).cast("long").alias("cues"))


def preview(segments: DataFrame, n: int = 5) -> DataFrame:
    """The first n cues of each medium."""
    return renumber(segments).filter(F.col("cue_idx") <= n)
