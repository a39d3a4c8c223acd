"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.functions import lexicon as lex
from lexitide.functions import media, text
from lexitide.operators import clean, fallback, islands, layout, merge, pipeline, recognise, segment
from lexitide.sources import srt, stt, timeline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.from_documents(table(spark, sf_dir, "documents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.from_conversations(table(spark, sf_dir, "conversations"))


def plain(segments: DataFrame) -> DataFrame:
    return segments.select("media_id", "seg_idx", "start_ms", "end_ms", "text")


def timeline_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("media_id", "seg_idx", F.posexplode("words").alias("pos", "w"))
    return rows.select("media_id", "seg_idx", F.col("pos").cast("long").alias("pos"), "w.word", "w.start_ms", "w.end_ms")


def drop_empty_and_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(clean.drop_no_duration(clean.drop_empty(document_segments(spark, sf_dir))))


def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth word blanked, some starts removed, some words without duration; then cleaned."""
    bad = F.transform(
        "words",
        lambda w, i: F.struct(
            F.when(i % 5 == 1, "  ").otherwise(w["word"]).alias("word"), F.when(i % 7 != 2, w["start_ms"]).alias("start_ms"), F.when(i % 11 == 3, w["start_ms"]).otherwise(w["end_ms"]).alias("end_ms")
        ),
    )
    rows = turns(spark, sf_dir).withColumn("bad", bad).withColumn("good", clean.clean_words(F.col("bad")))
    return rows.select("media_id", "seg_idx", F.size("bad").cast("long").alias("n_before"), F.size("good").cast("long").alias("n_after"), F.array_join(F.transform("good", lambda w: w["word"]), "").alias("kept_text"))


def clean_segments_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts are folded onto three values, so that repeated lines meet."""
    rows = document_segments(spark, sf_dir).withColumn("start_ms", (F.col("seg_idx") % 3) * 1000).withColumn("end_ms", F.col("start_ms") + F.col("seg_idx") % 5)
    return plain(clean.dedup_segments(rows))


def detect_language_pause(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_segments(spark, sf_dir).select("media_id", "seg_idx", "words")
    word = lambda w: F.struct(F.lit(w).alias("word"), F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"))
    fixed = spark.range(1).select(F.lit(-1).cast("long").alias("media_id"), F.posexplode(F.array(F.array(word("大家"), word("ok")), F.array(word("ok")), F.array(word("か")))).alias("seg_idx", "words"))
    rows = own.unionByName(fixed.withColumn("seg_idx", F.col("seg_idx").cast("long"))).withColumn("language", text.language_of_words(F.col("words")))
    return rows.select("media_id", "seg_idx", "language", text.pause_ms(F.col("language")).alias("pause_ms"))


def visible_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("words", F.lit(0), lambda a, w: a + text.visible_length(w["word"]))
    return turns(spark, sf_dir).select("media_id", "seg_idx", total.cast("long").alias("chars"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.with_features(turns(spark, sf_dir), F.lit(lex.PAUSE_OTHER_MS))
    rows = rows.select("media_id", "seg_idx", F.posexplode("__f").alias("pos", "f")).filter("pos > 0")
    return rows.withColumn("pos", F.col("pos").cast("long"))


def natural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("media_id", "seg_idx", "pos", F.col("f.nb").alias("natural_break"))


def gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("media_id", "seg_idx", "pos", F.col("f.g").cast("long").alias("score"))


def next_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successor of every word, not only of line starts."""
    rows = segment.with_features(turns(spark, sf_dir).filter(F.size("words") > 0), F.lit(lex.PAUSE_OTHER_MS)).withColumnRenamed("__f", "f")
    cuts = F.transform(F.sequence(F.lit(0), F.size("f") - 1), lambda i: segment.next_cut(F.col("f"), i, F.lit(0), lex.MAX_CHARS, lex.MAX_LINE_MS))
    return rows.select("media_id", "seg_idx", F.posexplode(cuts).alias("pos", "next")).select("media_id", "seg_idx", F.col("pos").cast("long").alias("pos"), F.col("next").cast("long").alias("next"))


def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.with_lines(document_segments(spark, sf_dir).filter(F.size("words") > 0), F.lit(lex.PAUSE_OTHER_MS))
    rows = rows.select("media_id", "seg_idx", F.posexplode("lines").alias("line", "x"))
    return rows.select("media_id", "seg_idx", F.col("line").cast("long").alias("line"), "x.start_ms", "x.end_ms", "x.text", F.size("x.words").cast("long").alias("n_words"))


def refine_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.refine(document_segments(spark, sf_dir), ordered=True)


def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut after every third word, so that letters meet often."""
    rows = document_segments(spark, sf_dir).select("media_id", "seg_idx", F.posexplode("words").alias("pos", "w"))
    rows = rows.select("media_id", (F.col("seg_idx") * 100_000 + F.floor(F.col("pos") / 3)).alias("seg_idx"), "pos", "w")
    rows = rows.groupBy("media_id", "seg_idx").agg(
        F.min("w.start_ms").alias("start_ms"), F.max("w.end_ms").alias("end_ms"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("w.word").alias("word")))), lambda x: x["word"]), "").alias("text")
    )
    return merge.merge_fragments(rows, 50)


def _with_loops(rows: DataFrame) -> DataFrame:
    """Some lines replaced by loops of a few characters and by a known phrase."""
    loop = F.when(F.col("seg_idx") % 10 == 3, F.repeat(F.lit("ab"), F.lit(15))).when(F.col("seg_idx") % 10 == 5, F.repeat(F.lit("abc"), F.lit(26))).when(F.col("seg_idx") % 10 == 7, lex.KNOWN_HALLUCINATIONS[0])
    return rows.withColumn("text", F.coalesce(loop, F.col("text")))


def repeat_loop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(clean.drop_hallucinations(_with_loops(document_segments(spark, sf_dir))))


def merge_adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line replaced by the one before it, in upper case, so that neighbours repeat."""
    before = F.lag("text").over(Window.partitionBy("media_id").orderBy("seg_idx"))
    copied = F.when(F.col("seg_idx") % 3 == 1, F.upper(F.coalesce(before, "text"))).otherwise(F.col("text"))
    return islands.merge_adjacent_duplicates(plain(document_segments(spark, sf_dir)).withColumn("text", copied))


def _event_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").filter("user_id is not null and ts is not null and value is not null")
    return rows.select(F.col("user_id").cast("long").alias("media_id"), F.col("event_id").cast("long").alias("idx"), start.alias("start_ms"), (start + F.floor(F.abs("value") * 1000).cast("long")).alias("end_ms"))


def merge_speech_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.merge_regions(_event_regions(spark, sf_dir), gap_ms=60_000, min_ms=1000)


def shift_to_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as regions: each on its own clock, moved onto the conversation's."""
    rows = turns(spark, sf_dir)
    regions = rows.select("media_id", F.col("seg_idx").alias("region"), "start_ms", "end_ms")
    local = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] - F.col("start_ms")).alias("start_ms"), (w["end_ms"] - F.col("start_ms")).alias("end_ms")))
    own = rows.withColumn("words", local).withColumn("end_ms", F.col("end_ms") - F.col("start_ms")).withColumn("start_ms", F.lit(0).cast("long")).withColumn("region", F.col("seg_idx"))
    out = islands.shift_to_absolute(own, regions)
    return out.select("media_id", "seg_idx", "start_ms", "end_ms", F.get("words", F.lit(0))["start_ms"].alias("first_word_ms"))


def cleanup_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.cleanup(plain(_with_loops(document_segments(spark, sf_dir))))


def format_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_segments(spark, sf_dir)
    return rows.select("media_id", "seg_idx", text.format_ms(F.col("start_ms")).alias("from_ms"), text.format_seconds(F.col("start_ms") / 1000.0).alias("from_seconds"))


def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.render_srt(clean.drop_empty(document_segments(spark, sf_dir)))


def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.parse_srt(srt.render_srt(clean.drop_empty(document_segments(spark, sf_dir))))


def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.cue_count(srt.render_srt(clean.drop_empty(turns(spark, sf_dir))))


def cue_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt.preview(plain(turns(spark, sf_dir))).select("media_id", "cue_idx", "start_ms", "end_ms", "text")


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments per medium before and after cleanup."""
    rows = plain(_with_loops(document_segments(spark, sf_dir)))
    before = rows.groupBy("media_id").agg(F.count("*").alias("n_before"))
    after = pipeline.cleanup(rows).groupBy("media_id").agg(F.count("*").alias("n_after"))
    return before.join(after, "media_id", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0).cast("long")))


def fallback_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.split_untimed(plain(document_segments(spark, sf_dir))).withColumn("line", F.col("line").cast("long"))


def _translated(cues: DataFrame) -> DataFrame:
    return cues.select("media_id", "cue_idx", F.concat(F.lit("T: "), "text").alias("text"))


def bilingual_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = pipeline.renumber(plain(clean.drop_empty(turns(spark, sf_dir)))).drop("seg_idx")
    out = None
    for mode in layout.MODES:
        rows = layout.layout_cues(cues, _translated(cues), mode).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out.select("media_id", "cue_idx", "start_ms", "end_ms", "mode", "text")


def cue_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues against a copy in which some are lost and some are moved."""
    cues = pipeline.renumber(plain(turns(spark, sf_dir)))
    other = cues.filter("cue_idx % 4 <> 3").withColumn("end_ms", F.col("end_ms") + F.when(F.col("cue_idx") % 5 == 0, 1).otherwise(0))
    return layout.mismatched_cues(cues, other).select("media_id", "cue_idx", "s1", "e1", "s2", "e2")


def translation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = pipeline.renumber(turns(spark, sf_dir)).withColumn("language", text.language_of_words(F.col("words")))
    return cues.select("media_id", "cue_idx", layout.needs_translation(F.col("language")).alias("translate"), layout.batch_of(F.col("cue_idx")).alias("batch"), layout.baseline_text(F.when(F.col("cue_idx") % 2 == 0, "polished"), F.col("text")).alias("baseline"), layout.wrap(F.col("text")).alias("wrapped"))


CJK_SAMPLES = ("用Python写3行代码。", "Hello世界, ok!", "纯中文", "plain text", "版本2是New的", "a中b文c")


def cjk_latin_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, CJK_SAMPLES))).alias("text"))
    rows = fixed.unionByName(turns(spark, sf_dir).select(F.concat(F.lit("中"), "text").alias("text")))
    return rows.select("text", text.space_cjk_latin(F.col("text")).alias("spaced"), text.remove_punctuation(F.col("text")).alias("bare"))


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("long").alias("media_id"), (F.col("o_orderkey").cast("long") % 40_000 + 1).cast("double").alias("duration_s"))


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _media(spark, sf_dir).withColumn("size_bytes", (F.col("duration_s") * 16_000).cast("long")).withColumn("wav", media.wav_bytes(F.col("duration_s")))
    return rows.select("media_id", media.upload_plan(F.col("size_bytes"), F.col("wav")).alias("plan"), media.bitrate(F.col("duration_s")).cast("long").alias("bitrate"))


def vad_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _media(spark, sf_dir).withColumn("vad", F.col("media_id") % 3 == 0).withColumn("no_vad", F.col("media_id") % 2 == 0)
    language = F.when(F.col("media_id") % 5 == 0, "zh-CN").when(F.col("media_id") % 5 == 1, "ja").when(F.col("media_id") % 5 == 2, "en")
    return rows.select("media_id", media.use_vad(F.col("duration_s"), F.col("vad"), F.col("no_vad")).alias("use_vad"), text.pause_ms(F.coalesce(language, F.lit(""))).cast("long").alias("pause_ms"), media.chinese_prompt(language).alias("chinese_prompt"))


def stt_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as service responses, segments in reverse, then scanned."""
    seg = F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), F.lit(7).alias("extra"))
    rows = turns(spark, sf_dir).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", seg.alias("s"))), asc=False).alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("segments")))
    return plain(stt.response_segments(rows.select("media_id", body.alias("body"))))


PROBES = ('{"streams":[{},{"duration":"12.5"}]}', '{"streams":[{"duration":"3"},{"duration":"9"}]}', '{"streams":[]}', "not json", '{"streams":[{"duration":"N/A"}]}', "{}")


def ffprobe_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, PROBES))).alias("id", "body"))
    rows = rows.select(F.col("id").cast("long").alias("id"), "body").unionByName(table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") + 100).alias("id"), F.concat(F.lit('{"streams":[{"duration":"'), F.col("o_orderkey").cast("string"), F.lit('.25"}]}')).alias("body")))
    return rows.select("id", stt.probe_duration(F.col("body")).alias("seconds"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three words each of the documents' lines, with their words. Words of a line follow one another in time."""
    rows = document_segments(spark, sf_dir).select("media_id", "seg_idx", "words")
    n = F.size("words")
    rows = rows.select("media_id", "seg_idx", "words", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int")))).alias("nth"))
    rows = rows.select("media_id", (F.col("seg_idx") * 100_000 + F.col("nth")).alias("seg_idx"), F.slice("words", F.col("nth") * 3 + 1, F.lit(3)).alias("words"))
    joined = F.concat(*(F.coalesce(F.get("words", F.lit(i))["word"], F.lit("")) for i in range(3)))
    return rows.select("media_id", "seg_idx", F.get("words", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("words", -1)["end_ms"].alias("end_ms"), text.strip(joined).alias("text"), "words")


def refine_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of three kinds by their id: without any words, with words in every fourth segment only, with words in all."""
    timed = F.when(F.col("media_id") % 3 == 0, False).when(F.col("media_id") % 3 == 1, F.col("seg_idx") % 4 == 0).otherwise(True)
    return pipeline.refine(_triples(spark, sf_dir).withColumn("words", F.when(timed, F.col("words"))), ordered=True)


HAN = ("大家", "好", "今天", "我们", "来", "学习", "一下，", "这个", "新的", "功能。", "首先", "但是", "看", "界面", "然后", "为了", "步骤、", "去", "操作", "因为", "ok", "所以", "比如说")


def refine_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose words are replaced by Han ones, chosen by length and position, with the words' times."""
    table_ = F.array(*map(F.lit, HAN))
    words = F.transform("words", lambda w, i: F.struct(F.get(table_, (F.length(w["word"]) * 7 + i) % len(HAN)).alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms")))
    return pipeline.refine(turns(spark, sf_dir).withColumn("words", words))


def stt_words_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as service responses with words, scanned and refined."""
    word = lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] / 1000.0).alias("start"), (w["end_ms"] / 1000.0).alias("end"))
    seg = F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", F.transform("words", word).alias("words"))
    rows = turns(spark, sf_dir).groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", seg.alias("s"))), asc=False).alias("x"))
    body = F.to_json(F.struct(F.transform("x", lambda x: x["s"]).alias("segments")))
    return pipeline.refine(stt.response_segments(rows.select("media_id", body.alias("body"))))


def whole_audio_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as regions; a user whose regions are all short is taken whole."""
    events = _event_regions(spark, sf_dir)
    media_ = events.groupBy("media_id").agg(F.max("end_ms").alias("duration_ms"))
    return islands.regions_or_whole(media_, islands.merge_regions(events, gap_ms=1000, min_ms=250_000))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/v1.2/"), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, ".tar.mp3").when(F.col("c_custkey") % 3 == 1, ".wav").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"), F.when(F.col("c_custkey") % 2 == 0, "zh").alias("language"), (F.col("c_custkey") % 5 == 0).alias("polished"))
    return rows.select(F.col("c_custkey").cast("long").alias("id"), srt.output_path(F.col("path"), F.col("language"), F.col("polished")).alias("output"))


def sample_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media of two channels at 16 samples a second: mono, a region of it, and whether that is long enough."""
    n = (F.col("media_id") % 90).cast("int")
    left = F.transform(F.sequence(F.lit(0), n), lambda i: (i % 7).cast("double"))
    right = F.transform(F.sequence(F.lit(0), n), lambda i: (i % 5).cast("double"))
    frames = F.zip_with(left, right, lambda x, y: F.array(x, y))
    rows = text.pinned(_media(spark, sf_dir).withColumn("audio", media.mono(frames)), "audio")
    part = media.sample_slice(F.col("audio"), (F.col("media_id") % 13) * 100, (F.col("media_id") % 29) * 150, rate=16)
    rows = text.pinned(rows.withColumn("part", part), "part")
    return rows.select("media_id", F.size("audio").cast("long").alias("samples"), F.size("part").cast("long").alias("kept"), F.aggregate("part", F.lit(0.0), lambda a, x: a + x).alias("total"), media.long_enough(F.col("part"), rate=16).alias("long_enough"))


def engine_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") / by).cast("int") % len(names))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("media_id"), pick(("auto", "mlx", "groq"), 1).alias("requested"), pick(("Darwin", "Linux"), 3).alias("system"), pick(("arm64", "x86_64"), 6).alias("machine"))
    return rows.select("media_id", media.engine_of(F.col("requested"), F.col("system"), F.col("machine")).alias("engine"))


def _stub(content: str) -> recognise.Segments:
    """A recogniser for texts: one segment for each line of 5 words; it fails on some lengths and finds nothing in short ones."""
    if len(content) % 7 == 0:
        raise ValueError(f"length {len(content)}")
    words = content.split(" ")
    parts = [words[i : i + 5] for i in range(0, len(words), 5)] if len(words) > 5 else []
    return [(1000 * i, 1000 * i + 900, " ".join(p), [(w, 1000 * i + 100 * j, 1000 * i + 100 * j + 90) for j, w in enumerate(p)]) for i, p in enumerate(parts)]


def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of conversations: what each gave, and what it raised."""
    chunks = turns(spark, sf_dir).select("media_id", F.col("seg_idx").alias("region"), F.col("text").alias("content"))
    out = recognise.recognise_chunks(chunks, _stub)
    return out.select("media_id", "region", F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("segments"), F.coalesce("error", F.lit("")).alias("error"))


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the chunks that gave some, on the conversation's clock."""
    chunks = turns(spark, sf_dir).select("media_id", F.col("seg_idx").alias("region"), "start_ms", "end_ms", F.col("text").alias("content"))
    return plain(recognise.chunk_segments(recognise.recognise_chunks(chunks, _stub), chunks.select("media_id", "region", "start_ms", "end_ms")))


def media_without_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as media of one chunk each: those of which nothing was recognised."""
    chunks = turns(spark, sf_dir).select((F.col("media_id") * 1000 + F.col("seg_idx")).alias("media_id"), F.lit(1).alias("region"), F.col("text").alias("content"))
    return recognise.media_without_result(chunks.select("media_id"), recognise.recognise_chunks(chunks, _stub))


def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns that are the first word of a part's name, written as its type's last word."""
    cues = pipeline.renumber(plain(turns(spark, sf_dir))).select("media_id", "cue_idx", "text")
    first = F.element_at(F.split("p_name", " "), 1)
    terms = table(spark, sf_dir, "part").select(first.alias("term"), F.lower(F.element_at(F.split("p_type", " "), -1)).alias("wording"))
    common = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("wording")) for a, b in TERMS))))
    return layout.replace_terms(cues, terms.unionByName(common))


TERMS = (("the", "THE"), ("of", "von"), ("le", "the"), ("la", "the"), ("und", "et"), ("und", "&"), ("que", "which one"))


def normalize_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with some times and texts removed."""
    rows = document_segments(spark, sf_dir)
    rows = rows.select("media_id", "seg_idx", F.when(F.col("seg_idx") % 3 != 1, F.col("start_ms")).alias("start_ms"), F.when(F.col("seg_idx") % 5 != 2, F.col("end_ms")).alias("end_ms"), F.when(F.col("seg_idx") % 4 != 3, F.concat(F.lit(" \t"), "text", F.lit(" "))).alias("text"))
    return clean.normalize_segments(rows)


def _name(f: Callable) -> str:
    return f.__name__


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    _name(f): f
    for f in (
        timeline_words, drop_empty_and_zero, clean_words, clean_segments_dedup, detect_language_pause, visible_chars, natural_breaks, gap_scores, next_cut, segment_lines,
        refine_pipeline, merge_fragments, repeat_loop_filter, merge_adjacent_duplicates, merge_speech_regions, shift_to_absolute, cleanup_pipeline, format_timestamps, srt_render,
        srt_parse, cue_counts, cue_preview, change_report, fallback_split, bilingual_layout, cue_mismatches, translation_plan, cjk_latin_spacing, upload_plan, vad_plan, stt_json_scan, ffprobe_duration,
        refine_mixed, refine_han, stt_words_refine, whole_audio_fallback, output_names, sample_slices, engine_selection, chunk_errors, chunk_results, media_without_result, terminology, normalize_segments,
    )
}
