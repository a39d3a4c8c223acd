"""Fixtures with exact expected rows, and invariants."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexitide.functions import fold, lexicon, media, text
from lexitide.operators import clean, fallback, islands, layout, merge, pipeline, recognise, segment
from lexitide.plans import queries
from lexitide.sources import audio, srt, stt, timeline

SEG = "media_id long, seg_idx long, start_ms long, end_ms long, text string"
WORDS = "words array<struct<word:string,start_ms:bigint,end_ms:bigint>>"
HAN = """大家 0.0 0.3; 好 0.3 0.5; 今天 0.5 0.8; 我们 0.8 1.1; 来 1.1 1.3; 学习 1.3 1.6; 一下 1.6 1.8; 这个 1.8 2.0; 新的 2.0 2.3; 功能 2.3 2.5;
首先 3.0 3.3; 我们 3.3 3.5; 先 3.5 3.7; 来 3.7 3.9; 看 3.9 4.1; 一下 4.1 4.3; 这个 4.3 4.5; 界面 4.5 4.8; 然后 5.2 5.4; 我们 5.4 5.6;
再 5.6 5.8; 一步 5.8 6.0; 一步 6.0 6.2; 去 6.2 6.4; 操作 6.4 6.7"""
HAN_WORDS = [(w, round(float(a) * 1000), round(float(b) * 1000)) for w, a, b in (x.split() for x in HAN.replace("\n", " ").split(";"))]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def segs(spark, data, words=None):
    if words is None:
        return spark.createDataFrame([(1, i, *x) for i, x in enumerate(data)], SEG)
    return spark.createDataFrame([(1, i, *x, w) for i, (x, w) in enumerate(zip(data, words, strict=True))], f"{SEG}, {WORDS}")


def lines_of(spark, words, content="x", **options):
    df = segs(spark, [(words[0][1] if words else 0, words[-1][2] if words else 1, content)], [words])
    return rows(pipeline.refine(df, **options), "start_ms", "end_ms", "text")


@pytest.mark.parametrize(("most", "cuts"), [(20, [0, 10, 18, 25]), (15, [0, 8, 10, 18, 25])])
def test_han_lines(spark, most, cuts):
    want = [(HAN_WORDS[a][1], HAN_WORDS[b - 1][2], "".join(w[0] for w in HAN_WORDS[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert lines_of(spark, HAN_WORDS, max_chars=most) == want


def test_empty_text_is_dropped_even_with_words(spark):
    assert lines_of(spark, HAN_WORDS, content="", max_chars=15) == []


def test_single_word_and_duration_limit(spark):
    assert lines_of(spark, [("Hello", 0, 500)]) == [(0, 500, "Hello")]
    words = [(f"w{i}", i * 1000, i * 1000 + 500) for i in range(10)]
    got = lines_of(spark, words, max_chars=50, max_ms=3000, merge=False)
    assert [(a, b) for a, b, _ in got] == [(0, 2500), (3000, 5500), (6000, 8500), (9000, 9500)]


def test_zero_width_words_and_long_word(spark):
    words = [("​", 0, 10), ("​", 10, 20), ("x" * 40, 20, 30), ("y", 30, 40)]
    got = lines_of(spark, words, merge=False)
    assert "".join(t for _, _, t in got).replace("​", "") == "x" * 40 + "y"


def test_clean_words(spark):
    words = [("good", 0, 300), ("", 300, 500), ("bad", None, 500), ("bad2", 500, 300), ("ok", 600, 900)]
    df = segs(spark, [(0, 1, "x")], [words]).select(clean.clean_words(F.col("words")).alias("w"))
    assert [x.word for x in df.first().w] == ["good", "ok"]


def test_duplicates_and_glued_words(spark):
    df = segs(spark, [(0, 1000, "hello"), (0, 1000, "hello"), (2000, 3000, "world")], [[], [], None])
    assert rows(clean.dedup_segments(df), "seg_idx") == [(0,), (2,)]
    assert rows(pipeline.refine(df), "start_ms", "end_ms", "text") == [(0, 3000, "helloworld")]
    assert len(rows(pipeline.refine(df, merge=False), "text")) == 2
    assert len(rows(pipeline.refine(df, max_gap_ms=500), "text")) == 2


def test_untimed_segment_passes_or_splits(spark):
    line = "今天天气真不错，我们一起去公园散步吧。"
    df = segs(spark, [(0, 8000, line)], [[]])
    assert rows(pipeline.refine(df, max_chars=11, max_ms=5000), "start_ms", "end_ms", "text") == [(0, 8000, line)]
    parts = pipeline.refine(df, max_chars=11, max_ms=5000, fallback="split").orderBy("seg_idx").collect()
    assert len(parts) > 1 and "".join(p.text for p in parts) == line
    assert parts[0].start_ms == 0 and parts[-1].end_ms == 8000
    with pytest.raises(ValueError):
        pipeline.refine(df, fallback="no")


def test_fallback_keeps_text_of_edges(spark):
    data = [(0, 100, "a" * 60), (0, 9000, "word " * 20), (0, 9000, "x"), (0, 0, "  "), (0, 50, "，" * 30)]
    got = fallback.split_untimed(segs(spark, data))
    for i, (_, _, t) in enumerate(data):
        parts = [r.text for r in got.filter(F.col("seg_idx") == i).orderBy("line").collect()]
        assert "".join(parts).replace(" ", "") == t.replace(" ", "")


def test_adjacent_duplicates(spark):
    df = segs(spark, [(0, 1000, "Hi"), (1000, 2000, "hi "), (2000, 3000, "yo")])
    assert rows(islands.merge_adjacent_duplicates(df), "start_ms", "end_ms", "text") == [(0, 2000, "Hi"), (2000, 3000, "yo")]
    df = segs(spark, [(0, 5000, "a"), (1000, 3000, "a")])
    assert rows(pipeline.cleanup(df), "start_ms", "end_ms", "text") == [(0, 3000, "a")]


def test_repeat_loops(spark):
    cases = {"啊" * 30: True, "啊" * 29: False, "ab" * 15: True, "abc" * 15: False, "abc" * 26: True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.is_repeat_loop(F.col("t")).alias("x"))
    assert {r.t: bool(r.x) for r in df.collect()} == cases
    assert rows(pipeline.cleanup(segs(spark, [(0, 1, "啊" * 30)])), "text") == []


def test_regions(spark):
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 2000), (2500, 4000), (5000, 5500), (9000, 9400)])], "media_id long, idx long, start_ms long, end_ms long")
    merged = islands.merge_regions(df)
    assert rows(merged, "start_ms", "end_ms") == [(0, 4000)]
    medium = spark.createDataFrame([(1, 9999), (2, 700)], "media_id long, duration_ms long")
    assert rows(islands.regions_or_whole(medium, merged), "media_id", "start_ms", "end_ms") == [(1, 0, 4000), (2, 0, 700)]


def test_words_are_shifted_too(spark):
    own = spark.createDataFrame([(1, 1, 0, 0, 1000, "a", [("a", 500, 1000)])], f"media_id long, region long, seg_idx long, start_ms long, end_ms long, text string, {WORDS}")
    regions = spark.createDataFrame([(1, 1, 10_000, 12_000)], "media_id long, region long, start_ms long, end_ms long")
    got = islands.shift_to_absolute(own, regions).first()
    assert (got.start_ms, got.end_ms) == (10_000, 11_000) and tuple(got.words[0]) == ("a", 10_500, 11_000)


def test_fragments(spark):
    assert rows(merge.merge_fragments(segs(spark, [(0, 1, "posit"), (1, 2, "ion")]), 25), "text") == [("position",)]
    assert len(rows(merge.merge_fragments(segs(spark, [(0, 1, "posit"), (1, 2, "ion")]), 7), "text")) == 2
    assert rows(merge.merge_fragments(segs(spark, [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")]), 2), "text") == [("ab",), ("cd",)]


def test_timestamps(spark):
    df = spark.createDataFrame([(1.001,), (3661.999,), (0.0,)], "s double").select(text.format_seconds(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == ["00:00:01,000", "01:01:01,998", "00:00:00,000"]
    df = spark.createDataFrame([(3_661_999,)], "ms long").select(text.format_ms(F.col("ms")).alias("t"))
    assert df.first().t == "01:01:01,999"


def test_srt_quirks_and_round_trip(spark, tmp_path):
    body = "1\n00:00:01.500 --> 00:00:02,000 x:1\none\ntwo\n\n2\nbad stamp\nlost\n\n3\n00:00:03,000-->00:00:04,000\nthree\n"
    df = spark.createDataFrame([(1, body), (2, ""), (3, "5\n\n6\n00:00:01,000 --> 00:00:02,000\nlost\n")], "media_id long, content string")
    assert rows(srt.parse_srt(df), "media_id", "start_ms", "end_ms", "text") == [(1, 1500, 2000, "one two"), (1, 3000, 4000, "three")]
    data = segs(spark, [(0, 1234, "a b"), (5000, 6001, "c")])
    srt.write_srt(data, str(tmp_path / "out"))
    back = srt.read_srt(spark, str(tmp_path / "out" / "media_id=1"))
    assert rows(back, "start_ms", "end_ms", "text") == rows(data, "start_ms", "end_ms", "text")
    assert srt.default_output("/a/b.mp3", "zh", True) == "/a/b_zh_Enhance.srt"


def test_json_sources(spark):
    body = '{"segments":[{"start":2.0,"end":3.0,"text":" b "},{"text":"a"}],"language":"en"}'
    df = spark.createDataFrame([(1, body), (2, "{}")], "media_id long, body string")
    assert rows(stt.response_segments(df), "seg_idx", "start_ms", "end_ms", "text") == [(0, 0, 0, "a"), (1, 2000, 3000, "b")]
    probes = spark.createDataFrame([('{"streams":[{},{"duration":"12.5"}]}',), ("broken",), (None,)], "b string")
    assert [r.x for r in probes.select(stt.probe_duration(F.col("b")).alias("x")).collect()] == [12.5, 0.0, 0.0]


def test_media_plans(spark):
    df = spark.createDataFrame([(600.0,), (3600.0,), (20000.0,)], "d double").select(media.bitrate(F.col("d")).alias("b"))
    assert [r.b for r in df.collect()] == [128000, 48000, 16000]
    assert media.engine("auto", "Darwin", "arm64") == "mlx" and media.engine("auto", "Linux", "x86_64") == "faster-whisper"
    a = spark.createDataFrame([([1.0] * 16000, [[1.0, 3.0]])], "a array<double>, c array<array<double>>")
    got = a.select(F.size(media.sample_slice(F.col("a"), F.lit(500), F.lit(750))).alias("n"), media.mono(F.col("c")).alias("m"), media.long_enough(F.col("a")).alias("ok")).first()
    assert (got.n, got.m, got.ok) == (4000, [2.0], True)


def test_scores(spark):
    case = lambda left, right, gap, chars=20, ms=0: segment.score_gap(F.lit(left), F.lit(right), F.lit(gap), F.lit(300), F.lit(chars), F.lit(ms))
    got = spark.range(1).select(case("a。", "首先", 300).alias("a"), case("a,", "But", 150).alias("b"), case("so", "x", 0, 3).alias("c"), case("x", "y", 0, 30).alias("d")).first()
    assert tuple(got) == (10, 0, -6, 2)


def test_layout(spark):
    cues = spark.createDataFrame([(1, 1, 0, 10, "a"), (1, 2, 10, 20, "b")], "media_id long, cue_idx long, start_ms long, end_ms long, text string")
    other = cues.withColumn("text", F.upper("text"))
    assert rows(layout.layout_cues(cues, other, "translation_above"), "text") == [("A\na",), ("B\nb",)]
    assert layout.mismatched_cues(cues, other).count() == 0 and layout.mismatched_cues(cues, other.limit(1)).count() == 1
    got = spark.range(1).select(layout.tidy(F.lit("用Python写3行。")).alias("t"), layout.wrap(F.lit("x" * 20)).alias("w")).first()
    assert got.t == "用 Python 写 3 行" and got.w == "x" * 18 + "\n" + "x" * 2


def test_lexicon_membership():
    assert "for" in lexicon.BAD_LINE_START and "首先" in lexicon.GOOD_LINE_START and "然后" in lexicon.BAD_LINE_END and "…" in lexicon.STRONG_PUNCT


def test_lines_partition_words(spark):
    from lexitide.sources.timeline import from_documents

    docs = spark.createDataFrame([(1, "one two, three. " * 30 + "\n\nfour " * 3), (2, None), (3, "")], "doc_id long, text string")
    d = from_documents(docs).filter(F.size("words") > 0)
    for r in segment.with_lines(d, F.lit(500)).collect():
        assert [w for line in r.lines for w in line.words] == r.words
        assert all(line.end_ms - line.start_ms <= 4000 or len(line.words) == 1 for line in r.lines)


def test_entry_without_corpus_folder():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_translation_plan_keeps_whole_turns(spark, tmp_path):
    import __spark_entry__

    turns = [" ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40)), "short", "x" * 61]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = __spark_entry__.queries()["translation_plan"](spark, str(tmp_path)).sort("cue_idx").collect()
    assert [r.wrapped.replace("\n", "") for r in got] == turns and max(len(x) for r in got for x in r.wrapped.split("\n")) == 18
    assert [r.baseline for r in got] == [turns[0], "polished", turns[2], "polished"]


def test_bench_times_all_headline_queries():
    import bench

    assert {"segment_lines", "merge_fragments", "fallback_split"} <= set(bench.QUERIES)


def test_merge_adjacent_duplicates_compares_whole_lines(spark, monkeypatch):
    from lexitide.plans import queries

    data = [(100 * i, 100 * i + 50, f"The same start of line, then {i} differs.") for i in range(9)]
    monkeypatch.setattr(queries, "document_segments", lambda *_: segs(spark, data))
    got = rows(queries.merge_adjacent_duplicates(spark, ""), "seg_idx", "text")
    assert got == [(i, x[2]) for i, x in enumerate(data) if i % 3 != 1]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_fold_over_chunks(spark, n):
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.when(x % 3 > 0, F.array_append(a["out"], a["s"] + x)).otherwise(a["out"]).alias("out"))
    df = spark.createDataFrame([(list(range(1, n + 1)),)], "v array<int>")
    got = df.select(fold.fold(F.col("v"), F.lit(0), "int", "int", step, chunk=4).alias("f")).select(fold.emitted(F.col("f")).alias("out"), fold.last_state(F.col("f")).alias("s")).first()
    assert got.s == n * (n + 1) // 2 and got.out == [i * (i + 1) // 2 for i in range(1, n + 1) if i % 3]


def test_long_segments_keep_all_words(spark):
    """One segment of many chunks: lines partition its words, and cues of many lines survive a round trip."""
    from lexitide.sources.timeline import from_documents

    body = " ".join(f"word{i % 11}{'.' if i % 17 == 0 else ''}" for i in range(5000))
    docs = from_documents(spark.createDataFrame([(1, body)], "doc_id long, text string"))
    got = segment.with_lines(docs, F.lit(500)).first()
    assert [w for line in got.lines for w in line.words] == got.words and len(got.words) == 5000
    times = [(w.start_ms, w.end_ms) for w in got.words]
    assert all(a[1] <= b[0] for a, b in zip(times, times[1:], strict=False)) and times[-1][1] == got.end_ms
    block = "1\n00:00:01,000 --> 00:00:02,000\n" + "line\n" * 1000 + "\n" + "2\n00:00:03,000 --> 00:00:04,000\nx"
    back = srt.parse_srt(spark.createDataFrame([(1, block)], "media_id long, content string")).orderBy("seg_idx").collect()
    assert [(r.start_ms, len(r.text)) for r in back] == [(1000, 4999), (3000, 1)]


def test_zero_width_words_do_not_end_a_line(spark):
    words = [("\u200b", 10 * i, 10 * i + 10) for i in range(200)] + [("a b", 2000, 2100), ("c.", 2100, 2200), ("next", 2200, 2300)]
    got = lines_of(spark, words, merge=False)
    assert [t.replace("\u200b", "") for _, _, t in got] == ["a bc.next"]


def test_chunks_that_fail_are_rows(spark):
    def recogniser(content):
        if content == "bad":
            raise RuntimeError("no model")
        return [(0, 900, f" {content} ", [(content, 0, 900)])] if content else []

    chunks = spark.createDataFrame([(1, 1, "a", 0, 1000), (1, 2, "bad", 1000, 2000), (1, 3, "b", 2000, 3000), (2, 1, "bad", 0, 10), (3, 1, "", 0, 10)], "media_id long, region long, content string, start_ms long, end_ms long")
    out = recognise.recognise_chunks(chunks, recogniser)
    assert [(r.media_id, r.region, r.error) for r in out.orderBy("media_id", "region").collect() if r.error] == [(1, 2, "RuntimeError: no model"), (2, 1, "RuntimeError: no model")]
    own = recognise.chunk_segments(out, chunks.select("media_id", "region", "start_ms", "end_ms"))
    assert rows(own, "seg_idx", "start_ms", "end_ms", "text") == [(0, 0, 900, "a"), (1, 2000, 2900, "b")] and own.filter("seg_idx = 1").first().words[0].start_ms == 2000
    assert rows(recognise.media_without_result(chunks.select("media_id").distinct(), out), "media_id") == [(2,), (3,)]
    media_ = spark.createDataFrame([(1, 500, "x"), (2, 700, "")], "media_id long, duration_ms long, content string")
    found = recognise.detect_regions(media_, lambda c: [(0, 100), (200, 300)] if c else 1 / 0)
    assert rows(found, "media_id", "region", "start_ms", "end_ms") == [(1, 1, 0, 100), (1, 2, 200, 300), (2, 1, 0, 700)]


def test_a_failing_stage_raises(spark):
    df = segs(spark, [(0, 10, "a")], [[]])
    with pytest.raises(Exception, match="broken|ARITHMETIC|USER_RAISED"):
        pipeline.cleanup(pipeline.refine(df.withColumn("text", F.raise_error(F.lit("broken"))))).collect()


def test_wav_files(spark, tmp_path):
    import struct
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(struct.pack("<8h", 0, 16384, -32768, -32768, 100, 300, 32767, 1))
    (tmp_path / "b.wav").write_bytes(b"RIFF no")
    got = {r.media_id.rsplit("/", 1)[1]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert got["a.wav"].rate == 8000 and [round(x, 6) for x in got["a.wav"].audio] == [0.25, -1.0, round(200 / 32768, 6), 0.5]
    assert got["b.wav"].audio is None and got["b.wav"].error


@pytest.mark.parametrize("most", [10_000, 1])
def test_terms_by_plan_and_by_join(spark, most):
    cues = spark.createDataFrame([(1, 1, "use maya  and  Py"), (1, 2, ""), (1, 3, None)], "media_id long, cue_idx long, text string")
    terms = spark.createDataFrame([("maya", "Maya"), ("Py", "Python"), ("maya", "Zaya"), (None, "x")], "term string, wording string")
    assert sorted((r.cue_idx, r.text) for r in layout.replace_terms(cues, terms, max_terms=most).collect()) == [(1, "use Maya  and  Python"), (2, ""), (3, None)]
    assert layout.replace_terms(cues, terms.limit(0)).count() == 3


def test_output_paths_as_function_and_column(spark):
    cases = [("/a/b.mp3", "zh", True), ("/a.b/c", None, False), ("x.tar.gz", "en", False), ("/a/.hidden", None, True)]
    df = spark.createDataFrame(cases, "p string, l string, e boolean").select("p", srt.output_path(F.col("p"), F.col("l"), F.col("e")).alias("o"))
    assert [r.o for r in df.collect()] == [srt.default_output(*c) for c in cases]


def test_white_space_is_stripped_but_zero_width_space_kept(spark):
    cases = {"\u3000\t a b \x1f\xa0": "a b", "\u200bx\u200b ": "\u200bx\u200b", "\x85": "", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.strip(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases == {k: k.strip() for k in cases}


ODD_WORDS = ("the", " and", " So", "​", " ", "", None, " x", "。", "我们", " 因为", "but", " which,", "end.", " a b", "\u3000首先", " extraordinarily", "y" * 30, "é!", " However")


def odd_segments(n=400, seed=3):
    """Media of all kinds: without words, with some, with repeated texts and starts, words that overlap or lack what they need."""
    pick = random.Random(seed)
    for i in range(n):
        at, words = pick.choice([0, 0, 500, 1000, None]), []
        now = at or 0
        for _ in range(pick.choice([0, 0, 1, 2, 3, 9, 90]) if i % 4 else 0):
            ms = pick.choice([0, 60, 120, 300, 5000])
            words.append((pick.choice(ODD_WORDS), pick.choice([now, now, now, now - 100, None]), now + ms))
            now += ms + pick.choice([0, 0, 40, 250, 300, 500])
        yield (i % 4, i, at, (at or 0) + pick.choice([0, 900, 4000]), pick.choice(["one", " one", "two words ", "", "。end", None, "z"]), pick.choice([words, words or None]))


@pytest.mark.parametrize("options", [{}, {"merge": False}, {"max_chars": 9, "max_ms": 700}, {"pause": 200, "max_gap_ms": 300}])
def test_refine_is_what_its_steps_give(spark, options):
    """Step by step: filters, first of repeated rows, lines by the fold, joins one after the other."""
    df = spark.createDataFrame(list(odd_segments()), f"{SEG}, {WORDS}")
    most, ms = options.get("max_chars", lexicon.MAX_CHARS), options.get("max_ms", lexicon.MAX_LINE_MS)

    def join(parts, limit):
        out = []
        for p in parts:
            t = p[3].strip()
            last = out[-1][3].strip() if out else ""
            near = not out or "max_gap_ms" not in options or None not in (p[1], out[-1][2]) and p[1] - out[-1][2] <= options["max_gap_ms"]
            meet = near and last[-1:].isascii() and last[-1:].isalpha() and t[:1].isascii() and t[:1].isalpha()
            if meet and len((last + t).replace(" ", "")) <= limit:
                out[-1] = (*out[-1][:2], p[2], last + t)
            else:
                out.append(p)
        return out

    clean_ = text.pinned(clean.dedup_segments(df).withColumn("raw", F.coalesce(F.size("words"), F.lit(0))).withColumn("words", F.coalesce(clean.clean_words(F.col("words")), F.expr("array()").cast(WORDS[6:]))), "words")
    lined = segment.with_lines(clean_, text.pause_ms(text.language_of_words(F.col("words")), options.get("pause")), most, ms)
    media_ = {}
    for r in lined.orderBy("media_id", "seg_idx").collect():
        media_.setdefault(r.media_id, []).append(r)
    want = []
    for m, rs in media_.items():
        parts = [(r.seg_idx, r.start_ms, r.end_ms, r.text) for r in rs]
        if len(rs) > 1 and not any(r.raw > 0 for r in rs):
            parts = join(parts, 2 * most) if options.get("merge", True) else parts
        else:
            parts = [x for r, p in zip(rs, parts, strict=True) for x in ([(0, z.start_ms, z.end_ms, z.text) for z in r.lines] if r.words else [p])]
        parts = [(i, *p[1:]) for i, p in enumerate(parts)]
        want += [(m, *p) for p in (join(parts, most) if options.get("merge", True) else parts)]
    got = [tuple(r) for r in pipeline.refine(df, **options).orderBy("media_id", "seg_idx").collect()]
    assert got == want and len({m for m, *_ in got}) == 4


def test_refine_of_ordered_rows_deals_them_once(spark):
    """Only lines of text are shuffled, once; neither words nor three words each are."""
    for query in (queries.refine_mixed, queries.refine_pipeline):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    back = spark.createDataFrame([(1, 1, 0, 9, "b", []), (1, 0, 0, 9, "a", [])], f"{SEG}, {WORDS}").coalesce(1)
    assert rows(pipeline.refine(back), "text") == [("ab",)]
    with pytest.raises(Exception, match="not in order"):
        pipeline.refine(back, ordered=True).collect()


def test_media_across_batches(spark):
    """Media that begin, end or go on where a batch does."""
    data = [(m if m else None, i, 10 * i, 10 * i + 9, "ab", [("ab", 10 * i, 10 * i + 9)] if m % 2 else None) for m in range(5) for i in range(7)]
    df = spark.createDataFrame(data, f"{SEG}, {WORDS}")
    want = sorted(map(str, pipeline.refine(df).collect()))
    for most in (1, 3, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert sorted(map(str, pipeline.refine(df).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clock_of_odd_texts(spark):
    """Words, times and base as a plain loop gives them."""
    texts = ["", None, "  ", "a", " a\t\tb. ", "é,ö 我们。!", "x" * 70 + " \x0b y?", "\u3000\xa0z", "a  b   c    d"]
    df = timeline.segments_of(spark.createDataFrame([(i // 4, i, t) for i, t in enumerate(texts)], "media_id long, seg_idx long, text string"))
    base = {}
    for r in df.orderBy("seg_idx").collect():
        toks = [t for t in re.split(r"[\x20\x09-\x0D]+", texts[r.seg_idx] or "") if t]
        at = start = base.get(r.media_id, 0)
        end, words = at, []
        for i, t in enumerate(toks):
            end = at + 60 * len(t)
            words.append((" " * (i > 0) + t, at, end))
            at = end + (550 if t[-1] in ".!?" else 260 if t[-1] == "," else 40 * (i % 4))
        base[r.media_id] = at
        assert (r.start_ms, r.end_ms, [tuple(w) for w in r.words]) == (start, end, words)
