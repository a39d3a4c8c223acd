"""The queries once more as SQL, written apart from the engine, for comparison."""

from __future__ import annotations

from lexitide.functions import lexicon as lex
from lexitide.functions import media
from lexitide.plans.queries import CJK_SAMPLES, HAN, PROBES, TERMS


def _in(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


CJK = "[一-鿿㐀-䶿]"
STRONG, WEAK = _in(lex.STRONG_PUNCT), _in(lex.WEAK_PUNCT)
LOOP = f"CASE seg_idx % 10 WHEN 3 THEN repeat('ab', 15) WHEN 5 THEN repeat('abc', 26) WHEN 7 THEN '{lex.KNOWN_HALLUCINATIONS[0]}' ELSE text END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _visible(x: str) -> str:
    return f"replace(replace({x}, ' ', ''), chr(8203), '')"


def _stamp(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _timeline(lines: str) -> str:
    """CTEs w (words) and seg (segments) on the made-up clock."""
    return rf"""
raws AS ({lines}),
toks AS (SELECT media_id, seg_idx, raw, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM raws),
w0 AS (SELECT media_id, seg_idx, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM toks),
w1 AS (SELECT *, 60 * length(tok) AS ms, CASE WHEN right(tok, 1) IN ('.', '!', '?') THEN 550 WHEN right(tok, 1) = ',' THEN 260 ELSE 40 * (pos % 4) END AS pause FROM w0),
w AS (SELECT media_id, seg_idx, pos, CASE WHEN pos = 0 THEN tok ELSE ' ' || tok END AS word,
        CAST(sum(ms + pause) OVER c - ms - pause AS BIGINT) AS start_ms, CAST(sum(ms + pause) OVER c - pause AS BIGINT) AS end_ms
      FROM w1 WINDOW c AS (PARTITION BY media_id ORDER BY seg_idx, pos)),
per AS (SELECT media_id, seg_idx, sum(ms + pause) AS total FROM w1 GROUP BY ALL),
ends AS (SELECT media_id, seg_idx, max(end_ms) AS end_ms FROM w GROUP BY ALL),
seg AS (SELECT media_id, seg_idx, {_strip("raw")} AS text, base AS start_ms, coalesce(end_ms, base) AS end_ms
        FROM (SELECT t.media_id, t.seg_idx, t.raw, CAST(coalesce(sum(p.total) OVER (PARTITION BY t.media_id ORDER BY t.seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
              FROM toks t LEFT JOIN per p USING (media_id, seg_idx)) LEFT JOIN ends USING (media_id, seg_idx))"""


DOCS = _timeline("SELECT doc_id AS media_id, unnest(range(len(l))) AS seg_idx, unnest(l) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
TURNS = _timeline("SELECT conv_id AS media_id, CAST(turn AS BIGINT) AS seg_idx, text AS raw FROM conversations")

PLAIN = "media_id, seg_idx, start_ms, end_ms, text"

#: Features of words v (media_id, seg_idx, pos, word, start_ms, end_ms): n, cum, the score g and natural break nb of the gap before.
FEATURES = f"""
lagged AS (SELECT *, lag(word) OVER o AS lw, start_ms - lag(end_ms) OVER o AS gap, count(*) OVER (PARTITION BY media_id, seg_idx) AS cnt,
             length({_visible("word")}) AS n, sum(length({_visible("word")})) OVER (o ROWS UNBOUNDED PRECEDING) AS cum
           FROM v WINDOW o AS (PARTITION BY media_id, seg_idx ORDER BY pos)),
f AS (SELECT media_id, seg_idx, pos, word, start_ms, end_ms, n, cum, cnt,
        coalesce(right({_strip("lw")}, 1) IN {STRONG} OR gap >= {{pause}}, FALSE) AS nb,
        CASE WHEN right({_strip("lw")}, 1) IN {STRONG} THEN 5 WHEN right({_strip("lw")}, 1) IN {WEAK} THEN 3 ELSE 0 END
        + CASE WHEN gap >= {{pause}} THEN 4 WHEN 2 * gap >= {{pause}} THEN 1 ELSE 0 END
        + CASE WHEN lower({_strip("word")}) IN {_in(lex.BAD_LINE_START)} THEN -4 WHEN lower({_strip("word")}) IN {_in(lex.GOOD_LINE_START)} THEN 1 ELSE 0 END
        + CASE WHEN lower({_strip("lw")}) IN {_in(lex.BAD_LINE_END)} THEN -4 ELSE 0 END AS g
      FROM lagged)"""

#: Successor of each word, by joins with the words that it can reach.
SUCCESSORS = f"""
ov AS (SELECT a.media_id, a.seg_idx, a.pos AS st, any_value(a.cnt) AS cnt, any_value(a.cum - a.n) AS base,
         min(b.pos) FILTER (b.cum - a.cum + a.n > {lex.MAX_CHARS} OR b.end_ms - a.start_ms > {lex.MAX_LINE_MS}) AS j, min(b.pos) FILTER (b.pos > a.pos AND b.nb) AS p
       FROM f a JOIN f b ON a.media_id = b.media_id AND a.seg_idx = b.seg_idx AND b.pos BETWEEN a.pos AND a.pos + {lex.MAX_CHARS} GROUP BY a.media_id, a.seg_idx, a.pos),
cut AS (SELECT ov.media_id, ov.seg_idx, ov.st, any_value(ov.cnt) AS cnt, any_value(j) AS j, any_value(p) AS p, max(c.cum - c.n - base) FILTER (c.pos = p) AS pc,
          arg_max(c.pos, (c.g - CASE WHEN c.cum - c.n - base < {lex.MIN_LINE_CHARS} AND c.g < 3 THEN 2 ELSE 0 END) * 100000 + c.pos) FILTER (j IS NOT NULL AND c.pos <= j) AS k
        FROM ov LEFT JOIN f c ON c.media_id = ov.media_id AND c.seg_idx = ov.seg_idx AND c.pos > st AND c.pos <= st + {lex.MAX_CHARS} GROUP BY ov.media_id, ov.seg_idx, ov.st),
nx AS (SELECT media_id, seg_idx, st, CAST(CASE WHEN p IS NOT NULL AND (j IS NULL OR p <= j) AND pc >= {lex.MIN_LINE_CHARS} THEN p WHEN j IS NULL THEN cnt WHEN j = st THEN st + 1 ELSE k END AS BIGINT) AS nxt FROM cut)"""

LINES = f"""
chain(media_id, seg_idx, st, nxt, line) AS (
  SELECT media_id, seg_idx, st, nxt, 0 FROM nx WHERE st = 0
  UNION ALL SELECT nx.media_id, nx.seg_idx, nx.st, nx.nxt, line + 1 FROM chain JOIN nx ON nx.media_id = chain.media_id AND nx.seg_idx = chain.seg_idx AND nx.st = chain.nxt),
ln AS (SELECT c.media_id, c.seg_idx, CAST(c.line AS BIGINT) AS line, min(w.start_ms) AS start_ms, arg_max(w.end_ms, w.pos) AS end_ms,
         {_strip("string_agg(w.word, '' ORDER BY w.pos)")} AS text, count(*) AS n_words
       FROM chain c JOIN v w ON w.media_id = c.media_id AND w.seg_idx = c.seg_idx AND w.pos >= c.st AND w.pos < c.nxt GROUP BY ALL)"""


def _merged(limit: int, x: str = "x", joined: str = "joined") -> str:
    """CTEs that join fragments of x (media_id, seg_idx, start_ms, end_ms, text) into `joined`."""
    t = _strip("text")
    return f"""
{x}1 AS (SELECT *, {t} AS t, coalesce(regexp_matches(lag({t}) OVER o, '[A-Za-z]$') AND regexp_matches({t}, '^[A-Za-z]'), FALSE) AS meets FROM {x} WINDOW o AS (PARTITION BY media_id ORDER BY seg_idx)),
{x}2 AS (SELECT *, sum(CASE WHEN meets THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM {x}1),
{x}3 AS (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY seg_idx) AS k FROM {x}2),
{x}fold(media_id, island, k, first_idx, start_ms, end_ms, txt, t) AS (
  SELECT media_id, island, k, seg_idx, start_ms, end_ms, text, t FROM {x}3 WHERE k = 1
  UNION ALL
  SELECT n.media_id, n.island, n.k, CASE WHEN fits THEN first_idx ELSE seg_idx END, CASE WHEN fits THEN r.start_ms ELSE n.start_ms END, n.end_ms,
    CASE WHEN fits THEN r.t || n.t ELSE n.text END, CASE WHEN fits THEN r.t || n.t ELSE n.t END
  FROM (SELECT * FROM {x}fold) r JOIN {x}3 n ON n.media_id = r.media_id AND n.island = r.island AND n.k = r.k + 1,
    LATERAL (SELECT length(replace(r.t || n.t, ' ', '')) <= {limit} AS fits)),
{joined} AS (SELECT media_id, first_idx AS seg_idx, start_ms, end_ms, txt AS text FROM {x}fold QUALIFY row_number() OVER (PARTITION BY media_id, first_idx ORDER BY k DESC) = 1)"""


DEDUP = f"""
kept AS (SELECT {PLAIN} FROM s0 WHERE text <> '' AND end_ms > start_ms
         QUALIFY row_number() OVER (PARTITION BY media_id, {_strip("text")}, start_ms ORDER BY seg_idx) = 1)"""

CLEANUP = f"""
c0 AS (SELECT * FROM looped WHERE {_strip("text")} <> ''),
c1 AS (SELECT *, {_visible("text")} AS vis FROM c0),
c2 AS (SELECT {PLAIN} FROM c1 WHERE NOT (length(vis) >= 30 AND (len(list_distinct(string_split(vis, ''))) / length(vis) < 0.04 OR len(list_distinct(string_split(vis, ''))) <= 2))
         AND {_strip("text")} NOT IN {_in(lex.KNOWN_HALLUCINATIONS)})"""


def _adjacent(source: str) -> str:
    key = f"lower({_strip('text')})"
    return f"""
a1 AS (SELECT *, CASE WHEN {key} = lag({key}) OVER (PARTITION BY media_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS opens FROM {source}),
a2 AS (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY seg_idx) AS island FROM a1),
once AS (SELECT media_id, min(seg_idx) AS seg_idx, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms, arg_min(text, seg_idx) AS text FROM a2 GROUP BY media_id, island)"""



def _refined(pause: str = "500") -> str:
    """CTEs from kept segments and their words v to `joined`."""
    return f"""{FEATURES.format(pause=pause)}, {SUCCESSORS}, {LINES},
x AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, line) - 1 AS seg_idx, start_ms, end_ms, text FROM ln), {_merged(lex.MAX_CHARS)}"""


def _chars(low: str, high: str, test: str, pick: str, plus: str = "") -> str:
    """The first (list_min) or last (list_max) position c from low up to high, exclusive, that passes the test."""
    return f"{pick}(list_filter(range({low}, greatest({high}, {low})), lambda c: {test})){plus}"


def _letter(c: str) -> str:
    return f"regexp_full_match(substr(t, CAST({c} AS BIGINT) + 1, 1), '[A-Za-z]')"


_MARK = f"c < n AND substr(t, CAST(c AS BIGINT) + 1, 1) IN {_in(lex.SPLIT_PUNCT)}"
_BAD = "|".join(lex.BAD_LINE_START)

#: Pieces of s1 (t: stripped text; n, chars, ms, pieces, target): where each begins, one by one.
SPLIT = f"""
s1 AS (SELECT *, length(t) AS n, length(replace(t, ' ', '')) AS chars, end_ms - start_ms AS ms FROM (SELECT *, {_strip("text")} AS t FROM seg) WHERE t <> ''),
s2 AS (SELECT *, CASE WHEN chars <= {lex.MAX_CHARS} AND ms <= {lex.MAX_LINE_MS} THEN 1 ELSE greatest(CAST(ceil(chars / {lex.MAX_CHARS}) AS BIGINT), ms // {lex.MAX_LINE_MS} + 1, 1) END AS pieces FROM s1),
s3 AS (SELECT *, chars // pieces AS target FROM s2),
cuts(media_id, seg_idx, i, st, en) AS (
  SELECT media_id, seg_idx, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM s3 WHERE pieces > 1
  UNION ALL
  SELECT media_id, seg_idx, i + 1, st, CASE WHEN i + 1 = pieces THEN n ELSE coalesce(
      {_chars("greatest(st, e - 6) + 1", "e + 1", _MARK, "list_max", " + 1")},
      {_chars("greatest(st, e - 15) + 1", "e + 1", "substr(t, CAST(c AS BIGINT), 1) = ' '", "list_max")},
      {_chars("e", "least(n, e + 10)", "substr(t, CAST(c AS BIGINT) + 1, 1) = ' '", "list_min", " + 1")},
      CASE WHEN e > st AND e < n AND {_letter("e - 1")} AND {_letter("e")} THEN {_chars("e", "least(n, e + 10)", "NOT " + _letter("c"), "list_min")} END,
      CASE WHEN regexp_matches({_strip("substr(t, st + 1, e - st)")}, '^({_BAD})([^A-Za-z]|$)') THEN {_chars("e", "least(e + 6, n)", _MARK, "list_min", " + 1")} END,
      e) END
  FROM (SELECT s3.media_id, s3.seg_idx, c.i, c.en AS st, s3.t, s3.n, s3.pieces, least(c.en + s3.target, s3.n) AS e
        FROM (SELECT * FROM cuts) c JOIN s3 ON s3.media_id = c.media_id AND s3.seg_idx = c.seg_idx WHERE c.i < s3.pieces)),
pc AS (SELECT c.media_id, c.seg_idx, i, {_strip("substr(t, st + 1, greatest(en - st, 0))")} AS piece, s3.start_ms, ms, chars FROM cuts c JOIN s3 USING (media_id, seg_idx) WHERE i > 0),
pd AS (SELECT *, row_number() OVER o - 1 AS line, sum(length(replace(piece, ' ', ''))) OVER o AS upto, length(replace(piece, ' ', '')) AS own
       FROM pc WHERE piece <> '' WINDOW o AS (PARTITION BY media_id, seg_idx ORDER BY i)),
sp AS (SELECT media_id, seg_idx, start_ms + CAST(round(ms * (upto - own) / greatest(chars, 1)) AS BIGINT) AS start_ms, start_ms + CAST(round(ms * upto / greatest(chars, 1)) AS BIGINT) AS end_ms, piece AS text, CAST(line AS BIGINT) AS line FROM pd
       UNION ALL SELECT media_id, seg_idx, start_ms, end_ms, text, 0 FROM s3 WHERE pieces = 1)"""

TRIPLES = """
tri AS (SELECT media_id, seg_idx * 100000 + pos // 3 AS seg_idx, pos % 3 AS pos, word, start_ms, end_ms FROM w),
seg3 AS (SELECT media_id, seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, trim(string_agg(word, '' ORDER BY pos)) AS text FROM tri GROUP BY ALL),
s0 AS (SELECT * FROM seg3)"""

#: What the stub recogniser makes of a text.
STUB = r"""
ck AS (SELECT media_id, seg_idx, start_ms, end_ms, text, string_split(text, ' ') AS ws FROM seg),
ok AS (SELECT * FROM ck WHERE length(text) % 7 <> 0 AND len(ws) > 5)"""

CUES = f"WITH {TURNS}, cues AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS cue_idx, seg_idx, start_ms, end_ms, text FROM seg"
SRT = f"""WITH {{source}}, q AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS i, start_ms, end_ms, text FROM seg WHERE text <> '')"""
RENDERED = f"string_agg(i || chr(10) || {_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY i)"

ORACLES: dict[str, str] = {
    "timeline_words": f"WITH {TURNS} SELECT media_id, seg_idx, CAST(pos AS BIGINT) AS pos, word, start_ms, end_ms FROM w",
    "drop_empty_and_zero": f"WITH {DOCS} SELECT {PLAIN} FROM seg WHERE text <> '' AND end_ms > start_ms",
    "clean_words": f"""WITH {TURNS},
b AS (SELECT media_id, seg_idx, pos, CASE WHEN pos % 5 = 1 THEN '  ' ELSE word END AS word, CASE WHEN pos % 7 <> 2 THEN start_ms END AS s, CASE WHEN pos % 11 = 3 THEN start_ms ELSE end_ms END AS e FROM w),
g AS (SELECT *, trim(word) <> '' AND s IS NOT NULL AND e > s AS ok FROM b),
a AS (SELECT media_id, seg_idx, count(*) AS n_before, count(*) FILTER (ok) AS n_after, string_agg(word, '' ORDER BY pos) FILTER (ok) AS kept_text FROM g GROUP BY ALL)
SELECT seg.media_id, seg.seg_idx, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(kept_text, '') AS kept_text FROM seg LEFT JOIN a USING (media_id, seg_idx)""",
    "clean_segments_dedup": f"WITH {DOCS}, s0 AS (SELECT media_id, seg_idx, seg_idx % 3 * 1000 AS start_ms, seg_idx % 3 * 1000 + seg_idx % 5 AS end_ms, text FROM seg), {DEDUP} SELECT * FROM kept",
    "detect_language_pause": f"""WITH {DOCS}, l AS (SELECT media_id, seg_idx, coalesce(regexp_matches(text, '{CJK}'), FALSE) AS han FROM seg
UNION ALL SELECT * FROM (VALUES (-1, 0, TRUE), (-1, 1, FALSE), (-1, 2, FALSE)))
SELECT media_id, seg_idx, CASE WHEN han THEN 'zh' ELSE 'en' END AS language, CAST(CASE WHEN han THEN 300 ELSE 500 END AS INTEGER) AS pause_ms FROM l""",
    "visible_chars": f"WITH {TURNS}, c AS (SELECT media_id, seg_idx, CAST(sum(length({_visible('word')})) AS BIGINT) AS chars FROM w GROUP BY ALL) SELECT media_id, seg_idx, coalesce(chars, 0) AS chars FROM seg LEFT JOIN c USING (media_id, seg_idx)",
    "natural_breaks": f"WITH {TURNS}, v AS (SELECT * FROM w), {FEATURES.format(pause=500)} SELECT media_id, seg_idx, CAST(pos AS BIGINT) AS pos, nb AS natural_break FROM f WHERE pos > 0",
    "gap_scores": f"WITH {TURNS}, v AS (SELECT * FROM w), {FEATURES.format(pause=500)} SELECT media_id, seg_idx, CAST(pos AS BIGINT) AS pos, CAST(g AS BIGINT) AS score FROM f WHERE pos > 0",
    "next_cut": f"WITH {TURNS}, v AS (SELECT * FROM w), {FEATURES.format(pause=500)}, {SUCCESSORS} SELECT media_id, seg_idx, CAST(st AS BIGINT) AS pos, nxt AS next FROM nx",
    "segment_lines": f"WITH RECURSIVE {DOCS}, v AS (SELECT * FROM w), {FEATURES.format(pause=500)}, {SUCCESSORS}, {LINES} SELECT * FROM ln",
    "refine_pipeline": f"""WITH RECURSIVE {DOCS}, s0 AS (SELECT {PLAIN} FROM seg), {DEDUP},
v AS (SELECT w.* FROM w JOIN kept USING (media_id, seg_idx) WHERE w.end_ms > w.start_ms), {FEATURES.format(pause=500)}, {SUCCESSORS}, {LINES},
x AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, line) - 1 AS seg_idx, start_ms, end_ms, text FROM ln), {_merged(lex.MAX_CHARS)} SELECT * FROM joined""",
    "merge_fragments": f"""WITH RECURSIVE {DOCS}, x AS (SELECT media_id, seg_idx * 100000 + pos // 3 AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, '' ORDER BY pos) AS text FROM w GROUP BY ALL),
{_merged(50)} SELECT * FROM joined""",
    "repeat_loop_filter": f"WITH {DOCS}, looped AS (SELECT media_id, seg_idx, start_ms, end_ms, {LOOP} AS text FROM seg), {CLEANUP.replace('WHERE ' + _strip('text') + ' <> ' + chr(39) * 2, '', 1)} SELECT * FROM c2",
    "merge_adjacent_duplicates": f"""WITH {DOCS}, s2 AS (SELECT media_id, seg_idx, start_ms, end_ms,
  CASE WHEN seg_idx % 3 = 1 THEN upper(replace(coalesce(lag(text) OVER (PARTITION BY media_id ORDER BY seg_idx), text), 'ß', 'SS')) ELSE text END AS text FROM seg), {_adjacent('s2')} SELECT * FROM once""",
    "merge_speech_regions": """WITH e AS (SELECT CAST(user_id AS BIGINT) AS media_id, CAST(event_id AS BIGINT) AS idx, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS start_ms, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) AS end_ms
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, idx) < 60000 THEN 0 ELSE 1 END AS opens FROM e),
i AS (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY start_ms, idx) AS region FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY media_id, region ORDER BY start_ms DESC, idx DESC) AS back FROM i),
m AS (SELECT media_id, CAST(region AS BIGINT) AS region, min(start_ms) AS start_ms, max(end_ms) FILTER (back = 1) AS end_ms FROM l GROUP BY ALL)
SELECT * FROM m WHERE end_ms - start_ms >= 1000""",
    "shift_to_absolute": f"WITH {TURNS}, a AS (SELECT media_id, seg_idx, min(start_ms) AS first_word_ms FROM w GROUP BY ALL) SELECT media_id, seg_idx, start_ms, end_ms, first_word_ms FROM seg LEFT JOIN a USING (media_id, seg_idx)",
    "cleanup_pipeline": f"WITH {DOCS}, looped AS (SELECT media_id, seg_idx, start_ms, end_ms, {LOOP} AS text FROM seg), {CLEANUP}, {_adjacent('c2')} SELECT * FROM once",
    "format_timestamps": f"""WITH {DOCS} SELECT media_id, seg_idx, {_stamp("start_ms")} AS from_ms,
  printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, CAST(floor((start_ms / 1000.0::DOUBLE - floor(start_ms / 1000.0::DOUBLE)) * 1000) AS BIGINT)) AS from_seconds FROM seg""",
    "srt_render": f"{SRT.format(source=DOCS)} SELECT media_id, {RENDERED} AS content FROM q GROUP BY media_id",
    "srt_parse": f"WITH {DOCS} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS seg_idx, start_ms, end_ms, text FROM seg WHERE text <> ''",
    "cue_counts": rf"{SRT.format(source=TURNS)}, r AS (SELECT media_id, {RENDERED} AS content FROM q GROUP BY media_id) SELECT media_id, CAST(len(list_filter(string_split(content, chr(10)), lambda x: regexp_full_match(x, '[0-9]+'))) AS BIGINT) AS cues FROM r",
    "cue_preview": f"{CUES}) SELECT media_id, cue_idx, start_ms, end_ms, text FROM cues WHERE cue_idx <= 5",
    "change_report": f"""WITH {DOCS}, looped AS (SELECT media_id, seg_idx, start_ms, end_ms, {LOOP} AS text FROM seg), {CLEANUP}, {_adjacent('c2')}
SELECT media_id, n_before, coalesce(n_after, 0) AS n_after FROM (SELECT media_id, count(*) AS n_before FROM seg GROUP BY 1) LEFT JOIN (SELECT media_id, count(*) AS n_after FROM once GROUP BY 1) USING (media_id)""",
    "bilingual_layout": f"""{CUES} WHERE text <> '')
SELECT media_id, cue_idx, start_ms, end_ms, mode, CASE mode WHEN 'translation' THEN 'T: ' || text WHEN 'translation_above' THEN 'T: ' || text || chr(10) || text WHEN 'translation_below' THEN text || chr(10) || 'T: ' || text ELSE text END AS text
FROM cues, (VALUES ('translation'), ('translation_above'), ('translation_below'), ('original')) m(mode)""",
    "cue_mismatches": f"""{CUES}), o AS (SELECT media_id, cue_idx, start_ms AS s2, end_ms + CASE WHEN cue_idx % 5 = 0 THEN 1 ELSE 0 END AS e2 FROM cues WHERE cue_idx % 4 <> 3)
SELECT media_id, cue_idx, start_ms AS s1, end_ms AS e1, s2, e2 FROM cues LEFT JOIN o USING (media_id, cue_idx) WHERE s2 IS NULL OR s2 <> start_ms OR e2 <> end_ms""",
    "translation_plan": f"""{CUES})
SELECT media_id, cue_idx, NOT regexp_matches(text, '{CJK}') AS translate, CAST((cue_idx - 1) // 5 AS BIGINT) AS batch, CASE WHEN cue_idx % 2 = 0 THEN 'polished' ELSE text END AS baseline,
  array_to_string(list_transform(range(greatest(CAST(ceil(length(text) / 18) AS BIGINT), 1)), lambda i: substr(text, CAST(i * 18 + 1 AS BIGINT), 18)), chr(10)) AS wrapped
FROM cues""",
    "cjk_latin_spacing": rf"""WITH {TURNS}, t AS (SELECT unnest({list(CJK_SAMPLES)}) AS text UNION ALL SELECT '中' || text FROM seg)
SELECT text, regexp_replace(regexp_replace(text, '({CJK})([A-Za-z0-9])', '\1 \2', 'g'), '([A-Za-z0-9])({CJK})', '\1 \2', 'g') AS spaced, regexp_replace(text, '[{lex.STRONG_PUNCT}{lex.WEAK_PUNCT}]', '', 'g') AS bare FROM t""",
    "upload_plan": f"""WITH m AS (SELECT CAST(o_orderkey AS BIGINT) AS media_id, CAST(o_orderkey AS BIGINT) % 40000 + 1 AS d FROM orders)
SELECT media_id, CASE WHEN d * 16000 <= {media.MAX_UPLOAD_BYTES} THEN 'as_is' WHEN d * 32000 + 44 <= {media.MAX_UPLOAD_BYTES} THEN 'wav' ELSE 'mp3' END AS plan,
  CAST(least(128000, greatest(16000, floor(floor({media.MAX_UPLOAD_BYTES * 8 * 0.9}::DOUBLE / d) / 8000) * 8000)) AS BIGINT) AS bitrate FROM m""",
    "vad_plan": """WITH m AS (SELECT CAST(o_orderkey AS BIGINT) AS media_id, CAST(o_orderkey AS BIGINT) % 40000 + 1 AS d FROM orders)
SELECT media_id, CASE WHEN media_id % 3 = 0 THEN TRUE WHEN media_id % 2 = 0 THEN FALSE ELSE d > 600 END AS use_vad,
  CAST(CASE WHEN media_id % 5 IN (0, 1) THEN 300 ELSE 500 END AS BIGINT) AS pause_ms, media_id % 5 = 0 AS chinese_prompt FROM m""",
    "stt_json_scan": f"WITH {TURNS} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx DESC) - 1 AS seg_idx, start_ms, end_ms, text FROM seg",
    "ffprobe_duration": f"""WITH p AS (SELECT unnest(range({len(PROBES)})) AS id, unnest({list(PROBES)}) AS body UNION ALL SELECT CAST(o_orderkey AS BIGINT) + 100, '{{"streams":[{{"duration":"' || CAST(o_orderkey AS VARCHAR) || '.25"}}]}}' FROM orders),
d AS (SELECT id, CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.streams[*].duration') AS VARCHAR[]) END AS ds FROM p)
SELECT id, coalesce(try_cast(list_filter(ds, lambda x: x IS NOT NULL AND x <> '')[1] AS DOUBLE), 0.0) AS seconds FROM d""",
    "fallback_split": f"WITH RECURSIVE {DOCS}, {SPLIT} SELECT * FROM sp",
    "refine_mixed": f"""WITH RECURSIVE {DOCS}, {TRIPLES}, {DEDUP},
has AS (SELECT *, CASE media_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN seg_idx % 4 = 0 ELSE TRUE END AS h FROM kept),
med AS (SELECT *, NOT bool_or(h) OVER m AND count(*) OVER m > 1 AS loose FROM has WINDOW m AS (PARTITION BY media_id)),
y AS (SELECT {PLAIN} FROM med WHERE loose), {_merged(2 * lex.MAX_CHARS, "y", "early")},
v AS (SELECT tri.* FROM tri JOIN med USING (media_id, seg_idx) WHERE med.h AND tri.end_ms > tri.start_ms), {FEATURES.format(pause=500)}, {SUCCESSORS}, {LINES},
every AS (SELECT media_id, seg_idx, line, start_ms, end_ms, text FROM ln UNION ALL SELECT media_id, seg_idx, 0, start_ms, end_ms, text FROM med WHERE NOT loose AND NOT h UNION ALL SELECT media_id, seg_idx, 0, start_ms, end_ms, text FROM early),
x AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx, line) - 1 AS seg_idx, start_ms, end_ms, text FROM every), {_merged(lex.MAX_CHARS)} SELECT * FROM joined""",
    "refine_han": f"""WITH RECURSIVE {TURNS}, s0 AS (SELECT {PLAIN} FROM seg), {DEDUP},
v AS (SELECT w.media_id, w.seg_idx, w.pos, ({list(HAN)})[CAST((length(w.word) * 7 + w.pos) % {len(HAN)} AS BIGINT) + 1] AS word, w.start_ms, w.end_ms FROM w JOIN kept USING (media_id, seg_idx) WHERE w.end_ms > w.start_ms),
{_refined("(CASE WHEN bool_or(regexp_matches(word, '" + CJK + "')) OVER (PARTITION BY media_id, seg_idx) THEN 300 ELSE 500 END)")} SELECT * FROM joined""",
    "stt_words_refine": f"""WITH RECURSIVE {TURNS}, ord AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx DESC) - 1 AS nr FROM seg),
s0 AS (SELECT media_id, nr AS seg_idx, start_ms, end_ms, text FROM ord), {DEDUP},
v AS (SELECT w.media_id, ord.nr AS seg_idx, w.pos, w.word, w.start_ms, w.end_ms FROM w JOIN ord ON ord.media_id = w.media_id AND ord.seg_idx = w.seg_idx JOIN kept ON kept.media_id = w.media_id AND kept.seg_idx = ord.nr WHERE w.end_ms > w.start_ms),
{_refined()} SELECT * FROM joined""",
    "whole_audio_fallback": """WITH e AS (SELECT CAST(user_id AS BIGINT) AS media_id, CAST(event_id AS BIGINT) AS idx, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS start_ms, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) AS end_ms
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, idx) < 1000 THEN 0 ELSE 1 END AS opens FROM e),
i AS (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY start_ms, idx) AS region FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY media_id, region ORDER BY start_ms DESC, idx DESC) AS back FROM i),
m AS (SELECT media_id, CAST(region AS BIGINT) AS region, min(start_ms) AS start_ms, max(end_ms) FILTER (back = 1) AS end_ms FROM l GROUP BY ALL),
r AS (SELECT * FROM m WHERE end_ms - start_ms >= 250000)
SELECT * FROM r UNION ALL SELECT media_id, 1, 0, max(end_ms) FROM e WHERE media_id NOT IN (SELECT media_id FROM r) GROUP BY media_id""",
    "output_names": r"""SELECT CAST(c_custkey AS BIGINT) AS id,
  regexp_replace('/in/v1.2/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.tar.mp3' WHEN 1 THEN '.wav' ELSE '' END, '\.[^./]*$', '') || CASE WHEN c_custkey % 2 = 0 THEN '_zh' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '_Enhance' ELSE '' END || '.srt' AS output FROM customer""",
    "sample_slices": """WITH m AS (SELECT CAST(o_orderkey AS BIGINT) AS media_id FROM orders),
a AS (SELECT media_id, list_transform(range(media_id % 90 + 1), lambda i: (i % 7 + i % 5) / 2.0) AS audio FROM m),
p AS (SELECT media_id, audio, list_filter(list_transform(range(len(audio)), lambda i: CASE WHEN i >= media_id % 13 * 100 * 16 // 1000 AND i < media_id % 29 * 150 * 16 // 1000 THEN audio[i + 1] END), lambda x: x IS NOT NULL) AS part FROM a)
SELECT media_id, len(audio) AS samples, len(part) AS kept, CAST(coalesce(list_sum(part), 0) AS DOUBLE) AS total, len(part) >= 4 AS long_enough FROM p""",
    "engine_selection": """SELECT CAST(o_orderkey AS BIGINT) AS media_id, CASE WHEN o_orderkey % 3 = 1 THEN 'mlx' WHEN o_orderkey % 3 = 2 THEN 'groq' WHEN o_orderkey // 3 % 2 = 0 AND o_orderkey // 6 % 2 = 0 THEN 'mlx' ELSE 'faster-whisper' END AS engine FROM orders""",
    "chunk_errors": f"""WITH {TURNS}, {STUB}
SELECT media_id, seg_idx AS region, CAST(CASE WHEN length(text) % 7 <> 0 AND len(ws) > 5 THEN ceil(len(ws) / 5) ELSE 0 END AS BIGINT) AS segments, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: length ' || length(text) ELSE '' END AS error FROM ck""",
    "chunk_results": f"""WITH {TURNS}, {STUB},
p AS (SELECT media_id, seg_idx, start_ms, ws, unnest(range(CAST(ceil(len(ws) / 5) AS BIGINT))) AS i FROM ok)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms + 1000 * i, seg_idx, i) - 1 AS seg_idx, start_ms + 1000 * i AS start_ms, start_ms + 1000 * i + 900 AS end_ms, {_strip("array_to_string(ws[5 * i + 1 : 5 * i + 5], ' ')")} AS text FROM p""",
    "media_without_result": f"WITH {TURNS}, {STUB} SELECT media_id * 1000 + seg_idx AS media_id FROM ck WHERE length(text) % 7 = 0 OR len(ws) <= 5",
    "terminology": f"""{CUES}), terms AS (SELECT term, min(wording) AS wording FROM (SELECT string_split(p_name, ' ')[1] AS term, lower(string_split(p_type, ' ')[-1]) AS wording FROM part UNION ALL VALUES {", ".join(map(str, TERMS))}) WHERE term IS NOT NULL AND wording IS NOT NULL GROUP BY term),
w8 AS (SELECT media_id, cue_idx, unnest(string_split(text, ' ')) AS term, unnest(range(len(string_split(text, ' ')))) AS pos FROM cues)
SELECT media_id, cue_idx, string_agg(coalesce(wording, w8.term), ' ' ORDER BY pos) AS text FROM w8 LEFT JOIN terms USING (term) GROUP BY media_id, cue_idx""",
    "normalize_segments": f"""WITH {DOCS} SELECT media_id, seg_idx, CASE WHEN seg_idx % 3 <> 1 THEN start_ms ELSE 0 END AS start_ms, CASE WHEN seg_idx % 5 <> 2 THEN end_ms ELSE 0 END AS end_ms, CASE WHEN seg_idx % 4 <> 3 THEN text ELSE '' END AS text FROM seg""",
}
