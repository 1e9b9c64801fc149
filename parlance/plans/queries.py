"""Queries over the stored tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import glossary, loops, text
from ..functions.text import INVENTED, INVENTED_SHORT
from ..operators import alignment, fusion, intervals, retry, speakers
from ..operators.periods import periods_and_gaps
from ..session import scratch, spread, written
from ..sources import audio, models, sinks
from ..sources.models import HypothesisModel
from ..sources.tables import deliveries_once, millis, read
from ..streaming import stateful
from . import metrics, pipeline, post

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def ms(column: str) -> str:
    """SQL: seconds as whole milliseconds."""
    return f"CAST(floor({column} * 1000 + 0.5) AS BIGINT)"


#: SQL: each turn once, in whole milliseconds.
TURNS = f"t AS (SELECT DISTINCT turn_id, recording, ord, speaker, {ms('start_s')} AS a, {ms('end_s')} AS b FROM turns)"


@query("p7_found", f"""
WITH {TURNS},
v AS (SELECT DISTINCT recording, speaker, a, b FROM t WHERE speaker IS NOT NULL AND b > a),
w AS (SELECT *, max(b) OVER (PARTITION BY recording, speaker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY recording, speaker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM w),
p AS (SELECT recording, speaker, k, min(a) AS from_ms, max(b) AS to_ms FROM i GROUP BY recording, speaker, k),
g AS (SELECT recording, speaker, lag(to_ms) OVER (PARTITION BY recording, speaker ORDER BY k) AS from_ms, from_ms AS to_ms FROM p)
SELECT recording, speaker, 'period' AS kind, from_ms, to_ms FROM p
UNION ALL SELECT recording, speaker, 'gap', from_ms, to_ms FROM g WHERE from_ms IS NOT NULL
""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods_and_gaps(read(spark, folder, "turns"))


# --- filters and merging ------------------------------------------------------------------------------------------

#: SQL: each turn once, in seconds, and the valid ones.
DISTINCT_TURNS = "d AS (SELECT DISTINCT turn_id, recording, ord, start_s, end_s, speaker FROM turns)"
VALID = "v AS (SELECT * FROM d WHERE start_s IS NOT NULL AND speaker IS NOT NULL AND end_s > start_s)"
#: SQL: turns of one speaker merged over short pauses.
MERGED = """
r AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY start_s, end_s, ord ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY recording ORDER BY start_s, end_s, ord) = speaker THEN 0 ELSE 1 END AS c FROM v)),
b AS (SELECT *, max(end_s) OVER (PARTITION BY recording, run ORDER BY start_s, end_s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s - reach > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, run ORDER BY start_s, end_s, ord ROWS UNBOUNDED PRECEDING) AS k FROM b),
m AS (SELECT recording, speaker, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(ord, (start_s, end_s, ord)) AS ord FROM i GROUP BY recording, speaker, run, k)
"""


def turns_once(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries_once(read(spark, folder, "turns"), "turn_id")


def pieces_once(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries_once(read(spark, folder, "pieces"), "piece_id")


def words_once(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries_once(read(spark, folder, "words"), "word_id")


def segments_once(spark: SparkSession, folder: str) -> DataFrame:
    return deliveries_once(read(spark, folder, "segments"), "seg_id")


def turns_text(column: str = "text") -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}]+')"


@query("s6_turns", f"WITH {DISTINCT_TURNS} SELECT recording, ord, start_s, end_s, speaker FROM d")
def s6_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns_once(spark, folder).select("recording", "ord", "start_s", "end_s", "speaker")


@query("f1_phantom_filter", f"""
WITH {DISTINCT_TURNS}, s AS (SELECT recording, speaker FROM d WHERE speaker IS NOT NULL GROUP BY recording, speaker
  HAVING sum({ms('end_s')} - {ms('start_s')}) >= 2000)
SELECT turn_id, d.recording, d.speaker FROM d JOIN s ON d.recording = s.recording AND d.speaker = s.speaker
""")
def f1_phantom_filter(spark: SparkSession, folder: str) -> DataFrame:
    t = intervals.without_phantoms(turns_once(spark, folder)).where("speaker IS NOT NULL")
    return t.select("turn_id", "recording", "speaker")


@query("f2_valid_turns", f"WITH {DISTINCT_TURNS}, {VALID} SELECT turn_id, recording, speaker FROM v")
def f2_valid_turns(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.valid(turns_once(spark, folder)).select("turn_id", "recording", "speaker")


@query("a1_talk_time", f"""
WITH {DISTINCT_TURNS}, {VALID}
SELECT recording, speaker, CAST(sum({ms('end_s')} - {ms('start_s')}) AS BIGINT) AS talk_ms, count(*) AS n_turns FROM v GROUP BY recording, speaker
""")
def a1_talk_time(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.talk_time(turns_once(spark, folder))


@query("a2_counts", f"""
WITH {DISTINCT_TURNS} SELECT recording, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM d GROUP BY recording
""")
def a2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return turns_once(spark, folder).groupBy("recording").agg(F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"))


@query("m1_merge_turns", f"WITH {DISTINCT_TURNS}, {VALID}, {MERGED} SELECT recording, speaker, start_s, end_s, ord FROM m")
def m1_merge_turns(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.merge_turns(turns_once(spark, folder))


@query("f3_micro_turns", f"WITH {DISTINCT_TURNS}, {VALID}, {MERGED} SELECT recording, speaker, start_s, end_s, ord FROM m WHERE end_s - start_s >= 0.15")
def f3_micro_turns(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.without_micro_turns(intervals.merge_turns(turns_once(spark, folder)))


#: SQL: greedy packing of merged turns into windows, turn after turn.
WINDOWS = """
o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start_s, ord) AS rn FROM m WHERE end_s - start_s >= 0.15),
f AS (SELECT recording, rn, start_s AS a, end_s AS b, 0 AS k FROM o WHERE rn = 1
  UNION ALL SELECT o.recording, o.rn, CASE WHEN x THEN o.start_s ELSE f.a END, CASE WHEN x THEN o.end_s ELSE greatest(f.b, o.end_s) END, f.k + CASE WHEN x THEN 1 ELSE 0 END
  FROM f JOIN o ON o.recording = f.recording AND o.rn = f.rn + 1,
  LATERAL (SELECT o.start_s - f.b > 1.5 OR greatest(f.b, o.end_s) - f.a > 30.0 AS x)),
w AS (SELECT recording, CAST(k AS BIGINT) AS window_ix, min(a) AS start_s, max(b) AS end_s FROM f GROUP BY recording, k)
"""


@query("m2_windows", f"WITH RECURSIVE {DISTINCT_TURNS}, {VALID}, {MERGED}, {WINDOWS} SELECT recording, window_ix, start_s, end_s FROM w")
def m2_windows(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.build_windows(intervals.without_micro_turns(intervals.merge_turns(turns_once(spark, folder))))


@query("f10_padded", f"""
WITH RECURSIVE {DISTINCT_TURNS}, {VALID}, {MERGED}, {WINDOWS}, e AS (SELECT recording, max(end_s) AS total FROM v GROUP BY recording)
SELECT recording, window_ix, greatest(0, start_s - 0.15) AS pad_start, least(total, end_s + 0.15) AS pad_end FROM w JOIN e USING (recording)
""")
def f10_padded(spark: SparkSession, folder: str) -> DataFrame:
    turns = turns_once(spark, folder)
    windows = m2_windows(spark, folder)
    total = intervals.valid(turns).groupBy("recording").agg(F.max("end_s").alias("total"))
    return intervals.padded(windows.join(total, "recording"), F.col("total")).select("recording", "window_ix", "pad_start", "pad_end")


# --- who speaks ---------------------------------------------------------------------------------------------------

#: SQL: the speaker of each timed word, by overlap or by the nearest turn.
SPEAKER_AT = f"""
t0 AS (SELECT DISTINCT recording, ord, speaker, {ms('start_s')} AS a, {ms('end_s')} AS b FROM v),
w0 AS (SELECT DISTINCT recording, word_id, {ms('start_s')} AS s, {ms('end_s')} AS e FROM words WHERE start_s IS NOT NULL AND end_s IS NOT NULL),
x AS (SELECT word_id, speaker, a, b, ord, least(e, b) - greatest(s, a) AS o, greatest(a * 2 - (s + e), (s + e) - b * 2, 0) AS dist FROM w0 JOIN t0 USING (recording)),
g AS (SELECT word_id, speaker, sum(o) AS o, min((a, b, ord)) AS f FROM x WHERE o > 0 GROUP BY word_id, speaker),
g1 AS (SELECT word_id, speaker, o, row_number() OVER (PARTITION BY word_id ORDER BY o DESC, f) AS r FROM g),
n1 AS (SELECT word_id, speaker, dist, row_number() OVER (PARTITION BY word_id ORDER BY dist, a, b, ord) AS r FROM x WHERE word_id NOT IN (SELECT word_id FROM g)),
who AS (SELECT word_id, speaker, CAST(o AS BIGINT) AS overlap_ms, 0.0::DOUBLE AS distance_ms FROM g1 WHERE r = 1
  UNION ALL SELECT word_id, speaker, 0, dist / 2.0 FROM n1 WHERE r = 1)
"""


@query("m5_speaker_at", f"WITH {DISTINCT_TURNS}, {VALID}, {SPEAKER_AT} SELECT word_id, speaker, overlap_ms, distance_ms FROM who")
def m5_speaker_at(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.speaker_at(read(spark, folder, "words"), turns_once(spark, folder))


@query("m6_relabel", """
WITH s AS (SELECT DISTINCT seg_id, recording, start_s, speaker FROM segments),
f AS (SELECT recording, speaker, min((coalesce(start_s, -1), seg_id)) AS seen FROM s WHERE speaker IS NOT NULL GROUP BY recording, speaker),
l AS (SELECT recording, speaker, CAST(row_number() OVER (PARTITION BY recording ORDER BY seen, speaker) - 1 AS INT) AS label FROM f)
SELECT seg_id, s.recording, s.speaker, label FROM s LEFT JOIN l ON s.recording = l.recording AND s.speaker = l.speaker
""")
def m6_relabel(spark: SparkSession, folder: str) -> DataFrame:
    s = segments_once(spark, folder).withColumn("start_s", F.coalesce("start_s", F.lit(-1.0)))
    return intervals.relabel_speakers(s).select("seg_id", "recording", "speaker", "label")


#: SQL: sentences and runs of a piece's words, and the smoothed speakers.
WORDS = "w AS (SELECT DISTINCT word_id, recording, piece_id, pos, start_s, end_s, text, speaker FROM words)"
SENTENCES = """
s AS (SELECT *, coalesce(CAST(sum(CASE WHEN regexp_matches(regexp_replace(text, '[»"'')]+$', ''), '[.?!…]$') THEN 1 ELSE 0 END)
  OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS sentence FROM w)
"""
RUNS = """
q AS (SELECT *, CAST(sum(c) OVER (PARTITION BY piece_id, sentence ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
  SELECT *, CASE WHEN row_number() OVER z = 1 OR lag(speaker) OVER z IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS c FROM s WINDOW z AS (PARTITION BY piece_id, sentence ORDER BY pos))),
u AS (SELECT *, count(*) OVER (PARTITION BY piece_id, sentence, run) AS run_len FROM q)
"""
SMOOTH = """
k AS (SELECT piece_id, sentence, speaker AS major, row_number() OVER (PARTITION BY piece_id, sentence ORDER BY wt DESC, p) AS r FROM (
  SELECT piece_id, sentence, speaker, sum(1000000000 + CAST(round(coalesce(end_s - start_s, 0) * 1000000) AS BIGINT)) AS wt, min(pos) AS p FROM u GROUP BY piece_id, sentence, speaker)),
y AS (SELECT u.*, major, count(*) OVER (PARTITION BY u.piece_id, u.sentence) AS n,
  max(CASE WHEN run_len >= 2 OR pos = first_pos THEN pos END) OVER (PARTITION BY u.piece_id, u.sentence ORDER BY pos ROWS UNBOUNDED PRECEDING) AS anchor
  FROM (SELECT *, min(pos) OVER (PARTITION BY piece_id, sentence) AS first_pos FROM u) u JOIN k ON k.piece_id = u.piece_id AND k.sentence = u.sentence AND k.r = 1),
sm AS (SELECT y.*, CASE WHEN y.n > 40 THEN a.speaker WHEN y.run_len < 4 THEN y.major ELSE y.speaker END AS smoothed FROM y JOIN u a ON a.piece_id = y.piece_id AND a.pos = y.anchor)
"""


@query("w1_sentences", f"WITH {WORDS}, {SENTENCES} SELECT word_id, sentence FROM s")
def w1_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return speakers.with_sentences(words_once(spark, folder)).select("word_id", "sentence")


@query("w2_runs", f"WITH {WORDS}, {SENTENCES}, {RUNS} SELECT word_id, run, run_len FROM u")
def w2_runs(spark: SparkSession, folder: str) -> DataFrame:
    return speakers.with_runs(speakers.with_sentences(words_once(spark, folder)), ["piece_id", "sentence"]).select("word_id", "run", "run_len")


@query("w3_smooth", f"WITH {WORDS}, {SENTENCES}, {RUNS}, {SMOOTH} SELECT word_id, speaker, smoothed FROM sm")
def w3_smooth(spark: SparkSession, folder: str) -> DataFrame:
    return speakers.smooth_by_sentence(words_once(spark, folder)).select("word_id", "speaker", "smoothed")


#: SQL: words grouped into segments by speaker and pause.
GROUPED = """
gw AS (SELECT w.*, p.flags FROM w LEFT JOIN (SELECT DISTINCT piece_id, flags FROM pieces) p USING (piece_id) WHERE start_s IS NOT NULL AND end_s IS NOT NULL),
gb AS (SELECT *, CASE WHEN row_number() OVER z = 1 OR lag(speaker) OVER z IS DISTINCT FROM speaker OR start_s - lag(end_s) OVER z > 1.0 THEN 1 ELSE 0 END AS c FROM gw WINDOW z AS (PARTITION BY recording ORDER BY start_s, word_id)),
gi AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY start_s, word_id ROWS UNBOUNDED PRECEDING) AS k FROM gb)
"""


@query("m7_segments", f"""
WITH {WORDS}, {GROUPED}
SELECT recording, speaker, min(start_s) AS start_s, arg_max(end_s, (start_s, word_id)) AS end_s, string_agg(text, ' ' ORDER BY start_s, word_id) AS text,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(flags, []))))), '|') AS flags, arg_min(word_id, (start_s, word_id)) AS first_word, count(*) AS n_words
FROM gi GROUP BY recording, speaker, k
""")
def m7_segments(spark: SparkSession, folder: str) -> DataFrame:
    flags = pieces_once(spark, folder).select("piece_id", "flags")
    words = words_once(spark, folder).join(flags, "piece_id", "left")
    return intervals.group_words(words).withColumn("flags", F.array_join("flags", "|"))


# --- words of pieces ----------------------------------------------------------------------------------------------

PIECES = "p AS (SELECT DISTINCT piece_id, recording, span_id, piece_ix, start_s, end_s, text, flags FROM pieces)"
#: SQL: tokens of a text, and those without letter or digit glued to the one before.
GLUED = """
k AS (SELECT piece_id, start_s, end_s, unnest(range(len(t))) AS i, unnest(t) AS tok FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM p WHERE text IS NOT NULL)),
h AS (SELECT *, sum(CASE WHEN i = 0 OR regexp_matches(tok, '[\\p{L}\\p{N}]') THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM k),
a AS (SELECT piece_id, start_s, end_s, CAST(pos AS INT) AS pos, string_agg(tok, ' ' ORDER BY i) AS text FROM h GROUP BY piece_id, start_s, end_s, pos),
n AS (SELECT *, count(*) OVER (PARTITION BY piece_id) AS n FROM a)
"""


@query("c7_attach_punctuation", f"WITH {PIECES}, {GLUED} SELECT piece_id, pos, text FROM n")
def c7_attach_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_once(spark, folder).select("piece_id", F.posexplode(alignment.attached(F.col("text"))).alias("pos", "text"))


@query("c8_uniform_words", f"""
WITH {PIECES}, {GLUED} SELECT piece_id, pos, text, start_s + pos * ((end_s - start_s) / n) AS start_s, start_s + (pos + 1) * ((end_s - start_s) / n) AS end_s FROM n
""")
def c8_uniform_words(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.uniform_words(pieces_once(spark, folder))


@query("w7_fill_gaps", f"""
WITH {WORDS}, {PIECES}, j AS (SELECT w.*, p.start_s AS pa, p.end_s AS pb, w.start_s IS NOT NULL AND w.end_s IS NOT NULL AS timed FROM w JOIN p USING (piece_id)),
l AS (SELECT *, last_value(CASE WHEN timed THEN end_s END IGNORE NULLS) OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
  first_value(CASE WHEN timed THEN start_s END IGNORE NULLS) OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f,
  coalesce(lag(timed) OVER (PARTITION BY piece_id ORDER BY pos), TRUE) AS first FROM j)
SELECT word_id, CASE WHEN timed THEN start_s WHEN first THEN coalesce(e, pa) ELSE greatest(coalesce(e, pa), coalesce(f, pb)) END AS start_s,
  CASE WHEN timed THEN end_s ELSE greatest(coalesce(e, pa), coalesce(f, pb)) END AS end_s FROM l
""")
def w7_fill_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.fill_gaps(words_once(spark, folder), pieces_once(spark, folder)).select("word_id", "start_s", "end_s")


# --- loops --------------------------------------------------------------------------------------------------------


@query("l3_normalize_words", f"WITH {PIECES} SELECT piece_id, array_to_string({turns_text()}, ' ') AS words FROM p WHERE text IS NOT NULL")
def l3_normalize_words(spark: SparkSession, folder: str) -> DataFrame:
    p = pieces_once(spark, folder).where("text IS NOT NULL")
    return p.select("piece_id", F.array_join(loops.normalize_words_udf("text"), " ").alias("words"))


#: SQL: the first n-gram repeated back to back.
REPEATED = f"""
z AS (SELECT piece_id, {turns_text()} AS w FROM p WHERE text IS NOT NULL),
c AS (SELECT piece_id, w, unnest(range(1, len(w) + 1)) AS i FROM z),
cn AS (SELECT piece_id, w, i, unnest(range(1, 31)) AS n FROM c),
eq AS (SELECT piece_id, i, n, w[i] = w[i + n] AS same, len(w) AS l FROM cn WHERE i + n <= len(w)),
br AS (SELECT *, min(CASE WHEN NOT same THEN i END) OVER (PARTITION BY piece_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM eq),
rr AS (SELECT piece_id, i, n, coalesce(stop, l - n + 1) - i AS r FROM br),
hit AS (SELECT piece_id, i - 1 AS start, n, 1 + r // n AS repeats FROM rr WHERE 1 + r // n >= CASE WHEN n <= 2 THEN 6 ELSE 3 END),
first_hit AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY start, n) AS o FROM hit)
"""


@query("l2_repeated_run", f"WITH {PIECES}, {REPEATED} SELECT piece_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n, CAST(repeats AS INT) AS repeats FROM first_hit WHERE o = 1")
def l2_repeated_run(spark: SparkSession, folder: str) -> DataFrame:
    p = pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", loops.repeated_run_udf(loops.normalize_words_udf("text")).alias("r"))
    return p.where("r.n IS NOT NULL").select("piece_id", "r.start", "r.n", "r.repeats")


@query("l1_periodic_suffix")
def l1_periodic_suffix(spark: SparkSession, folder: str) -> DataFrame:
    p = pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", loops.periodic_suffix_udf(loops.normalize_words_udf("text")).alias("r"))
    return p.where("r.period IS NOT NULL").select("piece_id", "r.period", "r.repeats")


@query("l4_compression")
def l4_compression(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", F.round(loops.compression_ratio_udf("text"), 6).alias("ratio"))


@query("l7_collapse")
def l7_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", loops.collapse_udf("text").alias("text"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of spans: the piece as it is, its half, and its text once more, so that every rung has its cases."""
    p = pieces_once(spark, folder).where("text IS NOT NULL").groupBy("recording", "span_id").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_ix", "text"))), lambda r: r["text"]), " ").alias("text"))
    t = F.col("text")
    each = F.array(F.struct(F.lit(0).alias("rung"), t.alias("text")), F.struct(F.lit(1).alias("rung"), F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int")).alias("text")), F.struct(F.lit(2).alias("rung"), F.concat(t, F.lit(" "), t).alias("text")))
    x = spread(p, "recording", "span_id").withColumn("a", F.explode(each)).select("recording", "span_id", "start_s", "end_s", "a.rung", "a.text")
    return x.withColumns({"hit_limit": (F.col("rung") == 0) & (F.length("text") > 600), "stop_reason": F.when((F.col("rung") == 1) & (F.col("span_id") % 7 == 0), "token loop")})


@query("l6_diagnose")
def l6_diagnose(spark: SparkSession, folder: str) -> DataFrame:
    a = retry.diagnosed(attempts(spark, folder))
    return a.select("recording", "span_id", "rung", F.array_join("issues", "; ").alias("issues"))


@query("l8_retry_ladder")
def l8_retry_ladder(spark: SparkSession, folder: str) -> DataFrame:
    x = retry.resolved(retry.diagnosed(attempts(spark, folder)))
    return x.select("recording", "span_id", "text", F.array_join("flags", "; ").alias("flags"), "rung")


@query("l6_issues")
def l6_issues(spark: SparkSession, folder: str) -> DataFrame:
    """All issues but the one that a compressor tells."""
    a = retry.diagnosed(attempts(spark, folder))
    return a.select("recording", "span_id", "rung", F.array_join(F.filter("issues", lambda x: ~x.startswith("compression ratio")), "; ").alias("issues"))


def stored_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of a span as its attempts, their flags as what is wrong with them."""
    return pieces_once(spark, folder).where("text IS NOT NULL").select("recording", "span_id", "start_s", "end_s", F.col("piece_ix").alias("rung"), "text", F.coalesce("flags", F.array().cast("array<string>")).alias("issues"))


@query("j6_stored")
def j6_stored(spark: SparkSession, folder: str) -> DataFrame:
    return retry.pending(stored_attempts(spark, folder), 0)


@query("l8_stored")
def l8_stored(spark: SparkSession, folder: str) -> DataFrame:
    x = retry.resolved(stored_attempts(spark, folder))
    return x.select("recording", "span_id", "text", F.array_join("flags", "; ").alias("flags"), "rung")


@query("j6_pending")
def j6_pending(spark: SparkSession, folder: str) -> DataFrame:
    return retry.pending(retry.diagnosed(attempts(spark, folder)), 0)


@query("o2_batches")
def o2_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of each piece: within parts of the ids, longest first, sixteen by sixteen."""
    p = pieces_once(spark, folder).withColumn("span_id", F.col("piece_id"))
    return retry.batches(p, part=F.abs("piece_id") % 64).select("piece_id", "batch")


# --- text ---------------------------------------------------------------------------------------------------------


@query("f7_latin_ratio", f"""
WITH {PIECES}, r AS (SELECT piece_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS l, length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) AS a FROM p WHERE text IS NOT NULL)
SELECT piece_id, round(CASE WHEN l = 0 THEN 1.0 ELSE a / l END, 6) AS ratio FROM r
""")
def f7_latin_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", F.round(text.latin_ratio(F.col("text")), 6).alias("ratio"))


@query("f6_clean", f"""
WITH {PIECES}, c AS (SELECT piece_id, end_s - start_s AS dur, trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\[[^\\]]{{0,40}}\\]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS t FROM p),
k AS (SELECT *, array_to_string({turns_text('t')}, ' ') AS key, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS l, length(regexp_replace(t, '[^\\p{{Latin}}]', '', 'g')) AS a FROM c),
r AS (SELECT *, CASE WHEN t = '' THEN 'non-speech tag' WHEN key IN ({', '.join(f"'{x}'" for x in INVENTED)}) THEN 'known hallucination'
  WHEN dur < 1.0 AND key IN ({', '.join(f"'{x}'" for x in INVENTED_SHORT)}) THEN 'short-turn hallucination' WHEN l > 0 AND a * 2 < l THEN 'foreign script' END AS reason FROM k)
SELECT piece_id, CASE WHEN reason IS NULL THEN t ELSE '' END AS text, reason FROM r
""")
def f6_clean(spark: SparkSession, folder: str) -> DataFrame:
    p = pieces_once(spark, folder)
    return p.select("piece_id", text.clean_column(F.col("text"), "fr", False, F.col("end_s") - F.col("start_s")).alias("c")).select("piece_id", "c.text", "c.reason")


@query("t2_phonetic")
def t2_phonetic(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "glossary").select("term_id", text.phonetic_column(F.col("term")).alias("key"))


@query("t7_fillers", """
WITH s AS (SELECT DISTINCT seg_id, text FROM segments WHERE text IS NOT NULL)
SELECT seg_id, CAST(len(regexp_extract_all(' ' || regexp_replace(text, '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' ', '(?i)[^\\p{L}\\p{N}_](?:euh+|heu+|hum+|hm+|mmh*|hmm+)(?:[^\\p{L}\\p{N}_])')) AS INT) AS fillers FROM s
""")
def t7_fillers(spark: SparkSession, folder: str) -> DataFrame:
    return segments_once(spark, folder).where("text IS NOT NULL").select("seg_id", text.fillers_counted(F.col("text")).alias("fillers"))


@query("t8_read_style")
def t8_read_style(spark: SparkSession, folder: str) -> DataFrame:
    return segments_once(spark, folder).where("text IS NOT NULL").select("seg_id", text.read_style_udf("text").alias("r")).select("seg_id", "r.*")


@query("t10_numbers")
def t10_numbers(spark: SparkSession, folder: str) -> DataFrame:
    s = segments_once(spark, folder).where("text IS NOT NULL")
    return s.select("seg_id", text.french_numbers_udf(F.concat("text", F.lit(" vingt et un, quatre-vingt-dix-sept et deux cents"))).alias("r")).select("seg_id", "r.*")


@query("t11_typography")
def t11_typography(spark: SparkSession, folder: str) -> DataFrame:
    return segments_once(spark, folder).where("text IS NOT NULL").select("seg_id", text.french_typography_udf("text").alias("text"))


@query("t13_json_text", f"""
WITH {PIECES} SELECT recording, span_id, string_agg(trim(text), ' ' ORDER BY piece_ix) AS text FROM p WHERE trim(text) <> '' GROUP BY recording, span_id
""")
def t13_json_text(spark: SparkSession, folder: str) -> DataFrame:
    """A model's JSON made of the pieces of a span, every third cut off in its last string, read again."""
    p = pieces_once(spark, folder).where("trim(text) <> ''").groupBy("recording", "span_id").agg(F.sort_array(F.collect_list(F.struct("piece_ix", F.col("text").alias("Content")))).alias("a"))
    raw = F.to_json("a")
    cut = F.when(F.col("span_id") % 3 == 0, F.substring(raw, F.lit(1), F.length(raw) - 3)).otherwise(raw)
    return p.select("recording", "span_id", text.json_text_udf(F.concat(F.lit("assistant"), cut)).alias("text"))


@query("t3_glossary")
def t3_glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the reference list put right in every segment."""
    return post.postprocess(segments_once(spark, folder), _config(spark, folder)).where(F.size("glossary") > 0).select("seg_id", "text", F.array_join("glossary", "; ").alias("hits"))


def _config(spark: SparkSession, folder: str, **more) -> post.PostConfig:
    """Options with the reference list, a fixed table, as glossary, and the words that pieces use often as common."""
    entries = tuple(r["term"] + ("=" + "|".join(r["aliases"]) if r["aliases"] else "") for r in read(spark, folder, "glossary").orderBy("term_id").collect())
    words = read(spark, folder, "pieces", ["text"]).where("text IS NOT NULL").select(F.lit("fr").alias("lang"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    often = post.zipf(words).where(F.col("zipf") >= post.PostConfig.max_zipf)  # at 4.0 they are at most 100,000
    return post.PostConfig(glossary=entries, lang_filter=False, frequencies={r["word"]: r["zipf"] for r in often.collect()}, **more)


@query("t12_postprocess")
def t12_postprocess(spark: SparkSession, folder: str) -> DataFrame:
    done = post.kept(post.postprocess(segments_once(spark, folder), _config(spark, folder, style="lu", numbers="digits")))
    return done.select("seg_id", "text", "fillers", "stutters", "numbers", "typography")


@query("a10_post_summary")
def a10_post_summary(spark: SparkSession, folder: str) -> DataFrame:
    return post.summary(post.postprocess(segments_once(spark, folder), _config(spark, folder, style="lu", numbers="digits")))


@query("t1_language_filter", """
WITH s AS (SELECT DISTINCT seg_id, text FROM segments WHERE text IS NOT NULL AND seg_id IS NOT NULL),
c AS (SELECT seg_id, len(regexp_extract_all(regexp_replace(text, '[^\\s]*[\\p{L}\\p{N}_][.@][\\p{L}\\p{N}_][^\\s]*', ' ', 'g'), '[\\p{L}\\p{M}\\p{N}_\\x{200c}\\x{200d}]+')) AS n FROM s)
SELECT seg_id, CASE WHEN n >= 3 AND seg_id % 5 = 0 THEN 'en' END AS other FROM c
""")
def t1_language_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The rule of the filter over confidences of a stand-in model: every fifth row is surely English."""
    c = F.when(F.col("seg_id") % 5 == 0, F.create_map(F.lit("en"), F.lit(0.9), F.lit("fr"), F.lit(0.02))).otherwise(F.create_map(F.lit("fr"), F.lit(0.8), F.lit("en"), F.lit(0.1)))
    return segments_once(spark, folder).where("text IS NOT NULL").select("seg_id", post.foreign_language(F.col("text"), c, "fr").alias("other"))


# --- sinks --------------------------------------------------------------------------------------------------------

SEGMENTS = "s AS (SELECT DISTINCT seg_id, recording, start_s, end_s, speaker, text, flags FROM segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL AND text IS NOT NULL)"


def full_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments_once(spark, folder).where("start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL AND text IS NOT NULL")


def sql_clock(t: str) -> str:
    return f"printf('%02d:%02d:%05.2f', CAST(floor({t} / 3600) AS INT), CAST(floor(({t} - floor({t} / 3600) * 3600) / 60) AS INT), {t} - floor({t} / 60) * 60)"


@query("k1_txt")
def k1_txt(spark: SparkSession, folder: str) -> DataFrame:
    return full_segments(spark, folder).select("seg_id", sinks.text_line(F.col("start_s"), F.col("end_s"), F.col("speaker"), F.col("text"), F.col("flags")).alias("line"))


@query("k5_clock")
def k5_clock(spark: SparkSession, folder: str) -> DataFrame:
    return full_segments(spark, folder).select("seg_id", text.clock_udf("start_s").alias("clock"))


@query("k2_srt", f"""
WITH {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start_s, seg_id) AS i, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS b FROM s)
SELECT seg_id, i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000)
  || chr(10) || '[SPEAKER_' || speaker || '] ' || text || chr(10) AS block FROM n
""")
def k2_srt(spark: SparkSession, folder: str) -> DataFrame:
    s = intervals.numbered(full_segments(spark, folder), ["recording"], ["start_s", "seg_id"], "ix")
    return s.select("seg_id", sinks.srt_block(F.col("ix") + 1, F.col("start_s"), F.col("end_s"), F.col("speaker"), F.col("text")).alias("block"))


@query("k3_json")
def k3_json(spark: SparkSession, folder: str) -> DataFrame:
    s = full_segments(spark, folder).withColumnRenamed("start_s", "start").withColumnRenamed("end_s", "end")
    return s.select("seg_id", sinks.json_row("start", "end", "speaker", "text", "flags").alias("json"))


@query("k4_files")
def k4_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text and subtitle files of all recordings, written to the shared folder, and what they hold when they are read again."""
    done = written(sinks.write_files(full_segments(spark, folder), scratch(spark, "transcripts"), ["txt", "srt", "json"]), "files")
    return sinks.read_files(done).where("format <> 'json'").select("recording", "format", "content")


@query("k3_files", f"WITH {SEGMENTS} SELECT recording, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(speaker) AS BIGINT) AS speakers FROM s GROUP BY recording")
def k3_files(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of all recordings, read again."""
    done = written(sinks.write_files(full_segments(spark, folder), scratch(spark, "transcripts"), ["json"]), "files")
    rows = sinks.read_files(done).select("recording", F.explode(F.from_json("content", "array<struct<start: double, end: double, speaker: int, text: string, flags: array<string>>>")).alias("r"))
    return rows.groupBy("recording").agg(F.count("*").alias("n_segments"), F.sum(F.length("r.text")).alias("n_chars"), F.sum("r.speaker").alias("speakers"))


@query("a11_trimmed", """
WITH s AS (SELECT DISTINCT seg_id, recording, flags FROM segments)
SELECT recording, count(*) AS segments, CAST(sum(CASE WHEN list_contains(flags, 'loop_trimmed') THEN 1 ELSE 0 END) AS BIGINT) AS trimmed FROM s GROUP BY recording
""")
def a11_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    trimmed = F.coalesce(F.array_contains("flags", "loop_trimmed"), F.lit(False))
    return segments_once(spark, folder).groupBy("recording").agg(F.count("*").alias("segments"), F.count_if(trimmed).alias("trimmed"))


@query("a6_flags", """
SELECT recording, array_to_string(list_sort(list_distinct(flatten(list(coalesce(flags, []))))), '|') AS flags FROM (SELECT DISTINCT piece_id, recording, flags FROM pieces) GROUP BY recording
""")
def a6_flags(spark: SparkSession, folder: str) -> DataFrame:
    each = pieces_once(spark, folder).select("recording", F.explode_outer("flags").alias("f")).distinct()  # a few flags a recording before they are gathered
    return each.groupBy("recording").agg(F.array_join(F.array_sort(F.collect_set("f")), "|").alias("flags"))


# --- frames, waveforms, fusion ------------------------------------------------------------------------------------

#: Frames from vectors: a label is a span, its vectors in order its frames.
FRAMES = "e AS (SELECT label AS span_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings)"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("span_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("frame"), alignment.log_softmax(F.col("embedding")).alias("logp"))


def spans_of_frames(spark: SparkSession, folder: str) -> DataFrame:
    x = frames(spark, folder).groupBy("span_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "logp"))), lambda r: r["logp"]).alias("logp"))
    tokens = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size("logp") / 3).cast("int"))), lambda i: ((i * 7 + F.col("span_id")) % 63 + 1).cast("int"))
    return x.withColumn("tokens", tokens)


@query("s7_log_softmax", f"""
WITH {FRAMES}, m AS (SELECT *, list_max(embedding)::DOUBLE AS top FROM e), s AS (SELECT *, top + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - top)))) AS norm FROM m)
SELECT CAST(span_id AS BIGINT) AS span_id, CAST(frame AS INT) AS frame, round(embedding[1]::DOUBLE - norm, 6) AS first, round(embedding[64]::DOUBLE - norm, 6) AS last FROM s
""")
def s7_log_softmax(spark: SparkSession, folder: str) -> DataFrame:
    return frames(spark, folder).select("span_id", "frame", F.round(F.col("logp")[0], 6).alias("first"), F.round(F.col("logp")[63], 6).alias("last"))


@query("w8_blank_score", f"""
WITH {FRAMES}, m AS (SELECT *, list_max(embedding)::DOUBLE AS top FROM e), s AS (SELECT *, embedding[1]::DOUBLE - (top + ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - top))))) AS b FROM m)
SELECT CAST(span_id AS BIGINT) AS span_id, CAST(frame AS INT) AS frame, round(sum(b) OVER (PARTITION BY span_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 4) AS score FROM s
""")
def w8_blank_score(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.blank_scores(frames(spark, folder)).select("span_id", "frame", F.round("score", 4).alias("score"))


@query("c4_align_tokens")
def c4_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    x = spans_of_frames(spark, folder).withColumn("s", alignment.align_tokens_udf("logp", "tokens"))
    return x.select("span_id", F.posexplode("s").alias("token_ix", "s")).select("span_id", "token_ix", "s.first", "s.last")


@query("c3_path_score")
def c3_path_score(spark: SparkSession, folder: str) -> DataFrame:
    return spans_of_frames(spark, folder).select("span_id", F.round(alignment.path_score_udf("logp", "tokens"), 4).alias("score"))


@query("m4_frame_rms", """
WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, vec_id AS f FROM embeddings),
r AS (SELECT label, f, round(sqrt(avg(x * x)), 6) AS rms FROM e GROUP BY label, f)
SELECT CAST(label AS BIGINT) AS span_id, arg_min(f, (rms, f)) AS quietest, min(rms) AS rms FROM r GROUP BY label
""")
def m4_frame_rms(spark: SparkSession, folder: str) -> DataFrame:
    """The quietest frame of each waveform: the first of least root mean square."""
    r = read(spark, folder, "embeddings").select(F.col("label").cast("bigint").alias("span_id"), "vec_id", F.round(intervals.rms(F.col("embedding")), 6).alias("loud"))
    return intervals.quietest(r, ["span_id"], "vec_id", "loud")


@query("m4_best_cut")
def m4_best_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Long windows of a waveform made of the vectors, cut at quiet places."""
    e = read(spark, folder, "embeddings").withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    waves = e.select(F.col("label").cast("string").alias("recording"), F.lit(64).alias("rate"), F.col("frame").cast("double").alias("from_s"), F.col("embedding").alias("samples"))
    spans = waves.groupBy("recording").agg(F.max("from_s").alias("end_s")).select("recording", F.lit(0).cast("bigint").alias("span_id"), F.lit(0.0).alias("start_s"), (F.col("end_s") + 1).alias("end_s"))
    return intervals.split_long(spans, waves, 20.0).withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


@query("s3_slice", """
WITH p AS (SELECT vec_id, embedding[CAST(trunc(0.15 * 64) AS INT) + 1:CAST(trunc(0.6 * 64) AS INT)] AS part FROM embeddings)
SELECT vec_id, CAST(len(part) AS INT) AS n, round(part[1]::DOUBLE, 6) AS first, round(part[len(part)]::DOUBLE, 6) AS last FROM p
""")
def s3_slice(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", audio.sliced(F.col("embedding"), 64, F.lit(0.15), F.lit(0.6)).alias("part"))
    edge = lambda i: F.round(F.element_at("part", i).cast("double"), 6)
    return e.select("vec_id", F.size("part").alias("n"), edge(1).alias("first"), edge(-1).alias("last"))


#: Letters, an apostrophe and the mark between words, as an aligner's vocabulary of 64 tokens; 0 is the blank.
VOCAB = {c: i for i, c in enumerate("|'-abcdefghijklmnopqrstuvwxyzàâäçéèêëîïôöùûü", 1)}


#: SQL: what is said in each segment: its words, each with its place in letters, so that none comes twice.
HEARD = """
h0 AS (SELECT recording, seg_id AS span_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM (SELECT DISTINCT recording, seg_id, text FROM segments) WHERE text IS NOT NULL),
h AS (SELECT recording, span_id, list_transform(w, lambda x, i: x || chr(CAST(96 + i % 26 + CASE WHEN i % 26 = 0 THEN 26 ELSE 0 END AS INT)) || chr(CAST(97 + (i - 1) // 26 % 26 AS INT)) || chr(CAST(97 + (i - 1) // 676 % 26 AS INT))) AS w FROM h0)
"""


def heard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Two transcripts of each segment and frames of what is said in it, a letter a frame. The first recogniser hears 'z' for
    every fifth word from the third on, the second 'b' for every fifth from the fifth on."""
    p = segments_once(spark, folder).where("text IS NOT NULL").select("recording", F.col("seg_id").alias("span_id"), F.lower("text").alias("t"))
    letter = lambda n: F.char(97 + n % 26)
    w = F.filter(F.split(F.regexp_replace("t", "[^a-z ]", " "), " +"), lambda x: x != "")
    w = F.transform(w, lambda x, i: F.concat(x, letter(i), letter(F.floor(i / 26)), letter(F.floor(i / 676))))
    p = spread(p.select("recording", "span_id", w.alias("w")).where(F.size("w") > 0), "recording", "span_id")
    wrong = lambda at, said: F.array_join(F.transform("w", lambda x, i: F.when(i % 5 == at, F.lit(said)).otherwise(x)), " ")
    token = F.transform(F.filter(F.split(F.array_join("w", "|"), ""), lambda c: c != ""), lambda c: F.instr(F.lit("|abcdefghijklmnopqrstuvwxyz"), c))
    logp = F.transform(token, lambda k: F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.when(i == k, F.lit(0.0)).otherwise(F.lit(-20.0))))
    none = F.array().cast("array<string>")
    return p.select("recording", "span_id", wrong(2, "z").alias("text_a"), wrong(4, "b").alias("text_b"), none.alias("flags_a"), none.alias("flags_b"), logp.alias("logp"))


@query("c9_fuse", f"""
WITH {HEARD} SELECT recording, span_id, array_to_string(w, ' ') AS text, 1 AS windows, CAST(len(w) AS INT) AS words,
  CAST(len(list_filter(w, lambda x, i: i % 5 IN (0, 3))) AS INT) AS regions, 0 AS number_variants, CAST(len(list_filter(w, lambda x, i: i % 5 = 3)) AS INT) AS secondary_chosen
FROM h WHERE len(w) > 0
""")
def c9_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Two transcripts of each segment made into one, where the frames tell who is right: all that was said comes out."""
    got = fusion.fused(heard_pairs(spark, folder), {c: i for i, c in enumerate("|abcdefghijklmnopqrstuvwxyz", 1)}, 1)
    return got.select("recording", "span_id", "text", "windows", "words", "regions", "number_variants", "secondary_chosen")


@query("e4_secondary_share", f"""
WITH {HEARD}, n AS (SELECT CAST(count(*) AS BIGINT) AS windows, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_filter(w, lambda x, i: i % 5 IN (0, 3)))) AS BIGINT) AS regions,
  CAST(0 AS BIGINT) AS number_variants, CAST(sum(len(list_filter(w, lambda x, i: i % 5 = 3))) AS BIGINT) AS secondary_chosen FROM h WHERE len(w) > 0)
SELECT *, round(secondary_chosen / regions, 6) AS share FROM n
""")
def e4_secondary_share(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.secondary_share(c9_fuse(spark, folder))


@query("e1_word_gap")
def e1_word_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each span before and after its loops are cut."""
    a = attempts(spark, folder).where("rung = 0").select("recording", "span_id", F.col("text").alias("text_a"), loops.collapse_udf("text").alias("text_b"))
    return metrics.word_gap(a).select("recording", "span_id", "edits", "longest", F.round("gap", 6).alias("gap"))


@query("e2_agreement")
def e2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    a = attempts(spark, folder)
    x = a.select(F.concat_ws("/", "recording", F.col("span_id").cast("string")).alias("unit"), F.concat(F.lit("rung"), F.col("rung").cast("string")).alias("system"), "text")
    got = metrics.agreement(x, ["rung0", "rung1", "rung2"])
    return got.withColumn("gap", F.round("gap", 6))


@query("e1_word_distance")
def e1_word_distance(spark: SparkSession, folder: str) -> DataFrame:
    """The same by words as they are."""
    a = attempts(spark, folder).where("rung = 0").select("recording", "span_id", F.col("text").alias("text_a"), loops.collapse_udf("text").alias("text_b"))
    return metrics.word_gap(a, plain=True).select("recording", "span_id", "edits", "longest", F.round("gap", 6).alias("gap"))


@query("e2_agreement_words")
def e2_agreement_words(spark: SparkSession, folder: str) -> DataFrame:
    x = attempts(spark, folder).select(F.concat_ws("/", "recording", F.col("span_id").cast("string")).alias("unit"), F.concat(F.lit("rung"), F.col("rung").cast("string")).alias("system"), "text")
    return metrics.agreement(x, ["rung0", "rung1", "rung2"], plain=True).withColumn("gap", F.round("gap", 6))


@query("e3_kept_style")
def e3_kept_style(spark: SparkSession, folder: str) -> DataFrame:
    s = segments_once(spark, folder)
    return metrics.kept_style(s, "config_id", ["réunion", "budget"])


# --- whole pipelines ----------------------------------------------------------------------------------------------


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Merged turns with relabelled speakers, and how long each speaker talks."""
    m = pipeline.speech_turns(turns_once(spark, folder))
    talk = m.groupBy("recording", "speaker").agg(F.sum(millis("end_s") - millis("start_s")).alias("talk_ms"))
    return intervals.relabel_speakers(m, "ord").join(talk, ["recording", "speaker"]).select("recording", "speaker", "label", "start_s", "end_s", "talk_ms")


@query("speaker_timeline", f"""
WITH {DISTINCT_TURNS}, ph AS (SELECT recording, speaker FROM d WHERE speaker IS NOT NULL GROUP BY recording, speaker HAVING sum({ms('end_s')} - {ms('start_s')}) >= 2000),
v AS (SELECT d.* FROM d JOIN ph USING (recording, speaker) WHERE start_s IS NOT NULL AND end_s > start_s), {MERGED}, q AS (SELECT * FROM m WHERE end_s - start_s >= 0.15),
f AS (SELECT recording, speaker, min((start_s, ord)) AS seen, CAST(sum({ms('end_s')} - {ms('start_s')}) AS BIGINT) AS talk_ms FROM q GROUP BY recording, speaker),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording ORDER BY seen, speaker) - 1 AS INT) AS label FROM f)
SELECT q.recording, q.speaker, label, start_s, end_s, talk_ms FROM q JOIN l ON q.recording = l.recording AND q.speaker = l.speaker
""")
def speaker_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return timeline(spark, folder)


@query("pipeline_window")
def pipeline_window(spark: SparkSession, folder: str) -> DataFrame:
    words = words_once(spark, folder).select("word_id", "piece_id", "pos", "start_s", "end_s", "text")
    s = pipeline.window_segments(pieces_once(spark, folder), turns_once(spark, folder), words, pipeline.Options(lang=None))
    return s.withColumn("flags", F.array_join("flags", "|"))


class SpokenWords(HypothesisModel):
    """A stand-in for a recogniser: it says a name for each timed word whose middle lies in the span. It goes in circles
    where there are more than forty, on the last rung where there are more than sixty."""

    MOST = (40, 40, 60)
    BUCKET_S = 30.0

    def __init__(self, words: DataFrame):
        mid = (F.col("start_s") + F.col("end_s")) / 2
        name = F.translate(F.substring(F.md5(F.col("word_id").cast("string")), 1, 8), "0123456789", "ghijklmnop")
        self.words = words.where(mid.isNotNull()).select(F.col("recording").alias("_r"), F.floor(mid / self.BUCKET_S).alias("_k"), mid.alias("_m"), F.struct(F.col("start_s"), F.col("word_id"), name.alias("name")).alias("w"))
        self.limits = models.limits("cohere")

    def attempts(self, spans: DataFrame, rung: int) -> DataFrame:
        keys = ["recording", "span_id", "node", "start_s", "end_s"]
        cells = F.explode(F.sequence(F.floor(F.col("start_s") / self.BUCKET_S), F.floor(F.col("end_s") / self.BUCKET_S)))
        at = (F.col("_r") == F.col("recording")) & (F.col("_k") == F.col("k")) & (F.col("_m") >= F.col("start_s")) & (F.col("_m") < F.col("end_s"))
        said = spans.select(*keys, cells.alias("k")).join(self.words, at, "left").groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("w"))
        text = F.array_join(F.transform("w", lambda x: x["name"]), " ")
        text = F.when(F.size("w") > self.MOST[rung], F.concat(text, F.repeat(F.lit(" encore"), 9))).otherwise(text)
        return said.select(*keys, F.lit(rung).alias("rung"), text.alias("text"), F.lit(False).alias("hit_limit"), F.lit(None).cast("string").alias("stop_reason"))


@query("pipeline_full")
def pipeline_full(spark: SparkSession, folder: str) -> DataFrame:
    """From turns to segments: windows, ladder, halves that are tried again, trimming, words, speakers, labels."""
    s = pipeline.run(turns_once(spark, folder), SpokenWords(words_once(spark, folder)), pipeline.Options(lang=None))
    return s.withColumn("flags", F.array_join(F.filter("flags", lambda f: f.isin("retry", "loop_trimmed")), "|"))


@query("pipeline_pieces")
def pipeline_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What the ladder and bisection make of the windows, each piece with its flags."""
    o = pipeline.Options(lang=None)
    spans = pipeline.window_spans(turns_once(spark, folder), o, 35.0).select("recording", F.col("window_ix").alias("span_id"), F.col("pad_start").alias("start_s"), F.col("pad_end").alias("end_s"))
    got = pipeline.transcribed(SpokenWords(words_once(spark, folder)), spans, o)
    return got.withColumn("flags", F.array_join(F.filter("flags", lambda f: f.isin("retry", "loop_trimmed")), "|"))


@query("pipeline_turns")
def pipeline_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns mode, where the segments of a recording stand for what was recognised in them."""
    s = segments_once(spark, folder).where("start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL")
    spans = s.select("recording", F.col("seg_id").alias("span_id"), "speaker", "start_s", "end_s")
    pieces = s.select("recording", F.col("seg_id").alias("span_id"), F.lit(0).alias("piece_ix"), "start_s", "end_s", "text", "flags")
    return pipeline.turn_segments(spans, pieces, pipeline.Options(lang=None)).withColumn("flags", F.array_join("flags", "|"))


# --- streams ------------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, stream: DataFrame, what: str) -> DataFrame:
    """A stream over everything that is there, and what it gave."""
    out = scratch(spark, what)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, what + "-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("l5_watch_loops")
def l5_watch_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Words of pieces as a stream of tokens, watched for loops of tokens and of words."""
    p = pieces_once(spark, folder).where("text IS NOT NULL").select("recording", F.col("piece_id").alias("span_id"), F.posexplode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("ix", "word"))
    tokens = written(p.select("recording", "span_id", "ix", F.pmod(F.xxhash64("word"), F.lit(1 << 20)).cast("int").alias("token"), "word"), "tokens")
    path = tokens.inputFiles()[0].rsplit("/", 1)[0]
    return _run(spark, stateful.watch_loops(spark.readStream.schema(tokens.schema).parquet(path)), "loops")


@query("s5_chunked_turns")
def s5_chunked_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings made of the vectors, in chunks, through a stand-in model whose cache is the loudness so far."""

    def model(samples, cache):
        import struct

        total, n = struct.unpack("dq", cache) if cache else (0.0, 0)
        total, n = total + sum(abs(x) for x in samples), n + len(samples)
        loud = sum(abs(x) for x in samples) / max(1, len(samples)) > total / n
        return [(0.0, len(samples) / 64, int(loud))], struct.pack("dq", total, n)

    e = read(spark, folder, "embeddings")
    chunks = e.select(F.col("label").cast("string").alias("recording"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int").alias("ix"), F.col("embedding").alias("samples"))
    chunks = written(chunks.withColumn("from_s", F.col("ix").cast("double")), "chunks")
    path = chunks.inputFiles()[0].rsplit("/", 1)[0]
    return _run(spark, stateful.chunked_turns(spark.readStream.schema(chunks.schema).parquet(path), model), "turns")


# --- smaller operators --------------------------------------------------------------------------------------------


@query("j10_zipf", f"""
WITH {PIECES}, w AS (SELECT unnest({turns_text()}) AS word FROM p WHERE text IS NOT NULL), n AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT count(*) AS total FROM w)
SELECT word, round(log10(1e9 * n / total), 6) AS zipf FROM n, t
""")
def j10_zipf(spark: SparkSession, folder: str) -> DataFrame:
    """How frequent each word of the pieces is."""
    w = pieces_once(spark, folder).where("text IS NOT NULL").select(F.lit("fr").alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return post.zipf(w).select("word", F.round("zipf", 6).alias("zipf"))


@query("o4_word_cap", f"""
WITH {PIECES}, t AS (SELECT piece_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, CAST(floor(greatest((end_s - start_s) / 10, 1.0) * 6.0) AS INT) + 5 AS n FROM p WHERE text IS NOT NULL)
SELECT piece_id, array_to_string(w[1:n], ' ') AS text FROM t
""")
def o4_word_cap(spark: SparkSession, folder: str) -> DataFrame:
    """As many words of a piece as a tenth of its time can hold."""
    return pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", retry.capped(F.col("text"), (F.col("end_s") - F.col("start_s")) / 10).alias("text"))


@query("m8_halves", f"""
WITH {PIECES}, c AS (SELECT piece_id, start_s, end_s, (start_s + end_s) / 2 AS cut FROM p)
SELECT piece_id, start_s, cut AS end_s, TRUE AS split FROM c WHERE end_s - start_s >= 4.0 UNION ALL SELECT piece_id, cut, end_s, TRUE FROM c WHERE end_s - start_s >= 4.0
UNION ALL SELECT piece_id, start_s, end_s, FALSE FROM c WHERE NOT end_s - start_s >= 4.0
""")
def m8_halves(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces long enough to be split, halved in the middle, and the others."""
    p = pieces_once(spark, folder).select("piece_id", "start_s", "end_s")
    halves, rest = intervals.bisected(p, (F.col("start_s") + F.col("end_s")) / 2)
    return halves.withColumn("split", F.lit(True)).unionByName(rest.withColumn("split", F.lit(False)))


#: SQL: what the JVM takes for a character of a word.
WORD_CHARS = "\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{24B6}-\\x{24E9}\\x{200C}\\x{200D}"


@query("t6_bare", f"""
WITH w AS (SELECT DISTINCT word_id, text FROM words)
SELECT word_id, lower(regexp_replace(regexp_replace(text, '^[^{WORD_CHARS}]+', ''), '[^{WORD_CHARS}]+$', '')) AS bare FROM w
""")
def t6_bare(spark: SparkSession, folder: str) -> DataFrame:
    """Words without the marks around them."""
    return words_once(spark, folder).select("word_id", text.bare_column(F.col("text")).alias("bare"))


@query("l10_budget", f"""
WITH {PIECES} SELECT recording, CAST(floor(24 + max(end_s - start_s) * 12.0) AS INT) AS budget FROM p GROUP BY recording
""")
def l10_budget(spark: SparkSession, folder: str) -> DataFrame:
    """New tokens that a recording's pieces may have if they are one batch."""
    p = pieces_once(spark, folder).groupBy("recording").agg(F.max(F.col("end_s") - F.col("start_s")).alias("longest"))
    return p.select("recording", retry.token_budget(F.col("longest"), 24, 12.0).alias("budget"))


@query("c6_align_words")
def c6_align_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of pieces timed by the frames that stand for their sound."""
    from ..functions.arrow import by_row

    def one(logp, start, end, said):
        rows = alignment.align_words(alignment._frames(logp), (end - start) / max(1, len(logp)), start, end, said, VOCAB, VOCAB["|"])
        return [{"start_s": round(a, 6), "end_s": round(b, 6), "text": w} for a, b, w in rows]

    udf = by_row("array<struct<start_s: double, end_s: double, text: string>>")(one)
    p = pieces_once(spark, folder).where("text IS NOT NULL").withColumn("_k", F.col("piece_id") % 10)
    x = p.join(spans_of_frames(spark, folder).select(F.col("span_id").alias("_k"), "logp"), "_k")
    return x.select("piece_id", F.posexplode(udf("logp", "start_s", "end_s", "text")).alias("pos", "w")).select("piece_id", "pos", "w.start_s", "w.end_s", "w.text")


@query("o6_top_language", """
WITH s AS (SELECT DISTINCT seg_id, recording, config_id FROM segments), n AS (SELECT recording, coalesce(lang, '') AS lang, count(*) AS n FROM s JOIN post_configs USING (config_id) GROUP BY ALL)
SELECT recording, arg_max(lang, (n, lang)) AS lang, max(n) AS n FROM n GROUP BY recording
""")
def o6_top_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language label that most segments of a recording have, of equals the last by name."""
    labels = F.broadcast(read(spark, folder, "post_configs").select("config_id", F.coalesce("lang", F.lit("")).alias("lang")))  # a fixed table
    n = segments_once(spark, folder).join(labels, "config_id").groupBy("recording", "lang").agg(F.count("*").alias("n"))
    n = n.groupBy("recording").agg(post.top_language(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).alias("t"))  # a few labels a recording
    return n.select("recording", F.col("t.k").alias("lang"), F.col("t.v").alias("n"))


@query("t4_heard_terms")
def t4_heard_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words of segments that may be a misheard name of one word."""
    w = segments_once(spark, folder).where("text IS NOT NULL").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return glossary.heard_terms(w, read(spark, folder, "glossary", ["term"]))


@query("t10_spelled", """
SELECT p_partkey, 'il y en a ' || CASE WHEN p_partkey = 1 THEN 'un' ELSE CAST(p_partkey AS VARCHAR) END || ', je crois' AS text, CAST(CASE WHEN p_partkey = 1 THEN 0 ELSE 1 END AS INT) AS numbers FROM part
""")
def t10_spelled(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in words, read back as digits."""
    said = F.concat(F.lit("il y en a "), text.in_french_udf("p_partkey"), F.lit(", je crois"))
    return read(spark, folder, "part", ["p_partkey"]).select("p_partkey", text.french_numbers_udf(said).alias("r")).select("p_partkey", "r.text", "r.numbers")


@query("c6_known_words")
def c6_known_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words timed by frames that say them, a letter a frame of twenty milliseconds: where each begins is known."""
    from ..functions.arrow import by_row

    vocab = {c: i for i, c in enumerate("|abcdefghijklmnopqrstuvwxyz", 1)}

    def one(said):
        import numpy as np

        tokens = [vocab[c] for c in "|".join(said)]
        logp = np.full((len(tokens), 28), -20.0)
        logp[np.arange(len(tokens)), tokens] = 0.0
        return [{"start_s": round(a, 6), "end_s": round(b, 6), "text": w} for a, b, w in alignment.align_words(logp, 0.02, 0.0, 0.02 * len(tokens), " ".join(said), vocab, 1)]

    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +"), lambda x: x != "")
    p = pieces_once(spark, folder).where("text IS NOT NULL").select("piece_id", w.alias("w")).where(F.size("w") > 0)
    udf = by_row("array<struct<start_s: double, end_s: double, text: string>>")(one)
    return p.select("piece_id", F.posexplode(udf("w")).alias("pos", "w")).select("piece_id", "pos", "w.start_s", "w.end_s", "w.text")


@query("s5_overlapping")
def s5_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings made of the vectors in chunks of two seconds that look one ahead."""
    e = read(spark, folder, "embeddings").withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    waves = e.select(F.col("label").cast("string").alias("recording"), F.lit(64).alias("rate"), F.col("frame").cast("double").alias("from_s"), F.col("embedding").alias("samples"))
    c = audio.overlapping(waves, 2.0, 1.0)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return c.select("recording", "ix", "from_s", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


@query("sql_functions")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """A function of texts called from SQL."""
    from ..functions.arrow import register

    register(spark)
    pieces_once(spark, folder).where("text IS NOT NULL").createOrReplaceTempView("pieces_said")
    return spark.sql("SELECT piece_id, collapse_loops(text) AS text FROM pieces_said")


@query("speech_sessions")
def speech_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each speaker from a stream of turns; a turn of nobody, long after all others, ends the last ones."""
    t = intervals.valid(turns_once(spark, folder)).where(millis("end_s") > millis("start_s"))
    t = t.select("recording", "speaker", F.timestamp_millis(millis("start_s")).alias("ts"), ((millis("end_s") - millis("start_s")) / 1000.0).alias("seconds"))
    end = spark.createDataFrame([("", -1)], "recording string, speaker int").select("recording", "speaker", F.timestamp_millis(F.lit(4 * 10**12)).alias("ts"), F.lit(1.0).alias("seconds"))
    rows = written(t.unionByName(end), "turn-stream")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    got = _run(spark, stateful.speech_sessions(spark.readStream.schema(rows.schema).parquet(path)), "sessions")
    return got.where("speaker >= 0").select("recording", "speaker", F.unix_millis("from_ts").alias("from_ms"), F.unix_millis("to_ts").alias("to_ms"), "n_turns")


@query("t15_glossary_entries", """
WITH e AS (SELECT config_id, unnest(glossary) AS e FROM post_configs)
SELECT config_id, trim(split_part(e, '=', 1)) AS term, count(*) AS n FROM e WHERE trim(split_part(e, '=', 1)) <> '' GROUP BY config_id, term
""")
def t15_glossary_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The terms typed into each configuration."""
    e = read(spark, folder, "post_configs").select("config_id", F.explode("glossary").alias("e"))
    t = F.trim(F.element_at(F.split("e", "="), 1))
    return e.select("config_id", t.alias("term")).where("term <> ''").groupBy("config_id", "term").agg(F.count("*").alias("n"))


from . import answers  # noqa: E402, F401 - adds the SQL that takes a walk
