"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from . import glossary_match, language, mixing, mojibake, nearest_time, packing, repetition, script_form, speaker_turns, speech

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


@query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = language.wrong_labels(read(spark, folder, "documents"), read(spark, folder, "segments"), read(spark, folder, "post_configs"))
    return found.select("src", "row_id", "lang")


_CLOCK = speech._CLOCK
_NAMED = speech._NAME
#: SQL: a label in brackets, or at the head of a line with its mark; groups 1 to 3 and 5 have the number.
_LABEL_SQL = f"\\[\\s*{_NAMED}(\\d+)\\s*\\]|\\(\\s*{_NAMED}(\\d+)\\s*\\)|<v\\s+{_NAMED}(\\d+)\\s*>|(^|[^\\p{{L}}\\p{{N}}]){_NAMED}(\\d+)\\s*(?:>>|:|-|–|—)(?:\\s|$)"
_HES_SQL = "(^|[^\\p{L}\\p{N}''’])(?:" + "|".join(speech.HESITATIONS) + ")($|[^\\p{L}\\p{N}''’])"
_ROUND_SQL = f"\\(\\s*(?:{'|'.join(speech.ROUND_NOTES)})\\s*\\)"
_TIMES_SQL = speech.TIME


def _without(text: str) -> str:
    """SQL: text without times, labels, notes and hesitations."""
    text = f"regexp_replace(regexp_replace({text}, '{_TIMES_SQL}', ' ', 'g'), '(?i){_LABEL_SQL}', '\\4 ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{speech.NOTE}', ' ', 'g'), '(?i){_ROUND_SQL}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({text}, '(?i){_HES_SQL}', '\\1 \\2', 'g'), '(?i){_HES_SQL}', '\\1 \\2', 'g')"


@query("p2_found", f"""
WITH s AS (SELECT DISTINCT seg_id, recording, start_s, speaker, coalesce(text, '') AS text FROM segments),
m AS (SELECT *, regexp_extract(text, '{_CLOCK}') AS clock, regexp_extract(regexp_extract(text, '(?i){_LABEL_SQL}'), '\\d+') AS label FROM s),
k AS (SELECT seg_id, recording, coalesce(speaker, TRY_CAST(nullif(label, '') AS INT)) AS who, regexp_matches({_without('text')}, '[\\p{{L}}\\p{{N}}]') AS said,
  coalesce({ms('start_s')}, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(regexp_extract(clock, '^[\\d:]+'), ':'), lambda x: TRY_CAST(x AS BIGINT))), lambda a, x: a * 60 + x) * 1000 + TRY_CAST(rpad(regexp_extract(clock, '\\d+$'), 3, '0') AS BIGINT)) AS ms_at FROM m),
f AS (SELECT *, last_value(who IGNORE NULLS) OVER (PARTITION BY recording ORDER BY ms_at NULLS FIRST, seg_id ROWS UNBOUNDED PRECEDING) AS speaker FROM k),
r AS (SELECT *, sum(c) OVER (PARTITION BY recording ORDER BY ms_at NULLS FIRST, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN row_number() OVER z = 1 OR lag(speaker) OVER z IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS c FROM f WHERE said WINDOW z AS (PARTITION BY recording ORDER BY ms_at NULLS FIRST, seg_id)))
SELECT recording, speaker, arg_min(seg_id, (coalesce(ms_at, -1), seg_id)) AS first_seg_id, arg_max(seg_id, (coalesce(ms_at, -1), seg_id)) AS last_seg_id FROM r GROUP BY recording, speaker, run
""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    turns = speaker_turns.clean_turns(read(spark, folder, "segments"))
    return turns.select("recording", "speaker", "first_seg_id", "last_seg_id")


@query("p2_turns")
def p2_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The whole clean turns, with their scores."""
    return speaker_turns.clean_turns(read(spark, folder, "segments")).withColumn("score", F.round("score", 6))


@query("p3_found", f"""
WITH w AS (SELECT DISTINCT word_id, recording, speaker, {ms('start_s')} + {ms('end_s')} AS m FROM words WHERE speaker IS NOT NULL),
t AS (SELECT DISTINCT turn_id, recording, speaker, 2 * {ms('start_s')} AS a, 2 * {ms('end_s')} AS b FROM turns WHERE speaker IS NOT NULL),
j AS (SELECT word_id, turn_id, greatest(a - m, m - b, 0) AS d FROM w JOIN t USING (recording, speaker) WHERE b > a AND m IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY d, turn_id) AS r FROM j)
SELECT word_id, turn_id FROM k WHERE r = 1 AND d > 0 AND d <= 2400
""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = nearest_time.nearest_time(spark, f"{folder}/words.parquet", f"{folder}/turns.parquet")
    return pairs.where(F.col("turn_id").isNotNull()).select("word_id", "turn_id")


@query("p3_unmatched", f"""
WITH w AS (SELECT DISTINCT word_id, recording, speaker, {ms('start_s')} + {ms('end_s')} AS m FROM words WHERE speaker IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL),
t AS (SELECT DISTINCT recording, speaker, 2 * {ms('start_s')} AS a, 2 * {ms('end_s')} AS b FROM turns WHERE speaker IS NOT NULL)
SELECT word_id FROM w WHERE word_id NOT IN (SELECT word_id FROM w JOIN t USING (recording, speaker) WHERE b > a AND greatest(a - m, m - b, 0) <= 2400)
""")
def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Words whose speaker has no turn near enough."""
    pairs = nearest_time.nearest_time(spark, f"{folder}/words.parquet", f"{folder}/turns.parquet")
    return pairs.where(F.col("turn_id").isNull()).select("word_id")


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    words = read(spark, folder, "words", ["word_id", "piece_id", "pos", "text"])
    return script_form.variants_found(words, read(spark, folder, "segments", ["seg_id", "text"]))


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled(read(spark, folder, "documents"))


@query("p10_restored")
def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled document with its spans and its restored text."""
    return mojibake.restored(read(spark, folder, "documents")).where("found").select("doc_id", "restored", F.to_json("spans").alias("spans"))


@query("p1_stretches")
def p1_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Each stretch of each text with its language and confidence."""
    rows = language.text_rows(read(spark, folder, "documents"), read(spark, folder, "segments"), read(spark, folder, "post_configs"))
    got = language.languages(rows, stretches=True)
    return got.select("src", "row_id", "stretch", "lang", "words", F.round("confidence", 4).alias("confidence"))


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    got = glossary_match.mapped(read(spark, folder, "segments"), read(spark, folder, "post_configs"), read(spark, folder, "glossary"))
    return got.select("src", "row_id", "entry_pos", "term_id")


@query("p4_unmatched")
def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed entries that mean no term."""
    configs = read(spark, folder, "post_configs")
    got = glossary_match.mapped_entries(configs, read(spark, folder, "glossary")).where("term_id = 0")
    typed = configs.select(F.col("config_id").cast("bigint").alias("row_id"), F.posexplode("glossary").alias("entry_pos", "entry"))
    return got.join(typed, ["row_id", "entry_pos"]).select(F.col("row_id").alias("config_id"), "entry_pos", "entry").distinct()


@query("p5_forms")
def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every word."""
    return script_form.normalized_words(read(spark, folder, "words")).select("word_id", "form", "kinds").distinct()


@query("p6_found", """
-- NFKC is left out: no text of the tables is a case, or none, for it
WITH t AS (SELECT DISTINCT 'piece' AS src, piece_id AS row_id, text FROM pieces WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'segment', seg_id, text FROM segments WHERE text IS NOT NULL),
w AS (SELECT src, row_id, regexp_extract_all(lower(text), '[\\p{L}]+') AS w FROM t),
i AS (SELECT src, row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY src, row_id, w[i], w[i + 1], w[i + 2] ORDER BY i) AS o FROM i),
c AS (SELECT DISTINCT src, row_id, len(w) AS n, unnest([i, i + 1, i + 2]) AS at FROM r WHERE o > 1)
SELECT src, row_id FROM c GROUP BY src, row_id, n HAVING count(*) * 2 >= n
""")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeating(read(spark, folder, "pieces"), read(spark, folder, "segments"))


@query("p6_shares")
def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated content of every text."""
    got = repetition.measured(read(spark, folder, "pieces"), read(spark, folder, "segments"))
    return got.select("src", "row_id", "n_words", "n_repeated", F.round("share", 6).alias("share"), "outlier")


@query("p8_packed")
def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read(spark, folder, "documents"), read(spark, folder, "containers"))


@query("p8_report")
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well each container kind is filled."""
    containers = read(spark, folder, "containers")
    return packing.report(packing.packed(read(spark, folder, "documents"), containers), containers)


@query("p9_mixed")
def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(read(spark, folder, "documents"), read(spark, folder, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source really has in each mix."""
    targets = read(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixed(read(spark, folder, "documents"), targets), targets)
