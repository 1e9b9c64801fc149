"""SQL for queries whose answer takes a walk: recursion over tokens, frames and words."""

from __future__ import annotations

from ..functions.text import EMPHATIC, INVENTED, INVENTED_SHORT, SOUND_RULES
from .queries import DISTINCT_TURNS, FRAMES, GROUPED, PIECES, SEGMENTS, SENTENCES, SMOOTH, RUNS, SQL, WORDS, turns_text

# --- sinks --------------------------------------------------------------------------------------------------------


def clock(t: str) -> str:
    return f"printf('%02d:%02d:%05.2f', CAST(floor({t} / 3600) AS INT), CAST(floor({t} % 3600 / 60) AS INT), {t} % 60)"


SQL["k5_clock"] = f"WITH {SEGMENTS} SELECT seg_id, {clock('start_s')} AS clock FROM s"
LINE = f"'[' || {clock('start_s')} || ' - ' || {clock('end_s')} || '] SPEAKER_' || speaker || CASE WHEN list_contains(flags, 'loop_trimmed') THEN ' ⚠' ELSE '' END || ': ' || text"
SQL["k1_txt"] = f"WITH {SEGMENTS} SELECT seg_id, {LINE} AS line FROM s"
SQL["k3_json"] = f"""WITH {SEGMENTS} SELECT seg_id, CAST(to_json({{'start': start_s, 'end': end_s, 'speaker': speaker, 'text': text, 'flags': flags}}) AS VARCHAR) AS json FROM s"""

# --- sound keys and typography ------------------------------------------------------------------------------------


def phonetic(t: str) -> str:
    """SQL: the sound key of a text."""
    t = f"regexp_replace(strip_accents(lower({t})), '[^\\p{{L}}]', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, 'c([eiy])', 's\\1', 'g'), 'g([ei])', 'j\\1', 'g')"
    for a, b in SOUND_RULES:
        t = f"replace({t}, '{a}', '{b}')"
    once = f"list_reduce(list_prepend('', string_split({t}, '')), lambda a, x: CASE WHEN right(a, 1) = x THEN a ELSE a || x END)"
    return f"regexp_replace({once}, '[stdxe]$', '')"


SQL["t2_phonetic"] = f"SELECT term_id, {phonetic('term')} AS key FROM glossary"

W = "\\p{L}\\p{N}_"
SQL["t11_typography"] = f"""
WITH s AS (SELECT DISTINCT seg_id, text AS t FROM segments WHERE text IS NOT NULL),
a AS (SELECT seg_id, regexp_replace(regexp_replace(t, '([{W}])''([{W}])', '\\1’\\2', 'g'), '([{W}])''([{W}])', '\\1’\\2', 'g') AS t FROM s),
b AS (SELECT seg_id, regexp_replace(replace(t, '...', '…'), '[\\s\\p{{Z}}]*([;!?]+)', chr(8239) || '\\1', 'g') AS t FROM a),
-- colons before a digit, and right after one, stay; of white space after a digit the first character stays
c AS (SELECT seg_id, regexp_replace(regexp_replace(t, ':(\\p{{Nd}})', chr(57345) || '\\1', 'g'), '(\\p{{Nd}}):', '\\1' || chr(57345), 'g') AS t FROM b),
d AS (SELECT seg_id, regexp_replace(regexp_replace(t, '(\\p{{Nd}}[\\s\\p{{Z}}])[\\s\\p{{Z}}]*:', '\\1' || chr(57346), 'g'), '[\\s\\p{{Z}}]*:', chr(160) || ':', 'g') AS t FROM c),
e AS (SELECT seg_id, replace(replace(t, chr(57345), ':'), chr(57346), chr(160) || ':') AS t FROM d),
f AS (SELECT seg_id, regexp_replace(regexp_replace(t, '«[\\s\\p{{Z}}]*', '«' || chr(160), 'g'), '[\\s\\p{{Z}}]*»', chr(160) || '»', 'g') AS t FROM e),
g AS (SELECT seg_id, regexp_replace(regexp_replace(t, '(^|[^{W}])1[èe]re(s?)([^{W}]|$)', '\\11re\\2\\3', 'g'), '(^|[^{W}])(\\p{{Nd}}+)(?:[èe]me|ième)(s?)([^{W}]|$)', '\\1\\2e\\3\\4', 'g') AS t FROM f),
h AS (SELECT seg_id, string_split(regexp_replace(t, '([.!?…])[\\s\\p{{Z}}]+([a-zà-ÿ])', '\\1 ' || chr(57347) || '\\2', 'g'), chr(57347)) AS p FROM g)
SELECT seg_id, regexp_replace(array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), ''), '^[' || chr(8239) || chr(160) || ']+', '') AS text FROM h
"""

# --- loops --------------------------------------------------------------------------------------------------------

SQL["l1_periodic_suffix"] = f"""
WITH {PIECES}, z AS (SELECT piece_id, {turns_text()} AS w FROM p WHERE text IS NOT NULL),
q AS (SELECT piece_id, w, len(w) AS n, unnest(range(1, least(64, len(w) // 2) + 1)) AS period FROM z),
r AS (SELECT piece_id, period, 1 + coalesce(nullif(list_position(list_transform(range(0, n - period), lambda k: w[n - k] = w[n - k - period]), false), 0) - 1, n - period) // period AS repeats FROM q),
f AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY period) AS o FROM r WHERE CASE WHEN period <= 4 THEN repeats >= 10 ELSE repeats >= 3 AND repeats * period >= 30 END)
SELECT piece_id, CAST(period AS INT) AS period, CAST(repeats AS INT) AS repeats FROM f WHERE o = 1
"""


def runs(source: str, prefix: str, longest: int = 30) -> str:
    """SQL: how often the n words at each place i of the lists w of ``source`` (key k) follow each other: k, i, n, copies."""
    x = prefix
    return f"""
{x}c AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM {source}),
{x}n AS (SELECT k, w, i, unnest(range(1, least({longest}, len(w) // 2) + 1)) AS n FROM {x}c),
{x}e AS (SELECT k, i, n, w[i] = w[i + n] AS same, len(w) AS l FROM {x}n WHERE i + n <= len(w)),
{x}b AS (SELECT *, min(CASE WHEN NOT same THEN i END) OVER (PARTITION BY k, n ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM {x}e),
{x}r AS (SELECT k, i, n, 1 + (coalesce(stop, l - n + 1) - i) // n AS copies FROM {x}b)
"""


def collapsed(source: str) -> str:
    """SQL: col(k, t): the text t of ``source`` (key k) with repeated n-grams once. Needs WITH RECURSIVE."""
    return f"""
ct AS MATERIALIZED (SELECT k, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS t FROM {source}),
ck AS (SELECT k, list_transform(t, lambda x: coalesce(nullif(array_to_string(regexp_extract_all(lower(x), '[\\p{{L}}]+'), ' '), ''), x)) AS w FROM ct),
{runs('ck', 'c')},
ch AS MATERIALIZED (SELECT k, i, min(n) AS n, arg_min(copies, n) AS copies FROM cr WHERE copies > CASE WHEN n <= 2 THEN 2 ELSE 1 END GROUP BY k, i),
cw AS (SELECT k, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept FROM ct
  UNION ALL SELECT cw.k, cw.i + coalesce(ch.copies * ch.n, 1), list_concat(kept, CASE WHEN ch.n IS NULL THEN [t[cw.i]] ELSE t[cw.i:cw.i + ch.n * CASE WHEN ch.n <= 2 THEN 2 ELSE 1 END - 1] END)
  FROM cw JOIN ct ON ct.k = cw.k LEFT JOIN ch ON ch.k = cw.k AND ch.i = cw.i WHERE cw.i <= len(t)),
col AS (SELECT cw.k, array_to_string(kept, ' ') AS t FROM cw JOIN ct ON ct.k = cw.k WHERE cw.i > len(ct.t))
"""


SQL["l7_collapse"] = f"WITH RECURSIVE {PIECES}, ps AS (SELECT piece_id AS k, text AS t FROM p WHERE text IS NOT NULL), {collapsed('ps')} SELECT k AS piece_id, t AS text FROM col"

#: SQL: the attempts of spans, as the queries make them.
ATTEMPTS = """
g AS (SELECT recording, span_id, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(text, ' ' ORDER BY piece_ix) AS t FROM p WHERE text IS NOT NULL GROUP BY recording, span_id),
a AS (SELECT *, t AS text, 0 AS rung FROM g UNION ALL SELECT *, substring(t, 1, CAST(floor(length(t) / 2) AS INT)), 1 FROM g UNION ALL SELECT *, t || ' ' || t, 2 FROM g)
"""
SQL["l6_issues"] = f"""
WITH {PIECES}, {ATTEMPTS}, z AS (SELECT (recording, span_id, rung) AS k, {turns_text()} AS w FROM a), {runs('z', 'x')},
h AS (SELECT k, i, n, copies, row_number() OVER (PARTITION BY k ORDER BY i, n) AS o FROM xr WHERE copies >= CASE WHEN n <= 2 THEN 6 ELSE 3 END)
SELECT recording, span_id, rung, array_to_string(list_filter([CASE WHEN rung = 1 AND span_id % 7 = 0 THEN 'stopped: token loop' END, CASE WHEN rung = 0 AND length(text) > 600 THEN 'max_new_tokens reached' END,
  CASE WHEN len(z.w) > 6.0 * (end_s - start_s) + 8 THEN printf('%.1f words/s', len(z.w) / greatest(end_s - start_s, 0.1)) END, CASE WHEN h.n IS NOT NULL THEN 'repeated ' || h.n || '-gram x' || h.copies END], lambda x: x IS NOT NULL), '; ') AS issues
FROM a JOIN z ON z.k = (recording, span_id, rung) LEFT JOIN h ON h.k = z.k AND h.o = 1
"""
#: SQL: pieces of a span as attempts, their flags as issues.
STORED = f"{PIECES}, a AS (SELECT recording, span_id, start_s, end_s, piece_ix AS rung, text, coalesce(flags, []) AS issues FROM p WHERE text IS NOT NULL)"
SQL["j6_stored"] = f"WITH {STORED} SELECT recording, span_id FROM a GROUP BY recording, span_id HAVING NOT bool_or(rung <= 0 AND len(issues) = 0)"
SQL["l8_stored"] = f"""
WITH RECURSIVE {STORED}, r AS (SELECT *, row_number() OVER (PARTITION BY recording, span_id ORDER BY len(issues) > 0, len(issues), CASE WHEN len(issues) > 0 THEN length(text) ELSE 0 END, rung) AS o FROM a WHERE end_s - start_s >= 0.2),
best AS (SELECT * FROM r WHERE o = 1), bad AS (SELECT (recording, span_id) AS k, text AS t FROM best WHERE len(issues) > 0), {collapsed('bad')}
SELECT recording, span_id, rung, CASE WHEN col.k IS NULL THEN text ELSE array_to_string(list_filter(regexp_split_to_array(col.t, '\\s+'), lambda x: x <> '')[1:CAST(floor(greatest(end_s - start_s, 1.0) * 6.0) AS INT) + 5], ' ') END AS text,
  array_to_string(CASE WHEN len(issues) > 0 THEN list_concat(['loop_trimmed'], issues) WHEN rung > 0 THEN ['retry'] ELSE [] END, '; ') AS flags
FROM best LEFT JOIN col ON col.k = (recording, span_id)
"""
SQL["l5_watch_loops"] = f"""
WITH {PIECES}, z AS (SELECT recording, piece_id, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM p WHERE text IS NOT NULL),
c AS (SELECT piece_id, w, unnest(range(1, len(w) + 1)) AS i FROM z),
n AS (SELECT piece_id, w, i, unnest(range(1, least(64, i // 2) + 1)) AS p FROM c),
u AS (SELECT piece_id, p, i, w[i] = w[i - p] AS same FROM (SELECT piece_id, w, i, unnest(range(1, least(64, i - 1) + 1)) AS p FROM c)),
v AS (SELECT piece_id, p, i, i - coalesce(max(CASE WHEN NOT same THEN i END) OVER (PARTITION BY piece_id, p ORDER BY i ROWS UNBOUNDED PRECEDING), p) AS run FROM u),
tok AS (SELECT piece_id, i, p, 1 + run // p AS x FROM v WHERE i >= 16 AND p <= i // 2 AND CASE WHEN p <= 4 THEN 1 + run // p >= 10 ELSE 1 + run // p >= 3 AND (1 + run // p) * p >= 30 END),
f AS (SELECT piece_id, i, list_filter(w[1:i], lambda x: x <> '') AS s FROM c WHERE i >= 16 AND i % 8 = 0),
g AS (SELECT piece_id, i, s, len(s) AS l, unnest(range(1, least(40, len(s) // 2) + 1)) AS p FROM f),
h AS (SELECT piece_id, i, p, 1 + coalesce(nullif(list_position(list_transform(range(0, l - p), lambda k: s[l - k] = s[l - k - p]), false), 0) - 1, l - p) // p AS x FROM g),
txt AS (SELECT piece_id, i, p, x FROM h WHERE CASE WHEN p <= 3 THEN x >= 6 ELSE x >= 3 AND x * p >= 30 END),
b AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY i, kind, p) AS o FROM (SELECT *, 0 AS kind FROM tok UNION ALL SELECT *, 1 FROM txt))
SELECT recording, piece_id AS span_id, CAST(i AS INT) AS generated, CASE WHEN kind = 0 THEN 'token loop (period=' || p || ', x' || x || ')' ELSE 'text loop (period=' || p || ' words, x' || x || ')' END AS reason
FROM b JOIN z USING (piece_id) WHERE o = 1
"""

# --- frames -------------------------------------------------------------------------------------------------------

#: SQL: log probabilities of frames, and tokens of spans.
LOGP = f"""
{FRAMES}, lm AS (SELECT *, list_max(embedding)::DOUBLE AS top FROM e),
lp AS (SELECT span_id, frame, list_transform(embedding, lambda x: x::DOUBLE - (top + ln(list_sum(list_transform(embedding, lambda y: exp(y::DOUBLE - top)))))) AS lp FROM lm),
sp AS (SELECT span_id, count(*) AS t, list_transform(range(1, greatest(1, CAST(floor(count(*) / 3) AS BIGINT)) + 1), lambda i: (i * 7 + span_id) % 63 + 1) AS tok FROM lp GROUP BY span_id),
tr AS (SELECT span_id, CAST(0 AS BIGINT) AS frame, list_prepend(0.0::DOUBLE, list_transform(tok, lambda x: '-inf'::DOUBLE)) AS b FROM sp
  UNION ALL SELECT tr.span_id, tr.frame + 1, list_prepend(b[1] + lp[1], list_transform(tok, lambda x, j: greatest(b[j + 1] + greatest(lp[x + 1], lp[1]), b[j] + lp[x + 1])))
  FROM tr JOIN lp ON lp.span_id = tr.span_id AND lp.frame = tr.frame JOIN sp ON sp.span_id = tr.span_id)
"""
SQL["c3_path_score"] = f"WITH RECURSIVE {LOGP} SELECT CAST(sp.span_id AS BIGINT) AS span_id, round(b[-1], 4) AS score FROM tr JOIN sp ON sp.span_id = tr.span_id AND sp.t = tr.frame"
SQL["c4_align_tokens"] = f"""
WITH RECURSIVE {LOGP},
st AS (SELECT tr.span_id, tr.frame, b, lp, tok FROM tr JOIN lp ON lp.span_id = tr.span_id AND lp.frame = tr.frame JOIN sp ON sp.span_id = tr.span_id),
bt AS (SELECT span_id, t - 1 AS frame, CAST(len(tok) AS BIGINT) AS j FROM sp
  UNION ALL SELECT bt.span_id, bt.frame - 1, j - CASE WHEN b[j] + lp[tok[j] + 1] > b[j + 1] + greatest(lp[tok[j] + 1], lp[1]) THEN 1 ELSE 0 END FROM bt JOIN st ON st.span_id = bt.span_id AND st.frame = bt.frame WHERE j > 0 AND bt.frame >= 0)
SELECT CAST(bt.span_id AS BIGINT) AS span_id, CAST(j - 1 AS INT) AS token_ix, CAST(min(bt.frame) AS INT) AS first, CAST(max(bt.frame) AS INT) AS last FROM bt JOIN st ON st.span_id = bt.span_id AND st.frame = bt.frame
WHERE j > 0 AND (b[j] + lp[tok[j] + 1] > b[j + 1] + greatest(lp[tok[j] + 1], lp[1]) OR lp[tok[j] + 1] > lp[1]) GROUP BY bt.span_id, j
"""
SQL["s5_chunked_turns"] = f"""
WITH {FRAMES}, a AS (SELECT span_id, frame, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s FROM e),
b AS (SELECT *, s / n > sum(s) OVER z / sum(n) OVER z AS loud FROM a WINDOW z AS (PARTITION BY span_id ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT CAST(span_id AS VARCHAR) AS recording, CAST(frame AS DOUBLE) AS start_s, frame + n / 64.0 AS end_s, CAST(loud AS INT) AS speaker FROM b
"""
SQL["m4_best_cut"] = f"""
WITH RECURSIVE {FRAMES}, w AS (SELECT span_id, count(*)::DOUBLE AS e, flatten(list(embedding ORDER BY frame)) AS x FROM e GROUP BY span_id),
k AS (SELECT span_id, CAST(0 AS BIGINT) AS part, 0.0::DOUBLE AS a, CASE WHEN e > 20.0 THEN NULL ELSE e END AS b FROM w
  UNION ALL SELECT span_id, part + 1, cut, CASE WHEN e - cut > 20.0 THEN NULL ELSE e END FROM (
    SELECT k.span_id, part, e, CASE WHEN len(r) < 2 THEN a + 17.0 ELSE greatest(a + 1.0, a + 14.0) + (list_position(r, list_min(r)) - 1 + 0.5) * 0.05 END AS cut FROM (
      SELECT k.span_id, k.part, k.a, w.e, list_transform(range(0, len(y) // 3), lambda i: sqrt((y[i * 3 + 1]::DOUBLE ** 2 + y[i * 3 + 2]::DOUBLE ** 2 + y[i * 3 + 3]::DOUBLE ** 2) / 3)) AS r FROM (
        SELECT *, x[CAST(floor(greatest(a + 1.0, a + 14.0) * 64) AS BIGINT) + 1:CAST(floor(least(e - 1.0, a + 20.0) * 64) AS BIGINT)] AS y FROM (SELECT k.span_id, part, a, e, x FROM k JOIN w ON w.span_id = k.span_id WHERE b IS NULL) k) k JOIN w ON w.span_id = k.span_id) k)),
c AS (SELECT span_id, part, a, coalesce(b, lead(a) OVER (PARTITION BY span_id ORDER BY part)) AS b FROM k)
SELECT CAST(span_id AS VARCHAR) AS recording, CAST(0 AS BIGINT) AS span_id, CAST(part AS INT) AS part, round(a, 6) AS start_s, round(b, 6) AS end_s FROM c
"""

# --- cleaning, whole pipelines ------------------------------------------------------------------------------------


def cleaned(source: str, duration: str | None) -> str:
    """SQL: the rows of ``source`` whose text survives cleaning, as t (scripts aren't looked at)."""
    ws = "[\\s\\x0b\\x85\\p{Z}]"
    quoted = lambda words: ", ".join(f"'{x}'" for x in words)
    short = f" OR ({duration} < 1.0 AND key IN ({quoted(INVENTED_SHORT)}))" if duration else ""
    return f"""(SELECT * FROM (SELECT *, array_to_string(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), ' ') AS key FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\[[^\\]]{{0,40}}\\]', ' ', 'g'), '{ws}{{2,}}', ' ', 'g'), '^{ws}+', ''), '{ws}+$', '') AS t FROM {source}))
  WHERE NOT coalesce(t = '' OR key IN ({quoted(INVENTED)}){short}, false))"""


FLAGS = "array_to_string(list_sort(list_distinct(coalesce(flags, []))), '|')"
SQL["pipeline_turns"] = f"""
WITH s AS (SELECT DISTINCT seg_id, recording, start_s, end_s, speaker, text, flags FROM segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND speaker IS NOT NULL),
c AS {cleaned('s', 'end_s - start_s')},
f AS (SELECT recording, speaker, row_number() OVER (PARTITION BY recording ORDER BY min((start_s, seg_id)), speaker) - 1 AS label FROM c GROUP BY recording, speaker)
SELECT c.recording, c.speaker, CAST(label AS INT) AS label, start_s, end_s, t AS text, {FLAGS} AS flags FROM c JOIN f ON f.recording = c.recording AND f.speaker = c.speaker
"""


def _speech_turns() -> str:
    """SQL: mt, the turns of speech: phantoms out, merged, micro turns out."""
    from .queries import MERGED, ms

    return f"""{DISTINCT_TURNS}, ph AS (SELECT recording, speaker FROM d WHERE speaker IS NOT NULL GROUP BY recording, speaker HAVING sum({ms('end_s')} - {ms('start_s')}) >= 2000),
v AS (SELECT d.* FROM d JOIN ph USING (recording, speaker) WHERE start_s IS NOT NULL AND end_s > start_s), {MERGED}, mt AS (SELECT * FROM m WHERE end_s - start_s >= 0.15)"""


def attributed(words: str) -> str:
    """SQL: sg, the segments of the timed ``words`` (with piece_id and flags) by the turns mt: speakers, sentences, groups,
    cleaning and labels."""
    from .queries import SPEAKER_AT

    who = SPEAKER_AT.replace("FROM v)", "FROM mt)").replace("FROM words WHERE", f"FROM {words} WHERE")
    return f"""{who},
w AS (SELECT pw.word_id, pw.recording, pw.piece_id, pw.pos, pw.start_s, pw.end_s, pw.text, who.speaker, pw.flags FROM {words} pw JOIN who USING (word_id)), {SENTENCES}, {RUNS}, {SMOOTH},
gw AS (SELECT word_id, recording, start_s, end_s, text, flags, smoothed AS speaker FROM sm), {GROUPED[GROUPED.index('gb AS'):]},
sg0 AS (SELECT recording, speaker, min(start_s) AS start_s, arg_max(end_s, (start_s, word_id)) AS end_s, string_agg(text, ' ' ORDER BY start_s, word_id) AS text, flatten(list(coalesce(flags, []))) AS flags, arg_min(word_id, (start_s, word_id)) AS first_word
  FROM gi GROUP BY recording, speaker, k),
sg1 AS {cleaned('sg0', 'end_s - start_s')},
sl AS (SELECT recording, speaker, row_number() OVER (PARTITION BY recording ORDER BY min((start_s, first_word)), speaker) - 1 AS label FROM sg1 WHERE speaker IS NOT NULL GROUP BY recording, speaker),
sg AS (SELECT sg1.recording, sg1.speaker, CAST(label AS INT) AS label, start_s, end_s, t AS text, {FLAGS} AS flags FROM sg1 LEFT JOIN sl ON sl.recording = sg1.recording AND sl.speaker = sg1.speaker)"""


SQL["pipeline_window"] = f"""
WITH {_speech_turns()}, {PIECES}, pc AS {cleaned('p', None)},
pw AS (SELECT DISTINCT w.word_id, pc.recording, w.piece_id, w.pos, w.start_s, w.end_s, w.text, pc.flags FROM words w JOIN pc ON pc.piece_id = w.piece_id),
{attributed('pw')} SELECT * FROM sg
"""

# --- metrics and style --------------------------------------------------------------------------------------------


def distances(pairs: str) -> str:
    """SQL: wd(k, edits): the word edit distance of the word lists x and y of ``pairs`` (key k). Needs WITH RECURSIVE."""
    row = "list_prepend(i + 1, list_transform(y, lambda v, j: least(r[j + 1] + 1, r[j] + CASE WHEN v = x[i + 1] THEN 0 ELSE 1 END)))"
    return f"""
wp AS MATERIALIZED (SELECT * FROM {pairs}),
wr AS (SELECT k, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(y) + 1), lambda v: CAST(v AS BIGINT)) AS r FROM wp
  UNION ALL SELECT k, i + 1, list_reduce(list_transform(p, lambda v: [v]), lambda a, v: list_append(a, least(a[-1] + 1, v[1]))) FROM (SELECT wr.k, i, {row} AS p FROM wr JOIN wp ON wp.k = wr.k WHERE i < len(x))),
wd AS (SELECT wr.k, r[-1] AS edits FROM wr JOIN wp ON wp.k = wr.k WHERE i = len(x))
"""


def plain_words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[{W}]+')"


SQL["e1_word_distance"] = f"""
WITH RECURSIVE {PIECES}, {ATTEMPTS}, pe AS (SELECT (recording, span_id) AS k, text AS t FROM a WHERE rung = 0), {collapsed('pe')},
pr AS (SELECT k, {plain_words('pe.t')} AS x, {plain_words('col.t')} AS y FROM pe JOIN col USING (k)), {distances('pr')}
SELECT k[1] AS recording, k[2] AS span_id, CAST(edits AS INT) AS edits, CAST(greatest(len(x), len(y)) AS INT) AS longest, CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE round(edits / greatest(len(x), len(y)), 6) END AS gap FROM wd JOIN pr USING (k)
"""
SQL["e2_agreement_words"] = f"""
WITH RECURSIVE {PIECES}, {ATTEMPTS}, pr AS (SELECT (a.recording, a.span_id, a.rung, b.rung) AS k, {plain_words('a.text')} AS x, {plain_words('b.text')} AS y FROM a JOIN a b ON b.recording = a.recording AND b.span_id = a.span_id AND a.rung < b.rung), {distances('pr')}
SELECT 'rung' || k[3] AS system_a, 'rung' || k[4] AS system_b, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(greatest(len(x), len(y))) AS BIGINT) AS words, round(sum(edits) / sum(greatest(len(x), len(y))), 6) AS gap FROM wd JOIN pr USING (k) GROUP BY k[3], k[4]
"""
HESITATION = "euh+|heu+|hum+|hm+|mmh*|mm-hmm|hmm+"
WJ = "\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{200C}\\x{200D}"


def counted(words: str) -> str:
    """SQL: how often one of ``words`` stands by itself in text."""
    return f"len(regexp_extract_all(' ' || regexp_replace(coalesce(text, ''), '[^{WJ}]+', '  ', 'g') || ' ', '(?i) (?:{words}) '))"


SQL["e3_kept_style"] = f"""
WITH s AS (SELECT DISTINCT seg_id, config_id, text FROM segments)
SELECT config_id, count(*) AS segments, CAST(sum({counted('euh+|heu+|hum+|hm+|mmh*|hmm+')}) AS BIGINT) AS hesitations, round(avg(CAST(regexp_matches(coalesce(text, ''), '^\\p{{Lu}}') AS INT)), 6) AS capital_share,
  CAST(sum({counted('réunion')} + {counted('budget')}) AS BIGINT) AS term_hits FROM s GROUP BY config_id
"""
PARTED = f"(^|[^{W}])(?:{HESITATION})($|[^{W}])"
SQL["t8_read_style"] = f"""
WITH RECURSIVE s AS (SELECT DISTINCT seg_id, text FROM segments WHERE text IS NOT NULL),
m AS (SELECT *, regexp_replace(regexp_replace(text, '(?i){PARTED}', '\\1' || chr(57345) || '\\2', 'g'), '(?i){PARTED}', '\\1' || chr(57345) || '\\2', 'g') AS x FROM s),
t AS MATERIALIZED (SELECT seg_id, text, len(regexp_extract_all(x, chr(57345))) AS fillers, list_filter(regexp_split_to_array(regexp_replace(x, chr(57345) || '[,.…]*[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]*', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda v: v <> '') AS w FROM m),
k AS MATERIALIZED (SELECT seg_id, list_transform(w, lambda v: trim(lower(v), ',')) AS k FROM t),
f AS MATERIALIZED (SELECT seg_id, k, list_transform(k, lambda v: v NOT IN ({', '.join(f"'{x.replace(chr(39), chr(39) * 2)}'" for x in sorted(EMPHATIC))}) AND regexp_full_match(v, '[\\p{{L}}\\p{{Nl}}\\p{{No}}][{W}''’-]*')) AS fit FROM k),
r AS (SELECT seg_id, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept, 0 AS n FROM t
  UNION ALL SELECT seg_id, i + greatest(step, 1), CASE WHEN step > 0 THEN kept ELSE list_append(kept, v) END, n + CASE WHEN step > 0 THEN 1 ELSE 0 END FROM (
    SELECT r.*, w[i] AS v, CASE WHEN i + 3 <= len(w) AND fit[i] AND fit[i + 1] AND k[i] = k[i + 2] AND k[i + 1] = k[i + 3] THEN 2 WHEN i + 1 <= len(w) AND fit[i] AND k[i] = k[i + 1] THEN 1 ELSE 0 END AS step
    FROM r JOIN t ON t.seg_id = r.seg_id JOIN f ON f.seg_id = r.seg_id WHERE i <= len(w))),
e AS (SELECT r.seg_id, t.text, fillers, n, regexp_replace(regexp_replace(regexp_replace(array_to_string(kept, ' '), '^[\\s,;.…]+', ''), '\\s+([,.])', '\\1', 'g'), ',\\s*,', ',', 'g') AS x FROM r JOIN t ON t.seg_id = r.seg_id WHERE i > len(w))
SELECT seg_id, CASE WHEN regexp_matches(text, '^\\p{{Lu}}') THEN upper(x[1]) || x[2:] ELSE x END AS text, CAST(fillers AS INT) AS fillers, CAST(n AS INT) AS stutters FROM e
"""

# --- batches and files --------------------------------------------------------------------------------------------

SQL["o2_batches"] = f"""
WITH {PIECES}, r AS (SELECT piece_id, part, row_number() OVER (PARTITION BY part ORDER BY end_s - start_s DESC, recording, piece_id) - 1 AS o FROM p JOIN (SELECT DISTINCT piece_id, abs(piece_id) % 64 AS part FROM pieces) USING (piece_id))
SELECT piece_id, part || '-' || o // 16 AS batch FROM r
"""
SQL["k4_files"] = f"""
WITH {SEGMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start_s, end_s, seg_id) AS i, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS a, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS b FROM s),
srt AS (SELECT *, i || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || '[SPEAKER_' || speaker || '] ' || text || chr(10) AS block FROM o)
SELECT recording, 'txt' AS format, string_agg({LINE}, chr(10) ORDER BY i) || chr(10) AS content FROM o GROUP BY recording
UNION ALL SELECT recording, 'srt', string_agg(block, chr(10) ORDER BY i) FROM srt GROUP BY recording
"""

# --- from turns to segments ---------------------------------------------------------------------------------------


def climbed() -> str:
    """SQL: pcs, the pieces of the windows: three depths of spans, halved in the middle where more than sixty words are said."""
    said = "string_agg(translate(substring(md5(CAST(word_id AS VARCHAR)), 1, 8), '0123456789', 'ghijklmnop'), ' ' ORDER BY start_s, word_id)"
    counts = lambda k: f"""
n{k} AS (SELECT l.recording, l.span_id, l.a, l.b, count(t.word_id) AS n FROM l{k} l LEFT JOIN tw t ON t.recording = l.recording AND t.mid >= l.a AND t.mid < l.b GROUP BY l.recording, l.span_id, l.a, l.b),
x{k} AS (SELECT *, n > 60 AND b - a >= 4.0 AND {k} < 2 AS halved FROM n{k})"""  # noqa: E731
    half = lambda k: f"""
l{k} AS (SELECT recording, span_id, a, (a + b) / 2 AS b FROM x{k - 1} WHERE halved UNION ALL SELECT recording, span_id, (a + b) / 2, b FROM x{k - 1} WHERE halved)"""  # noqa: E731
    return f"""
tw AS (SELECT DISTINCT word_id, recording, start_s, (start_s + end_s) / 2 AS mid FROM words WHERE start_s IS NOT NULL AND end_s IS NOT NULL),
l0 AS (SELECT recording, window_ix AS span_id, greatest(0, start_s - 0.15) AS a, end_s + 0.15 AS b FROM w WHERE end_s + 0.15 - greatest(0, start_s - 0.15) >= 0.2), {counts(0)}, {half(1)}, {counts(1)}, {half(2)}, {counts(2)},
xx AS (SELECT * FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) WHERE NOT halved),
st AS (SELECT xx.recording, xx.span_id, xx.a, xx.b, xx.n, {said} AS t FROM xx LEFT JOIN tw ON tw.recording = xx.recording AND tw.mid >= xx.a AND tw.mid < xx.b GROUP BY xx.recording, xx.span_id, xx.a, xx.b, xx.n),
pcs AS (SELECT recording, span_id, CAST(row_number() OVER (PARTITION BY recording, span_id ORDER BY a) - 1 AS INT) AS piece_ix, a AS start_s, b AS end_s,
  CASE WHEN n > 60 THEN array_to_string(string_split(t || ' encore encore', ' ')[1:CAST(floor(greatest(b - a, 1.0) * 6.0) AS INT) + 5], ' ') ELSE coalesce(t, '') END AS text, CASE WHEN n > 60 THEN ['loop_trimmed'] WHEN n > 40 THEN ['retry'] ELSE [] END AS flags FROM st)"""


def _windows() -> str:
    from .queries import WINDOWS

    return f"{_speech_turns()}, {WINDOWS}, {climbed()}"


SQL["pipeline_pieces"] = f"WITH RECURSIVE {_windows()} SELECT recording, span_id, piece_ix, start_s, end_s, text, array_to_string(flags, '|') AS flags FROM pcs"
# The windows' names of steps give way to those of the words.
_PIECES_OF_WINDOWS = f"pcs AS MATERIALIZED (WITH RECURSIVE {_windows()} SELECT * FROM pcs)"
SQL["pipeline_full"] = f"""
WITH {_PIECES_OF_WINDOWS}, {_speech_turns()}, pn AS (SELECT *, row_number() OVER (ORDER BY recording, span_id, piece_ix) AS piece_id FROM pcs), pc AS {cleaned('pn', None)},
ws AS (SELECT recording, piece_id, start_s, end_s, flags, string_split(t, ' ') AS toks FROM pc),
wu AS (SELECT *, unnest(range(len(toks))) AS pos FROM ws),
pw AS (SELECT row_number() OVER (ORDER BY piece_id, pos) AS word_id, recording, piece_id, pos, start_s + pos * ((end_s - start_s) / len(toks)) AS start_s, start_s + (pos + 1) * ((end_s - start_s) / len(toks)) AS end_s, toks[pos + 1] AS text, flags FROM wu),
{attributed('pw')} SELECT * FROM sg
"""

# --- names, timed words, chunks, sessions -------------------------------------------------------------------------

SQL["t4_heard_terms"] = f"""
WITH s AS (SELECT DISTINCT seg_id, text FROM segments WHERE text IS NOT NULL), w AS (SELECT DISTINCT unnest({turns_text()}) AS word FROM s), wk AS (SELECT word, {phonetic('word')} AS k FROM w),
t AS (SELECT DISTINCT term, {phonetic('term')} AS k FROM glossary WHERE NOT regexp_matches(term, '\\s'))
SELECT word, term FROM wk JOIN t ON wk.k <> '' AND length(t.k) >= 4 AND wk.k[1] = t.k[1] AND 1 - levenshtein(wk.k, t.k) / greatest(length(wk.k), length(t.k)) >= 0.75 AND word <> lower(term)
"""
SQL["c6_known_words"] = f"""
WITH {PIECES}, w AS (SELECT piece_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM p WHERE text IS NOT NULL),
u AS (SELECT piece_id, w, unnest(range(len(w))) AS pos FROM w),
o AS (SELECT piece_id, pos, w[pos + 1] AS text, pos + coalesce(sum(length(w[pos + 1])) OVER (PARTITION BY piece_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM u)
SELECT piece_id, CAST(pos AS INT) AS pos, round(CAST(begins AS DOUBLE) * 0.02::DOUBLE, 6) AS start_s, round(CAST(begins + length(text) AS DOUBLE) * 0.02::DOUBLE, 6) AS end_s, text FROM o
"""
SQL["s5_overlapping"] = f"""
WITH {FRAMES}, w AS (SELECT span_id, count(*) AS f, flatten(list(embedding ORDER BY frame)) AS x FROM e GROUP BY span_id), c AS (SELECT *, unnest(range(CAST(ceil(f / 2) AS BIGINT))) AS ix FROM w)
SELECT CAST(span_id AS VARCHAR) AS recording, CAST(ix AS INT) AS ix, ix * 2.0::DOUBLE AS from_s, CAST(len(x[ix * 128 + 1:ix * 128 + 192]) AS INT) AS n, round(list_sum(list_transform(x[ix * 128 + 1:ix * 128 + 192], lambda v: v::DOUBLE)), 4) AS total FROM c
"""
SQL["sql_functions"] = SQL["l7_collapse"]


def _sessions() -> str:
    from .queries import TURNS

    return f"""
WITH {TURNS}, v AS (SELECT * FROM t WHERE speaker IS NOT NULL AND b > a),
w AS (SELECT *, max(b) OVER (PARTITION BY recording, speaker ORDER BY a, b, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, speaker ORDER BY a, b, turn_id ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT recording, speaker, min(a) AS from_ms, max(b) AS to_ms, count(*) AS n_turns FROM i GROUP BY recording, speaker, k"""


SQL["speech_sessions"] = _sessions()
