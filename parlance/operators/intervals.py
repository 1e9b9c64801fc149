"""Interval operators on speaker turns and spans: filters, merging, windows, attribution, relabelling, grouping.

Times are seconds, as stored. Every operator takes rows in an explicit order (start, then end, then ``ord`` or an id)
and works on recordings of any size: running state goes from bucket to bucket of a recording's time line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import millis
from .scans import BUCKET, carry, local

#: Seconds of a bucket of the time line.
BUCKET_S = 900.0


def by_time(df: DataFrame, column: str = "start_s") -> DataFrame:
    """Add the bucket of a time in seconds; rows without a time come first."""
    t = F.when(F.col(column).isNotNull() & ~F.isnan(column), F.floor(F.col(column) / BUCKET_S))
    return df.withColumn(BUCKET, F.coalesce(t, F.lit(-(2**62)).cast("bigint")))


def cut_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], fresh: Column, aggs: dict[str, Column]) -> DataFrame:
    """keys, _first and ``aggs`` of the rows from each fresh row up to the next, in parts: one for each bucket that they
    reach into. _first is the fresh row's order; a part before the first fresh row of its bucket takes that of the
    buckets before. Only the parts are written, which are as few as what comes out."""
    x = df.withColumn("_seg", F.sum(fresh.cast("int")).over(local(keys, *order).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col("_seg") > 0, F.min(F.struct(*order)))
    parts = x.groupBy(*keys, BUCKET, "_seg").agg(at.alias("_at"), *[c.alias(n) for n, c in aggs.items()])
    parts = carry(parts, keys, {"_c": (F.max("_at"), "last")}, cut=True)
    return parts.withColumn("_first", F.coalesce("_at", "_c")).drop("_at", "_c", "_seg", BUCKET)


def valid(turns: DataFrame) -> DataFrame:
    """Turns that have start, end and speaker and end after they start."""
    return turns.where(F.col("start_s").isNotNull() & F.col("speaker").isNotNull() & (F.col("end_s") > F.col("start_s")))


def without_phantoms(turns: DataFrame, least_ms: int = 2000) -> DataFrame:
    """Turns of speakers that talk for at least ``least_ms`` in their recording. Talk is summed in whole milliseconds,
    so that the sum depends on no order."""
    talk = turns.groupBy(F.col("recording").alias("_r"), F.col("speaker").alias("_s")).agg(F.sum(millis("end_s") - millis("start_s")).alias("_talk"))
    on = F.col("recording").eqNullSafe(F.col("_r")) & F.col("speaker").eqNullSafe(F.col("_s"))
    return turns.join(talk.where(F.col("_talk") >= least_ms), on, "left_semi")


def talk_time(turns: DataFrame) -> DataFrame:
    """recording, speaker, talk_ms, n_turns of valid turns."""
    return valid(turns).groupBy("recording", "speaker").agg(F.sum(millis("end_s") - millis("start_s")).alias("talk_ms"), F.count("*").alias("n_turns"))


def merge_turns(turns: DataFrame, max_gap: float = 0.6) -> DataFrame:
    """recording, speaker, start_s, end_s, ord: turns in order, joined while the speaker stays and the pause to the
    furthest end so far is no longer than ``max_gap``. A turn of another speaker between two breaks them.

    Defined cases: turns without start, end or speaker and empty or reversed ones are left out; ties go by end, then
    ord; a null recording is a recording.
    """
    order, key = ["start_s", "end_s", "ord"], ["recording"]
    x = by_time(valid(turns).select("recording", "ord", "start_s", "end_s", "speaker"))
    w = local(key, *order)
    x = x.withColumn("_change", F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_here", F.max("end_s").over(local([*key, "_run"], *order).rowsBetween(Window.unboundedPreceding, -1)))
    # Of each bucket: the first and last speaker, whether it is one run, and how far its last run reaches.
    at = F.struct(*order)
    s = x.groupBy(*key, BUCKET).agg(F.min_by("speaker", at).alias("_from"), F.max_by("speaker", at).alias("_to"), F.max(F.struct("_run", "end_s")).alias("_last"))
    w = Window.partitionBy(*key).orderBy(BUCKET)  # a row a bucket
    s = s.withColumn("_breaks", F.coalesce(((F.col("_last._run") > 1) | (F.lag("_to").over(w) != F.col("_from"))).cast("int"), F.lit(1)))
    s = s.withColumn("_group", F.sum("_breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_far", F.max("_last.end_s").over(Window.partitionBy(*key, "_group").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select(F.col("recording").alias("_r"), F.col(BUCKET).alias("_b"), F.lag("_to").over(w).alias("_before"), F.lag("_far").over(w).alias("_reached"))
    x = x.join(s, F.col("recording").eqNullSafe(F.col("_r")) & (F.col(BUCKET) == F.col("_b"))).drop("_r", "_b")
    goes_on = (F.col("_run") == 1) & (F.col("speaker") == F.col("_before"))
    reach = F.when(goes_on, F.greatest("_here", "_reached")).otherwise(F.col("_here"))
    x = x.withColumn("_fresh", reach.isNull() | (F.col("start_s") - reach > max_gap))
    parts = cut_at(x, key, order, F.col("_fresh"), {"speaker": F.first("speaker"), "start_s": F.min("start_s"), "end_s": F.max("end_s")})
    return parts.groupBy("recording", "speaker", "_first").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).select("recording", "speaker", "start_s", "end_s", F.col("_first.ord").alias("ord"))


def without_micro_turns(merged: DataFrame, least_s: float = 0.15) -> DataFrame:
    """Merged turns of some length. It comes after merging, which may make a turn long enough."""
    return merged.where(F.col("end_s") - F.col("start_s") >= least_s)


def build_windows(turns: DataFrame, max_len: float = 30.0, max_gap: float = 1.5) -> DataFrame:
    """recording, window_ix, start_s, end_s: turns packed greedily into windows of at most ``max_len``; a pause of more
    than ``max_gap`` closes one; a longer turn is a window of its own.

    A pause after everything said so far closes the window whatever came before, so the stretches between such pauses
    are packed by themselves: their turns pass by in order, and only the open window is held.
    """
    order, key = ["start_s", "ord"], ["recording"]
    x = by_time(turns.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select("recording", "ord", "start_s", "end_s"))
    x = x.withColumn("_here", F.max("end_s").over(local(key, *order).rowsBetween(Window.unboundedPreceding, -1)))
    x = carry(x, key, {"_c": (F.max("end_s"), "max")})
    reach = F.greatest("_here", "_c")
    x = x.withColumn("_own", F.when(reach.isNull() | (F.col("start_s") - reach > max_gap), F.struct(*order)))
    x = x.withColumn("_l", F.last("_own", ignorenulls=True).over(local(key, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_here", "_c")
    x = carry(x, key, {"_c": (F.max("_own"), "last")}, cut=True)
    first = F.coalesce("_l", "_c")
    x = x.select("recording", first["start_s"].alias("_at"), first["ord"].alias("_by"), "start_s", "ord", "end_s")
    x = x.repartition("recording", "_at", "_by").sortWithinPartitions("recording", "_at", "_by", *order)
    return numbered(x.mapInPandas(_packed(max_len, max_gap), "recording string, start_s double, end_s double"), key, ["start_s", "end_s"], "window_ix")


def _packed(max_len: float, max_gap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, a, b = None, 0.0, 0.0
        for batch in batches:
            out = []
            for rec, at, by, start, end in zip(batch["recording"], batch["_at"], batch["_by"], batch["start_s"], batch["end_s"]):
                key = (rec, at, by)
                if key != now or start - b > max_gap or max(b, end) - a > max_len:
                    if now is not None:
                        out.append((now[0], a, b))
                    now, a, b = key, start, end
                else:
                    b = max(b, end)
            yield pd.DataFrame(out, columns=["recording", "start_s", "end_s"])
        if now is not None:
            yield pd.DataFrame([(now[0], a, b)], columns=["recording", "start_s", "end_s"])

    return run


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based rank of each row in its entity's order."""
    x = by_time(df, order[0])
    x = x.withColumn("_n", F.row_number().over(local(keys, *order)))
    x = carry(x, keys, {"_c": (F.count("*"), "sum")}, cut=True)
    return x.withColumn(name, (F.col("_n") + F.col("_c") - 1).cast("bigint")).drop("_n", "_c", BUCKET)


def padded(spans: DataFrame, total_s: Column | float | None = None, pad: float = 0.15) -> DataFrame:
    """Add pad_start and pad_end: the span and a little more, inside the recording."""
    end = F.col("end_s") + pad
    if total_s is not None:
        end = F.least(F.lit(total_s) if isinstance(total_s, float) else total_s, end)
    return spans.withColumns({"pad_start": F.greatest(F.lit(0.0), F.col("start_s") - pad), "pad_end": end})


def chunk_limit(max_chunk: float, model_limit: float, pad: float = 0.15) -> float:
    """The longest window whose padded form a model takes."""
    return min(max_chunk, model_limit - 2 * pad)


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples, in the JVM."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples))


def quietest(frames: DataFrame, keys: Sequence[str], frame: str, loudness: str) -> DataFrame:
    """keys, quietest, rms: the first of the frames of least loudness."""
    return frames.groupBy(*keys).agg(F.min_by(frame, F.struct(loudness, frame)).alias("quietest"), F.min(loudness).alias("rms"))


# --- quiet places of a waveform -----------------------------------------------------------------------------------


def best_cut(samples: np.ndarray, rate: int, start: float, end: float, target: float | None = None, search: float = 3.0, win: float = 0.05) -> float:
    """The middle of the quietest frame near ``target`` (the middle of the span by default), at least a second inside
    the span; the target itself where there is no room for two frames."""
    target = (start + end) / 2 if target is None else target
    lo, hi = max(start + 1.0, target - search), min(end - 1.0, target + search)
    hop = max(1, int(win * rate))
    part = np.asarray(samples[int(lo * rate) : int(hi * rate)], dtype=np.float64) if hi > lo else np.zeros(0)
    n = len(part) // hop
    if n < 2:
        return target
    loud = np.sqrt(np.square(part[: n * hop]).reshape(n, hop).mean(axis=1))
    return lo + (int(loud.argmin()) + 0.5) * win


def _with_sound(spans: DataFrame, waves: DataFrame) -> DataFrame:
    """A row a span and block of sound that it reaches into; one without sound for spans that have none."""
    held = F.col("from_s") + F.size("samples") / F.col("rate")
    blocks = waves.select(F.col("recording").alias("_r"), "rate", "from_s", "samples", held.alias("_to"))
    met = spans.join(blocks, (F.col("recording") == F.col("_r")) & (F.col("from_s") < F.col("end_s")) & (F.col("_to") > F.col("start_s")), "left")
    return met.select("recording", "span_id", "start_s", "end_s", "rate", "from_s", "samples")


def _sound(g: pd.DataFrame) -> tuple[float, float, np.ndarray, int, float]:
    """Start and end of a span, its samples, their rate and where they begin."""
    a, b = float(g["start_s"].iloc[0]), float(g["end_s"].iloc[0])
    g = g.dropna(subset=["from_s"]).sort_values("from_s")
    if not len(g):
        return a, b, np.zeros(0, dtype=np.float32), 1, a
    return a, b, np.concatenate([np.asarray(s, dtype=np.float32) for s in g["samples"]]), int(g["rate"].iloc[0]), float(g["from_s"].iloc[0])


def with_cuts(spans: DataFrame, waves: DataFrame | None = None) -> DataFrame:
    """spans (recording, span_id, start_s, end_s) with cut: the quietest place near the middle, or the middle itself
    without sound."""
    if waves is None:
        return spans.withColumn("cut", (F.col("start_s") + F.col("end_s")) / 2)

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b, x, rate, base = _sound(g)
        return pd.DataFrame({"_r": [key[0]], "_s": [key[1]], "cut": [best_cut(x, rate, a - base, b - base) + base]})

    cuts = _with_sound(spans, waves).groupBy("recording", "span_id").applyInPandas(one, "_r string, _s bigint, cut double")
    return spans.join(cuts, (F.col("recording") == F.col("_r")) & (F.col("span_id") == F.col("_s"))).drop("_r", "_s")


def split_long(spans: DataFrame, waves: DataFrame, max_len: float = 30.0, search: float = 3.0) -> DataFrame:
    """recording, span_id, part, start_s, end_s: spans longer than ``max_len`` cut at quiet places near it.

    waves: recording, rate, from_s, samples — a recording's sound in blocks. Each span meets the blocks that hold it,
    so no task holds a recording; blocks are put together per span.
    """
    met = _with_sound(spans.where(F.col("end_s") - F.col("start_s") > max_len), waves)

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        a, b, x, rate, base = _sound(g)
        out = []
        while b - a > max_len:
            at = best_cut(x, rate, a - base, b - base, a - base + max_len - 3.0, search) + base
            out.append((a, at))
            a = at
        out.append((a, b))
        return pd.DataFrame({"part": range(len(out)), "start_s": [o[0] for o in out], "end_s": [o[1] for o in out]})

    def group(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        d = cut(g)
        d.insert(0, "recording", key[0])
        d.insert(1, "span_id", key[1])
        return d

    pieces = met.groupBy("recording", "span_id").applyInPandas(group, "recording string, span_id bigint, part int, start_s double, end_s double")
    whole = spans.where(F.col("end_s") - F.col("start_s") <= max_len).select("recording", "span_id", F.lit(0).alias("part"), "start_s", "end_s")
    return whole.unionByName(pieces)


def bisected(spans: DataFrame, cut: Column, depth: int = 0, max_depth: int = 2, least_s: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(halves of spans that may be split, the spans that may not). ``cut`` is where a span would be split."""
    may = (F.col("end_s") - F.col("start_s") >= least_s) & F.lit(depth < max_depth)
    halves = spans.where(may).withColumn("_c", cut)
    halves = halves.withColumn("_h", F.explode(F.array(F.struct("start_s", F.col("_c").alias("end_s")), F.struct(F.col("_c").alias("start_s"), "end_s"))))
    return halves.withColumns({"start_s": F.col("_h.start_s"), "end_s": F.col("_h.end_s")}).drop("_c", "_h"), spans.where(~may)


# --- who speaks ---------------------------------------------------------------------------------------------------

#: Milliseconds of a bucket of the overlap join, and buckets of an interval; longer ones meet in wider buckets.
JOIN_MS, MOST_BUCKETS = 30_000, 2880
_LEVELS = [JOIN_MS * MOST_BUCKETS**k for k in range(5)]


def _level(lo: str, hi: str) -> Column:
    """The first level at whose width an interval reaches into no more than MOST_BUCKETS buckets."""
    out = F.lit(len(_LEVELS) - 1)
    for k in range(len(_LEVELS) - 2, -1, -1):
        out = F.when(F.col(hi) - F.col(lo) < _LEVELS[k] * (MOST_BUCKETS - 1), k).otherwise(out)
    return out


def _overlaps(w: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs of words (s to e) and turns (a to b) that overlap, each once: where both are short, in the bucket in which
    they begin to; else at the level of the longer of the two."""
    w, t = w.withColumn("_lw", _level("s", "e")), t.withColumn("_lt", _level("a", "b"))
    most = max(w.agg(F.max("_lw")).first()[0] or 0, t.agg(F.max("_lt")).first()[0] or 0)
    out = None
    for k in range(most + 1):
        width = _LEVELS[k]
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(lo, hi) / width)))  # noqa: B023, E731
        sides = [("_lt <= 0", "_lw <= 0")] if not k else [(f"_lt = {k}", f"_lw <= {k}"), (f"_lt < {k}", f"_lw = {k}")]
        for turns, words in sides:
            met = w.where(words).withColumn("k", cells("s", "e")).join(t.where(turns).withColumn("k", cells("a", "b")), ["recording", "k"])
            met = met.where((F.col("s") < F.col("b")) & (F.col("a") < F.col("e")) & (F.floor(F.greatest("s", "a") / width) == F.col("k")))
            out = met if out is None else out.unionByName(met)
    return out


def speaker_at(words: DataFrame, turns: DataFrame) -> DataFrame:
    """word_id, speaker, overlap_ms, distance_ms: who speaks most during each timed word; the nearest turn's speaker
    where nobody does. In whole milliseconds; on ties the turn that comes first (start, end, ord).

    Words and turns meet by buckets of time, a pair in the bucket in which it begins to overlap. Words without overlap
    take the nearer of the furthest end before them and the next start, which scans over the time line carry.
    """
    order = ["a", "b", "ord"]
    t = valid(turns).select("recording", "ord", "speaker", millis("start_s").alias("a"), millis("end_s").alias("b")).distinct()
    w = words.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select("recording", "word_id", millis("start_s").alias("s"), millis("end_s").alias("e")).distinct()
    # NaN and infinity are no times. Both sides are read several times below: in slim form, without what they come from.
    t, w = written(t.where("a IS NOT NULL AND b IS NOT NULL"), "turns"), written(w.where("s IS NOT NULL AND e IS NOT NULL"), "words")
    met = _overlaps(w, t)
    each = met.groupBy("recording", "word_id", "speaker").agg(F.sum(F.least("e", "b") - F.greatest("s", "a")).alias("o"), F.min(F.struct(*order)).alias("f"))
    best = each.groupBy("recording", "word_id").agg(F.min(F.struct((-F.col("o")).alias("o"), "f", "speaker")).alias("m"))
    best = written(best, "overlaps")
    over = best.select("word_id", F.col("m.speaker").alias("speaker"), (-F.col("m.o")).alias("overlap_ms"), F.lit(0.0).alias("distance_ms"))
    lone = w.join(best.select("word_id"), "word_id", "left_anti").select("recording", "word_id", (F.col("s") + F.col("e")).alias("m2"))
    # Turns and lone words on one time line, in half milliseconds; at equal times turns come first.
    line = t.select("recording", (F.col("a") * 2).alias("x"), F.lit(0).alias("side"), "ord", F.lit(None).cast("bigint").alias("word_id"), F.struct((F.col("b") * 2).alias("b"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), (-F.col("ord")).alias("no"), "speaker").alias("t"))
    line = line.unionByName(lone.select("recording", F.col("m2").alias("x"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("ord"), "word_id", F.lit(None).cast("struct<b: bigint, na: bigint, nb: bigint, no: bigint, speaker: int>").alias("t")))
    width = int(BUCKET_S * 2000)
    line = line.withColumn(BUCKET, F.floor(F.col("x") / width))
    # The furthest end before a word and the next start after it, both carried by one scan.
    keys, order2 = ["recording"], ["x", "side", "ord", "word_id"]
    starts = F.when(F.col("t").isNotNull(), F.col("x"))
    line = line.withColumns({
        "_l": F.max("t").over(local(keys, *order2).rowsBetween(Window.unboundedPreceding, -1)),
        "_n": F.first(starts, ignorenulls=True).over(local(keys, *order2).rowsBetween(1, Window.unboundedFollowing)),
    })
    line = carry(line, keys, {"_cl": (F.max("t"), "max"), "_cn": (F.min(starts), "next")}, cut=True)
    line = line.withColumns({"_left": F.greatest("_l", "_cl"), "_next": F.coalesce("_n", "_cn")})
    lone = line.where("side = 1").select("recording", "word_id", "x", "_left", "_next")
    first = t.groupBy("recording", (F.col("a") * 2).alias("_next")).agg(F.min(F.struct(*order, "speaker")).alias("r"))
    lone = lone.join(first, ["recording", "_next"], "left")
    dl = F.greatest(F.col("x") - F.col("_left.b"), F.lit(0))
    dr = F.col("_next") - F.col("x")
    left = F.when(F.col("_left").isNotNull(), F.struct(dl.alias("d"), (-F.col("_left.na")).alias("a"), (-F.col("_left.nb")).alias("b"), (-F.col("_left.no")).alias("ord"), F.col("_left.speaker").alias("speaker")))
    right = F.when(F.col("r").isNotNull(), F.struct(dr.alias("d"), F.col("r.a").alias("a"), F.col("r.b").alias("b"), F.col("r.ord").alias("ord"), F.col("r.speaker").alias("speaker")))
    far = lone.withColumn("n", F.array_min(F.array_compact(F.array(left, right)))).where("n IS NOT NULL").select("word_id", F.col("n.speaker").alias("speaker"), F.lit(0).cast("bigint").alias("overlap_ms"), (F.col("n.d") / 2.0).alias("distance_ms"))
    return over.unionByName(far)


def relabel_speakers(segments: DataFrame, ident: str = "seg_id") -> DataFrame:
    """The segments with label: speakers numbered from 0 in order of first appearance in their recording."""
    at = F.struct("start_s", ident)
    seen = segments.where(F.col("speaker").isNotNull()).groupBy("recording", "speaker").agg(F.min(at).alias("_at"))
    seen = seen.withColumn("label", F.row_number().over(Window.partitionBy("recording").orderBy("_at", "speaker")) - 1)  # speakers of a recording
    seen = seen.select(F.col("recording").alias("_r"), F.col("speaker").alias("_s"), "label")
    return segments.join(seen, F.col("recording").eqNullSafe(F.col("_r")) & (F.col("speaker") == F.col("_s")), "left").drop("_r", "_s")


def group_words(words: DataFrame, max_pause: float = 1.0) -> DataFrame:
    """recording, speaker, start_s, end_s, text, flags, first_word, n_words: words in order of start, cut where the
    speaker changes or a pause is longer than ``max_pause``. The end is the last word's; flags are the sorted union.

    words: recording, word_id, start_s, end_s, text, speaker, flags. Untimed words are left out.
    """
    order, key = ["start_s", "word_id"], ["recording"]
    x = by_time(words.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()))
    x = x.withColumn("_l", F.lag(F.struct("speaker", "end_s")).over(local(key, *order)))
    x = carry(x, key, {"_c": (F.max_by(F.struct("speaker", "end_s"), F.struct(*order)), "last")})
    p = F.coalesce("_l", "_c")
    x = x.withColumn("_fresh", p.isNull() | ~p["speaker"].eqNullSafe(F.col("speaker")) | (F.col("start_s") - p["end_s"] > max_pause))
    none = F.array().cast("array<string>")
    parts = cut_at(x, key, order, F.col("_fresh"), {
        "speaker": F.first("speaker"), "start_s": F.min("start_s"), "last": F.max(F.struct(*order, "end_s")), "said": F.collect_list(F.struct(*order, "text")),
        "flags": F.array_distinct(F.flatten(F.collect_list(F.coalesce("flags", none)))), "n": F.count("*"),
    })
    text = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("said"))), lambda r: r["text"]), " ")
    return parts.groupBy("recording", "speaker", "_first").agg(
        F.min("start_s").alias("start_s"), F.max("last")["end_s"].alias("end_s"), text.alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.sum("n").alias("n_words")
    ).select("recording", "speaker", "start_s", "end_s", "text", "flags", F.col("_first.word_id").alias("first_word"), "n_words")
