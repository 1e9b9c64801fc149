"""From turns and a recogniser to speaker segments: by windows and by turns, with the retry ladder, bisection, words,
speakers, post-processing and files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_column
from ..operators import intervals, retry
from ..operators.alignment import uniform_words
from ..operators.speakers import smooth_by_sentence
from ..session import written
from ..sources import sinks
from ..sources.models import HypothesisModel, with_ladder
from . import post


# Languages that transcripts may be in.
LANGS = ("ar", "de", "el", "en", "es", "fr", "it", "ja", "ko", "nl", "pl", "pt", "vi", "zh")


@dataclass(frozen=True)
class Options:
    """lang None: no check of scripts. max_chunk must be in ]0, 35]."""

    lang: str | None = "fr"
    keep_tags: bool = False
    max_chunk: float = 30.0
    pad: float = 0.15
    min_turn: float = 0.15
    max_pause: float = 1.0
    max_wps: float = 6.0
    max_split_depth: int = 2
    min_split_s: float = 4.0

    def __post_init__(self):
        if self.lang is not None and self.lang not in LANGS:
            raise ValueError(f"unknown language {self.lang!r}; known: {', '.join(LANGS)}")
        if not 0 < self.max_chunk <= 35:
            raise ValueError("max_chunk is above 0 and at most 35 seconds")


def speech_turns(turns: DataFrame, o: Options = Options()) -> DataFrame:
    """Phantom speakers out, turns merged, micro turns out."""
    return intervals.without_micro_turns(intervals.merge_turns(intervals.without_phantoms(turns)), o.min_turn)


def window_spans(turns: DataFrame, o: Options = Options(), model_limit: float = 3600.0) -> DataFrame:
    """recording, window_ix, start_s, end_s, pad_start, pad_end: what a recogniser is given."""
    return intervals.padded(intervals.build_windows(speech_turns(turns, o), intervals.chunk_limit(o.max_chunk, model_limit, o.pad)), pad=o.pad)


def turn_spans(turns: DataFrame, o: Options = Options()) -> DataFrame:
    """recording, ord, speaker, start_s, end_s, pad_start, pad_end: each turn by itself."""
    return intervals.padded(speech_turns(turns, o), pad=o.pad)


def cleaned(df: DataFrame, o: Options, duration: bool = False) -> DataFrame:
    """Rows whose text survives cleaning, with the clean text."""
    d = F.col("end_s") - F.col("start_s") if duration else None
    x = df.withColumn("_c", clean_column(F.col("text"), o.lang, o.keep_tags, d))
    return x.where(F.col("_c.reason").isNull()).withColumn("text", F.col("_c.text")).drop("_c")


def window_segments(pieces: DataFrame, turns: DataFrame, words: DataFrame | None = None, o: Options = Options()) -> DataFrame:
    """recording, speaker, label, start_s, end_s, text, flags: window mode. Pieces are cleaned, their words timed (the
    aligner's ``words``, else evenly spread), given speakers by turns, smoothed by sentence, grouped, cleaned again
    with their length, and speakers relabelled."""
    p = cleaned(pieces, o)
    if words is None:
        words = uniform_words(p).withColumn("word_id", F.xxhash64("piece_id", "pos"))
    w = words.select("word_id", "piece_id", "pos", "start_s", "end_s", "text").join(p.select("piece_id", "recording", "flags"), "piece_id")
    w = written(w, "words-of-pieces")  # texts and flags stand aside while speakers are looked for
    who = intervals.speaker_at(w, speech_turns(turns, o)).select("word_id", "speaker")
    w = smooth_by_sentence(w.join(who, "word_id")).withColumn("speaker", F.col("smoothed"))
    w = written(w.select("recording", "word_id", "start_s", "end_s", "text", "speaker", "flags"), "words-of-speakers")
    s = cleaned(intervals.group_words(w, o.max_pause), o, True)
    return intervals.relabel_speakers(s, "first_word").select("recording", "speaker", "label", "start_s", "end_s", "text", "flags")


def turn_segments(spans: DataFrame, pieces: DataFrame, o: Options = Options()) -> DataFrame:
    """recording, speaker, label, start_s, end_s, text, flags: turns mode. A span's pieces that survive cleaning are
    joined; the segment has the span's times without padding. spans: recording, span_id, speaker, start_s, end_s."""
    p = cleaned(pieces, o, True).where(F.col("text") != "")
    none = F.array().cast("array<string>")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_ix", "text"))), lambda r: r["text"]), " ")
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("flags", none)))))
    t = p.groupBy("recording", "span_id").agg(text.alias("text"), flags.alias("flags"))
    s = spans.select("recording", "span_id", "speaker", "start_s", "end_s").join(t, ["recording", "span_id"])
    return intervals.relabel_speakers(s, "span_id").select("recording", "speaker", "label", "start_s", "end_s", "text", "flags")


def pieces_from_attempts(attempts: DataFrame, o: Options = Options()) -> DataFrame:
    """The piece of each span: attempts are diagnosed and the ladder's choice is made."""
    return retry.resolved(retry.diagnosed(attempts), o.max_wps)


def transcribed(model: HypothesisModel, spans: DataFrame, o: Options = Options(), waves: DataFrame | None = None) -> DataFrame:
    """recording, span_id, piece_ix, start_s, end_s, text, flags: what a recogniser makes of spans.

    All spans climb the ladder; those that no rung solves are halved at a quiet place and climb again, ``max_split_depth``
    times and while they have ``min_split_s``; what still fails is trimmed. Each half is a span of its own for the model,
    numbered ``node`` (1 for a whole span, 2n and 2n + 1 for the halves of n). Rungs and depths are a few fixed steps,
    each over all spans that are left.
    """
    todo = spans.select("recording", "span_id", F.lit(1).cast("bigint").alias("node"), "start_s", "end_s").where(F.col("end_s") - F.col("start_s") >= 0.2)
    done = None
    for depth in range(o.max_split_depth + 1):
        # A node is a span for the model, the ladder and the cuts: its key is one number within the recording.
        todo = written(todo, "to-transcribe")
        nodes = todo.withColumns({"_span": F.col("span_id"), "span_id": F.col("span_id") * (1 << (o.max_split_depth + 1)) + F.col("node")})
        tried = written(with_ladder(_Nodes(model, o.max_split_depth), nodes, len(retry.LADDER), retry.diagnosed), "attempts")
        found = retry.resolved(tried, o.max_wps)
        keys = nodes.select("recording", "span_id", "_span", "node")
        failed = nodes.join(found.where(F.array_contains("flags", "loop_trimmed")).select("recording", "span_id"), ["recording", "span_id"], "left_semi")
        halves, _ = intervals.bisected(intervals.with_cuts(failed, waves), F.col("cut"), depth, o.max_split_depth, o.min_split_s)
        halves = written(halves.drop("cut"), "halves")
        kept = found.join(halves.select("recording", "span_id").distinct(), ["recording", "span_id"], "left_anti").join(keys, ["recording", "span_id"])
        kept = kept.select("recording", F.col("_span").alias("span_id"), "start_s", "end_s", "text", "flags")
        done = kept if done is None else done.unionByName(kept)
        if depth < o.max_split_depth:
            second = F.col("start_s") != F.min("start_s").over(Window.partitionBy("recording", "span_id"))  # two halves
            todo = halves.select("recording", F.col("_span").alias("span_id"), (F.col("node") * 2 + second.cast("int")).alias("node"), "start_s", "end_s")
    ix = F.row_number().over(Window.partitionBy("recording", "span_id").orderBy("start_s")) - 1  # a span has at most four pieces
    return done.withColumn("piece_ix", ix).select("recording", "span_id", "piece_ix", "start_s", "end_s", "text", "flags")


class _Nodes(HypothesisModel):
    """A model that is given nodes as spans."""

    def __init__(self, model: HypothesisModel, depth: int):
        self.model, self.limits, self.base = model, model.limits, 1 << (depth + 1)

    def attempts(self, spans: DataFrame, rung: int) -> DataFrame:
        x = spans.withColumns({"node": F.col("span_id") % self.base, "span_id": F.floor(F.col("span_id") / self.base)})
        got = self.model.attempts(x.select("recording", "span_id", "node", "start_s", "end_s"), rung)
        return got.withColumn("span_id", F.col("span_id") * self.base + F.col("node")).select("recording", "span_id", "start_s", "end_s", "rung", "text", "hit_limit", "stop_reason")


def run(
    turns: DataFrame,
    model: HypothesisModel,
    o: Options = Options(),
    mode: str = "window",
    waves: DataFrame | None = None,
    aligner: Callable[[DataFrame], DataFrame] | None = None,
    config: post.PostConfig | None = None,
    folder: str | None = None,
    formats: list[str] | None = None,
) -> DataFrame:
    """recording, speaker, label, start_s, end_s, text, flags: from turns to the finished transcript, in one plan.

    mode: 'window' or 'turns'. waves: sound for cuts at quiet places; without it spans stay whole and halves are cut in
    the middle. aligner: pieces (with piece_id) to words as ``uniform_words`` gives them, the default. config:
    post-processing, none without it. folder and formats: files, checked before any work starts.
    """
    if mode not in ("window", "turns"):
        raise ValueError("mode is 'window' or 'turns'")
    sinks.check_formats(formats or [])
    limit = intervals.chunk_limit(o.max_chunk, model.limits.longest_s if model.limits else 3600.0, o.pad)
    merged = written(speech_turns(turns, o), "speech-turns")
    if mode == "window":
        spans = intervals.build_windows(merged, limit).select("recording", F.col("window_ix").alias("span_id"), F.lit(None).cast("int").alias("speaker"), "start_s", "end_s")
    else:
        spans = merged.select("recording", F.col("ord").alias("span_id"), "speaker", "start_s", "end_s")
    if waves is not None:
        parts = intervals.split_long(spans, waves, limit).withColumnRenamed("span_id", "_of")
        who = spans.select(F.col("recording").alias("_r"), F.col("span_id").alias("_s"), "speaker")
        parts = parts.join(who, (F.col("recording") == F.col("_r")) & (F.col("_of") == F.col("_s")))
        spans = intervals.numbered(parts.select("recording", "speaker", "start_s", "end_s", "_of"), ["recording"], ["start_s", "end_s", "_of"], "span_id").drop("_of")
    spans = written(spans, "spans")
    padded = intervals.padded(spans, pad=o.pad)
    if waves is not None:
        total = waves.groupBy(F.col("recording").alias("_r")).agg(F.max(F.col("from_s") + F.size("samples") / F.col("rate")).alias("_total"))
        padded = padded.join(total, F.col("recording") == F.col("_r"), "left").withColumn("pad_end", F.least("pad_end", "_total"))
    padded = padded.select("recording", "span_id", F.col("pad_start").alias("start_s"), F.col("pad_end").alias("end_s"))
    pieces = written(transcribed(model, padded, o, waves), "pieces")
    if mode == "window":
        pieces = pieces.withColumn("piece_id", F.xxhash64("recording", "span_id", "piece_ix"))
        words = aligner(cleaned(pieces, o)).withColumn("word_id", F.xxhash64("piece_id", "pos")) if aligner else None
        segments = window_segments(pieces, turns, words, o)
    else:
        segments = turn_segments(spans, pieces, o)
    if config is not None:
        segments = post.kept(post.postprocess(written(segments, "segments"), config)).select(*segments.columns)
    if folder is not None and formats:
        segments = written(segments, "transcript")
        sinks.write_files(segments.withColumn("speaker", F.col("label")), folder, formats).write.format("noop").mode("overwrite").save()
    return segments
