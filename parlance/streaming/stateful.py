"""Streams: decoding watched for loops, recordings diarized in chunks with carried state, and speech sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.loops import normalize_words, periodic_suffix

#: Tokens kept of each row's end; tokens before the first check.
TAIL, FIRST_CHECK = 400, 16
#: When the words of a text, rather than tokens, go in circles.
WORD_LOOP = {"max_period": 40, "min_repeats": 3, "min_span": 30, "short_period": 3, "short_min_repeats": 6}


def watch_loops(tokens: DataFrame, ignore: tuple[int, ...] = (), every: int = 8, decode: Callable[[list[int]], str] | None = None) -> DataFrame:
    """recording, span_id, generated, reason: emitted once a row's tokens loop; later tokens of the row are ignored.

    tokens, a stream: recording, span_id, ix (from 0, without gaps), token; those that come early wait. ``ignore``: tokens that end a row; a tail of them is no
    loop. ``decode`` turns the tail into text for the check of words; without it, the tokens' column ``word``, if they
    have one, is that text.
    """
    spelled = decode is None and "word" in tokens.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, n, reason, said, held = state.get if state.exists else ([], 0, None, [], [])
        tail, said = list(tail), list(said)
        fresh = None
        waiting = {int(h[0]): (int(h[1]), h[2]) for h in held}
        for b in batches if reason is None else ():
            waiting.update((int(i), (int(t), w)) for i, t, w in zip(b["ix"], b["token"], b["word"] if spelled else [None] * len(b)) if i >= n)
        if reason is None:
            while n in waiting:  # tokens in their order, whatever the order they come in
                t, word = waiting.pop(n)
                tail = [*tail, int(t)][-TAIL:]
                if spelled:
                    said = [*said, word or ""][-TAIL:]
                n += 1
                if n >= FIRST_CHECK and tail[-1] not in ignore:
                    text = None if n % every else decode(tail) if decode else " ".join(said) if spelled else None
                    if hit := periodic_suffix(tail):
                        fresh = f"token loop (period={hit[0]}, x{hit[1]})"
                    elif text and (hit := periodic_suffix(normalize_words(text), **WORD_LOOP)):
                        fresh = f"text loop (period={hit[0]} words, x{hit[1]})"
                    reason = fresh
                    if reason is not None:
                        break
        live = reason is None
        state.update((tail if live else [], n, reason, said if live else [], [(k, *v) for k, v in sorted(waiting.items())] if live else []))
        if fresh is not None:
            yield pd.DataFrame({"recording": [key[0]], "span_id": [key[1]], "generated": [n], "reason": [fresh]})

    return tokens.groupBy("recording", "span_id").applyInPandasWithState(
        step, "recording string, span_id bigint, generated int, reason string", "tail array<int>, n int, reason string, said array<string>, held array<struct<ix: int, token: int, word: string>>", "append", GroupStateTimeout.NoTimeout
    )


def chunked_turns(chunks: DataFrame, model: Callable[[list[float], bytes | None], tuple[list[tuple[float, float, int]], bytes]]) -> DataFrame:
    """recording, start_s, end_s, speaker: a recording diarized chunk by chunk, the model's cache carried along.

    chunks, a stream: recording, ix, from_s, samples. The model gets samples and its cache (null at first) and gives
    turns relative to the chunk and its new cache. Chunks that come early wait for those before them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache, next_ix, held = state.get if state.exists else (None, 0, [])
        waiting = {int(h["ix"] if isinstance(h, dict) else h[0]): ((h["from_s"], list(h["samples"])) if isinstance(h, dict) else (h[1], list(h[2]))) for h in held}
        for b in batches:
            for r in b.itertuples():
                if r.ix >= next_ix:
                    waiting[int(r.ix)] = (float(r.from_s), [float(x) for x in r.samples])
        out = []
        while next_ix in waiting:
            at, samples = waiting.pop(next_ix)
            turns, cache = model(samples, cache)
            out += [(key[0], at + a, at + b, s) for a, b, s in turns]
            next_ix += 1
        state.update((cache, next_ix, [(k, *v) for k, v in sorted(waiting.items())]))
        if out:
            yield pd.DataFrame(out, columns=["recording", "start_s", "end_s", "speaker"])

    return chunks.groupBy("recording").applyInPandasWithState(
        step, "recording string, start_s double, end_s double, speaker int",
        "cache binary, next_ix int, held array<struct<ix: int, from_s: double, samples: array<float>>>", "append", GroupStateTimeout.NoTimeout,
    )


def speech_sessions(turns: DataFrame, gap_s: float = 0.6, lateness: str = "10 minutes") -> DataFrame:
    """recording, speaker, from_ts, to_ts, n_turns: turns of a speaker joined while pauses are no longer than the gap.

    turns, a stream: recording, speaker, ts (start), seconds. A session ends when the watermark passes it. As in batch,
    a pause of exactly the gap joins.
    """
    x = turns.withWatermark("ts", lateness)
    # In whole microseconds: an interval of more decimals than it can hold is none, and its row would be lost.
    gap = F.concat(F.round((F.col("seconds") + gap_s) * 1_000_000).cast("bigint").cast("string"), F.lit(" microseconds"))
    return x.groupBy("recording", "speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_turns")).select(
        "recording", "speaker", F.col("w.start").alias("from_ts"), (F.col("w.end") - F.make_dt_interval(secs=F.lit(gap_s))).alias("to_ts"), "n_turns"
    )
