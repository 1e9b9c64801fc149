"""Words from texts and frames: punctuation, even spacing, filling of gaps, and alignment by dynamic programming."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import by_row

# Characters that aligners know by another.
CHARACTERS = {"’": "'", "‘": "'", "`": "'", "‐": "-", "–": "-"}


def attached(text: Column) -> Column:
    """The tokens of a text, those without a letter or digit glued to the token before them by a space."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    empty = F.array().cast("array<string>")

    def glue(acc: Column, t: Column) -> Column:
        alone = ~t.rlike(r"[\p{L}\p{N}]") & (F.size(acc) > 0)
        n = F.size(acc)
        return F.when(alone, F.concat(F.slice(acc, 1, n - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), t)))).otherwise(F.array_append(acc, t))

    return F.aggregate(F.coalesce(tokens, empty), empty, glue)


def uniform_words(pieces: DataFrame) -> DataFrame:
    """piece_id, pos, text, start_s, end_s: the words of each piece spread evenly over its span. Null and blank texts
    have none."""
    x = pieces.select("piece_id", "start_s", "end_s", attached(F.col("text")).alias("w"))
    step = (F.col("end_s") - F.col("start_s")) / F.size("w")
    x = x.select("piece_id", "start_s", step.alias("step"), F.posexplode("w").alias("pos", "text"))
    return x.select("piece_id", "pos", "text", (F.col("start_s") + F.col("pos") * F.col("step")).alias("start_s"), (F.col("start_s") + (F.col("pos") + 1) * F.col("step")).alias("end_s"))


def fill_gaps(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """words with times for those without: the first untimed word of a gap takes all of it, the others none.

    The gap goes from the end of the word before (the piece's start) to the start of the next timed word (the piece's
    end), and is empty where that comes earlier.
    """
    spans = pieces.select("piece_id", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    w = Window.partitionBy("piece_id").orderBy("pos")
    timed = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    x = words.join(spans, "piece_id")
    x = x.withColumns({
        "_e": F.last(F.when(timed, F.col("end_s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_s": F.first(F.when(timed, F.col("start_s")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "_t": F.lag(timed).over(w),
    })
    prev, nxt = F.coalesce("_e", "_a"), F.coalesce("_s", "_b")
    stop = F.greatest(prev, nxt)
    first = F.coalesce("_t", F.lit(True))
    return x.withColumns({
        "start_s": F.when(timed, F.col("start_s")).when(first, prev).otherwise(stop),
        "end_s": F.when(timed, F.col("end_s")).otherwise(stop),
    }).drop("_a", "_b", "_e", "_s", "_t")


# --- frames -------------------------------------------------------------------------------------------------------


def log_softmax(v: Column) -> Column:
    """An array of scores as log probabilities."""
    top = F.array_max(v)
    norm = top + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))
    return F.transform(v, lambda x: x.cast("double") - norm)


def blank_scores(frames: DataFrame, blank: int = 0) -> DataFrame:
    """frames (span_id, frame, logp) with score: what saying nothing up to and with each frame is worth. The frames of a
    span are some hundred."""
    w = Window.partitionBy("span_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("score", F.sum(F.col("logp")[blank]).over(w))


def tokens_of(words: Sequence[str], vocab: dict[str, int], separator: int | None) -> tuple[list[int], list[int]]:
    """Token ids of the words and the word that owns each; a separator, owned by -1, stands between words with tokens.
    Characters that the vocabulary lacks have no token."""
    tokens: list[int] = []
    owner: list[int] = []
    for k, w in enumerate(words):
        letters = (CHARACTERS.get(c, c) for c in unicodedata.normalize("NFC", w.lower()))
        own = [vocab[c] for c in letters if c in vocab]
        if own and tokens and separator is not None:
            tokens.append(separator)
            owner.append(-1)
        tokens.extend(own)
        owner.extend([k] * len(own))
    return tokens, owner


def _table(logp: np.ndarray, tokens: Sequence[int], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Best score of the first j tokens in the first t frames, and the score of staying with each token by frame."""
    frames, n = len(logp), len(tokens)
    emit = logp[:, np.asarray(tokens, dtype=int)]
    stay = np.maximum(emit, logp[:, [blank]])
    best = np.full((frames + 1, n + 1), -np.inf)
    best[:, 0] = np.concatenate([[0.0], np.cumsum(logp[:, blank])])
    for t in range(frames):
        best[t + 1, 1:] = np.maximum(best[t, 1:] + stay[t], best[t, :-1] + emit[t])
    return best, stay


def path_score(logp: np.ndarray, tokens: Sequence[int], blank: int = 0) -> float:
    """Log likelihood of the best path that says the tokens; minus infinity where the frames are too few."""
    if not len(tokens):
        return float(logp[:, blank].sum())
    return float(_table(logp, tokens, blank)[0][-1, -1]) if len(logp) >= len(tokens) else float("-inf")


def align_tokens(logp: np.ndarray, tokens: Sequence[int], blank: int = 0) -> list[tuple[int, int]] | None:
    """(first frame, last frame) of each token on the best path, None where there is none.

    A token owns the frame it comes in with, and later frames while it beats the blank. On a tie the path stays.
    """
    n = len(tokens)
    if not n or len(logp) < n:
        return None
    best, stay = _table(logp, tokens, blank)
    if not np.isfinite(best[-1, -1]):
        return None
    first, last = [-1] * n, [-1] * n
    j = n
    for t in range(len(logp) - 1, -1, -1):
        if not j:
            break
        p = logp[t, tokens[j - 1]]
        moved = best[t, j - 1] + p > best[t, j] + stay[t, j - 1]
        if moved or p > logp[t, blank]:
            first[j - 1] = t
            last[j - 1] = max(last[j - 1], t)
        j -= moved
    return None if j else list(zip(first, last))


def align_words(logp: np.ndarray, frame_s: float, start: float, end: float, text: str, vocab: dict[str, int], separator: int | None, blank: int = 0) -> list[tuple[float, float, str]]:
    """(start, end, word) of each word of a text said in a span; evenly spread where no path exists."""
    words: list[str] = []
    for t in text.split():
        if words and not any(map(str.isalnum, t)):
            words[-1] += f" {t}"
        else:
            words.append(t)
    tokens, owner = tokens_of(words, vocab, separator)
    spans = align_tokens(logp, tokens, blank)
    if spans is None:
        step = (end - start) / max(1, len(words))
        return [(start + k * step, start + (k + 1) * step, w) for k, w in enumerate(words)]
    own: dict[int, list[int]] = {}
    for (a, b), k in zip(spans, owner):
        if k >= 0:
            own.setdefault(k, [a, b])[1] = b
    timed = {k: (start + a * frame_s, start + (b + 1) * frame_s) for k, (a, b) in own.items()}
    out, before = [], start
    for k, w in enumerate(words):
        if k not in timed:  # what no character stands for takes the gap
            after = next((timed[m][0] for m in range(k + 1, len(words)) if m in timed), end)
            timed_here = (before, max(before, after))
        else:
            timed_here = timed[k]
        out.append((*timed_here, w))
        before = timed_here[1]
    return out


def _frames(rows) -> np.ndarray:
    return np.vstack([np.asarray(r, dtype=np.float64) for r in rows])


align_tokens_udf = by_row("array<struct<first: int, last: int>>")(
    lambda logp, tokens: None if logp is None or tokens is None or not len(logp) else (lambda s: None if s is None else [{"first": a, "last": b} for a, b in s])(align_tokens(_frames(logp), list(tokens)))
)
path_score_udf = by_row("double")(lambda logp, tokens: None if logp is None or tokens is None or not len(logp) else path_score(_frames(logp), list(tokens)))


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Insertions, deletions and substitutions of words between two sequences, row by row in NumPy."""
    if len(a) < len(b):
        a, b = b, a
    ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([ids[w] for w in b], dtype=np.int64)
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        part = np.minimum(row[1:] + 1, row[:-1] + (y != ids[w]))
        part = np.concatenate([[i], part])
        row = np.minimum.accumulate(part - steps) + steps
    return int(row[-1])
