"""Clean, ordered speaker turns from transcript rows, by a semi-Markov conditional model over whole turns.

A recording's rows in order of start are segmented into turns. The state of the model is the speaker of a turn; a
segmentation scores by the label evidence of the rows, the pauses and the lexical continuity between the rows of a
turn, and a prior of its length. Labels are evidence that nothing outweighs: a row's column and the label in its text
name its speaker, and a turn opens only at a row with one of them, for a row without goes on with the row before. Where
labels leave it open, the other factors decide: whose a row is whose column and label are at odds, whether rows before
the first label belong to the first labelled turn, and where a speaker's segments part. Rows take their speakers and
scores from the decoded segments. Non-speech is cut from the text, and rows of nothing else are dropped after decoding,
when turns of one speaker join.

Recordings are cut into buckets of time. The last speaker that is beyond doubt and the row before are carried into each,
which makes decoding bucket by bucket exact (but for where a chain of segments of ``MAX_ROWS``, rows in doubt, or rows
before the first label are cut by an edge); the turns cut by an edge are joined again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import BUCKET, bucketed, carry, local
from ..session import written
from ..sources.tables import deliveries_once, millis
from .speech import clock_ms, has_words, label_number, spoken

BUCKET_MS = 900_000
#: Weights of the model: a pause of one second, one shared word in ten, a new turn; mean rows of a turn.
PAUSE, LEXICAL, OPEN, MEAN_ROWS = -0.4, 1.0, -0.7, 2.0
#: Longest turn that is scored as one segment; a longer one is a chain of such segments.
MAX_ROWS = 64

_DECODED = "recording string, _bucket bigint, seg_id bigint, speaker int, turn_score double"


def decode(
    named: list[frozenset[int]], gaps: np.ndarray, shared: np.ndarray, head: int | None, follows: bool = False
) -> tuple[list[int | None], list[float]]:
    """Best segmentation of rows into turns: the speaker of each row's segment and the row's part of the score.

    named: the speakers that each row's column and label name; gaps: seconds of pause before it; shared: the share of
    its words that the row before has; head: the speaker that reigns before the first row; follows: there is a row
    before the first, whose turn may go on. The parts of a segment's rows sum up to its score. A segment none of whose
    rows is named has no speaker, unless it goes on with the head's.
    """
    n = len(named)
    link = PAUSE * np.minimum(gaps, 10.0) + LEXICAL * shared  # of a row to the row before, inside a turn
    sums = [0.0, *np.cumsum(link).tolist()]
    going = math.log(1 - 1 / MEAN_ROWS)
    opening = OPEN + math.log(1 / MEAN_ROWS)
    everyone = sorted(frozenset().union(*named) | ({head} - {None}))
    # best[j]: by the speaker of the segment that ends before row j, (score, where it begins, the speaker before).
    best: list[dict[int | None, tuple[float, int, int | None]]] = [{head: (0.0, 0, None)}]
    top: list[int | None] = [head]
    first: dict[int | None, float] = {}

    def start(s: int | None) -> float:
        """The first row opens a turn, or goes on with the one before where it must, or may and that is better."""
        if s not in first:
            may = follows and n > 0 and s == head
            first[s] = link[0] + going if may and (not named[0] or link[0] + going > opening) else opening
        return first[s]

    for j in range(1, n + 1):
        now: dict[int | None, tuple[float, int, int | None]] = {}
        for s in named[j - 1] or [None, *everyone]:
            seen = False
            for i in range(j - 1, max(-1, j - 1 - MAX_ROWS), -1):  # a turn of rows i..j-1
                if named[i] and s not in named[i]:
                    break
                seen = seen or bool(named[i])
                inside = sums[j] - sums[i + 1] + (j - 1 - i) * going
                if not i:
                    goes_on = follows and s == head
                    if not seen and s is not None and not goes_on or follows and not named[0] and head is not None and not goes_on:
                        continue  # a speaker needs a name, and a row without one goes on
                    v, before = start(s) + inside, None
                elif named[i]:
                    before = top[i]
                    v = best[i][before][0] + opening + inside
                elif j - i == MAX_ROWS and s in best[i]:  # a chain of segments goes on without a name
                    v, before = best[i][s][0] + opening + inside, s
                else:
                    continue
                if s not in now or v > now[s][0]:
                    now[s] = (v, i, before)
        best.append(now)
        top.append(max(now, key=lambda s: (now[s][0], s is None, -(s or 0))))
    speaker: list[int | None] = [None] * n
    part = [0.0] * n
    j, s = n, top[n]
    while j:  # the segments of the best path, from the last
        _, i, before = best[j][s]
        speaker[i:j] = [s] * (j - i)
        part[i:j] = [opening if i else start(s), *(float(x + going) for x in link[i + 1 : j])]
        j, s = i, before
    return speaker, part


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by recording, bucket and order of start; a bucket may span batches of Arrow."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        named = [frozenset(int(x) for x in pair if not pd.isna(x)) for pair in zip(g["column"], g["label"])]
        head = g["head"].iloc[0]
        speakers, score = decode(named, g["gap"].to_numpy(float), g["shared"].to_numpy(float), None if pd.isna(head) else int(head), bool(g["follows"].iloc[0]))
        return pd.DataFrame({
            "recording": g["recording"].to_numpy(), "_bucket": g["_bucket"].to_numpy(), "seg_id": g["seg_id"].to_numpy(),
            "speaker": pd.array(speakers, dtype="Int32"), "turn_score": score,
        })

    held: pd.DataFrame | None = None
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        if b.empty:
            continue
        key = (b["recording"].fillna("\0").ne(b["recording"].fillna("\0").shift()) | b["_bucket"].ne(b["_bucket"].shift())).cumsum()
        last = key.iloc[-1]
        done = [run(g) for k, g in b[key != last].groupby(key[key != last], sort=False)]
        held = b[key == last]
        if done:
            yield pd.concat(done, ignore_index=True)
    if held is not None and len(held):
        yield run(held)


def rows_with_speakers(segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """recording, seg_id, start_ms, end_ms, speaker, said, flags, turn_score: every row once, with its speaker."""
    rows = segments.select("seg_id", "recording", "start_s", "end_s", "speaker", "text", "flags")
    rows = deliveries_once(rows, "seg_id")
    rows = rows.select(
        "recording", "seg_id", "flags",
        F.coalesce(millis("start_s"), clock_ms(F.col("text"))).alias("start_ms"),
        millis("end_s").alias("end_ms"),
        F.col("speaker").alias("column"),
        label_number(F.col("text")).alias("label"),
        spoken(F.col("text")).alias("said"),
    )
    bag = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("said", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    rows = written(bucketed(rows, "start_ms", bucket_ms).withColumn("bag", bag), "parsed-rows")  # texts are parsed once
    keys, at = ["recording"], F.struct("start_ms", "seg_id")
    sure = F.when(F.col("column").isNull() | F.col("label").isNull() | (F.col("column") == F.col("label")), F.coalesce("column", "label"))
    last = F.max_by(sure, F.when(sure.isNotNull(), at))
    rows = carry(rows, keys, {"head": (last, "last"), "before": (F.max_by(F.struct("end_ms", "bag"), at), "last")})
    slim = rows.select("recording", BUCKET, "seg_id", "start_ms", "end_ms", "column", "label", "head", "bag", "before").repartition("recording", BUCKET)
    slim = slim.withColumn("_p", F.coalesce(F.lag(F.struct("end_ms", "bag")).over(local(keys, "start_ms", "seg_id")), "before"))
    pause = F.col("start_ms") - F.col("_p.end_ms")
    gap = F.when(pause > 0, pause / 1000.0).otherwise(0.0)
    shared = F.when(F.col("_p").isNull(), 0.0).otherwise(F.size(F.array_intersect("_p.bag", "bag")) / F.greatest(F.size("bag"), F.lit(1)))
    slim = slim.select("recording", BUCKET, "seg_id", "start_ms", "column", "label", "head", gap.alias("gap"), shared.alias("shared"), F.col("before").isNotNull().alias("follows"))
    slim = slim.sortWithinPartitions("recording", BUCKET, "start_ms", "seg_id")
    decoded = slim.mapInPandas(_decode_batches, _DECODED).drop(BUCKET, "recording")
    return rows.drop("column", "label", "head", "bag", "before").join(decoded, "seg_id")


def clean_turns(segments: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """recording, speaker, start_ms, end_ms, text, flags, first_seg_id, last_seg_id, n_rows, score: one row a turn.

    Rows are taken in order of start (the column's, else the time in the text), then of seg_id. Text is what is
    spoken, joined in order; flags are the sorted union; the score is the sum of its rows' parts.

    Defined cases: a row with neither speaker nor label goes on with the row before; before the first label it joins
    the first labelled turn if pauses and words speak for that, else its speaker is null; where column and label are at
    odds the better segmentation decides, and the smaller number where both are as good; null and empty texts and rows
    of sound notes or hesitations alone are dropped, but their labels hold for
    the rows after them; rows without any time come first; a null recording is a recording of its own; re-delivered
    rows count once; an empty table gives no turns; other columns are ignored.
    """
    rows = written(rows_with_speakers(segments, bucket_ms).where(has_words(F.col("said"))), "rows-with-speakers")
    keys, order = ["recording"], ["start_ms", "seg_id"]
    w = local(keys, *order)
    rows = rows.withColumn("_p", F.lag(F.struct("speaker")).over(w))
    rows = carry(rows, keys, {"_q": (F.max_by(F.struct("speaker"), F.struct(*order)), "last")})
    rows = rows.withColumn("_p", F.coalesce("_p", "_q"))
    rows = rows.withColumn("_new", F.col("_p").isNull() | ~F.col("_p.speaker").eqNullSafe(F.col("speaker")))
    rows = rows.withColumn("_first", F.when(F.col("_new"), F.col("seg_id")))
    here = F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_here", here)
    rows = carry(rows, keys, {"_earlier": (F.max_by("_first", F.when(F.col("_first").isNotNull(), F.struct(*order))), "last")}, cut=True)
    rows = rows.withColumn("first_seg_id", F.coalesce("_here", "_earlier"))
    at = F.struct(F.coalesce("start_ms", F.lit(-1)), "seg_id")
    parts = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("said"))))
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("flags", F.array().cast("array<string>"))))))
    return rows.groupBy("recording", "speaker", "first_seg_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(parts, lambda p: p["said"]), " ").alias("text"),
        F.array_compact(flags).alias("flags"),
        F.max_by("seg_id", at).alias("last_seg_id"),
        F.count("*").alias("n_rows"),
        F.sum("turn_score").alias("score"),
    )
