"""Pairing each left row with the right interval nearest in time: a stateful streaming join.

Both sides are streams. A key of state is a recording's stretch of its time line, with all its speakers; right rows go to every stretch they
come near to, so a hot entity is spread over many keys. The state buffers the right intervals and those left rows
that no interval covers so far (a covered row is settled at once: its distance is zero). A left row is emitted once
the watermark passes its tolerance horizon; right rows are evicted once the watermark passes theirs.

The event time of the watermark is the arrival of a row, for times within a recording tell nothing of other
recordings. Rows may arrive ``lateness`` after each other and still meet. A bounded replay reads stored tables in order
of arrival, a part after the other: the watermark moves, rows are emitted and the state shrinks as it goes. It measures
first how late rows of a recording come after each other, so none is lost, and ends with a marker row that carries the
watermark past all horizons, so nothing stays in the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scans import bucketed, carry, local
from ..session import scratch
from ..sources.tables import millis

TOLERANCE_MS = 1_200
STRETCH_MS = 900_000
#: Stretches of an interval, at most; of a longer one only the first and the last half as many are told. Words between
#: them are settled by a scan of their own.
MOST_STRETCHES = 96
LATENESS = "14 days"
#: Parts of a bounded replay.
PARTS = 4

_STATE = "left_rows binary, right_rows binary"
_OUT = "word_id bigint, turn_id bigint, distance_ms double"
_WORDS = "word_id bigint, recording string, start_s double, end_s double, speaker int, received_at timestamp"
_TURNS = "turn_id bigint, recording string, start_s double, end_s double, speaker int, received_at timestamp"
#: The arrival of a row whose arrival is not known: the day after the epoch, at which no first batch takes it for late.
_UNKNOWN_MS = 86_400_000
_END, _END_KEY = datetime(2200, 1, 1), "\x00end"
_FAR = np.int64(2**62)


def nearest(mid2: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each middle (in half milliseconds) the least distance to an interval, and the smallest id at it.

    Distances are in half milliseconds, zero inside (edges included); without intervals they are -1, ids 0.
    """
    if not len(ids):
        return np.full(len(mid2), -1, dtype=np.int64), np.zeros(len(mid2), dtype=np.int64)
    order = np.lexsort((ids, hi2, lo2))
    lo, hi, own = lo2[order], hi2[order], ids[order]
    # The furthest end among the intervals that begin no later, and the smallest id of such an end.
    reach, who = hi.copy(), own.copy()
    for k in range(1, len(lo)):
        if reach[k - 1] > reach[k]:
            reach[k], who[k] = reach[k - 1], who[k - 1]
        elif reach[k - 1] == reach[k] and who[k - 1] < who[k]:
            who[k] = who[k - 1]
    at = np.searchsorted(lo, mid2, side="right")
    far = np.int64(2**62)
    has_l, has_r = at > 0, at < len(lo)
    left = np.where(has_l, np.maximum(mid2 - reach[np.maximum(at - 1, 0)], 0), far)
    nxt = np.minimum(at, len(lo) - 1)
    right = np.where(has_r, lo[nxt] - mid2, far)
    starts, first = np.unique(lo, return_index=True)
    least = np.minimum.reduceat(own, first)
    right_id = least[np.searchsorted(starts, lo[nxt])]
    left_id = who[np.maximum(at - 1, 0)]
    dist = np.minimum(left, right)
    ids_out = np.where(left < right, left_id, np.where(right < left, right_id, np.minimum(left_id, right_id)))
    return dist, ids_out


def _join(tolerance_ms: int, stretch_ms: int):
    from_bytes = lambda b, n: np.frombuffer(b, dtype=np.int64).reshape(-1, n)
    rows = lambda q, *c: np.column_stack([q[x].to_numpy(dtype=np.int64) for x in c])
    apart = 4 * (stretch_ms + 2 * tolerance_ms + 4)  # times are told from the stretch's begin and end near its end

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Left rows: id, time, arrival, speaker, the least distance so far and whose it is. Right: id, from, to, arrival, speaker.
        left, right = np.zeros((0, 6), dtype=np.int64), np.zeros((0, 5), dtype=np.int64)
        if state.exists:
            a, b = state.get
            left, right = from_bytes(a, 6), from_bytes(b, 5)
        if not state.hasTimedOut:
            for p in batches:
                side = p["side"].to_numpy()
                new = rows(p[side == 0], "id", "lo2", "seen", "speaker")
                left = np.vstack([left, np.column_stack([new, np.full(len(new), _FAR), np.full(len(new), _FAR)])])
                right = np.vstack([right, rows(p[side == 1], "id", "lo2", "hi2", "seen", "speaker")])
        mark = state.getCurrentWatermarkMs()
        # Speakers stand so far apart on one line that none is near another.
        codes = np.unique(np.concatenate([left[:, 3], right[:, 4]]), return_inverse=True)[1].reshape(-1) * apart
        own = codes[len(left) :]
        dist, who = nearest(left[:, 1] + codes[: len(left)], right[:, 1] + own, right[:, 2] + own, right[:, 0])
        # A right row may leave before a left row does: what was nearest so far stands with the left row.
        dist = np.where(dist < 0, _FAR, dist)
        nearer = (dist < left[:, 4]) | ((dist == left[:, 4]) & (who < left[:, 5]))
        left = np.column_stack([left[:, :4], np.where(nearer, dist, left[:, 4]), np.where(nearer, who, left[:, 5])])
        open_ = left[:, 4] != 0  # a covered row is settled
        ripe = left[:, 2] + tolerance_ms <= mark
        out = left[ripe & open_]
        if len(out):
            near = out[:, 4] <= 2 * tolerance_ms
            yield pd.DataFrame({
                "word_id": out[:, 0],
                "turn_id": pd.Series(out[:, 5], dtype="Int64").where(pd.Series(near)),
                "distance_ms": np.where(near, out[:, 4] / 2.0, np.nan),
            })
        left = left[~ripe & open_]
        right = right[right[:, 3] + tolerance_ms > mark]
        if not len(left) and not len(right):
            if state.exists:
                state.remove()
            return
        state.update((left.tobytes(), right.tobytes()))
        state.setTimeoutTimestamp(max(mark + 1, int(min(left[:, 2].min(initial=2**62), right[:, 3].min(initial=2**62))) + tolerance_ms))

    return step


def _stretches(lo: Column, hi: Column) -> Column:
    half = MOST_STRETCHES // 2
    return F.when(hi - lo < MOST_STRETCHES, F.sequence(lo, hi)).otherwise(F.concat(F.sequence(lo, lo + (half - 1)), F.sequence(hi - (half - 1), hi)))


def nearest_time_stream(left: DataFrame, right: DataFrame, tolerance_ms: int = TOLERANCE_MS, lateness: str = LATENESS, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """The streaming join of two streams shaped as ``words`` and ``turns``: word_id, turn_id, distance_ms.

    One row for each left row with start, end and speaker that no valid right interval of its recording and speaker
    covers; turn_id is the nearest within the tolerance (the smallest id on a tie), null where none is that near. An
    interval of more than MOST_STRETCHES stretches covers only those at its ends here; ``nearest_time`` does the rest.
    """
    mid2 = millis("start_s") + millis("end_s")
    known = F.col("speaker").isNotNull() & F.col("recording").isNotNull()
    seen = F.coalesce(F.unix_millis(F.col("received_at").cast("timestamp")), F.lit(_UNKNOWN_MS))
    arrival = F.coalesce(F.col("received_at").cast("timestamp"), F.timestamp_millis(F.lit(_UNKNOWN_MS)))
    # A row's times are told from the begin of its stretch. What lies beyond the tolerance of the stretch is all the same.
    begin2 = F.col("stretch") * (2 * stretch_ms)
    inside = lambda x: F.least(F.greatest(x - begin2, F.lit(-2 * tolerance_ms - 2)), F.lit(2 * (stretch_ms + tolerance_ms) + 2)).cast("bigint")
    columns = ["recording", "speaker", "stretch", "side", "id", inside(F.col("lo2")).alias("lo2"), inside(F.col("hi2")).alias("hi2"), "seen", "arrival"]
    lhs = left.where(known & mid2.isNotNull()).select(
        "recording", "speaker", F.lit(0).alias("side"), F.col("word_id").alias("id"), mid2.alias("lo2"), mid2.alias("hi2"), seen.alias("seen"), arrival.alias("arrival"),
    ).withColumn("stretch", F.floor(F.col("lo2") / (2 * stretch_ms))).select(*columns)
    a, b = millis("start_s"), millis("end_s")
    rhs = right.where(known & a.isNotNull() & (b > a)).select(
        "recording", "speaker", F.explode(_stretches(F.floor((a - tolerance_ms) / stretch_ms), F.floor((b + tolerance_ms) / stretch_ms))).alias("stretch"),
        F.lit(1).alias("side"), F.col("turn_id").alias("id"), (a * 2).alias("lo2"), (b * 2).alias("hi2"), seen.alias("seen"), arrival.alias("arrival"),
    ).select(*columns)
    both = lhs.unionByName(rhs).withWatermark("arrival", lateness)
    return both.groupBy("recording", "stretch").applyInPandasWithState(_join(tolerance_ms, stretch_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    names = [f.split(" ")[0] for f in ddl.split(", ")]
    return spark.read.parquet(path).select(*[F.col(n).cast(f.split(" ")[1]) for n, f in zip(names, ddl.split(", "))])


def _within_long(words: DataFrame, turns: DataFrame, stretch_ms: int) -> DataFrame:
    """word_id of the words whose middle lies in an interval of more than MOST_STRETCHES stretches."""
    a, b = millis("start_s"), millis("end_s")
    keys = ["recording", "speaker"]
    long = turns.where(F.col("recording").isNotNull() & F.col("speaker").isNotNull() & (b - a > (MOST_STRETCHES - 4) * stretch_ms)).select(*keys, (a * 2).alias("x"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("word_id"), (b * 2).alias("to2"))
    mids = words.where((a + b).isNotNull()).select(*keys, (a + b).alias("x"), F.lit(1).alias("side"), "word_id", F.lit(None).cast("bigint").alias("to2")).join(long.select(*keys).distinct(), keys, "left_semi")
    line = bucketed(long.unionByName(mids), "x", 2 * MOST_STRETCHES * stretch_ms)
    w = local(keys, "x", "side", "word_id").rowsBetween(Window.unboundedPreceding, 0)
    line = carry(line.withColumn("_here", F.max("to2").over(w)), keys, {"_earlier": (F.max("to2"), "max")}, cut=True)
    return line.where((F.col("side") == 1) & (F.greatest("_here", "_earlier") >= F.col("x"))).select("word_id").distinct()


def nearest_time(
    spark: SparkSession, words_path: str, turns_path: str, tolerance_ms: int = TOLERANCE_MS, parts: int = PARTS, stretch_ms: int = STRETCH_MS, progress: list | None = None
) -> DataFrame:
    """Bounded replay of two stored tables through the streaming join: word_id, turn_id, distance_ms.

    The tables are replayed in ``parts`` of their time of arrival; ``progress`` takes what the stream reports of each.

    Defined cases: rows with a null in time, speaker or recording, and empty or reversed intervals, take no part;
    re-delivered rows count once; ties give the smallest turn_id; empty tables give no rows; a word without any turn
    of its speaker is reported with null; other columns are not read. If the arrival of any row is not known, all is
    replayed as one part, in which nothing is late.
    """
    words, turns = _rows(spark, words_path, _WORDS), _rows(spark, turns_path, _TURNS)
    at = F.unix_millis("received_at").alias("at")
    arrivals = words.select("recording", at).unionByName(turns.select("recording", at))
    per = arrivals.groupBy("recording").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_if(F.col("at").isNull()).alias("unknown"))
    late, unknown = per.agg(F.max(F.col("hi") - F.col("lo")), F.sum("unknown")).first()
    edges = [] if unknown or late is None else arrivals.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    edges = sorted(set(edges))
    folders = {n: scratch(spark, n) for n in ("arriving-words", "arriving-turns")}
    out, checkpoint = scratch(spark, "nearest"), scratch(spark, "nearest-state")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(len(edges) + 1):
            # Parts of arrival, in milliseconds: bounds on the stored column itself, so that the scan skips what is not of the part.
            ge = [F.col("received_at") >= F.timestamp_millis(F.lit(edges[k - 1]))] if k else []
            lt = [F.col("received_at") < F.timestamp_millis(F.lit(edges[k]))] if k < len(edges) else []
            for rows, folder, ident in ((words, folders["arriving-words"], "word_id"), (turns, folders["arriving-turns"], "turn_id")):
                for c in ge + lt:
                    rows = rows.where(c)
                if k == len(edges):  # a marker after all rows; no valid row, but it moves the watermark
                    end = spark.createDataFrame([(0, _END_KEY, 0.0, 1.0, 1, _END)], rows.schema)
                    rows = rows.unionByName(end)
                rows.write.mode("append").parquet(folder)
            streams = [spark.readStream.schema(ddl).parquet(folder) for ddl, folder in ((_WORDS, folders["arriving-words"]), (_TURNS, folders["arriving-turns"]))]
            query = (
                nearest_time_stream(*streams, tolerance_ms, f"{(late or 0) // 1000 + 1} seconds", stretch_ms)
                .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            if progress is not None:
                progress.append(query.recentProgress)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    got = spark.read.schema(_OUT).parquet(out).where(F.col("word_id").isNotNull()).distinct()
    longest = turns.agg(F.max(millis("end_s") - millis("start_s"))).first()[0]
    if (longest or 0) > (MOST_STRETCHES - 4) * stretch_ms:
        got = got.join(_within_long(words, turns, stretch_ms), "word_id", "left_anti")
    return got
