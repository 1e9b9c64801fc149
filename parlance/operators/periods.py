"""Continuous periods of speech and the gaps between them (gaps and islands), for entities of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import millis
from .scans import BUCKET, bucketed, carry, local

#: Width of a bucket of an entity's time line, in milliseconds.
BUCKET_MS = 900_000


def valid_turns(turns: DataFrame) -> DataFrame:
    """recording, speaker, from_ms, to_ms of turns with start, end and speaker whose end is later than the start."""
    return (
        turns.select("recording", "speaker", millis("start_s").alias("from_ms"), millis("end_s").alias("to_ms"))
        .where(F.col("speaker").isNotNull() & F.col("from_ms").isNotNull() & (F.col("to_ms") > F.col("from_ms")))
    )


def periods_and_gaps(turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """recording, speaker, kind ('period' or 'gap'), from_ms, to_ms.

    Each start is compared with the running maximum of the ends before it; a start later than that begins a period,
    and the stretch between the two is a gap. Touching turns join. Running maxima go through buckets of the time
    line, so an entity is never one task's work.

    Defined cases: a turn with a null (or NaN, infinite) start, end or speaker, and an empty or reversed turn, counts
    for nothing; a null recording is a recording of its own; repeated rows change nothing; an empty table gives no
    rows; other columns are ignored.
    """
    keys = ["recording", "speaker"]
    rows = bucketed(valid_turns(turns), "from_ms", bucket_ms)
    before = local(keys, "from_ms", "to_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.max("to_ms").over(before))
    rows = carry(rows, keys, {"_earlier": (F.max("to_ms"), "max")})
    rows = rows.withColumn("_reach", F.greatest("_here", "_earlier"))
    rows = rows.withColumn("_first", F.when(F.col("_reach").isNull() | (F.col("from_ms") > F.col("_reach")), F.col("from_ms")))
    upto = local(keys, "from_ms", "to_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.max("_first").over(upto))
    rows = carry(rows, keys, {"_before": (F.max("_first"), "max")})
    rows = rows.withColumn("_island", F.coalesce("_island", "_before"))
    # One aggregation gives both: a period by its island, and at the island's first row the reach before it.
    islands = rows.groupBy(*keys, "_island").agg(F.max("to_ms").alias("_end"), F.max(F.when(F.col("_first").isNotNull(), F.col("_reach"))).alias("_prev"))
    period = F.struct(F.lit("period").alias("kind"), F.col("_island").alias("from_ms"), F.col("_end").alias("to_ms"))
    gap = F.when(F.col("_prev").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("_prev").alias("from_ms"), F.col("_island").alias("to_ms")))
    return islands.select(*keys, F.explode(F.array_compact(F.array(period, gap))).alias("_r")).select(*keys, "_r.kind", "_r.from_ms", "_r.to_ms")
