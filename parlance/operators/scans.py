"""Window scans over groups of any size.

A plain ``Window.partitionBy(entity)`` puts a whole entity into one task; one recording may hold a third of all
rows. These scans cut each entity into buckets along its order, work inside the buckets, and carry a small summary
(one row a bucket) from bucket to bucket. The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BUCKET = "_bucket"


def bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    """Add the bucket of a whole-number order column. Rows without one go to bucket -1, which comes first, as
    nulls do in an ascending sort."""
    return df.withColumn(BUCKET, F.coalesce(F.floor(F.col(order) / F.lit(width)).cast("bigint"), F.lit(-(2**62)).cast("bigint")))


def local(keys: Sequence[str], *order: Column | str):
    """The window inside a bucket."""
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def carry(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[Column, str]], cut: bool = False) -> DataFrame:
    """Add, for each ``name: (aggregate of a bucket, how)``, its value over all earlier buckets of the entity.

    how: 'max', 'sum' or 'last' (the last that is not null), or 'next' (the first that is not null, over all later
    buckets). ``df`` has a bucket column; null keys are a group.
    ``df`` is read twice: where it is the work of further scans, ``cut`` writes it once, so that plans don't double.
    """
    if cut:
        df = written(df, "scan")
    summary = df.groupBy(*keys, BUCKET).agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    w = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    over = {
        "max": lambda c: F.max(c).over(w),
        "sum": lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)),
        "last": lambda c: F.last(c, ignorenulls=True).over(w),
        "next": lambda c: F.first(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)),
    }
    summary = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, BUCKET])], *[over[how](F.col(n)).alias(n) for n, (_, how) in aggs.items()])
    on = None
    for i, k in enumerate([*keys, BUCKET]):
        c = df[k].eqNullSafe(summary[f"_k{i}"])
        on = c if on is None else on & c
    return df.join(summary, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
