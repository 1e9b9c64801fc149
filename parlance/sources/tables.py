"""Parquet tables and the columns every operator derives from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def read(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table of ``folder``; only ``columns`` reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def millis(seconds: Column | str) -> Column:
    """Seconds as whole milliseconds, rounded to the nearest. NaN and infinities become null."""
    x = F.col(seconds) if isinstance(seconds, str) else seconds
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(9.0e12))
    return F.when(finite, F.floor(x * F.lit(1000.0) + F.lit(0.5)).cast("bigint"))


def deliveries_once(df: DataFrame, *keys: str) -> DataFrame:
    """Re-delivered rows equal their first delivery but for ``received_at``: keep one row a key."""
    rest = [c for c in df.columns if c not in keys and c != "received_at"]
    return spread(df, *keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest])
