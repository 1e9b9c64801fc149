"""Arrow-batched functions on columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def arrow(ddl: str) -> Callable:
    """Like ``pandas_udf``, but built on use: no session is needed when a module is imported, and the series passed
    to it are told by position, not by type hints."""

    def wrap(fn: Callable) -> Callable:
        fn.__annotations__ = {}

        def call(*cols):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # it would have type hints, which say nothing of any number of series
                return F.pandas_udf(fn, ddl, F.PandasUDFType.SCALAR)(*cols)

        call.__name__ = fn.__name__
        call.__doc__ = fn.__doc__
        call.batch, call.ddl = fn, ddl
        return call

    return wrap


def by_row(ddl: str, columns: list[str] | None = None) -> Callable:
    """An Arrow-batched function from a function of one row's values. With ``columns``, it returns tuples."""

    def wrap(fn: Callable) -> Callable:
        import pandas as pd

        def batch(*series):
            rows = [fn(*x) for x in zip(*series)]
            return pd.DataFrame(rows, columns=columns) if columns else pd.Series(rows, dtype=object)

        out = arrow(ddl)(batch)
        out.__name__, out.__doc__ = fn.__name__, fn.__doc__
        batch.__annotations__ = {}
        out.plain = fn
        return out

    return wrap


def register(spark: SparkSession) -> list[str]:
    """Make the functions of texts callable from SQL; their names."""
    from . import loops, text

    named = {
        "normalize_words": loops.normalize_words_udf, "periodic_suffix": loops.periodic_suffix_udf, "repeated_run": loops.repeated_run_udf, "compression_ratio": loops.compression_ratio_udf,
        "measure_text": loops.measures_udf, "collapse_loops": loops.collapse_udf, "clock_time": text.clock_udf,
        "read_style": text.read_style_udf, "french_numbers": text.french_numbers_udf, "french_typography": text.french_typography_udf, "json_text": text.json_text_udf,
    }
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, fn in named.items():
            spark.udf.register(name, F.pandas_udf(fn.batch, fn.ddl, F.PandasUDFType.SCALAR))
    return sorted(named)
